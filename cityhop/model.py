"""The network: one DataFrame per GTFS table, all feeds unioned by ``feed_id``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Network:
    feeds: DataFrame  # feed_id, feed_priority, feed_kind, timezone  (one row per feed: bounded)
    stops: DataFrame  # feed_id, stop_id, stop_name, stop_lat, stop_lon, stop_timezone, parent_station
    stop_times: DataFrame  # feed_id, trip_id, stop_id, stop_sequence, departure_s
    trips: DataFrame  # feed_id, trip_id, service_id, route_id
    calendar: DataFrame  # feed_id, service_id, days ARRAY<INT>(Mon..Sun), start_date, end_date
    calendar_dates: DataFrame  # feed_id, service_id, date, exception_type
    files: DataFrame | None = None  # feed_id, file: which tables each feed has; None = not known
    days: DataFrame | None = None  # running days as bit masks (operators.service.running_days), if they are stored
    hubs: DataFrame | None = None  # feed_id, stop_id, slices: stops with very many stop times (operators.calls), if there are any

    def feed_info(self) -> DataFrame:
        """Feeds table for joining.  Its size is the number of declared feeds
        (a handful, bounded by configuration), so broadcasting it is safe."""
        return F.broadcast(self.feeds.select("feed_id", "feed_priority", "feed_kind", "timezone"))

    def stops_with_kind(self) -> DataFrame:
        """Stops plus kind-derived flags.

        * ``boardable``: the row can be a departure (STATION feeds: platforms only).
        * ``area_id``: what an answer reports (STATION: the parent station).
        * ``stop_timezone`` defaulted to the feed zone when missing or blank.
        """
        f = self.feed_info()
        s = self.stops.join(f, "feed_id")
        station = F.col("feed_kind") == F.lit("STATION")
        return s.select(
            "feed_id",
            "stop_id",
            "stop_name",
            "stop_lat",
            "stop_lon",
            F.coalesce(F.nullif(F.trim("stop_timezone"), F.lit("")), F.col("timezone")).alias("stop_timezone"),
            "parent_station",
            "feed_kind",
            "feed_priority",
            "timezone",
            (~station | F.col("parent_station").isNotNull()).alias("boardable"),
            F.when(station, F.col("parent_station")).otherwise(F.col("stop_id")).alias("area_id"),
        )

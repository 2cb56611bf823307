"""Stop activity per feed (O6: A4, A5, J14) and the cross-feed stop ranking (O7: A6, W1, W2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stop_activity(net) -> DataFrame:
    """Every stop (STATION feeds: every station) with the number of
    stop_times rows calling there (NULL when never served).

    STATION feeds roll platform counts up to their parent station.
    Output: feed_id, stop_id, stop_name, stop_lat, stop_lon, stop_timezone,
    number_of_appearance.
    """
    stops = net.stops_with_kind()
    counts = net.stop_times.where(F.col("trip_id").isNotNull()).groupBy("feed_id", "stop_id").agg(
        F.count("*").alias("n")
    )
    flat = (
        stops.where(F.col("feed_kind") != "STATION")
        .join(counts, ["feed_id", "stop_id"], "left")
        .select("feed_id", "stop_id", "stop_name", "stop_lat", "stop_lon", "stop_timezone", F.col("n").alias("number_of_appearance"))
    )
    st_stops = stops.where(F.col("feed_kind") == "STATION")
    rolled = (
        counts.join(st_stops.where(F.col("parent_station").isNotNull()).select("feed_id", "stop_id", "parent_station"), ["feed_id", "stop_id"])
        .groupBy("feed_id", F.col("parent_station").alias("stop_id"))
        .agg(F.sum("n").alias("number_of_appearance"))
    )
    stations = (
        st_stops.where(F.col("parent_station").isNull())
        .join(rolled, ["feed_id", "stop_id"], "left")
        .select("feed_id", "stop_id", "stop_name", "stop_lat", "stop_lon", "stop_timezone", "number_of_appearance")
    )
    return flat.unionByName(stations)


def ranked_stops(net) -> DataFrame:
    """One row per distinct stop name, the busiest stop carrying it.

    * A6: appearances are summed over every feed sharing a stop_id (stop ids
      of all feeds share one namespace here, as in the city build).
    * W1: the stop's attributes come from the highest-priority feed.
    * W2: per stop name, keep the stop with most appearances (tie: stop_id).

    Both "keep first" steps are ``min(struct(...))`` aggregates, so a hot
    key is combined map-side instead of sorted in one task.
    Output: stop_id, stop_name, stop_lat, stop_lon, feed_id, number_of_appearance.
    """
    act = stop_activity(net).join(net.feed_info().select("feed_id", "feed_priority"), "feed_id")
    per_id = act.groupBy("stop_id").agg(
        F.sum(F.coalesce(F.col("number_of_appearance"), F.lit(0))).cast("long").alias("total"),
        F.min(F.struct("feed_priority", "feed_id", "stop_name", "stop_lat", "stop_lon")).alias("first"),
    )
    named = per_id.select(
        "stop_id", "total", F.col("first.feed_id").alias("feed_id"), F.col("first.stop_name").alias("stop_name"),
        F.col("first.stop_lat").alias("stop_lat"), F.col("first.stop_lon").alias("stop_lon"),
    )
    best = named.groupBy("stop_name").agg(
        F.min(F.struct((-F.col("total")).alias("neg"), "stop_id", "stop_lat", "stop_lon", "feed_id")).alias("b")
    )
    return best.select(
        F.col("b.stop_id").alias("stop_id"),
        "stop_name",
        F.col("b.stop_lat").alias("stop_lat"),
        F.col("b.stop_lon").alias("stop_lon"),
        F.col("b.feed_id").alias("feed_id"),
        (-F.col("b.neg")).alias("number_of_appearance"),
    )

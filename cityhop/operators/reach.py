"""Direct reachability from a place (O1 trips_nearby, O2 trips_in_period, O3 reachable_stops).

All operators are batched: ``requests`` has one row per question
(query_id, lat, lon, max_distance[, start_date, end_date, transports]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityhop.operators.calls import calls_at
from cityhop.operators.service import may_run, running_rows
from cityhop.operators.spatial import DEFAULT_CELL_DEG, DEFAULT_MARGIN, nearby_stops
from cityhop.session import materialize

BOARD_COLS = ["query_id", "feed_id", "trip_id", "board_stop_id", "board_sequence", "board_departure_s"]


def _hits(net, near: DataFrame, live: DataFrame | None) -> DataFrame:
    """Calls at the stops ``near``; with ``live`` (feed_id, trip_id) only those of its trips."""
    st = net.stop_times.select("feed_id", "trip_id", "stop_id", "stop_sequence", "departure_s")
    hits = calls_at(net, st, near.select("query_id", "feed_id", "stop_id").distinct())
    return hits if live is None else hits.join(live, ["feed_id", "trip_id"], "left_semi")


def _boardings(net, near: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """A1: first nearby stop of each trip (lowest stop_sequence), per request.

    ``min(struct(seq, dep, stop))`` is a partial aggregate: a trip visited
    by many requests, or a hub stop on many trips, is combined map-side
    before the shuffle, and the choice is deterministic on ties.
    """
    first = _hits(net, near, live).groupBy("query_id", "feed_id", "trip_id").agg(
        F.min(F.struct("stop_sequence", "departure_s", "stop_id")).alias("b")
    )
    return first.select(
        "query_id",
        "feed_id",
        "trip_id",
        F.col("b.stop_id").alias("board_stop_id"),
        F.col("b.stop_sequence").alias("board_sequence"),
        F.col("b.departure_s").alias("board_departure_s"),
    )


def _first_departures(net, near: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """A1 where only the departure counts: (query_id, feed_id, trip_id, board_departure_s) of :func:`_boardings`.

    Sequence and departure share one BIGINT, so the minimum is a hash aggregate; a missing number stands before all others, as in a struct.
    """
    hits = _hits(net, near, live)
    low, span = F.lit(-(1 << 31)).cast("long"), F.lit(1 << 32).cast("long")
    packed = F.coalesce(F.col("stop_sequence").cast("long"), low) * span + (F.coalesce(F.col("departure_s").cast("long"), low) - low)
    first = hits.groupBy("query_id", "feed_id", "trip_id").agg(F.min(packed).alias("_first"))
    departure = (F.pmod("_first", span) + low).cast("int")
    return first.select("query_id", "feed_id", "trip_id", F.nullif(departure, low.cast("int")).alias("board_departure_s"))


def trips_nearby(net, places: DataFrame, *, margin=DEFAULT_MARGIN, cell=DEFAULT_CELL_DEG, min_radius=0.0) -> DataFrame:
    """O1: every trip calling at a stop near the place, with its first such stop."""
    near = nearby_stops(net, places, margin=margin, cell=cell, min_radius=min_radius)
    return _boardings(net, near)


def _in_period(net, boards: DataFrame, requests: DataFrame, strict_weekday: bool) -> DataFrame:
    period = requests.select("query_id", "start_date", "end_date")
    trips = net.trips.select("feed_id", "trip_id", "service_id")
    kinds = net.feed_info().select("feed_id", "feed_kind")
    with_svc = boards.join(trips, ["feed_id", "trip_id"]).join(kinds, "feed_id").join(period, "query_id")
    return running_rows(net, with_svc, strict_weekday=strict_weekday)


def trips_in_period(
    net, requests: DataFrame, *, margin=DEFAULT_MARGIN, cell=DEFAULT_CELL_DEG, min_radius=0.0, strict_weekday=False
) -> DataFrame:
    """O2: trips of O1 whose service runs in [start_date, end_date]."""
    near = nearby_stops(net, requests, margin=margin, cell=cell, min_radius=min_radius)
    boards = _boardings(net, near, may_run(net, requests, any_long=not strict_weekday))
    return _in_period(net, boards, requests, strict_weekday).select(*BOARD_COLS, "service_id")


def reachable_stops(
    net,
    requests: DataFrame,
    *,
    margin=DEFAULT_MARGIN,
    cell=DEFAULT_CELL_DEG,
    min_radius=0.0,
    strict_weekday=False,
    near: DataFrame | None = None,
) -> DataFrame:
    """O3: stops reachable on one vehicle, no transfer, from the place in the period.

    A stop is reached when a running trip calls there after its first nearby
    stop.  STATION feeds answer with parent stations.  Stops (stations) of the
    departure area itself are excluded.  ``near``: the departure areas'
    stops (query_id, feed_id, stop_id, area_id) where they are known; no
    place is searched then.  Output: query_id, feed_id, stop_id,
    stop_name, stop_lat, stop_lon, stop_timezone.
    """
    if near is None:
        # searched once: boardings and the areas to leave out both read it
        near = nearby_stops(net, requests, margin=margin, cell=cell, min_radius=min_radius)
        near = materialize(near.select("query_id", "feed_id", "stop_id", "area_id"))
    boards = _first_departures(net, near, may_run(net, requests, any_long=not strict_weekday))
    active = _in_period(net, boards, requests, strict_weekday).select("query_id", "feed_id", "trip_id", "board_departure_s")
    st = net.stop_times.select("feed_id", "trip_id", "stop_id", "departure_s")
    reached = (
        st.join(active, ["feed_id", "trip_id"])
        .where(F.col("departure_s") > F.col("board_departure_s"))
        .select("query_id", "feed_id", "stop_id")
        .distinct()
    )
    stops = net.stops_with_kind()
    to_area = stops.where("boardable").select("feed_id", "stop_id", "area_id")
    reached_areas = reached.join(to_area, ["feed_id", "stop_id"]).select("query_id", "feed_id", "area_id").distinct()
    origin_areas = near.select("query_id", "feed_id", "area_id").distinct()
    dest = reached_areas.join(origin_areas, ["query_id", "feed_id", "area_id"], "left_anti")
    area_rows = stops.where((F.col("feed_kind") != "STATION") | F.col("parent_station").isNull()).select(
        "feed_id", F.col("stop_id").alias("area_id"), "stop_name", "stop_lat", "stop_lon", "stop_timezone"
    )
    return dest.join(area_rows, ["feed_id", "area_id"]).select(
        "query_id", "feed_id", F.col("area_id").alias("stop_id"), "stop_name", "stop_lat", "stop_lon", "stop_timezone"
    )

"""Destinations: which cities can be reached directly from a place (O11), and
the full city-to-city reachability table (O16).

Requests that snap to the same city with the same period and transports
share one computation: the plan runs O3 once per distinct departure key and
joins the answer back to the requests.  Stops and cities meet in the index of
:mod:`cityhop.operators.membership`; only points of requests are searched for
by distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityhop.operators.cities import snap_to_city
from cityhop.operators.membership import city_stops, matched_cities, near_stops
from cityhop.operators.reach import reachable_stops
from cityhop.operators.spatial import DEFAULT_CELL_DEG
from cityhop.plans.fanout import expand_to_requests
from cityhop.session import materialize

KEY_COLS = ["city_id", "start_date", "end_date", "transports"]
OUT_COLS = ["query_id", "city_id", "city_name", "stop_lat", "stop_lon", "max_distance", "transport"]


def reachable_cities(
    net,
    cities: DataFrame,
    requests: DataFrame,
    *,
    cell: float = DEFAULT_CELL_DEG,
    strict_weekday: bool = False,
    min_radius: float = 0.0,
    members: DataFrame | None = None,
) -> DataFrame:
    """For each request (query_id, lat, lon, start_date, end_date[,
    transports]) the cities reachable on one vehicle.

    The request point snaps to the nearest city within 0.1 degree; the
    departure area is that city's centre and radius.  Requests that snap to
    no city produce no rows (:func:`cityhop.plans.requests.answer_destinations` reports them).
    ``strict_weekday``: a long overlap of calendar and period does not count as running by itself.
    ``min_radius`` (degrees): least radius of a departure area; with 0, a city of one stop is never a departure.
    ``members``: the stored index of these cities (:func:`cityhop.operators.membership.city_stops` with the same
    ``min_radius``), which is built here where it is not given.
    Output: :data:`OUT_COLS`.
    """
    if "transports" not in requests.columns:
        requests = requests.withColumn("transports", F.lit(None).cast("array<string>"))
    snapped = snap_to_city(requests.select("query_id", "lat", "lon"), cities, cell=cell)
    req = requests.select("query_id", "start_date", "end_date", "transports").join(snapped.select("query_id", "city_id").hint("merge"), "query_id")
    return _answers(net, cities, req, members, cell=cell, strict_weekday=strict_weekday, min_radius=min_radius)


def _answers(net, cities: DataFrame, req: DataFrame, members: DataFrame | None, *, cell: float, strict_weekday: bool, min_radius: float) -> DataFrame:
    """O11 for requests that name their departure city: query_id, city_id, start_date, end_date, transports."""
    if members is None:
        members = materialize(city_stops(net, cities, min_radius=min_radius, cell=cell))
    # Plan boundaries (keyed requests, per-key answers): each is computed once
    # and the adaptive planner works on shallow plans.
    keyed = materialize(req.withColumn("key", F.sha2(F.to_json(F.struct(*KEY_COLS)), 256)))
    work = keyed.select(F.col("key").alias("query_id"), *KEY_COLS).dropDuplicates(["query_id"])
    dest = materialize(
        reachable_stops(net, work, strict_weekday=strict_weekday, near=near_stops(members, work)).select(F.col("query_id").alias("key"), "feed_id", "stop_id")
    )
    info = cities.select("city_id", "city_name", "stop_lat", "stop_lon", "max_distance")
    answers = materialize(matched_cities(members, dest).join(info, "city_id"))
    return expand_to_requests(keyed.select("query_id", "key"), answers).select(*OUT_COLS)


def reachability_matrix(
    net,
    cities: DataFrame,
    start_date,
    end_date,
    transports=None,
    *,
    cell: float = DEFAULT_CELL_DEG,
    strict_weekday: bool = False,
    min_radius: float = 0.0,
    members: DataFrame | None = None,
) -> DataFrame:
    """Every city as a departure -> (dep_city_id, city_id, ..., transport); options as in :func:`reachable_cities`.

    Departures are known cities, so nothing is searched by distance.  Cities with one and the same centre depart as the
    smallest of them, as a point there would.
    """
    t = F.array(*[F.lit(x) for x in transports]) if transports else F.lit(None).cast("array<string>")
    placed = cities.where(F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull()).select("city_id", "stop_lat", "stop_lon")
    first = placed.groupBy("stop_lat", "stop_lon").agg(F.min("city_id").alias("first"))
    req = placed.withColumnRenamed("city_id", "query_id").join(first, ["stop_lat", "stop_lon"]).select(
        "query_id",
        F.col("first").alias("city_id"),
        F.lit(start_date).cast("date").alias("start_date"),
        F.lit(end_date).cast("date").alias("end_date"),
        t.alias("transports"),
    )
    answers = _answers(net, cities, req, members, cell=cell, strict_weekday=strict_weekday, min_radius=min_radius)
    return answers.withColumnRenamed("query_id", "dep_city_id")

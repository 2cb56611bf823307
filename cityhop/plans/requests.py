"""Raw request batches: checked, answered, and what was refused beside the answers (F10 + O11 / O12).

Every request is in exactly one of the two results' query ids or was answered by no row: nothing vanishes unreported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cityhop.operators.quality import accepted, check_destination_requests, check_trip_requests, rejected
from cityhop.plans.destinations import reachable_cities
from cityhop.plans.journeys import search_trips
from cityhop.session import materialize


def answer_destinations(net, cities: DataFrame, raw: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(answers of O11, refused requests) of raw requests: query_id, lat, lon, start, end[, transports]."""
    checked = materialize(check_destination_requests(raw, cities))
    return reachable_cities(net, cities, accepted(checked), **options), rejected(checked)


def answer_trips(net, cities: DataFrame, raw: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(answers of O12, refused requests) of raw requests: query_id, dep_lat, dep_lon, arr_lat, arr_lon, start, end, dep_time[, transports]."""
    checked = materialize(check_trip_requests(raw, cities))
    return search_trips(net, cities, accepted(checked), **options), rejected(checked)

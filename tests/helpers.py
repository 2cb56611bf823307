"""Single-request wrappers over the batch operators, for golden tests."""

from __future__ import annotations

import datetime as dt
import os

from cityhop import schema
from cityhop.operators.reach import reachable_stops, trips_in_period, trips_nearby
from cityhop.operators.spatial import nearby_stops
from cityhop.operators.trips import direct_trips

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def place(spark, lat, lon, r=0.5, qid="q"):
    return spark.createDataFrame([(qid, float(lat), float(lon), float(r))], schema.PLACES)


def dest_request(spark, lat, lon, start, end, r=0.5, qid="q", transports=None):
    return spark.createDataFrame([(qid, float(lat), float(lon), float(r), d(start), d(end), transports)], schema.REQUESTS_DEST)


def trip_request(spark, dep, arr, start, end, hour, r=0.5, qid="q", transports=None):
    row = (qid, float(dep[0]), float(dep[1]), float(r), float(arr[0]), float(arr[1]), float(r), d(start), d(end), int(hour * 3600), transports)
    return spark.createDataFrame([row], schema.REQUESTS_TRIP)


def nearby(net, spark, lat, lon, r=0.5):
    return nearby_stops(net, place(spark, lat, lon, r)).collect()


def trips(net, spark, lat, lon, r=0.5):
    return trips_nearby(net, place(spark, lat, lon, r)).collect()


def trips_period(net, spark, lat, lon, start, end, r=0.5):
    return trips_in_period(net, dest_request(spark, lat, lon, start, end, r)).collect()


def destinations(net, spark, lat, lon, start, end, r=0.5):
    return reachable_stops(net, dest_request(spark, lat, lon, start, end, r)).collect()


def between(net, spark, dep, arr, start, end, hour, r=0.5):
    return direct_trips(net, trip_request(spark, dep, arr, start, end, hour, r)).collect()

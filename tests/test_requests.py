"""raw requests with defaults, both places, and what is refused; answers beside refusals; the streaming adapter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cityhop import schema
from cityhop.operators.quality import REQUEST_DEFAULTS, accepted, check_destination_requests, check_trip_requests, rejected
from cityhop.plans.destinations import reachable_cities
from cityhop.plans.requests import answer_destinations, answer_trips
from cityhop.streaming.requests import serve_destinations

RAW = "query_id string, dep_lat double, dep_lon double, arr_lat double, arr_lon double, start string, end string, dep_time string"


@pytest.fixture(scope="module")
def cities(spark, dates_net):
    """Every boardable stop as a city of its own, wide enough to be a departure."""
    rows = dates_net.stops_with_kind().where("boardable").select("stop_id", "stop_name", "stop_lat", "stop_lon").collect()
    return spark.createDataFrame([(r.stop_id, r.stop_name, r.stop_lat, r.stop_lon, 0.05, 1) for r in rows], schema.CITIES)


def test_faults_of_trip_requests(spark, cities):
    a, b = cities.orderBy("city_id").limit(2).collect()
    ok = [a.stop_lat, a.stop_lon, b.stop_lat, b.stop_lon]
    t0, t1 = "2024-07-01T10:00:00", "2024-07-03T09:00:00"
    rows = [
        ("ok", *ok, t0, t1, "07:45:30"),
        ("start", *ok, "2024-07-01", t1, "07:45:30"),
        ("end", *ok, t0, "soon", "x"),
        ("turned", *ok, t1, t0, None),
        ("same", *ok, t0, t0, None),
        ("clock", *ok, t0, t1, "7h"),
        ("far", *ok[:2], -80.0, 0.0, t0, t1, None),
        ("half", None, 1.0, *ok[2:], t0, t1, None),
        ("all defaults", None, None, None, None, None, None, None),
    ]
    checked = check_trip_requests(spark.createDataFrame(rows, RAW), cities)
    good = {r.query_id: r for r in accepted(checked).collect()}
    bad = {r.query_id: (r.field, r.raw, r.reason) for r in rejected(checked).collect()}
    assert set(good) | set(bad) == {r[0] for r in rows} and not set(good) & set(bad)
    assert (good["ok"].start_date, good["ok"].end_date, good["ok"].min_departure_s) == (dt.date(2024, 7, 1), dt.date(2024, 7, 3), 7 * 3600 + 45 * 60 + 30)
    assert (good["ok"].dep_city, good["ok"].arr_city) == (a.city_id, b.city_id) and good["same"].min_departure_s == 6 * 3600
    assert bad["start"] == ("start", "2024-07-01", "bad_time") and bad["end"] == ("end", "soon", "bad_time")
    assert bad["turned"] == ("end", f"{t1}..{t0}", "end_before_start") and bad["clock"] == ("dep_time", "7h", "bad_time")
    assert bad["far"] == ("arr_place", "-80.0,0.0", "unknown_place") and bad["half"][0] == "dep_place"
    paris = REQUEST_DEFAULTS
    near = cities.where((F.abs(F.col("stop_lat") - paris["lat"]) < 0.07) & (F.abs(F.col("stop_lon") - paris["lon"]) < 0.07)).count()
    assert ("all defaults" in good) == (near > 0)


def test_destination_requests_without_the_optional_columns(spark, cities):
    a = cities.orderBy("city_id").first()
    raw = spark.createDataFrame([("q", a.stop_lat, a.stop_lon), ("far", -80.0, 0.0)], "query_id string, lat double, lon double")
    checked = check_destination_requests(raw, cities)
    good = accepted(checked).collect()
    assert [(r.query_id, r.start_date, r.end_date, r.transports, r.city) for r in good] == [("q", dt.date(2024, 10, 10), dt.date(2024, 10, 11), None, a.city_id)]
    assert [tuple(r) for r in rejected(checked).collect()] == [("far", "place", "-80.0,0.0", "unknown_place")]


def test_no_request_vanishes(spark, dates_net, cities):
    places = cities.select("stop_lat", "stop_lon").collect()
    t0, t1 = "2024-06-28T00:00:00", "2024-07-05T00:00:00"
    raw = [(f"{i}-{j}", a.stop_lat, a.stop_lon, b.stop_lat, b.stop_lon, t0, t1, "00:00:00") for i, a in enumerate(places) for j, b in enumerate(places) if i != j]
    raw += [("far", -80.0, 0.0, 1.0, 1.0, t0, t1, None)]
    df = spark.createDataFrame(raw, RAW)
    trips, refused = answer_trips(dates_net, cities, df)
    assert trips.count() > 0 and [r.query_id for r in refused.collect()] == ["far"]
    answers, out = answer_destinations(dates_net, cities, df.select("query_id", F.col("dep_lat").alias("lat"), F.col("dep_lon").alias("lon"), "start", "end"))
    assert answers.count() > 0 and [r.query_id for r in out.collect()] == ["far"]


def test_a_stream_of_requests_gets_the_batch_answers(spark, dates_net, cities, tmp_path):
    req = cities.select(F.col("city_id").alias("query_id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"),
                        F.lit("2024-06-28").cast("date").alias("start_date"), F.lit("2024-07-05").cast("date").alias("end_date"))
    req.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "in"))
    query = serve_destinations(stream, dates_net, cities, str(tmp_path / "out"), str(tmp_path / "ckpt"), {"availableNow": True})
    query.awaitTermination()
    want = {tuple(r) for r in reachable_cities(dates_net, cities, req).collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch_id").collect()}
    assert got == want and want

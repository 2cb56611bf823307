"""Work that many requests, or many rows, share is done once: answers, running services, rows without faults."""

import dataclasses
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cityhop.model import Network
from cityhop.operators.quality import check_trip_requests
from cityhop.operators.reach import _in_period, trips_in_period
from cityhop.operators.service import active_services, may_run, running_days, running_rows
from cityhop.plans.benchmark_queries import placed_trips
from cityhop.plans.fanout import expand_to_requests
from cityhop.plans.journeys import ordered_trips
from cityhop.operators.trips import TRIP_COLUMNS
from cityhop.sources.gtfs import _table_rejects
from cityhop.sources.testbind import clock_of


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_fan_out_keeps_what_requests_bring(spark):
    keyed = spark.createDataFrame([(f"q{i}", f"k{i % 3}", i) for i in range(900)] + [("q0", "k0", 0)], "query_id string, key string, n int")
    answers = spark.createDataFrame([(f"k{i % 2}", i) for i in range(10)], "key string, v int")
    got = expand_to_requests(keyed, answers)
    assert got.columns == ["query_id", "n", "key", "v"]
    want = sorted((q.query_id, q.n, q.key, a.v) for q in keyed.collect() for a in answers.collect() if q.key == a.key)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_places_of_shared_answers(spark, tmp_path):
    """A request's places count its trips in order; one given twice has each trip twice, side by side."""
    fill = [c for c in TRIP_COLUMNS if c not in ("query_id", "trip_id", "dep_time", "arr_time")]
    rows = spark.createDataFrame([(f"k{i % 2}", f"t{i}", i * 7919 % 500, i) for i in range(400)], "query_id string, trip_id string, dep_time long, arr_time long")
    rows = rows.select("*", *[F.lit("x").alias(c) for c in fill])
    ordered_trips(rows, files=3).write.parquet(str(tmp_path / "trips"))
    requests = spark.createDataFrame([("a", "k0", 1), ("b", "k0", 2), ("c", "k1", 1), ("d", "none", 1)], "query_id string, key string, times long")
    got = placed_trips(spark.read.parquet(str(tmp_path / "trips")), requests).select("query_id", "place", "trip_id").collect()
    order = {k: [r.trip_id for r in sorted((r for r in rows.collect() if r.query_id == k), key=lambda r: (r.dep_time, r.arr_time))] for k in ("k0", "k1")}
    want = [("a", n + 1, t) for n, t in enumerate(order["k0"])] + [("c", n + 1, t) for n, t in enumerate(order["k1"])]
    want += [("b", 2 * n + c, t) for n, t in enumerate(order["k0"]) for c in (1, 2)]
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.fixture
def net(spark):
    cal = [("C", f"s{i}", [int((i >> b) & 1) for b in range(7)], day(i), day(i + i % 13)) for i in range(60)] + [("C", "s1", None, day(2), day(30))]
    cd = [("D", f"s{i}", day(i * 3 % 90), 1 + i % 2) for i in range(60)] + [("C", f"s{i}", day(i), 2) for i in range(0, 60, 3)]
    trips = [(f, f"t{i}", f"s{i % 70}", "r") for f in "CD" for i in range(140)] + [("C", "t5", "s5", "r"), ("C", "tn", None, "r")]
    net = Network(
        spark.createDataFrame([("C", 0, "CALENDAR", "UTC"), ("D", 1, "DATES", "UTC")], "feed_id string, feed_priority int, feed_kind string, timezone string"),
        spark.createDataFrame([(f, f"p{i}", f"p{i}", 0.01 * i, 0.0, None, None) for f in "CD" for i in range(4)],
                              "feed_id string, stop_id string, stop_name string, stop_lat double, stop_lon double, stop_timezone string, parent_station string"),
        spark.createDataFrame([(f, t, f"p{n}", n, 600 * n) for f, t, _, _ in trips[:-2] for n in range(4)],
                              "feed_id string, trip_id string, stop_id string, stop_sequence int, departure_s int"),
        spark.createDataFrame(trips, "feed_id string, trip_id string, service_id string, route_id string"),
        spark.createDataFrame(cal, "feed_id string, service_id string, days array<int>, start_date date, end_date date"),
        spark.createDataFrame(cd, "feed_id string, service_id string, date date, exception_type int"),
    )
    return dataclasses.replace(net, trips=net.trips.coalesce(1).cache(), days=running_days(net).coalesce(1).cache())


@pytest.mark.parametrize("strict", [False, True])
def test_running_rows_are_those_of_active_services(spark, net, strict):
    periods = spark.createDataFrame([("q0", day(3), day(5)), ("q1", day(10), day(16)), ("q2", day(50), day(70)), ("q3", day(9), day(8)), ("q4", day(0), day(400))],
                                    "query_id string, start_date date, end_date date")
    rows = net.trips.join(net.feed_info().select("feed_id", "feed_kind"), "feed_id").crossJoin(periods)
    svc = rows.select("query_id", "feed_id", "service_id", "feed_kind", "start_date", "end_date")
    want = rows.join(active_services(net, svc, strict_weekday=strict).select("query_id", "feed_id", "service_id"), ["query_id", "feed_id", "service_id"], "left_semi")
    got = running_rows(net, rows, strict_weekday=strict)
    cols = sorted(rows.columns)
    want = want.select(cols).collect()
    assert 0 < len(want) < 282 * 5
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want))
    # the first sieve loses none of them, and drops most of the others
    live = {tuple(r) for r in may_run(net, periods.where("query_id = 'q0'"), any_long=not strict).collect()}
    assert {(r.feed_id, r.trip_id) for r in want if r.query_id == "q0"} <= live and 0 < len(live) < 60


def test_boardings_are_computed_once(spark, net, tmp_path):
    """Stop times are read by one scan, and those of trips that do not run never reach the boardings."""
    for name in ("stop_times", "trips"):
        getattr(net, name).write.parquet(str(tmp_path / name))
    stored = Network(net.feeds, net.stops, spark.read.parquet(str(tmp_path / "stop_times")), spark.read.parquet(str(tmp_path / "trips")), net.calendar, net.calendar_dates, days=net.days)
    req = spark.createDataFrame([("q", 0.0, 0.0, 0.05, day(3), day(9))], "query_id string, lat double, lon double, max_distance double, start_date date, end_date date")
    found = trips_in_period(stored, req)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*stop_sequence", plan)) == 1
    assert found.count() > 0 and found.where("board_stop_id <> 'p0'").count() == 0
    boards = net.stop_times.where("stop_id = 'p0'").select(F.lit("q").alias("query_id"), "feed_id", "trip_id")
    assert found.count() == _in_period(net, boards, req, False).count()


def test_snapped_requests_are_not_broadcast(spark):
    cities = spark.createDataFrame([("c", "C", 1.0, 1.0, 0.1, 2)], "city_id string, city_name string, stop_lat double, stop_lon double, max_distance double, n_stops long")
    raw = spark.createDataFrame([(f"q{i}", 1.0, 1.01, 1.0, 0.99, None, None, None) for i in range(20)],
                                "query_id string, dep_lat double, dep_lon double, arr_lat double, arr_lon double, start string, end string, dep_time string")
    checked = check_trip_requests(raw, cities)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [query_id" not in plan and plan.count("SortMergeJoin [query_id") == 2
    assert checked.where("dep_city = 'c' and arr_city = 'c' and fault is null").count() == 20


def test_clock_text_and_faultless_rows(spark):
    seconds = spark.createDataFrame([(s,) for s in (None, 0, 59, 60, 3599, 3600, 90_061, 360_000, 2_000_000_000)], "s int")
    old = F.format_string("%d:%02d:%02d", F.floor(F.col("s") / 3600).cast("int"), (F.floor(F.col("s") / 60) % 60).cast("int"), (F.col("s") % 60).cast("int"))
    assert seconds.where(~clock_of(F.col("s")).eqNullSafe(old)).count() == 0
    clocks = ["1:02:03", " 25:00:00 ", "7h30", "1:2", "1:2:3:4", "::", "", None, "a:1:2", "1: 2:3"]
    raw = spark.createDataFrame([("F", "t", "s", "1", c) for c in clocks], "feed_id string, trip_id string, stop_id string, stop_sequence string, departure_time string")
    found = _table_rejects("stop_times", raw)
    assert sorted(r.raw for r in found.collect()) == sorted(["7h30", "1:2", "1:2:3:4", "::", "a:1:2"])
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("Generate") < plan.index("Filter")  # a row is looked at before its report is built

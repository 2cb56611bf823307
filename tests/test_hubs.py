"""J1 with a hub stop: same rows as the plain join, and no task that holds the hub."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from cityhop.model import Network
from cityhop.operators.calls import calls_at, hub_stops
from cityhop.operators.reach import _boardings, _first_departures


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, as with large sides, in 16 tasks that nothing merges or splits."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hub_is_dealt_to_tasks(shuffled):
    n = 120_000
    st = shuffled.range(n).select(
        F.lit("A").alias("feed_id"), F.concat(F.lit("t"), F.col("id")).alias("trip_id"), F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("s"), F.col("id") % 3001)).alias("stop_id")
    )
    near = st.select("feed_id", "stop_id").distinct().withColumn("query_id", F.lit("q"))
    hubs = hub_stops(st, hub_rows=300)
    assert [(r.stop_id, r.slices) for r in hubs.collect()] == [("hub", n // 2 // 300)]
    net = Network(None, None, st, None, None, None, hubs=hubs)
    plain = Network(None, None, st, None, None, None)
    sizes = {k: [r["count"] for r in calls_at(v, st, near).groupBy(F.spark_partition_id()).count().collect()] for k, v in (("dealt", net), ("plain", plain))}
    assert sum(sizes["dealt"]) == sum(sizes["plain"]) == n
    assert max(sizes["plain"]) > 5 * median(sizes["plain"])
    assert max(sizes["dealt"]) < 2 * median(sizes["dealt"])
    assert calls_at(net, st, near).exceptAll(calls_at(plain, st, near)).count() == 0


def test_no_hub_without_many_rows(spark):
    st = spark.createDataFrame([("A", f"t{i}", f"s{i % 3}") for i in range(30)], "feed_id string, trip_id string, stop_id string")
    assert hub_stops(st).count() == 0 and hub_stops(st.limit(0)).count() == 0


def test_packed_minimum_equals_struct(spark):
    seqs, deps = [None, 0, 1, 2**31 - 1, -5], [None, 0, 86_400, 2**31 - 1, -1]
    rows = [("A", f"t{i % 4}", "s", s, d) for i, (s, d) in enumerate((s, d) for s in seqs for d in deps)]
    st = spark.createDataFrame(rows, "feed_id string, trip_id string, stop_id string, stop_sequence int, departure_s int")
    net = Network(None, None, st, None, None, None)
    for cut in (st, st.where("stop_sequence is not null"), st.where("stop_sequence > 0")):
        net = Network(None, None, cut, None, None, None)
        near = cut.select(F.lit("q").alias("query_id"), "feed_id", "stop_id").distinct()
        cols = ["query_id", "feed_id", "trip_id", "board_departure_s"]
        plan = _first_departures(net, near)
        assert sorted(plan.collect()) == sorted(_boardings(net, near).select(cols).collect(), key=lambda r: r.trip_id)
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()

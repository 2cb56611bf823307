"""Calls of trips at given stops (J1), with hub stops dealt to several tasks.

A hub can hold a large share of all stop times, and a join on the stop would put them into one task.  The stops with more
than :data:`HUB_ROWS` stop times are counted when the network is stored; at these, stop times are dealt by trip to slices
and the other side's row is repeated once per slice.  Every other stop keeps one slice and is joined as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop times of one slice of a hub.
HUB_ROWS = 1 << 16
#: No more stops than this are hubs, so their table may be broadcast.
MAX_HUBS = 10_000

STOP = ["feed_id", "stop_id"]


def hub_stops(stop_times: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(feed_id, stop_id, slices) of the stops with more than ``hub_rows`` stop times, and more than one in
    :data:`MAX_HUBS` of all stop times; so there are fewer than MAX_HUBS of them."""
    degree = stop_times.where(F.col("stop_id").isNotNull()).groupBy(*STOP).agg(F.count("*").alias("n"))
    total = degree.agg(F.sum("n").alias("t")).first().t or 0
    rows = max(int(hub_rows), total // MAX_HUBS)
    return degree.where(F.col("n") > rows).select(*STOP, F.ceil(F.col("n") / F.lit(rows)).cast("int").alias("slices"))


def calls_at(net, stop_times: DataFrame, near: DataFrame) -> DataFrame:
    """``stop_times`` (feed_id, trip_id, stop_id, ...) joined to ``near`` (feed_id, stop_id, ...) on the stop."""
    if net.hubs is None:
        return stop_times.join(near, STOP)
    hubs = F.broadcast(net.hubs)
    dealt = stop_times.join(hubs, STOP, "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("trip_id"), F.col("slices")).cast("int"), F.lit(0)))
    copies = near.join(hubs, STOP, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    return dealt.drop("slices").join(copies.drop("slices"), [*STOP, "_slice"]).drop("_slice")

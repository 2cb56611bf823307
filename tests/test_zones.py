"""Instants do not depend on the session zone; ids may hold any character."""

import datetime

import pytest
from pyspark.sql import functions as F

from cityhop.functions.timefmt import clock_text, day_text, instant_to_local, local_wall_clock, utc_offset_seconds, wall_clock_to_instant
from cityhop.model import Network
from cityhop.operators.cities import build_cities
from cityhop.plans.journeys import od_frequency

#: (service date, seconds, zone): plain, past midnight, the skipped and the repeated hour of a zone and of the session's
CLOCKS = [
    ("2024-01-20", 30_000, "Europe/Paris"),
    ("2024-01-20", 90_000, "UTC"),
    ("2024-03-31", 2 * 3600 + 1800, "Europe/Paris"),
    ("2024-10-27", 2 * 3600 + 1800, "Europe/Paris"),
    ("2024-03-10", 2 * 3600 + 1800, "UTC"),
    ("2024-11-03", 5 * 3600 + 1800, "UTC"),
    ("2024-11-03", 6 * 3600 + 1800, "UTC"),
    ("2024-03-10", 2 * 3600 + 1800, "America/New_York"),
]


def _answers(spark):
    df = spark.createDataFrame(CLOCKS, "d string, s int, z string")
    t = wall_clock_to_instant(local_wall_clock(F.col("d").cast("date"), F.col("s")), F.col("z"))
    df = df.withColumn("t", t).withColumn("local", instant_to_local("t", F.col("z")))
    return [tuple(r) for r in df.select(F.unix_timestamp("t"), F.col("local").cast("string"), utc_offset_seconds("t", F.col("z")), clock_text("local"), day_text("local")).collect()]


def test_session_zone_changes_nothing(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    utc = _answers(spark)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert _answers(spark) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    seconds = [r[0] for r in utc]
    instant = lambda *a: int(datetime.datetime(*a, tzinfo=datetime.timezone.utc).timestamp())
    assert seconds[0] == instant(2024, 1, 20, 7, 20) and seconds[1] == instant(2024, 1, 21, 1, 0)
    assert seconds[2] == instant(2024, 3, 31, 1, 30)  # skipped: moved on by the gap
    assert seconds[3] == instant(2024, 10, 27, 0, 30)  # repeated: the first
    assert seconds[6] - seconds[5] == 3600
    assert utc[0][2:] == (3600, "08h20", "20-01")


@pytest.fixture
def barred(dates_net):
    """The feed with stop ids that hold a bar."""
    ids = lambda df, *cs: df.withColumns({c: F.concat(F.lit("FR|"), F.col(c)) for c in cs if c in df.columns})
    n = dates_net
    return Network(n.feeds, ids(n.stops, "stop_id", "parent_station"), ids(n.stop_times, "stop_id"), n.trips, n.calendar, n.calendar_dates)


def test_pair_frequencies_with_bars_in_ids(dates_net, barred):
    days = dates_net.calendar_dates.agg(F.min("date"), F.max("date")).first()

    def run(net, prefix):
        out = od_frequency(net, build_cities(net, eps_km=8.0), str(days[0]), str(days[1]))
        return sorted((r["dep_city_id"].removeprefix(prefix), r["arr_city_id"].removeprefix(prefix), str(r["date"]), r["n_trips"]) for r in out.collect())

    assert run(barred, "FR|") == run(dates_net, "")

"""Service calendars: which services run in a period (F2-F5) and on which dates.

The calendar side is one table of **running days as bit masks**: a row per (feed, service, block of ``BLOCK_DAYS`` days)
with a bit for each day (:func:`running_days`).  It depends on the network only, not on the requests, and can be written
once (``write_network`` does) and is then used by every plan (``Network.days``, or ``days=``).  A period is a mask per
block it touches, so a test is one equi-join on
(feed, service, block) and a bitwise AND; dates are expanded only for the days that run.

Four masks are kept per row:

* ``flags``: days inside the service's validity whose weekday flag is 1 (CALENDAR);
* ``listed``: days that calendar_dates names, whatever the type;
* ``added`` / ``removed``: those of type 1 and type 2.

Input rows carry (query_id, feed_id, service_id, start_date, end_date, feed_kind); periods are DATE bounds, inclusive at
both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["query_id", "feed_id", "service_id"]
#: Days of a mask: 8 weeks, so that a block always begins on the same weekday and fits into a LONG.
BLOCK_DAYS = 56
MASKS = ["flags", "listed", "added", "removed"]

# Day 4 after 1970-01-01 (a Thursday) is a Monday: blocks begin on Mondays.
_MONDAY = 4


def _day_number(date) -> Column:
    """Days since a Monday."""
    return F.unix_date(date).cast("long") - _MONDAY


def _block(day: Column) -> Column:
    return F.floor(day / BLOCK_DAYS)


def _mask(low: Column, high: Column) -> Column:
    """Bits ``low`` to ``high`` (0 <= low, high < BLOCK_DAYS); none when high < low."""
    below = lambda n: F.expr(f"shiftleft(1L, cast({n} as int))") - F.lit(1)
    upto, from_ = "_high + 1", "_low"
    return F.when(high >= low, below(upto) - below(from_)).otherwise(F.lit(0)).cast("long")


def _spans(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row per block that [start, end] touches: ``block`` and ``span``, the mask of its days in the period."""
    a, b = _day_number(F.col(start)), _day_number(F.col(end))
    df = df.where(F.col(start) <= F.col(end)).withColumns({"_a": a, "_b": b})
    df = df.withColumn("block", F.explode(F.sequence(_block(F.col("_a")), _block(F.col("_b")))))
    first = F.col("block") * BLOCK_DAYS
    df = df.withColumns({"_low": F.greatest(F.col("_a") - first, F.lit(0)), "_high": F.least(F.col("_b") - first, F.lit(BLOCK_DAYS - 1))})
    return df.withColumn("span", _mask(F.col("_low"), F.col("_high"))).drop("_a", "_b", "_low", "_high")


def _week_pattern(days: str) -> Column:
    """The weekday flags of a Mon..Sun array, repeated over a block."""
    week = F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.lit(0).cast("long"), lambda a, i: a + F.when(F.element_at(days, i + 1) == 1, F.expr("1L") * F.pow(F.lit(2), i).cast("long")).otherwise(0))
    return week * F.lit(sum(1 << (7 * w) for w in range(BLOCK_DAYS // 7)))


def running_days(net) -> DataFrame:
    """feed_id, service_id, block, flags, listed, added, removed: one row per service and block in which anything is said of it.

    Several calendar rows of a service, and repeated calendar_dates rows, are combined with OR.
    """
    cal = net.calendar.select("feed_id", "service_id", "days", "start_date", "end_date").where("days is not null")
    spans = _spans(cal, "start_date", "end_date")
    zero = F.lit(0).cast("long")
    flags = spans.select("feed_id", "service_id", "block", _week_pattern("days").bitwiseAND(F.col("span")).alias("flags"), zero.alias("listed"), zero.alias("added"), zero.alias("removed"))
    day = _day_number(F.col("date"))
    cd = net.calendar_dates.where("date is not null").withColumns({"block": _block(day), "_bit": F.pmod(day, F.lit(BLOCK_DAYS))})
    bit = F.expr("shiftleft(1L, cast(_bit as int))")
    of = lambda t: F.when(F.col("exception_type") == t, bit).otherwise(zero)
    listed = cd.select("feed_id", "service_id", "block", zero.alias("flags"), bit.alias("listed"), of(1).alias("added"), of(2).alias("removed"))
    return flags.unionByName(listed).groupBy("feed_id", "service_id", "block").agg(*[F.bit_or(m).alias(m) for m in MASKS])


def _days(net, given: DataFrame | None) -> DataFrame:
    if given is not None:
        return given
    return net.days if net.days is not None else running_days(net)


def _any_overlap(net, req: DataFrame) -> DataFrame:
    """Rows of ``req`` that a validity overlaps by six days or more, which count as running whatever the flags."""
    cal = net.calendar.select("feed_id", "service_id", F.col("start_date").alias("_s"), F.col("end_date").alias("_e")).distinct()
    same = ["feed_id", "service_id"]
    overlap = F.datediff(F.least("_e", "q_end"), F.greatest("_s", "q_start"))
    return req.join(cal, same).where((F.col("_s") <= F.col("q_end")) & (F.col("_e") >= F.col("q_start")) & (overlap >= 6)).select(*req.columns)


def _overlaps_long(start: str, end: str) -> Column:
    """Whether a validity [_s, _e] overlaps the period by six days or more (only one of seven days or more can)."""
    overlap = F.datediff(F.least("_e", end), F.greatest("_s", start))
    return (F.col("_s") <= F.col(end)) & (F.col("_e") >= F.col(start)) & (overlap >= 6)


def may_run(net, requests: DataFrame, *, any_long: bool = False, days: DataFrame | None = None) -> DataFrame:
    """(feed_id, trip_id) of the trips whose service runs on some day of some request's period (start_date, end_date), whatever its kind.

    All periods together are one mask per block, so this reads the running days once, however many requests there are.  Nothing
    that runs for a request is missing; what runs for another request only is for the exact test that follows.
    ``any_long``: a validity of six days or more that meets a period of seven days or more counts as well.
    """
    days = _days(net, days)
    periods = requests.select("start_date", "end_date").distinct()
    # a row per 56 days of the calendar
    wanted = F.broadcast(_spans(periods, "start_date", "end_date").groupBy("block").agg(F.bit_or("span").alias("span")))
    said = F.col("flags").bitwiseOR(F.col("listed"))
    services = days.join(wanted, "block").where(said.bitwiseAND(F.col("span")) != 0).select("feed_id", "service_id")
    if any_long:
        hull = periods.where(F.datediff("end_date", "start_date") >= 6).agg(F.min("start_date").alias("_from"), F.max("end_date").alias("_to"))
        cal = net.calendar.where((F.datediff("end_date", "start_date") >= 6)).crossJoin(F.broadcast(hull))
        services = services.unionByName(cal.where((F.col("start_date") <= F.col("_to")) & (F.col("end_date") >= F.col("_from"))).select("feed_id", "service_id"))
    return net.trips.join(services, ["feed_id", "service_id"], "left_semi").select("feed_id", "trip_id")


def running_rows(net, rows: DataFrame, *, strict_weekday: bool = False, days: DataFrame | None = None) -> DataFrame:
    """The rows of ``rows`` that :func:`active_services` finds running, as they are and read once: each meets what is said of its service."""
    cal = net.calendar.select("feed_id", "service_id", F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    said = _days(net, days).select("feed_id", "service_id", "block", "flags", "listed").unionByName(cal, allowMissingColumns=True)
    said = said.withColumnsRenamed({"feed_id": "_feed", "service_id": "_service"})
    low, high = f"greatest(_a - block * {BLOCK_DAYS}, 0L)", f"least(_b - block * {BLOCK_DAYS}, {BLOCK_DAYS - 1}L)"
    span = F.expr(f"shiftleft(1L, cast({high} + 1 as int)) - shiftleft(1L, cast({low} as int))")
    calendar = F.col("feed_kind") == "CALENDAR"
    hit = F.when(calendar, F.col("flags")).otherwise(F.col("listed"))
    runs = F.expr(f"{high} >= {low}") & (hit.bitwiseAND(span) != 0)
    if not strict_weekday:
        runs = F.coalesce(runs, F.lit(False)) | F.coalesce(calendar & _overlaps_long("start_date", "end_date"), F.lit(False))
    at = rows.withColumns({"_a": _day_number(F.col("start_date")), "_b": _day_number(F.col("end_date"))})
    same = (F.col("feed_id") == F.col("_feed")) & (F.col("service_id") == F.col("_service"))
    return at.join(said, same & runs, "left_semi").drop("_a", "_b")


def active_services(net, svc: DataFrame, *, strict_weekday: bool = False, days: DataFrame | None = None) -> DataFrame:
    """Rows of ``svc`` whose service runs at least once in [start_date, end_date]; equal rows come back once.

    CALENDAR: the calendar row overlaps the period and a weekday flag is set on
    some day of the overlap; an overlap of 6+ days counts as running whatever
    the flags unless ``strict_weekday``.  calendar_dates are ignored here.
    DATES / STATION: some calendar_dates row falls in the period (any type).
    ``days``: the table of :func:`running_days`, if it is at hand.
    """
    days = _days(net, days)
    req = svc.distinct().withColumnsRenamed({"start_date": "q_start", "end_date": "q_end"})
    masks = days.select("feed_id", "service_id", "block", "flags", "listed")
    hit = F.when(F.col("feed_kind") == "CALENDAR", F.col("flags")).otherwise(F.col("listed"))
    out = _spans(req, "q_start", "q_end").join(masks, ["feed_id", "service_id", "block"]).where(hit.bitwiseAND(F.col("span")) != 0).select(*req.columns)
    if not strict_weekday:
        # six days or more can only overlap a period of seven days or more
        long = req.where((F.col("feed_kind") == "CALENDAR") & (F.datediff("q_end", "q_start") >= 6))
        out = out.unionByName(_any_overlap(net, long))
    return out.distinct().withColumnsRenamed({"q_start": "start_date", "q_end": "end_date"})


def running_dates(net, rows: DataFrame, *, honor_exception_type: bool = False, days: DataFrame | None = None) -> DataFrame:
    """``rows`` once for each date their service runs in their period, with ``date``.

    ``rows`` hold feed_id, service_id, feed_kind, start_date, end_date and any other columns; ``rows`` are read once.
    For what runs see :func:`service_dates`.
    """
    days = _days(net, days)
    calendar = F.col("feed_kind") == "CALENDAR"
    if honor_exception_type:
        by_flags = F.col("flags").bitwiseAND(F.bitwise_not("removed")).bitwiseOR(F.col("added"))
        runs = F.when(calendar, by_flags).otherwise(F.col("added"))
    else:
        runs = F.when(calendar, F.col("flags").bitwiseAND(F.bitwise_not("listed"))).otherwise(F.col("listed"))
    spans = _spans(rows, "start_date", "end_date").join(days, ["feed_id", "service_id", "block"])
    on = spans.withColumn("_on", runs.bitwiseAND(F.col("span"))).where("_on <> 0")
    bits = F.expr(f"filter(sequence(0, {BLOCK_DAYS - 1}), i -> getbit(_on, i) = 1)")
    dates = on.select(*rows.columns, F.explode(bits).alias("_i"), "block")
    return dates.select(*rows.columns, F.date_from_unix_date((F.col("block") * BLOCK_DAYS + F.col("_i") + _MONDAY).cast("int")).alias("date"))


def service_dates(net, svc: DataFrame, *, honor_exception_type: bool = False, days: DataFrame | None = None) -> DataFrame:
    """Every date a service runs inside a period.

    ``svc`` holds (feed_id, service_id, feed_kind, start_date, end_date); the
    expansion is done once per distinct (service, period), so many requests
    over the same period share it.  Output: those five columns + ``date``.

    CALENDAR: days of the overlap whose weekday flag is 1 (no 6-day
    shortcut here), minus every (service, date) present in calendar_dates
    (any type cancels).  DATES / STATION: calendar_dates rows in the period
    (any type runs).  ``honor_exception_type`` gives standard GTFS instead
    (type 1 adds, type 2 removes).  ``days``: the table of :func:`running_days`.
    """
    keys = ["feed_id", "service_id", "feed_kind", "start_date", "end_date"]
    return running_dates(net, svc.select(*keys).distinct(), honor_exception_type=honor_exception_type, days=days)

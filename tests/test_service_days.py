"""Running days as bit masks (D1, F2-F5, O4) against day-by-day loops."""

import datetime as dt
import random

from cityhop import schema
from cityhop.model import Network
from cityhop.operators.service import BLOCK_DAYS, active_services, running_days, service_dates

DAY = dt.timedelta(days=1)
EPOCH = dt.date(1970, 1, 1)


def _random_network(spark, seed):
    rng = random.Random(seed)
    at = lambda: dt.date(2023, 12, 1) + rng.randrange(150) * DAY
    calendar, dates = [], []
    for s in range(25):
        for _ in range(rng.choice([0, 1, 1, 2])):
            start = at()
            calendar.append(("C", f"s{s}", [rng.choice([0, 0, 1]) for _ in range(7)], start, start + rng.randrange(120) * DAY))
        for feed in ("C", "D"):
            dates += [(feed, f"s{s}", at(), rng.choice([1, 2])) for _ in range(rng.randrange(6))]
    calendar.append(("C", "old", [1] * 7, dt.date(1969, 12, 20), dt.date(1970, 1, 20)))
    dates.append(("D", "s1", dates[-1][2], 1))
    dates.append(("D", "none", None, 1))
    frames = {
        "calendar": spark.createDataFrame(calendar, schema.CALENDAR),
        "calendar_dates": spark.createDataFrame(dates, schema.CALENDAR_DATES),
        "feeds": spark.createDataFrame([("C", 0, "CALENDAR", "UTC"), ("D", 1, "DATES", "UTC")], schema.FEEDS),
    }
    rest = {n: spark.createDataFrame([], getattr(schema, n.upper())) for n in ("stops", "stop_times", "trips")}
    return Network(**frames, **rest), calendar, [d for d in dates if d[2]]


def _requests(seed):
    rng = random.Random(seed)
    rows = [("C", "old", "CALENDAR", EPOCH - 20 * DAY, EPOCH + 3 * DAY), ("C", "s1", "CALENDAR", dt.date(2024, 2, 1), dt.date(2024, 1, 1))]
    for feed, kind in (("C", "CALENDAR"), ("D", "DATES")):
        for s in range(27):
            for _ in range(4):
                start = dt.date(2023, 12, 1) + rng.randrange(200) * DAY
                rows.append((feed, f"s{s}", kind, start, start + rng.choice([0, 1, 2, 5, 6, 9, 100]) * DAY))
    return sorted(set(rows))


def _span(a, b):
    return [a + i * DAY for i in range((b - a).days + 1)]


def test_service_dates_and_active_services_match_loops(spark):
    net, calendar, listed = _random_network(spark, 5)
    rows = _requests(6)
    svc = spark.createDataFrame([(f"q{i}", *r) for i, r in enumerate(rows)], "query_id string, feed_id string, service_id string, feed_kind string, start_date date, end_date date")

    def flagged(feed, s, a, b):
        return {d for f, x, days, start, end in calendar if (f, x) == (feed, s) for d in _span(max(a, start), min(b, end)) if days[d.weekday()] == 1}

    def named(feed, s, a, b, types=(1, 2)):
        return {d for f, x, d, t in listed if (f, x) == (feed, s) and a <= d <= b and t in types}

    days = running_days(net).cache()
    for honor in (False, True):
        want = set()
        for feed, s, kind, a, b in rows:
            runs = flagged(feed, s, a, b) if kind == "CALENDAR" else set()
            off, on = ((2,), (1,)) if honor else ((1, 2), () if kind == "CALENDAR" else (1, 2))
            runs = (runs - named(feed, s, a, b, off) if kind == "CALENDAR" else set()) | named(feed, s, a, b, on)
            want |= {(feed, s, kind, a, b, d) for d in runs}
        for given in (None, days):
            got = [tuple(r) for r in service_dates(net, svc, honor_exception_type=honor, days=given).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    for strict in (False, True):
        want = set()
        for i, (feed, s, kind, a, b) in enumerate(rows):
            long = any((min(b, end) - max(a, start)).days >= 6 for f, x, _, start, end in calendar if (f, x) == (feed, s) and start <= b and end >= a)
            if (flagged(feed, s, a, b) or (long and not strict)) if kind == "CALENDAR" else named(feed, s, a, b):
                want.add(f"q{i}")
        got = [r.query_id for r in active_services(net, svc, strict_weekday=strict, days=days).collect()]
        assert sorted(got) == sorted(want)


def test_the_service_side_does_not_grow_with_requests(spark):
    net, calendar, listed = _random_network(spark, 7)
    days = running_days(net).collect()
    first = lambda d: ((d - EPOCH).days - 4) // BLOCK_DAYS
    blocks = {(f, s, k) for f, s, _, a, b in calendar for k in range(first(a), first(b) + 1)} | {(f, s, first(d)) for f, s, d, _ in listed}
    assert {(r.feed_id, r.service_id, r.block) for r in days} == blocks and len(days) == len(blocks)

"""One-pass feed reader (S1-S5), reject outputs (P2), freshness by files."""

import os

from cityhop.operators.quality import feed_freshness
from cityhop.sources.gtfs import FeedSpec, find_tables, load_feeds, read_network, read_table, rejects, write_network

TABLES = {
    "agency": ["agency_id", "agency_timezone"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "stop_timezone", "parent_station"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "trips": ["trip_id", "service_id", "route_id"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}


def _feed(root, k):
    """A small feed whose files have their columns turned by ``k`` places, with one column too many for some."""
    base = os.path.join(root, f"feed {k}%20")
    os.makedirs(base)
    rows = {
        "agency": [["a", "Europe/Paris" if k % 2 else "UTC"], ["b", "Asia/Tokyo"]],
        "stops": [["001", f'Stop "{k}", north', str(k / 8), "2.5", "", ""], ["002", "é", "x" if k % 5 == 0 else "1", "2", "", ""]],
        "stop_times": [[f"T{k}", "bad", "7:05:09", "001", "1"], [f"T{k}", "bad", "25:00:00", "002", "2"]],
        "trips": [[f"T{k}", "S", str(k)]],
        "calendar_dates": [["S", "20240105", "1"]],
    }
    for table, columns in TABLES.items():
        extra = ["note"] if k % 3 == 0 else []
        turn = k % len(columns)
        order = [*columns[turn:], *columns[:turn], *extra]
        with open(os.path.join(base, f"{table}.txt"), "w", encoding="utf-8") as f:
            f.write(("﻿" if k % 4 == 0 else "") + ",".join(order) + "\n")
            for row in rows[table]:
                value = {**dict(zip(columns, row)), "note": "x,y"}
                f.write(",".join('"' + value[c].replace('"', '""') + '"' for c in order) + "\n")
    return FeedSpec(f"N{k}", base, k)


def _size(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_two_hundred_feeds_are_one_scan_per_table(spark, tmp_path):
    specs = [_feed(str(tmp_path), k) for k in range(200)]
    net = load_feeds(spark, specs)
    few = load_feeds(spark, specs[:2])
    for name in ("stops", "stop_times", "trips", "calendar_dates", "feeds"):
        many = getattr(net, name)
        assert _size(many) == _size(getattr(few, name)), name
        assert many._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2, name
    stops = {(r.feed_id, r.stop_id): (r.stop_name, r.stop_lat, r.stop_lon) for r in net.stops.collect()}
    assert len(stops) == 400
    assert all(stops[f"N{k}", "001"] == (f'Stop "{k}", north', k / 8, 2.5) for k in range(200))
    assert all(stops[f"N{k}", "002"] == ("é", None if k % 5 == 0 else 1.0, 2.0) for k in range(200))
    times = {(r.feed_id, r.stop_sequence): (r.trip_id, r.stop_id, r.departure_s) for r in net.stop_times.collect()}
    assert all(times[f"N{k}", 1] == (f"T{k}", "001", 25509) and times[f"N{k}", 2] == (f"T{k}", "002", 90000) for k in range(200))
    assert {(r.feed_id, r.feed_kind, r.timezone) for r in net.feeds.collect()} == {(f"N{k}", "DATES", "Europe/Paris" if k % 2 else "UTC") for k in range(200)}
    bad = rejects(spark, specs).collect()
    assert {(r.feed_id, r.table, r.column, r.row_key, r.raw, r.rejected) for r in bad} == {(f"N{k}", "stops", "stop_lat", "002", "x", False) for k in range(0, 200, 5)}


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_rejects_name_row_value_and_reason(spark, tmp_path):
    days = ",".join(["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"])
    _write(tmp_path / "A/calendar.txt", f"service_id,{days},start_date,end_date\nok,1,1,1,1,1,1,1,20240101,20240110\nturned,1,1,1,1,1,1,1,20240110,20240101\nbad,1,1,1,y,1,1,1,2024-01-01,\n")
    _write(tmp_path / "A/calendar_dates.txt", "service_id,date,exception_type\nok,20240103,2\nok,soon,1\nok,,1\nok,20240104,\n")
    _write(tmp_path / "A/trips.txt", "trip_id,service_id,route_id\nt,ok,1\n")
    specs = [FeedSpec("A", str(tmp_path / "A"), 0)]
    net = load_feeds(spark, specs)
    assert [r.service_id for r in net.calendar.collect()] == ["ok"]
    assert sorted((str(r.date), r.exception_type) for r in net.calendar_dates.collect()) == [("2024-01-03", 2), ("2024-01-04", None)]
    assert net.stops.count() == 0 and net.stop_times.count() == 0
    got = {(r.table, r.column, r.row_key, r.raw, r.reason, r.rejected) for r in rejects(spark, specs).collect()}
    assert got == {
        ("calendar", "end_date", "turned", "20240110..20240101", "end_before_start", True),
        ("calendar", "thursday", "bad", "y", "bad_number", False),
        ("calendar", "start_date", "bad", "2024-01-01", "bad_date", True),
        ("calendar", "end_date", "bad", None, "missing", True),
        ("calendar_dates", "date", "ok", "soon", "bad_date", True),
        ("calendar_dates", "date", "ok", None, "missing", True),
    }
    # every row is either in the network or reported as rejected
    tables = find_tables(spark, specs)
    for table, rows in (("calendar", net.calendar), ("calendar_dates", net.calendar_dates)):
        lost = {k for t, _, k, _, _, out in got if t == table and out}
        kept = {r.service_id for r in rows.collect()}
        assert kept | lost == {r.service_id for r in read_table(spark, table, tables[table]).collect()}
    fresh = feed_freshness(net, "2024-01-05", rejects(spark, specs)).collect()[0]
    assert (fresh.n_dates, fresh.share_future) == (2, 0.5)  # the end of the turned validity counts


def test_a_feed_without_file_is_stale_one_with_an_empty_file_is_not(spark, tmp_path):
    _write(tmp_path / "EMPTY/calendar_dates.txt", "service_id,date,exception_type\n")
    _write(tmp_path / "NONE/trips.txt", "trip_id,service_id,route_id\nt,s,1\n")
    _write(tmp_path / "OLD/calendar_dates.txt", "service_id,date,exception_type\ns,20200101,1\n")
    specs = [FeedSpec(n, str(tmp_path / n), i) for i, n in enumerate(["EMPTY", "NONE", "OLD"])]
    net = load_feeds(spark, specs)
    want = {"EMPTY": (0, False), "NONE": (0, True), "OLD": (1, True)}
    assert {r.feed_id: (r.n_dates, r.stale) for r in feed_freshness(net, "2024-01-01").collect()} == want
    write_network(net, str(tmp_path / "net"))
    back = read_network(spark, str(tmp_path / "net"))
    assert {r.feed_id: (r.n_dates, r.stale) for r in feed_freshness(back, "2024-01-01").collect()} == want

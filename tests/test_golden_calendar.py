"""Golden cases on the weekday-calendar fixture feed (FIXTURES.md section 4, set 1)."""

import datetime as dt

from helpers import between, destinations, nearby, trips, trips_period

from cityhop.operators.stops import stop_activity


def names(rows, col="stop_name"):
    return sorted(getattr(r, col) for r in rows)


def test_feed_kind_detected(cal_net):
    row = cal_net.feeds.collect()[0]
    assert row.feed_kind == "CALENDAR" and row.timezone == "UTC"


def test_nearby_none(cal_net, spark):
    assert nearby(cal_net, spark, 0, 0) == []


def test_nearby_one(cal_net, spark):
    assert names(nearby(cal_net, spark, 1, 1)) == ["Laval"]


def test_nearby_two(cal_net, spark):
    assert names(nearby(cal_net, spark, 8, 8)) == ["Avignon1", "Avignon2"]


def test_trips_nearby_none(cal_net, spark):
    assert trips(cal_net, spark, 0, 0) == []


def test_trips_nearby_one(cal_net, spark):
    rows = trips(cal_net, spark, 1, 1)
    assert [(r.trip_id, r.board_stop_id) for r in rows] == [("TRIP001", "Laval_id")]


def test_trips_nearby_two_trips_one_stop(cal_net, spark):
    rows = trips(cal_net, spark, 2, 2)
    assert sorted(r.trip_id for r in rows) == ["TRIP001", "TRIP002"]
    assert {r.board_stop_id for r in rows} == {"Nantes_id"}


def test_trips_nearby_two_stops_two_trips(cal_net, spark):
    rows = trips(cal_net, spark, 15, 15)
    assert sorted((r.trip_id, r.board_stop_id) for r in rows) == [("TRIP003", "Strasbourg1_id"), ("TRIP004", "Strasbourg2_id")]


def test_trips_nearby_one_boarding_per_trip(cal_net, spark):
    rows = trips(cal_net, spark, 8, 8)
    assert sorted(r.trip_id for r in rows) == ["TRIP005", "TRIP006", "TRIP007"]
    assert {r.board_stop_id for r in rows} == {"Avignon1_id", "Avignon2_id"}
    # TRIP005 calls at both Avignon stops: the first one boards
    assert [r.board_stop_id for r in rows if r.trip_id == "TRIP005"] == ["Avignon1_id"]


def test_period_no_stop(cal_net, spark):
    assert trips_period(cal_net, spark, 0, 0, "2024-07-01", "2024-07-01") == []


def test_period_wrong_year(cal_net, spark):
    assert trips_period(cal_net, spark, 1, 1, "2023-07-01", "2023-07-01") == []


def test_period_one_day(cal_net, spark):
    assert [r.trip_id for r in trips_period(cal_net, spark, 1, 1, "2024-07-01", "2024-07-01")] == ["TRIP001"]


def test_period_overlap_start(cal_net, spark):
    assert [r.trip_id for r in trips_period(cal_net, spark, 2, 2, "2024-06-20", "2024-07-03")] == ["TRIP001"]


def test_period_weekday_mask(cal_net, spark):
    assert [r.trip_id for r in trips_period(cal_net, spark, 2, 2, "2024-07-03", "2024-07-08")] == ["TRIP002"]


def test_period_two_trips(cal_net, spark):
    assert sorted(r.trip_id for r in trips_period(cal_net, spark, 15, 15, "2024-07-03", "2024-07-10")) == ["TRIP003", "TRIP004"]


def test_destinations_none(cal_net, spark):
    assert destinations(cal_net, spark, 0, 0, "2024-07-01", "2024-08-01") == []


def test_destinations_wrong_year(cal_net, spark):
    assert destinations(cal_net, spark, 15, 15, "2023-07-01", "2023-08-01") == []


def test_destinations_one(cal_net, spark):
    assert names(destinations(cal_net, spark, 1, 1, "2024-07-01", "2024-07-01")) == ["Nantes"]


def test_destinations_two(cal_net, spark):
    assert names(destinations(cal_net, spark, 15, 15, "2024-07-01", "2024-07-07")) == ["SaintMalo", "Vannes"]


def test_destinations_exclude_departure_area(cal_net, spark):
    got = names(destinations(cal_net, spark, 8, 8, "2024-07-01", "2024-08-01"))
    assert got == ["Bordeaux", "Brest", "Lyon", "Marseille", "Nimes"]


def test_trips_no_stop(cal_net, spark):
    assert between(cal_net, spark, (0, 0), (1, 1), "2024-07-01", "2024-08-01", 6) == []


def test_trips_too_late(cal_net, spark):
    assert between(cal_net, spark, (1, 1), (2, 2), "2024-07-01", "2024-08-01", 20) == []


def test_trips_single(cal_net, spark):
    rows = between(cal_net, spark, (1, 1), (2, 2), "2024-07-01", "2024-08-01", 6)
    assert len(rows) == 1
    # agency zone UTC: 12:45 wall clock is 12:45Z (compare epochs: collect() yields local naive datetimes)
    assert rows[0].arr_time.timestamp() == dt.datetime(2024, 7, 1, 12, 45, tzinfo=dt.timezone.utc).timestamp()


def test_trips_every_day(cal_net, spark):
    rows = between(cal_net, spark, (8, 8), (9, 9), "2024-07-01", "2024-08-01", 6)
    assert len(rows) == 15 and {r.trip_id for r in rows} == {"TRIP005"}


def test_trips_weekend_service(cal_net, spark):
    rows = between(cal_net, spark, (15, 15), (5, 5), "2024-07-01", "2024-08-01", 6)
    assert len(rows) == 4 and {r.trip_id for r in rows} == {"TRIP004"}
    assert {r.stop_timezone_x for r in rows} == {"Europe/Paris"}


def test_trips_period_clamped(cal_net, spark):
    rows = between(cal_net, spark, (15, 15), (4, 4), "2024-07-04", "2024-08-05", 6)
    assert [r.trip_id for r in rows] == ["TRIP003"]


def test_trips_period_inside(cal_net, spark):
    rows = between(cal_net, spark, (15, 15), (5, 5), "2024-07-06", "2024-07-09", 6)
    assert len(rows) == 2 and {r.trip_id for r in rows} == {"TRIP004"}


def test_trips_cancelled_dates(cal_net, spark):
    rows = between(cal_net, spark, (16, 16), (17, 17), "2024-07-01", "2024-07-08", 6)
    assert {r.trip_id for r in rows} == {"TRIP008"}
    assert sorted(r.date for r in rows) == [dt.date(2024, 7, d) for d in (2, 3, 4, 7)]


def test_stop_activity(cal_net):
    rows = stop_activity(cal_net).collect()
    assert len(rows) == 19
    by = {r.stop_name: r.number_of_appearance for r in rows}
    assert by["Laval"] == 1 and by["Nantes"] == 2 and by["Nice"] is None
    assert {"Laval", "Vannes", "Strasbourg1"} <= set(by)

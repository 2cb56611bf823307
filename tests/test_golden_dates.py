"""Golden cases on the dated-services fixture feeds (FIXTURES.md section 4, sets 2 and 3).

The flat feed and the station feed hold the same timetable; the station
feed answers destinations and activity with parent stations.
"""

import pytest
from helpers import between, destinations, nearby, trips, trips_period

from cityhop.operators.stops import stop_activity


@pytest.fixture(params=["dates", "station"])
def net(request, dates_net, station_net):
    return dates_net if request.param == "dates" else station_net


def ids(rows, col="stop_id"):
    return sorted(getattr(r, col) for r in rows)


def test_kinds(dates_net, station_net):
    assert dates_net.feeds.collect()[0].feed_kind == "DATES"
    assert station_net.feeds.collect()[0].feed_kind == "STATION"
    assert dates_net.feeds.collect()[0].timezone == "Europe/Paris"


def test_nearby_one(net, spark):
    rows = nearby(net, spark, 42, 2)
    assert [r.stop_name for r in rows] == ["Laval"] and [r.stop_id for r in rows] == ["Laval001"]


def test_nearby_none(net, spark):
    assert nearby(net, spark, 0, 0) == []


def test_nearby_two(net, spark):
    assert ids(nearby(net, spark, 45, 5)) == ["Paris001", "Paris2001"]


def test_trips_none(net, spark):
    assert trips(net, spark, 0, 0) == []


def test_trips_one(net, spark):
    rows = trips(net, spark, 50, 10)
    assert [(r.trip_id, r.board_stop_id) for r in rows] == [("TRIP001", "Marseille001")]


def test_trips_invalid_latitude_tolerated(net, spark):
    rows = trips(net, spark, 100, 15)
    assert sorted((r.trip_id, r.board_departure_s) for r in rows) == [("TRIP002", 17 * 3600 + 56 * 60), ("TRIP003", 18 * 3600 + 56 * 60)]


def test_trips_two_stops(net, spark):
    rows = trips(net, spark, 45, 0)
    assert sorted(r.trip_id for r in rows) == ["TRIP004", "TRIP005", "TRIP006"]
    assert {r.board_stop_id for r in rows} == {"Nantes001", "Nantes2001"}


def test_trips_first_boarding(net, spark):
    rows = trips(net, spark, 45, 5)
    assert sorted(r.trip_id for r in rows) == ["TRIP007", "TRIP008", "TRIP009"]
    assert [r.board_stop_id for r in rows if r.trip_id == "TRIP009"] == ["Paris001"]


def test_period_none(net, spark):
    assert trips_period(net, spark, 0, 0, "2024-07-01", "2024-07-01") == []


def test_period_other_day(net, spark):
    assert trips_period(net, spark, 50, 10, "2024-01-01", "2024-01-01") == []


def test_period_one(net, spark):
    assert [r.trip_id for r in trips_period(net, spark, 50, 10, "2024-07-01", "2024-07-01")] == ["TRIP001"]


def test_period_two(net, spark):
    assert sorted(r.trip_id for r in trips_period(net, spark, 100, 15, "2024-07-01", "2024-07-06")) == ["TRIP002", "TRIP003"]


def test_period_three(net, spark):
    got = sorted(r.trip_id for r in trips_period(net, spark, 45, 0, "2024-07-01", "2024-08-01"))
    assert got == ["TRIP004", "TRIP005", "TRIP006"]


def test_destinations_none(net, spark):
    assert destinations(net, spark, 0, 0, "2024-07-01", "2024-08-01") == []


def test_destinations_wrong_year(net, spark):
    assert destinations(net, spark, 45, 0, "2023-07-01", "2023-08-01") == []


def test_destinations_one(net, spark):
    assert [r.stop_name for r in destinations(net, spark, 50, 10, "2024-07-01", "2024-07-01")] == ["Perpignan"]


def test_destinations_two(net, spark):
    got = sorted(r.stop_name for r in destinations(net, spark, 40, 0, "2024-08-10", "2024-08-20"))
    assert got == ["Laval", "Strasbourg"]


def test_destinations_flat_vs_station(dates_net, station_net, spark):
    flat = ids(destinations(dates_net, spark, 45, 5, "2024-07-01", "2024-08-01"))
    assert flat == ["Laval001", "Strasbourg001", "Vannes001"]
    stations = ids(destinations(station_net, spark, 45, 5, "2024-07-01", "2024-08-01"))
    assert stations == ["Laval", "Strasbourg", "Vannes"]


def test_between_none(net, spark):
    assert between(net, spark, (0, 0), (0, 0), "2024-07-01", "2024-09-01", 8) == []


def test_between_too_late(net, spark):
    assert between(net, spark, (50, 10), (48, 5), "2024-07-01", "2024-07-01", 20) == []


def test_between_one(net, spark):
    rows = between(net, spark, (50, 10), (48, 5), "2024-07-01", "2024-07-01", 8)
    assert [r.trip_id for r in rows] == ["TRIP001"]
    assert rows[0].stop_timezone_x == rows[0].stop_timezone_y == "Europe/Paris"


def test_between_five(net, spark):
    rows = between(net, spark, (100, 15), (48, 5), "2024-07-01", "2024-08-01", 8)
    assert len(rows) == 5 and {r.trip_id for r in rows} == {"TRIP002", "TRIP003"}


def test_stop_activity(dates_net, station_net):
    flat = stop_activity(dates_net).collect()
    assert len(flat) == 11
    st = stop_activity(station_net).collect()
    assert len(st) == 11 and all(not r.stop_id.endswith("001") for r in st)
    by = {r.stop_id: r.number_of_appearance for r in st}
    assert by["Laval"] == 4 and by["Carcassonne"] == 2 and by["Marseille"] == 1

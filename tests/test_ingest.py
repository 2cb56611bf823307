"""S4 kind inference and P4 zone defaulting on the fixture feeds."""

import os

from helpers import FIXTURES

from cityhop.sources.gtfs import FeedSpec, load_feeds


def test_undeclared_station_feed_is_inferred(spark):
    net = load_feeds(spark, [FeedSpec("X", os.path.join(FIXTURES, "station_feed"), 0)])
    assert net.feeds.collect()[0].feed_kind == "STATION"


def test_missing_stop_zone_defaults_to_agency_zone(dates_net):
    zones = {r.stop_timezone for r in dates_net.stops_with_kind().collect()}
    assert zones == {"Europe/Paris"}


def test_malformed_unread_column_does_not_break_load(cal_net):
    # arrival_time "07:34:00:" is never parsed; departure of that row is 07:34
    rows = cal_net.stop_times.where("trip_id = 'TRIP006' AND stop_sequence = 0").collect()
    assert [r.departure_s for r in rows] == [7 * 3600 + 34 * 60]

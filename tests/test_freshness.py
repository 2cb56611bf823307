"""O15 feed freshness on the fixture feeds (shares computed by hand from the fixture dates)."""

from cityhop.operators.quality import feed_freshness


def _one(net, as_of):
    r = feed_freshness(net, as_of).collect()[0]
    return r.n_dates, round(r.share_future, 4), r.stale


def test_calendar_feed_uses_end_dates(cal_net):
    # end dates: 0701, 0707, 0706, 0715, 0715, 0801 -> 3 of 6 after 07-10
    assert _one(cal_net, "2024-07-10") == (6, 0.5, True)
    assert _one(cal_net, "2024-06-30") == (6, 1.0, False)


def test_dated_feed_uses_service_dates(dates_net):
    # 12 calendar_dates rows, 8 of them after 07-01
    assert _one(dates_net, "2024-07-01") == (12, round(8 / 12, 4), True)
    assert _one(dates_net, "2024-06-30") == (12, 1.0, False)

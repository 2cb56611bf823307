import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cityhop.session import REQUIRED_CONF

    b = (
        SparkSession.builder.master("local[*]")
        .appName("cityhop-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cityhop-test-ckpt-"))
    yield s


def _load(spark, name, feed_id, kind):
    from helpers import FIXTURES

    from cityhop.sources.gtfs import FeedSpec, load_feeds

    net = load_feeds(spark, [FeedSpec(feed_id, os.path.join(FIXTURES, name), 0, kind)])
    # cache the small fixture tables: every test re-reads them many times
    from cityhop.model import Network

    return Network(*[getattr(net, f).cache() for f in ("feeds", "stops", "stop_times", "trips", "calendar", "calendar_dates")])


@pytest.fixture(scope="session")
def cal_net(spark):
    return _load(spark, "calendar_feed", "CAL", None)


@pytest.fixture(scope="session")
def dates_net(spark):
    return _load(spark, "dates_feed", "DATES", None)


@pytest.fixture(scope="session")
def station_net(spark):
    # the station kind is declared, not inferred from the feed name
    return _load(spark, "station_feed", "RAIL", "STATION")

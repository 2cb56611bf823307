"""A network written as Parquet (partitioned by feed) reads back unchanged."""

from cityhop.sources.gtfs import read_network, transports, write_network


def test_parquet_roundtrip_keeps_string_ids(dates_net, spark, tmp_path):
    out = str(tmp_path / "net")
    write_network(dates_net, out)
    back = read_network(spark, out)
    for name in ("stops", "stop_times", "trips", "calendar_dates"):
        a = sorted(tuple(r) for r in getattr(dates_net, name).select(*sorted(getattr(dates_net, name).columns)).collect())
        b = sorted(tuple(r) for r in getattr(back, name).select(*sorted(getattr(dates_net, name).columns)).collect())
        assert a == b, name
    assert {r.service_id for r in back.trips.collect()} >= {"001", "004"}
    assert [r.feed_id for r in transports(back).collect()] == ["DATES"]

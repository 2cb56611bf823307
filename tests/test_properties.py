"""Property and hand-case tests: clustering vs brute force, naming, batching,
empty inputs, request validation, >24h clocks, DST."""

import datetime as dt
import math
import random

from helpers import dest_request, destinations
from pyspark.sql import functions as F

from cityhop import schema
from cityhop.operators.cities import city_names
from cityhop.operators.cluster import cluster_points
from cityhop.operators.quality import validate_period
from cityhop.operators.reach import reachable_stops
from cityhop.functions.timefmt import local_wall_clock, parse_gtfs_clock, wall_clock_to_instant


def _hav(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(b[1]) - math.radians(a[1])) / 2) ** 2
    return 2 * math.asin(min(1.0, math.sqrt(h)))


def _brute(points, eps_km):
    ids = sorted(points)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    eps = eps_km / 6371.0
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if _hav(points[a], points[b]) <= eps:
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for i in ids:
        comp.setdefault(find(i), []).append(i)
    return {i: min(members) for members in comp.values() for i in members}


def test_cluster_matches_brute_force(spark):
    rnd = random.Random(7)
    pts = {}
    centres = [(45.0, 2.0), (89.97, 10.0), (0.0, 179.97), (0.0, -179.98), (100.0, 15.0), (-60.0, -70.0)]
    k = 0
    for c in centres:
        for _ in range(30):
            pts[f"p{k:03d}"] = (c[0] + rnd.uniform(-0.4, 0.4), c[1] + rnd.uniform(-0.4, 0.4))
            k += 1
    pts["dup1"] = pts["p000"]  # identical coordinates collapse
    df = spark.createDataFrame([(i, la, lo) for i, (la, lo) in pts.items()], "id string, lat double, lon double")
    got = {r.id: r.cluster_id for r in cluster_points(df.repartition(5), eps_km=12.0).collect()}
    assert got == _brute(pts, 12.0)


def test_cluster_null_coordinates(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 1.0)], "id string, lat double, lon double")
    got = {r.id: r.cluster_id for r in cluster_points(df, eps_km=1.0).collect()}
    assert got == {"a": "a", "b": None}


def _names(spark, rows):
    df = spark.createDataFrame(rows, "city_id string, stop_id string, stop_name string, number_of_appearance long")
    return {r.city_id: r.city_name for r in city_names(df).collect()}


def test_city_names(spark):
    got = _names(
        spark,
        [
            ("c1", "1", "Gare de Lyon Part Dieu", 10),  # one name: every non-noise word
            ("c2", "2", "Paris Nord", 5),
            ("c2", "3", "Paris Est", 4),  # two names: threshold 1 -> all words, first-occurrence order
            ("c3", "4", "Nantes Sud", 9),
            ("c3", "5", "Nantes Nord", 8),
            ("c3", "6", "Nantes Gare", 7),
            ("c3", "7", "Nantes Centre", 6),  # four names: threshold 2 -> nantes only
            ("c4", "8", "de la", 3),  # only noise -> the top-ranked name itself
        ],
    )
    assert got == {"c1": "Gare lyon part dieu", "c2": "Paris nord est", "c3": "Nantes", "c4": "de la"}


def test_batch_equals_single_requests(dates_net, spark):
    reqs = [("a", 45.0, 5.0), ("b", 50.0, 10.0), ("c", 45.0, 0.0)]
    batch = spark.createDataFrame(
        [(q, la, lo, 0.5, dt.date(2024, 7, 1), dt.date(2024, 8, 1), None) for q, la, lo in reqs], schema.REQUESTS_DEST
    )
    together = sorted((r.query_id, r.stop_id) for r in reachable_stops(dates_net, batch).collect())
    alone = sorted(
        (q, r.stop_id) for q, la, lo in reqs for r in destinations(dates_net, spark, la, lo, "2024-07-01", "2024-08-01")
    )
    assert together == alone and together


def test_empty_requests_keep_schema(dates_net, spark):
    empty = spark.createDataFrame([], schema.REQUESTS_DEST)
    out = reachable_stops(dates_net, empty)
    assert out.count() == 0
    assert out.columns == ["query_id", "feed_id", "stop_id", "stop_name", "stop_lat", "stop_lon", "stop_timezone"]


def test_singleton_city_is_not_a_departure(dates_net, spark):
    # radius 0 -> strict "< 1.05 * 0" finds nothing (a single-stop city never departs)
    assert reachable_stops(dates_net, dest_request(spark, 45.0, 5.0, "2024-07-01", "2024-08-01", r=0.0)).count() == 0


def test_request_validation(spark):
    raw = spark.createDataFrame(
        [("ok", "2024-07-01T00:00:00", "2024-07-02T00:00:00"), ("bad", "2024/07/01", "2024-07-02T00:00:00"),
         ("rev", "2024-07-03T00:00:00", "2024-07-02T00:00:00")],
        "query_id string, start string, end string",
    )
    got = {r.query_id: (r.error, r.start_date) for r in validate_period(raw).collect()}
    assert got == {"ok": (None, dt.date(2024, 7, 1)), "bad": ("bad_time", None), "rev": ("end_before_start", dt.date(2024, 7, 3))}


def test_clock_parsing_and_local_time(spark):
    df = spark.createDataFrame([("25:10:00",), ("07:34:00:",), ("x",)], "t string").select(parse_gtfs_clock("t").alias("s"))
    assert [r.s for r in df.collect()] == [25 * 3600 + 600, None, None]
    # DST: 2024-03-31 02:30 does not exist in Paris (shifted forward); a >24h clock rolls to the next day
    df = spark.createDataFrame([(dt.date(2024, 3, 31), 2 * 3600 + 1800), (dt.date(2024, 1, 1), 25 * 3600)], "d date, s int")
    inst = df.select(F.date_format(wall_clock_to_instant(local_wall_clock("d", "s"), F.lit("Europe/Paris")), "yyyy-MM-dd HH:mm").alias("u"))
    assert [r.u for r in inst.collect()] == ["2024-03-31 01:30", "2024-01-02 00:00"]


def _brute_dbscan(points, eps_km, min_samples):
    ids = sorted(points)
    eps = eps_km / 6371.0
    nb = {i: [j for j in ids if _hav(points[i], points[j]) <= eps] for i in ids}
    core = {i for i in ids if len(nb[i]) >= min_samples}
    parent = {i: i for i in core}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in core:
        for j in nb[i]:
            if j in core:
                ri, rj = find(i), find(j)
                if ri != rj:
                    parent[max(ri, rj)] = min(ri, rj)
    cid = {}
    for i in core:
        cid.setdefault(find(i), []).append(i)
    label = {i: min(m) for m in cid.values() for i in m}
    out = {}
    for i in ids:
        if i in core:
            out[i] = label[i]
        else:
            cs = [label[j] for j in nb[i] if j in core]
            out[i] = min(cs) if cs else None
    return out


def test_cluster_min_samples_matches_brute_force(spark):
    rnd = random.Random(11)
    pts = {}
    k = 0
    for c in [(45.0, 2.0), (0.0, 179.95), (70.0, -20.0)]:
        for _ in range(40):
            pts[f"p{k:03d}"] = (c[0] + rnd.uniform(-0.3, 0.3), c[1] + rnd.uniform(-0.3, 0.3))
            k += 1
    pts["dupA"] = pts["p005"]
    pts["dupB"] = pts["p005"]
    df = spark.createDataFrame([(i, la, lo) for i, (la, lo) in pts.items()], "id string, lat double, lon double")
    for ms in (3, 5):
        got = {r.id: r.cluster_id for r in cluster_points(df, eps_km=10.0, min_samples=ms).collect()}
        assert got == _brute_dbscan(pts, 10.0, ms), ms

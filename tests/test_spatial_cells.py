"""Distance joins with radii of every size, and links between facing dense cells."""

import math
import random

from pyspark.sql import functions as F

from cityhop.operators import cluster
from cityhop.operators.cluster import cluster_points
from cityhop.operators.spatial import FINE_CELLS, _occupied_cover, within_radius


def test_radii_of_every_size_match_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(300 + i, 45 + i * 0.1, 2.0) for i in range(20)]
    radii = [0.0, 0.1, 0.4, 0.40001, 3.2, 25.0, 25.7, 120.0, 500.0, None, -1.0, float("nan")]
    probes = [(k, r, rng.uniform(-60, 60), rng.uniform(-120, 120)) for k, r in enumerate(radii)] + [(90, 0.1, 45.0, 2.0), (91, 0.4, 45.5, 2.0)]
    p = spark.createDataFrame(probes, "k int, r double, plat double, plon double")
    q = spark.createDataFrame(pts, "i int, lat double, lon double")
    for strict in (True, False):
        got = within_radius(p, q, probe_lat="plat", probe_lon="plon", radius="r", point_lat="lat", point_lon="lon", strict=strict)
        want = sorted(
            (k, i)
            for k, r, a, b in probes
            for i, x, y in pts
            if r is not None and (math.sqrt((x - a) ** 2 + (y - b) ** 2) < r if strict else math.sqrt((x - a) ** 2 + (y - b) ** 2) <= r)
        )
        assert sorted((t.k, t.i) for t in got.select("k", "i").collect()) == want


def test_a_large_disc_costs_what_it_finds(spark):
    """A radius of 20 degrees: no more rows than occupied cells, where all its cells are 160,000."""
    occupied = spark.range(500).select(F.col("id").alias("_cx"), (F.col("id") % 7).alias("_cy"))
    p = spark.createDataFrame([("a", 20.0, 0.0, 20.0), ("b", 20.0, 0.0, 0.3)], "q string, lat double, lon double, r double")
    met = _occupied_cover(p, occupied, F.col("lat"), F.col("lon"), F.col("r"), 0.1)
    n = {r.q: r["count"] for r in met.groupBy("q").count().collect()}
    assert n["a"] == 401 and n["b"] <= 2 * FINE_CELLS + 2


def test_facing_dense_cells(spark, monkeypatch):
    """Two groups (100,000 points each where no pair links) face each other over a gap: linked by one pair, or not at all, without their point product."""
    compared = []
    real = cluster._points
    monkeypatch.setattr(cluster, "_points", lambda locs, s, level: compared.append(level) or real(locs, s, level))
    eps_km = 1.0
    deg = math.degrees(eps_km / 6371.0)
    for bridge, n, clusters in ((False, 100_000, 2), (True, 10_000, 1)):
        base = spark.range(2 * n).select(
            F.format_string("p%06d", "id").alias("id"),
            ((F.xxhash64("id", F.lit(1)) % 100_000 + 100_000) / 200_000 * deg * 0.15).alias("lat"),
            ((F.xxhash64("id", F.lit(2)) % 100_000 + 100_000) / 200_000 * deg * 0.15 + F.when(F.col("id") < n, 0.0).otherwise(deg * 1.1505)).alias("lon"),
        )
        # a point at the edge of each group, or a little beyond it
        points = base.unionByName(spark.createDataFrame([("x", 0.0, deg * (0.1506 if bridge else 0.149))], "id string, lat double, lon double"))
        assert cluster_points(points, eps_km=eps_km).select("cluster_id").distinct().count() == clusters
    assert max(compared) > 0  # the cells were halved


def test_small_eps(spark):
    """Centimetres: there is no least eps of 45 m."""
    m = math.degrees(0.001 / 6371.0)  # one metre
    rows = [("a", 45.0, 2.0), ("b", 45.0 + 0.4 * m, 2.0), ("c", 45.0 + 0.8 * m, 2.0), ("d", 45.0 + 2 * m, 2.0)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    assert {r.id: r.cluster_id for r in cluster_points(df, eps_km=0.0005).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_halving_equals_direct_comparison(spark, monkeypatch):
    """With cells halved down to few points, clusters, core and border points stay what brute force says."""
    from test_properties import _brute_dbscan

    monkeypatch.setattr(cluster, "DIRECT_PAIRS", 6)
    monkeypatch.setattr(cluster, "DIRECT_POINTS", 3)
    rng = random.Random(5)
    pts = {f"p{i:03d}": (45 + rng.gauss(0, 0.08), 2 + rng.gauss(0, 0.08)) for i in range(60)}
    pts["copy"] = pts["p007"]
    df = spark.createDataFrame([(i, la, lo) for i, (la, lo) in pts.items()], "id string, lat double, lon double")
    assert {r.id: r.cluster_id for r in cluster_points(df, eps_km=6.0, min_samples=4).collect()} == _brute_dbscan(pts, 6.0, 4)

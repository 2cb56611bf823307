"""Density clustering of stops into cities (J15 + O8) and connected components.

A point is *core* when at least ``min_samples`` points (itself and copies
included) lie within eps (haversine distance <= eps); clusters are the
connected components of core points, and other points within eps of a core
point join as border.  With ``min_samples=1`` every point is core.  Nothing
is compared point by point where geometry decides:

1. identical coordinates collapse to one location;
2. locations map to the unit sphere and to micro-cells of side
   ``s = chord(eps) / (2*sqrt(3))``; any two points of a micro-cell, and of
   two micro-cells whose farthest corners are within the chord (offsets
   with sum((|d|+1)^2) <= 12), are within eps -- those cells are linked
   with no point comparison at all;
3. components of that cell graph are computed; only pairs of cells that may
   still link (sum(max(|d|-1,0)^2) <= 12) and lie in *different* components
   are looked at -- dense areas are already one component;
4. whether two such cells hold a link is an existence question: where both
   hold few points these are compared, else both cells are halved along each
   axis and the same two rules decide the pairs of parts, level by level,
   until one link is found or nothing is left that could link;
5. a second components pass over the cell components with those links.

Neighbours are counted (``min_samples > 1``) by the same halving, only for
points of cells whose surroundings do not make them core at once, and only
until the count is reached.

Components use the alternating large-star / small-star iteration (Kiveris
et al., "Connected Components in MapReduce and Beyond", SoCC 2014):
O(log^2 n) rounds, each a couple of joins/aggregations; state lives in
DataFrames, lineage is cut every round with a reliable ``checkpoint()`` in
the session's checkpoint directory.

Cluster id = smallest core point id of the cluster (stable across runs).
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityhop.functions.geo import EARTH_RADIUS_KM, chord_for_angle, haversine_angle, unit_vector
from cityhop.session import ensure_checkpoint_dir, materialize

#: Pairs of points that two cells may hold to be compared directly; cells with more are halved first.
DIRECT_PAIRS = 4096
#: Points of a cell that one point is compared with directly.
DIRECT_POINTS = 256
#: Halvings after which whatever is left is compared directly.
MAX_LEVEL = 16
AXES = ("x", "y", "z")


def _offset_sets():
    auto, cand = [], []
    for d in itertools.product(range(-4, 5), repeat=3):
        if d <= (0, 0, 0):  # each unordered cell pair once (lexicographically positive offsets)
            continue
        far = sum((abs(x) + 1) ** 2 for x in d)
        near = sum(max(abs(x) - 1, 0) ** 2 for x in d)
        if far <= 12:
            auto.append(d)
        elif near <= 12:
            cand.append(d)
    return auto, cand


AUTO_OFFSETS, CANDIDATE_OFFSETS = _offset_sets()


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star step on undirected edges (a, b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    # large-star: connect every larger neighbour of u to the min of u's closed neighbourhood
    m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    ).where(F.col("a") != F.col("b")).distinct()
    both = large.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        large.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    # small-star: connect u and its smaller neighbours to the min of them
    le = both.where(F.col("v") < F.col("u"))
    m2 = le.groupBy("u").agg(F.min("v").alias("m"))
    small = le.join(m2, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        m2.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )
    return small.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Labels (node, label) for every node appearing in ``edges`` (a, b: LONG);
    label = smallest node of the component.  Nodes absent from ``edges``
    are singletons and are the caller's to add."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    cur = materialize(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    for _ in range(max_rounds):
        cur = materialize(_star_round(cur))
        # a forest of stars: every node is either a centre or in one edge to a centre; all edges then lead to the component's minimum
        ends = cur.select(F.col("a").alias("u"), F.lit(1).alias("_out")).unionByName(cur.select(F.col("b").alias("u"), F.lit(0).alias("_out")))
        held = ends.groupBy("u").agg(F.sum("_out").alias("_out"), F.min("_out").alias("_in"))
        if held.where((F.col("_out") > 1) | ((F.col("_out") == 1) & (F.col("_in") == 0))).limit(1).count() == 0:
            break
    else:
        raise RuntimeError("connected components did not converge")
    # Converged: every edge is (member, component minimum).
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("label"))
    ).distinct()


def _with_labels(nodes: DataFrame, key: str, labels: DataFrame, out: str) -> DataFrame:
    return nodes.join(labels.withColumnRenamed("node", key), key, "left").withColumn(
        out, F.coalesce(F.col("label"), F.col(key))
    ).drop("label")


@dataclass(frozen=True)
class _Grid:
    """Micro-cells of one eps.  Coordinates are counted in cell sides, so a part of level L has side 2^-L."""

    eps: float  # radians
    side: float
    chord2: float  # squared chord of eps, in sides
    slack: float  # relative; what rounding may shift, so that geometry decides only where it is sure

    @staticmethod
    def of(eps_km: float) -> _Grid:
        eps = min(eps_km / EARTH_RADIUS_KM, math.pi)
        chord = chord_for_angle(eps)
        if chord < 1e-12:
            raise ValueError("eps is below the resolution of coordinates (about a hundredth of a millimetre)")
        slack = 1e-9 + 4e-15 / chord
        side = chord / (2.0 * math.sqrt(3.0)) * (1.0 - 2.0 * slack)
        return _Grid(eps, side, (chord / side) ** 2, slack)

    def surely_within(self, far2: Column, level: int) -> Column:
        return far2 <= F.lit(self.chord2 * 4.0**level * (1.0 - self.slack))

    def surely_beyond(self, near2: Column, level: int) -> Column:
        return near2 > F.lit(self.chord2 * 4.0**level * (1.0 + self.slack))

    def linked(self, a: str, b: str) -> Column:
        return haversine_angle(f"lat_{a}", f"lon_{a}", f"lat_{b}", f"lon_{b}") <= F.lit(self.eps)


def _part(axis: str, level: int) -> Column:
    return F.floor(F.col(f"u{axis}") * F.lit(2.0**level))


def _sum(terms) -> Column:
    return functools.reduce(operator.add, terms)


def _square(c: Column) -> Column:
    return c * c


def _locations(points: DataFrame, grid: _Grid) -> tuple[DataFrame, DataFrame]:
    """Distinct locations (lat, lon, loc_id, mult, ux, uy, uz, cell) and their cells (cell, ix, iy, iz, n, m: locations, points)."""
    good = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    at = points.where(good).groupBy("lat", "lon").agg(F.min("id").alias("loc_id"), F.count("*").alias("mult"))
    at = at.select("*", *[(c / F.lit(grid.side)).alias(f"u{x}") for x, c in zip(AXES, unit_vector("lat", "lon"))])
    at = materialize(at.select("*", *[_part(x, 0).alias(f"i{x}") for x in AXES]))
    index = [f"i{x}" for x in AXES]
    cells = at.groupBy(*index).agg(F.count("*").alias("n"), F.sum("mult").alias("m"))
    # the checkpointed table fixes the numbers: nothing reads them before it is written
    cells = materialize(cells.withColumn("cell", F.monotonically_increasing_id()))
    return materialize(at.join(cells.select("cell", *index), index).drop(*index)), cells


def _cell_pairs(left: DataFrame, right: DataFrame, offsets, both_ways: bool = False) -> DataFrame:
    """Pairs (a, b) of cells of two cell tables that lie at one of ``offsets`` from each other."""
    offsets = [*offsets, *(tuple(-x for x in d) for d in offsets)] if both_ways else offsets
    # one literal, folded when the plan is optimised: hundreds of column objects take longer than the join
    moves = F.from_json(F.lit(json.dumps([dict(zip(AXES, d)) for d in offsets])), "array<struct<x:bigint,y:bigint,z:bigint>>")
    probe = left.select(F.col("cell").alias("a"), *[f"i{x}" for x in AXES], F.explode(moves).alias("_d"))
    probe = probe.select("a", *[(F.col(f"i{x}") + F.col(f"_d.{x}")).alias(f"i{x}") for x in AXES])
    return probe.join(right.select(F.col("cell").alias("b"), *[f"i{x}" for x in AXES]), [f"i{x}" for x in AXES]).select("a", "b")


def _boxes(cells: DataFrame, s: str) -> DataFrame:
    return cells.select(F.col("cell").alias(s), *[F.col(f"i{x}").alias(f"{s}{x}") for x in AXES], F.col("n").alias(f"{s}_n"), F.col("m").alias(f"{s}_m"))


def _parts(locs: DataFrame, s: str, level: int) -> DataFrame:
    """The occupied parts of each cell at a level, with the index of the part they halve."""
    parts = locs.groupBy(F.col("cell").alias(s), *[_part(x, level).alias(f"{s}{x}") for x in AXES]).agg(F.count("*").alias(f"{s}_n"), F.sum("mult").alias(f"{s}_m"))
    return parts.select("*", *[F.shiftright(f"{s}{x}", 1).alias(f"{s}{x}_up") for x in AXES])


def _halved(frontier: DataFrame, locs: DataFrame, s: str, level: int) -> DataFrame:
    """Each row's part of side ``s`` replaced by the occupied parts of the next level inside it."""
    up = frontier.drop(f"{s}_n", f"{s}_m").withColumnsRenamed({f"{s}{x}": f"{s}{x}_up" for x in AXES})
    inside = locs.join(frontier.select(F.col(s).alias("cell")).distinct(), "cell", "left_semi")
    return up.join(_parts(inside, s, level), [s, *[f"{s}{x}_up" for x in AXES]]).drop(*[f"{s}{x}_up" for x in AXES])


def _points(locs: DataFrame, s: str, level: int) -> DataFrame:
    return locs.select(F.col("cell").alias(s), *[_part(x, level).alias(f"{s}{x}") for x in AXES], F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("mult").alias(f"{s}_mult"))


def _all_of(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _links(locs: DataFrame, cells: DataFrame, pairs: DataFrame, grid: _Grid) -> DataFrame:
    """Of cell pairs (a, b, la, lb), the labels (la, lb) of those that hold two locations within eps.

    Level by level; labels that are linked already leave the search, so it stops at the first link.
    """
    frontier = pairs.join(_boxes(cells, "a"), "a").join(_boxes(cells, "b"), "b")
    found = []
    for level in range(MAX_LEVEL + 1):
        frontier = materialize(frontier)
        few = F.lit(level == MAX_LEVEL) | (F.col("a_n") * F.col("b_n") <= DIRECT_PAIRS)
        ends = [_points(locs, s, level) for s in ("a", "b")]
        direct = frontier.where(few).join(ends[0], ["a", *[f"a{x}" for x in AXES]]).join(ends[1], ["b", *[f"b{x}" for x in AXES]])
        found.append(direct.where(grid.linked("a", "b")).select("la", "lb").distinct())
        rest = frontier.where(~few)
        if rest.limit(1).count() == 0:
            break
        found[-1] = materialize(found[-1])
        rest = rest.join(found[-1], ["la", "lb"], "left_anti")
        gap = {x: F.abs(F.col(f"a{x}") - F.col(f"b{x}")).cast("double") for x in AXES}
        far2, near2 = _sum(_square(g + 1) for g in gap.values()), _sum(_square(F.greatest(g - 1, F.lit(0.0))) for g in gap.values())
        halves = _halved(_halved(rest, locs, "a", level + 1), locs, "b", level + 1)
        halves = materialize(halves.withColumn("sure", grid.surely_within(far2, level + 1)).where(~grid.surely_beyond(near2, level + 1)))
        found.append(halves.where("sure").select("la", "lb").distinct())
        frontier = halves.where(~F.col("sure")).drop("sure").join(found[-1], ["la", "lb"], "left_anti")
    return _all_of(found).distinct()


def _counts(locs: DataFrame, cells: DataFrame, pairs: DataFrame, keys: list[str], grid: _Grid) -> DataFrame:
    """(``keys``, w): how many points of the cells ``b`` lie within eps of a location, at least up to ``need``.

    ``pairs``: ``keys``, need, lat_a, lon_a, ux, uy, uz of the location, and b.  A part that lies wholly within eps counts
    whole; a key that has what it needs leaves the search.
    """
    frontier = pairs.join(_boxes(cells, "b"), "b")
    sums = []
    for level in range(MAX_LEVEL + 1):
        lo = {x: F.col(f"b{x}") - F.col(f"u{x}") * F.lit(2.0**level) for x in AXES}  # from the location to the part's lower face
        far2 = _sum(_square(F.greatest(F.abs(g), F.abs(g + 1))) for g in lo.values())
        near2 = _sum(_square(F.greatest(g, -g - 1, F.lit(0.0))) for g in lo.values())
        frontier = materialize(frontier.withColumn("sure", grid.surely_within(far2, level)).where(~grid.surely_beyond(near2, level)))
        few = F.lit(level == MAX_LEVEL) | (F.col("b_n") <= DIRECT_POINTS)
        open_ = frontier.where(~F.col("sure"))
        direct = open_.where(few).join(_points(locs, "b", level), ["b", *[f"b{x}" for x in AXES]]).where(grid.linked("a", "b"))
        seen = frontier.where("sure").select(*keys, F.col("b_m").alias("w")).unionByName(direct.select(*keys, F.col("b_mult").alias("w")))
        sums.append(seen.groupBy(*keys).agg(F.sum("w").alias("w")))
        rest = open_.where(~few).drop("sure")
        if rest.limit(1).count() == 0:
            break
        sums[-1] = materialize(sums[-1])
        so_far = _all_of(sums).groupBy(*keys).agg(F.sum("w").alias("w"))
        enough = frontier.select(*keys, "need").distinct().join(so_far, keys).where(F.col("w") >= F.col("need"))
        frontier = _halved(rest.join(enough, keys, "left_anti"), locs, "b", level + 1)
    return _all_of(sums).groupBy(*keys).agg(F.sum("w").alias("w"))


def _core(locs: DataFrame, cells: DataFrame, min_samples: int, grid: _Grid) -> DataFrame:
    """Locations with ``core``: at least ``min_samples`` points within eps.  Cells whose own points and those of the cells
    that lie wholly within eps are enough need no comparison; any other holds fewer than ``min_samples`` points."""
    around = _cell_pairs(cells, cells, AUTO_OFFSETS, both_ways=True).join(cells.select(F.col("cell").alias("b"), "m"), "b").groupBy("a").agg(F.sum("m").alias("am"))
    sure = cells.join(around.withColumnRenamed("a", "cell"), "cell", "left").withColumn("need", F.lit(int(min_samples)) - F.col("m") - F.coalesce("am", F.lit(0)))
    sure = materialize(sure.select("cell", *[f"i{x}" for x in AXES], "need"))
    thin = sure.where(F.col("need") > 0)
    near = _cell_pairs(thin, cells, CANDIDATE_OFFSETS, both_ways=True).withColumnRenamed("a", "cell")
    asked = locs.join(thin.select("cell", "need"), "cell").join(near, "cell").select("loc_id", "need", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "ux", "uy", "uz", "b")
    counted = _counts(locs, cells, asked, ["loc_id"], grid)
    out = locs.join(sure.select("cell", "need"), "cell").join(counted, "loc_id", "left")
    return materialize(out.withColumn("core", F.coalesce("w", F.lit(0)) >= F.col("need")).drop("w", "need"))


def _border(border: DataFrame, core: DataFrame, cells: DataFrame, core_cells: DataFrame, grid: _Grid) -> DataFrame:
    """(loc_id, cluster_id) of the locations of ``border`` that have a core location within eps: the smallest such cluster.
    ``core_cells`` has the cluster_id of each cell with core locations (one cell's core locations are one cluster)."""
    at = cells.join(border.select("cell").distinct(), "cell", "left_semi")
    whole = _cell_pairs(at, core_cells, AUTO_OFFSETS, both_ways=True).unionByName(core_cells.select(F.col("cell").alias("a"), F.col("cell").alias("b")))
    sure = border.select("loc_id", F.col("cell").alias("a")).join(whole, "a").select("loc_id", "b")
    maybe = border.join(_cell_pairs(at, core_cells, CANDIDATE_OFFSETS, both_ways=True).withColumnRenamed("a", "cell"), "cell")
    maybe = maybe.select("loc_id", F.col("b").alias("of"), F.lit(1).alias("need"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "ux", "uy", "uz", "b")
    near = _counts(core, core_cells, maybe, ["loc_id", "of"], grid).select("loc_id", F.col("of").alias("b"))
    clusters = core_cells.select(F.col("cell").alias("b"), "cluster_id")
    return sure.unionByName(near).join(clusters, "b").groupBy("loc_id").agg(F.min("cluster_id").alias("cluster_id"))


def cluster_points(points: DataFrame, eps_km: float = 1.0, min_samples: int = 1) -> DataFrame:
    """(id, cluster_id) for points (id STRING, lat, lon degrees).

    Neighbours: haversine distance <= eps_km on a 6371 km sphere.  Points
    with NULL/NaN coordinates are not clustered (cluster_id NULL).  With
    ``min_samples > 1`` a border point joins the smallest cluster id among
    its core neighbours, and points without one are noise (cluster_id NULL).
    """
    ensure_checkpoint_dir(points.sparkSession)
    grid = _Grid.of(eps_km)
    pts = points.select("id", "lat", "lon")
    locs, cells = _locations(pts, grid)
    dense = min_samples > 1
    if dense:
        marked = _core(locs, cells, min_samples, grid)
        core = marked.where("core").drop("core")
        live = core.groupBy("cell").agg(F.count("*").alias("n"), F.sum("mult").alias("m"))
        core_cells = materialize(cells.drop("n", "m").join(live, "cell"))
    else:
        core, core_cells = locs, cells

    first = connected_components(_cell_pairs(core_cells, core_cells, AUTO_OFFSETS))
    lab1 = _with_labels(core_cells.select("cell"), "cell", first, "c1")  # cell -> c1
    ends = [lab1.select(F.col("cell").alias(s), F.col("c1").alias(f"l{s}")) for s in ("a", "b")]
    apart = _cell_pairs(core_cells, core_cells, CANDIDATE_OFFSETS).join(ends[0], "a").join(ends[1], "b").where(F.col("la") != F.col("lb"))
    apart = apart.select("a", "b", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
    linked = _links(core, core_cells, apart, grid).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    lab2 = _with_labels(lab1.select("c1").distinct(), "c1", connected_components(linked), "c2")  # c1 -> c2
    labels = lab1.join(lab2, "c1").select("cell", "c2")
    smallest = core.join(labels, "cell").groupBy("c2").agg(F.min("loc_id").alias("cluster_id"))
    core_cells = materialize(core_cells.join(labels, "cell").join(smallest, "c2").drop("c2"))

    clustered = core.join(core_cells.select("cell", "cluster_id"), "cell").select("lat", "lon", "cluster_id")
    if dense:
        border = marked.where(~F.col("core"))
        joined = _border(border, core, cells, core_cells, grid)
        clustered = clustered.unionByName(border.join(joined, "loc_id").select("lat", "lon", "cluster_id"))
    return pts.join(clustered, ["lat", "lon"], "left").select("id", "cluster_id")


def cluster_stops(stops: DataFrame, eps_km: float = 1.0, min_samples: int = 1) -> DataFrame:
    """O8 on a stop table (stop_id, stop_lat, stop_lon, ...): adds ``city_id``.

    The stop table (one row per distinct stop of the network) is
    materialised once: the clustering reads it several times.
    """
    ensure_checkpoint_dir(stops.sparkSession)
    stops = materialize(stops)
    pts = stops.select(F.col("stop_id").alias("id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    labels = cluster_points(pts, eps_km=eps_km, min_samples=min_samples)
    return stops.join(labels.withColumnRenamed("id", "stop_id").withColumnRenamed("cluster_id", "city_id"), "stop_id", "left")

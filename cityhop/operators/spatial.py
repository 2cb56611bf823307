"""Distance joins on a planar degree grid (F1, J11, J12 building block).

A "probe" side carries a radius per row (places, cities); it is exploded over
the grid cells its disc touches, so each row of the large side (stops,
destination rows) lands in exactly one cell and is never replicated.  The
join is an equi-join on the cell, so Spark/AQE picks a broadcast hash join
when the probe side turns out small at runtime and a shuffled join beyond
that -- no hand-written broadcast of an unbounded side.  The exact distance
predicate is re-checked after the join.

A probe of radius r costs about (2r/cell + 2)^2 rows while r is at most
:data:`FINE_CELLS` cells.  A larger disc is covered by coarser cells, at most
(2*FINE_CELLS + 2)^2 of them whatever its radius, which are looked up among
the cells that hold points at all; so it costs one row per occupied cell that
it touches, and points are never copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityhop.functions.geo import cell_range, covering_cells, grid_cell, planar_distance

DEFAULT_CELL_DEG = 0.1
DEFAULT_MARGIN = 1.05
#: Radius, in cells, up to which a disc's cells are listed one by one.
FINE_CELLS = 4
#: Each coarser level's cells are this many times wider; at the last one a disc of any radius touches few cells.
COARSER = 8
LEVELS = 5


def within_radius(
    probes: DataFrame,
    points: DataFrame,
    *,
    probe_lat: str,
    probe_lon: str,
    radius: str,
    point_lat: str,
    point_lon: str,
    strict: bool,
    cell: float = DEFAULT_CELL_DEG,
    distance_col: str | None = None,
    max_radius: float | None = None,
) -> DataFrame:
    """Rows (probe, point) with planar distance < radius (``strict``) or <= radius.

    Column names of the two sides must be disjoint.  Probes with a NULL, NaN
    or negative radius (or zero radius when strict) match nothing.
    ``max_radius``: a radius that no probe exceeds, where one is known; up to
    FINE_CELLS cells it spares the look-up of occupied cells.
    """
    r = F.col(radius)
    usable = r.isNotNull() & ~F.isnan(r) & ((r > 0) if strict else (r >= 0))
    p = probes.where(usable & F.col(probe_lat).isNotNull() & F.col(probe_lon).isNotNull())
    q = points.where(F.col(point_lat).isNotNull() & F.col(point_lon).isNotNull())
    q = q.withColumn("_cx", grid_cell(point_lat, cell)).withColumn("_cy", grid_cell(point_lon, cell))
    if max_radius is not None and max_radius <= FINE_CELLS * cell:
        p = p.withColumn("_cx", F.explode(covering_cells(F.col(probe_lat), r, cell))).withColumn(
            "_cy", F.explode(covering_cells(F.col(probe_lon), r, cell))
        )
    else:
        p = _occupied_cover(p, q.select("_cx", "_cy").distinct(), F.col(probe_lat), F.col(probe_lon), r, cell)
    d = planar_distance(point_lat, point_lon, probe_lat, probe_lon)
    joined = p.join(q, ["_cx", "_cy"]).where(d < r if strict else d <= r).drop("_cx", "_cy")
    if distance_col:
        joined = joined.withColumn(distance_col, d)
    return joined


def _level(radius, cell: float):
    """Coarseness of a disc's cover: the first level at which the radius is at most FINE_CELLS cells, else the last."""
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(radius <= F.lit(FINE_CELLS * cell * COARSER**k), F.lit(k)).otherwise(level)
    return level


def _coarse(index, level):
    """The index, at a level, of the cell that holds a fine cell (or range end) of index ``index``."""
    return F.floor(index / F.pow(F.lit(float(COARSER)), level)).cast("long")


def _occupied_cover(probes: DataFrame, occupied: DataFrame, lat, lon, radius, cell: float) -> DataFrame:
    """Probes joined to the occupied fine cells (_cx, _cy) that their disc may touch.

    Both meet on cells of the probe's level: at most (2*FINE_CELLS + 2)^2 rows per probe, LEVELS rows per occupied cell
    (there are no more of these than cells on the globe).  A fine cell outside the disc's bounding square is dropped.
    """
    ends = dict(zip(("_x0", "_x1", "_y0", "_y1"), (*cell_range(lat, radius, cell), *cell_range(lon, radius, cell))))
    p = probes.withColumn("_level", _level(radius, cell)).withColumns(ends)
    for lo, hi, k in (("_x0", "_x1", "_kx"), ("_y0", "_y1", "_ky")):
        p = p.withColumn(k, F.explode(F.sequence(_coarse(F.col(lo), F.col("_level")), _coarse(F.col(hi), F.col("_level")))))
    o = occupied.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(LEVELS)])))
    o = o.withColumns({k: _coarse(F.col(c), F.col("_level")) for c, k in (("_cx", "_kx"), ("_cy", "_ky"))})
    met = p.join(o, ["_level", "_kx", "_ky"]).where(F.col("_cx").between(F.col("_x0"), F.col("_x1")) & F.col("_cy").between(F.col("_y0"), F.col("_y1")))
    return met.drop("_level", "_kx", "_ky", *ends)


def nearby_stops(
    net,
    places: DataFrame,
    *,
    margin: float = DEFAULT_MARGIN,
    cell: float = DEFAULT_CELL_DEG,
    min_radius: float = 0.0,
    boardable_only: bool = True,
) -> DataFrame:
    """stops strictly within ``margin * max_distance`` (degrees) of each place.

    ``places`` needs query_id, lat, lon, max_distance; other columns pass
    through (request period, transports...).  STATION feeds answer with
    platforms only.  Output adds feed_id, stop_id, stop_name, stop_lat,
    stop_lon, stop_timezone, parent_station, feed_kind, feed_priority,
    timezone, area_id.  A ``transports`` array column, when present, keeps only
    the listed feeds (NULL = all).
    """
    stops = net.stops_with_kind()
    if boardable_only:
        stops = stops.where("boardable")
    stops = stops.drop("boardable")
    radius = F.greatest(F.lit(float(margin)) * F.col("max_distance"), F.lit(float(min_radius)))
    probes = places.withColumn("_radius", radius)
    out = within_radius(
        probes,
        stops,
        probe_lat="lat",
        probe_lon="lon",
        radius="_radius",
        point_lat="stop_lat",
        point_lon="stop_lon",
        strict=True,
        cell=cell,
    ).drop("_radius")
    if "transports" in places.columns:
        out = out.where(F.col("transports").isNull() | F.array_contains(F.col("transports"), F.col("feed_id")))
    return out

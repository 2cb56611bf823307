"""Geometry expressions (all built-in Catalyst expressions, no UDF).

Distances are written as ``(a-b)*(a-b)`` rather than ``pow`` so the same
IEEE operations run in every engine the results are compared with.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def planar_distance(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degrees (the engine's notion of "near")."""
    dlat = _c(lat1) - _c(lat2)
    dlon = _c(lon1) - _c(lon2)
    return F.sqrt(dlat * dlat + dlon * dlon)


def unit_vector(lat, lon) -> list[Column]:
    """Point on the unit sphere; valid for any angle, even |lat| > 90."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def haversine_angle(lat1, lon1, lat2, lon2) -> Column:
    """Central angle in radians between two (lat, lon) points in degrees."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = p2 - p1
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def chord_for_angle(angle_rad: float) -> float:
    """Straight-line distance on the unit sphere for a central angle."""
    return 2.0 * math.sin(angle_rad / 2.0)


def grid_cell(value, cell: float) -> Column:
    return F.floor(_c(value) / F.lit(float(cell))).cast("long")


def covering_cells(center, radius, cell: float) -> Column:
    """All grid indices whose cell can hold a point within ``radius`` of ``center``."""
    return F.sequence(*cell_range(center, radius, cell))


def cell_range(center, radius, cell: float) -> tuple[Column, Column]:
    """First and last grid index whose cell can hold a point within ``radius`` of ``center``.

    The radius is padded by a relative 1e-9 so rounding at cell borders never
    loses a candidate; the exact predicate is re-checked after the join.
    """
    pad = _c(radius) * F.lit(1.0 + 1e-9) + F.lit(1e-12)
    lo = F.floor((_c(center) - pad) / F.lit(float(cell))).cast("long")
    hi = F.floor((_c(center) + pad) / F.lit(float(cell))).cast("long")
    return lo, hi

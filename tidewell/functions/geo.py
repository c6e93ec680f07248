"""Geometry as column expressions: everything stays inside generated code on the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in km, km per nautical mile.
EARTH_KM = 6371.0
NAUTICAL_KM = 1.852

Ring = Sequence[tuple[float, float]]


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lon1: Column | float, lat1: Column | float, lon2: Column | float, lat2: Column | float) -> Column:
    """Great-circle distance in km."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0)))) * (2 * EARTH_KM)


def project_point(lon: Column, lat: Column, seconds: float, knots: Column, heading: Column) -> tuple[Column, Column]:
    """Where a mover is after some seconds on a great circle; rounded half up to 6 decimals."""
    d = _c(knots) * NAUTICAL_KM * (seconds / 3600.0) / EARTH_KM
    b, la, lo = F.radians(_c(heading)), F.radians(_c(lat)), F.radians(_c(lon))
    la2 = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
    lo2 = lo + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(la2))
    return F.round(F.degrees(lo2), 6), F.round(F.degrees(la2), 6)


def edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    """The sides of a closed ring."""
    r = list(ring)
    if len(r) < 3:
        raise ValueError("a ring needs three corners")
    if r[0] != r[-1]:
        r.append(r[0])
    return [(*a, *b) for a, b in zip(r, r[1:], strict=False)]


def in_polygon(lon: Column, lat: Column, ring: Ring) -> Column:
    """Point in polygon by crossing count. Points exactly on a side may fall on either side."""
    crossings = [
        F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < F.lit(x2 - x1) * (lat - y1) / F.lit(y2 - y1) + x1), 1).otherwise(0)
        for x1, y1, x2, y2 in edges(ring)
        if y1 != y2
    ]
    return reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1


def ring_distance(lon: Column, lat: Column, ring: Ring) -> Column:
    """Distance from a point to the sides of a ring, in the units of the coordinates."""

    def side(x1: float, y1: float, x2: float, y2: float) -> Column:
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - x1) * dx + (lat - y1) * dy) / F.lit(n))) if n else F.lit(0.0)
        return F.sqrt(F.pow(lon - (t * dx + x1), 2) + F.pow(lat - (t * dy + y1), 2))

    d = [side(*e) for e in edges(ring)]
    return d[0] if len(d) == 1 else F.least(*d)


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(a: Sequence[Column | float], b: Sequence[Column | float]) -> Column:
    """Do two segments (x1, y1, x2, y2) share a point?"""
    ax, ay, bx, by = map(_c, a)
    cx, cy, dx, dy = map(_c, b)
    o1, o2 = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)
    o3, o4 = _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)

    def on(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return (rx >= F.least(px, qx)) & (rx <= F.greatest(px, qx)) & (ry >= F.least(py, qy)) & (ry <= F.greatest(py, qy))

    return (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & on(ax, ay, bx, by, cx, cy))
        | ((o2 == 0) & on(ax, ay, bx, by, dx, dy))
        | ((o3 == 0) & on(cx, cy, dx, dy, ax, ay))
        | ((o4 == 0) & on(cx, cy, dx, dy, bx, by))
    )


def segment_meets_ring(segment: Sequence[Column | float], ring: Ring) -> Column:
    """Does a segment cross or touch a side of the ring, or lie inside it?"""
    hits = [segments_meet(segment, e) for e in edges(ring)]
    return reduce(lambda a, b: a | b, hits) | in_polygon(_c(segment[0]), _c(segment[1]), ring)

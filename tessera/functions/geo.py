"""Points and planar shapes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6372797.560856
METRES = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 0.3048}


def metres(radius: float, unit: str) -> float:
    if unit.lower() not in METRES:
        raise ValueError(f"unknown unit {unit!r}")
    return radius * METRES[unit.lower()]


def point(col: Column) -> tuple[Column, Column]:
    """(lon, lat) of a 'lon,lat' text; null where it is not one or out of range."""
    parts = F.split(col, ",")
    lon, lat = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    fine = (F.size(parts) == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(fine, lon), F.when(fine, lat)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_radius(lon: Column, lat: Column, x: float, y: float, limit: float) -> Column:
    """Inside the circle; a plain latitude band comes first, which a scan can use."""
    band = limit / EARTH * 57.29577951308232 + 1e-9
    return lat.between(y - band, y + band) & (haversine(F.lit(x), F.lit(y), lon, lat) <= limit)


@dataclass(frozen=True)
class Shape:
    """A point, or the outer ring of a polygon without its closing vertex."""

    kind: str
    points: tuple[tuple[float, float], ...]

    @property
    def box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.points)
        return min(xs), min(ys), max(xs), max(ys)


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_POINT = re.compile(rf"^\s*POINT\s*\(\s*({_NUMBER})\s+({_NUMBER})\s*\)\s*$", re.I)
_POLYGON = re.compile(r"^\s*POLYGON\s*\(\s*\(([^()]*)\)", re.I)


def parse_shape(text: str | None) -> Shape | None:
    """POINT and POLYGON of well-known text; holes are ignored; None where it is neither."""
    if not isinstance(text, str):
        return None
    if m := _POINT.match(text):
        return Shape("point", ((float(m[1]), float(m[2])),))
    if not (m := _POLYGON.match(text)):
        return None
    pts = []
    for part in m[1].split(","):
        xy = part.split()
        if len(xy) != 2:
            return None
        try:
            pts.append((float(xy[0]), float(xy[1])))
        except ValueError:
            return None
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    return Shape("polygon", tuple(pts)) if len(pts) >= 3 else None


def covers_point(s: Shape, x: float, y: float) -> bool:
    if s.kind == "point":
        return s.points[0] == (x, y)
    odd = False
    for (x1, y1), (x2, y2) in zip(s.points, s.points[-1:] + s.points[:-1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def covers(s: Shape, other: Shape) -> bool:
    """Every vertex of other lies in s; a point covers nothing."""
    return s.kind != "point" and all(covers_point(s, x, y) for x, y in other.points)


def _side(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _cross(p: tuple, q: tuple, r: tuple, s: tuple) -> bool:
    return _side(r, s, p) * _side(r, s, q) < 0 and _side(p, q, r) * _side(p, q, s) < 0


def meets(s: Shape, other: Shape) -> bool:
    """A vertex of one lies in the other, or two edges properly cross."""
    if "point" in (s.kind, other.kind):
        a, b = (s, other) if s.kind == "point" else (other, s)
        return a.points == b.points if b.kind == "point" else covers_point(b, *a.points[0])
    if any(covers_point(s, *p) for p in other.points) or any(covers_point(other, *p) for p in s.points):
        return True
    ring = lambda x: list(zip(x.points, x.points[1:] + x.points[:1]))
    return any(_cross(*e, *f) for e in ring(s) for f in ring(other))


def holds(op: str, own: Shape, asked: Shape) -> bool:
    """Whether a stored shape stands in the relation to the one asked for."""
    a, b = own.box, asked.box
    inside = lambda p, q: p[0] <= q[0] and p[1] <= q[1] and p[2] >= q[2] and p[3] >= q[3]
    apart = a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1]
    if op == "WITHIN":
        return inside(b, a) and covers(asked, own)
    if op == "CONTAINS":
        return inside(a, b) and covers(own, asked)
    if op == "INTERSECTS":
        return not apart and meets(own, asked)
    if op == "DISJOINT":
        return apart or not meets(own, asked)
    raise ValueError(f"unknown relation {op!r}")


def shape_holds(col: Column, op: str, asked: Shape) -> Column:
    """holds() over a column of well-known text; false where that cannot be read."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: (own := parse_shape(t)) is not None and holds(op, own, asked)).astype(bool)

    return run(col)


def point_in_polygon(x: Column, y: Column, ring: Shape) -> Column:
    """Ray casting as plain columns."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring.points, ring.points[-1:] + ring.points[:-1]):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1)))
            crossings = crossings + F.when(hit, 1).otherwise(0)
    x0, y0, x1, y1 = ring.box
    return x.between(x0, x1) & y.between(y0, y1) & (crossings % 2 == 1)

"""Regions: corner order, areas, growth, projection, crop sizes, reading order.

A quad is an ``array<struct<x, y>>`` of four points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import READING_ORDER_TOLERANCE


def canonical_quad(points: Column) -> Column:
    """Top-left, top-right, bottom-right, bottom-left: by x, then y, the left and the right pair each by y."""
    p = F.array_sort(points)
    upper = lambda a, b: F.when(p[a]["y"] <= p[b]["y"], p[a]).otherwise(p[b])
    lower = lambda a, b: F.when(p[a]["y"] <= p[b]["y"], p[b]).otherwise(p[a])
    return F.array(upper(0, 1), upper(2, 3), lower(2, 3), lower(0, 1))


def double_area(points: Column) -> Column:
    """Twice the signed area (shoelace); positive if clockwise on a page whose y grows downward."""
    terms = [points[i]["x"] * points[(i + 1) % 4]["y"] - points[(i + 1) % 4]["x"] * points[i]["y"] for i in range(4)]
    return ((terms[0] + terms[1]) + terms[2]) + terms[3]


def strictly_convex(points: Column) -> Column:
    """All four turns to the right."""
    ok = F.lit(True)
    for i in range(4):
        a, b, c = points[i], points[(i + 1) % 4], points[(i + 2) % 4]
        ok = ok & ((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]) > 0)
    return ok


def inside(points: Column, width: Column, height: Column, last: int = 1) -> Column:
    """Every point in [0, width - last] x [0, height - last]."""
    ok = F.lit(True)
    for i in range(4):
        ok = ok & points[i]["x"].between(F.lit(0), width - last) & points[i]["y"].between(F.lit(0), height - last)
    return ok


def _edge(points: Column, a: int, b: int) -> Column:
    dx, dy = points[a]["x"] - points[b]["x"], points[a]["y"] - points[b]["y"]
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def crop_width(points: Column) -> Column:
    return F.floor(F.greatest(_edge(points, 0, 1), _edge(points, 3, 2))).cast("int")


def crop_height(points: Column) -> Column:
    return F.floor(F.greatest(_edge(points, 0, 3), _edge(points, 1, 2))).cast("int")


def unclip_distance(short: Column, long: Column, ratio: float = 1.5) -> Column:
    """How far each side of a rectangle moves outward: area * ratio / perimeter."""
    return short * long * ratio / (2 * (short + long))


def project(value: Column, scale: Column, size: Column) -> Column:
    """A map coordinate on the page: divided by the scale, rounded half to even, clamped; never -0."""
    return F.least(F.greatest(F.rint(value / scale) + F.lit(0.0), F.lit(0.0)), size - 1)


def reading_order(items: str) -> Column:
    """Items (y, x, i, ...) as read: by (y, x), then each moves left past neighbours on its line that lie right of it."""
    t = READING_ORDER_TOLERANCE
    passed = f"coalesce(array_max(transform(acc, (a, j) -> if(abs(it.y - a.y) < {t} and it.x < a.x, 0, j + 1))), 0)"
    return F.expr(f"aggregate(array_sort({items}), filter({items}, z -> false), (acc, it) -> concat(slice(acc, 1, {passed}), array(it), slice(acc, {passed} + 1, greatest(size(acc), 1))))")

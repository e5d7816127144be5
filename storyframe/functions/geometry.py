"""Boxes as columns: x0, y0, x1, y1 (exclusive), in pixels or as shares of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + n) for n in ("x0", "y0", "x1", "y1"))


def valid(b: Box) -> Column:
    """Within [0, 1], with a positive extent."""
    return (b[0] >= 0) & (b[1] >= 0) & (b[2] <= 1) & (b[3] <= 1) & (b[2] > b[0]) & (b[3] > b[1])


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def overlap(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def containment(inner: Box, outer: Box) -> Column:
    """Share of the inner box that the outer one covers; 0 without area."""
    return F.when(area(inner) == 0, 0.0).otherwise(F.try_divide(overlap(inner, outer).cast("double"), area(inner)))


def gap(a: Box, b: Box) -> Column:
    """Manhattan distance of the edges, 0 when they touch."""
    return F.greatest(F.lit(0), F.greatest(a[0], b[0]) - F.least(a[2], b[2])) + F.greatest(F.lit(0), F.greatest(a[1], b[1]) - F.least(a[3], b[3]))


def union(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def distance2(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def to_share(v: Column, extent, far: bool = False) -> Column:
    return F.least(F.lit(1.0), v / extent) if far else v / extent


def to_pixel(v: Column, extent) -> Column:
    """Half-even rounding."""
    return F.bround(v * extent).cast("int")


def padded(b: Box, margin: float, width, height) -> Box:
    """A crop window: the box padded by a share of its size, clipped to the page."""
    px, py = ((b[2] - b[0]) * margin).cast("int"), ((b[3] - b[1]) * margin).cast("int")
    return F.greatest(F.lit(0), b[0] - px), F.greatest(F.lit(0), b[1] - py), F.least(F.lit(width), b[2] + px), F.least(F.lit(height), b[3] + py)


def letterbox(width: Column, height: Column, target: int) -> tuple[Column, Column, Column]:
    """(scale, x offset, y offset) that fit an image into a square."""
    scale = F.least(target / width, target / height)
    return scale, F.floor((target - F.bround(width * scale)) / 2), F.floor((target - F.bround(height * scale)) / 2)


def shrunk(width: Column, height: Column, cap: int) -> tuple[Column, Column]:
    """Size with the long edge at most ``cap``."""
    long = F.greatest(width, height)
    return tuple(F.when(long > cap, F.greatest(F.lit(1), F.bround(v * cap / long))).otherwise(v).cast("int") for v in (width, height))

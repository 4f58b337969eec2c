"""Point and rectangle arithmetic as column expressions.

A point is a pair of columns (x, y); a rectangle is four columns (x, y, w, h).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_even

Point = tuple[Column, Column]
Rect = tuple[Column, Column, Column, Column]


def add(a: Point, b: Point) -> Point:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def scale(a: Point, factor) -> Point:
    return a[0] * factor, a[1] * factor


def rotate(a: Point, degrees) -> Point:
    angle = (degrees if isinstance(degrees, Column) else F.lit(degrees)) * (math.pi / 180)
    return (a[0] * F.cos(angle) - a[1] * F.sin(angle),
            a[0] * F.sin(angle) + a[1] * F.cos(angle))


def rotate_around(a: Point, origin: Point, degrees) -> Point:
    return add(rotate(subtract(a, origin), degrees), origin)


def scale_around(a: Point, origin: Point, factor) -> Point:
    return add(scale(subtract(a, origin), factor), origin)


def scaled_value(v: Column, factor, top, whole: bool = False) -> Column:
    """v·factor, at most `top`; optionally rounded to a whole number."""
    r = half_even(v * factor) if whole else v * factor
    return F.least(r, F.lit(top))


def distance(a: Point, b: Point) -> Column:
    dx, dy = subtract(a, b)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def angle_between(a: Point, b: Point) -> Column:
    """Direction from a to b in degrees."""
    dx = F.when(b[0] == a[0], F.lit(1e-8)).otherwise((b[0] - a[0]).cast("double"))
    return F.atan2((b[1] - a[1]).cast("double"), dx) * (180 / math.pi)


def map_rotated(p: Point, size: Point, degrees, factor) -> Point:
    """Where a point lands when its image is rotated and scaled about the centre."""
    centre = scale(size, 0.5)
    return add(scale(rotate(subtract(p, centre), degrees), factor), scale(centre, factor))


def scale_rect(r: Rect, sx: float, sy: float, w: int = 0, h: int = 0) -> Rect:
    x, y = half_even(r[0] * sx), half_even(r[1] * sy)
    wd, ht = half_even(r[2] * sx), half_even(r[3] * sy)
    if w > 0 and h > 0:
        wd = F.when(x + wd > w, w - x).otherwise(wd)
        ht = F.when(y + ht > h, h - y).otherwise(ht)
    return x, y, wd, ht


def scale_rect_in_place(r: Rect, sx: float, sy: float, bx: float = 0.0, by: float = 0.0,
                        w: int = 0, h: int = 0) -> Rect:
    """Scale about the centre and add a border; optionally stay inside w × h."""
    def axis(pos, length, s, border, limit):
        start = pos - half_even(length * ((s - 1.0) * 0.5) + border)
        size = half_even(length * s + 2.0 * border)
        if limit > 0:
            size = F.when(start < 0, size + start).otherwise(size)
            start = F.greatest(start, F.lit(0))
            size = F.when(start + size > limit, limit - start).otherwise(size)
        return start, size

    both = w > 0 and h > 0
    x, wd = axis(r[0], r[2], sx, bx, w if both else 0)
    y, ht = axis(r[1], r[3], sy, by, h if both else 0)
    return x, y, wd, ht


def offset_rect(r: Rect, by: Point) -> Rect:
    return r[0] + by[0], r[1] + by[1], r[2], r[3]


def crop_rect(r: Rect, w: int, h: int) -> Rect:
    """Limit a rectangle to a w × h image."""
    def axis(pos, length, limit):
        size = F.when(pos + length > limit, limit - pos).otherwise(length)
        start = F.least(F.greatest(pos, F.lit(0)), F.lit(limit - 1))
        size = F.greatest(size, F.lit(0))
        return start, F.when(size > limit, limit - start).otherwise(size)

    x, wd = axis(r[0], r[2], w)
    y, ht = axis(r[1], r[3], h)
    return x, y, wd, ht

"""Boxes and axes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of (x1, y1, x2, y2); 1e-8 keeps the quotient defined."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h + F.lit(1e-8))


def pixel_to_data(v: Column, pixels: int, low: float, high: float) -> Column:
    """A pixel coordinate on a data axis."""
    return F.lit(low) + v / F.lit(float(max(pixels, 1))) * F.lit(high - low)


def data_to_pixel(v: Column, pixels: int, low: float, high: float) -> Column:
    """The inverse; 0 on an axis without extent."""
    return (v - F.lit(low)) / F.lit(high - low) * F.lit(float(pixels)) if high != low else F.lit(0.0)


def to_index(b: Column, n: int) -> Column:
    """A normalised coordinate as array index, clipped and truncated."""
    return F.least(F.greatest(b * n, F.lit(0.0)), F.lit(float(n - 1))).cast("int")


def settled(v: Column, digits: int) -> Column:
    """Rounded after a shift far below the last digit, which settles halves alike however a double is read."""
    return F.round(v + F.lit(1e-9), digits)

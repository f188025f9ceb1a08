"""Colour and shape arithmetic as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue of a colour in half degrees (0 to 180); 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.try_divide(F.lit(1.0), top - low)
    red = (g - b) * span
    return F.when(top == low, 0.0).when(top == r, 30.0 * (red + F.when(red < 0, 6.0).otherwise(0.0))).when(top == g, 30.0 * ((b - r) * span + 2)).otherwise(30.0 * ((r - g) * span + 4))


def circular_distance(a: Column, b: Column, turn: int = 180) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(turn) - d)


def circularity(area: Column, width: Column, height: Column) -> Column:
    """1 for a circle, less for anything longer: 4 pi area over the squared perimeter of the bounding box."""
    return F.lit(4 * pi) * area / F.pow(2.0 * (width + height), F.lit(2))

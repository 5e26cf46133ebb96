"""Boxes of lines and colour of pixels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(boundary: Column, baseline: Column) -> Column:
    """(left, top, right, bottom) of the boundary's points, else of the baseline's; null without points."""
    points = F.when(F.size(boundary) > 0, boundary).when(F.size(baseline) > 0, baseline)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(
        F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom")
    )
    return F.when(points.isNotNull(), box)


def centre(box: Column) -> Column:
    return F.struct(((box["left"] + box["right"]) / 2).alias("x"), ((box["top"] + box["bottom"]) / 2).alias("y"))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """Hue, saturation, lightness in [0, 1] of channels in [0, 255]; blue wins over green over red as the greatest."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    sat = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - hi - lo)).otherwise(d / (hi + lo))
    sixth = F.when(hi == b, (r - g) / d + 4).when(hi == g, (b - r) / d + 2).otherwise((g - b) / d + F.when(g < b, 6.0).otherwise(0.0))
    return F.struct(F.when(d == 0, 0.0).otherwise(sixth / 6).alias("h"), sat.alias("s"), light.alias("l"))


def _bell(x: Column, middle: float, sigma: float) -> Column:
    return F.exp(-((x - middle) ** 2) / (2 * sigma * sigma))


def redness(h: Column, s: Column, lightness: Column) -> Column:
    """How red a pixel is, 0 to 100: Gaussians around red hue, full saturation and middle lightness, cut at their ranges."""
    hue = F.when(h <= 0.1, _bell(h, 0.0, 0.05)).when(h >= 0.91, _bell(h, 1.0, 0.05)).otherwise(0.0)
    light = F.when(lightness.between(0.25, 0.8), _bell(lightness, 0.5, 0.15)).otherwise(0.0)
    sat = F.when(s.between(0.3, 1.0), _bell(s, 1.0, 0.2)).otherwise(0.0)
    return hue * light * sat * 100

"""Column expressions on positions, distances and labels. Missing values are NULL throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUSE, FACE, MIXED = "house", "face", "mixed"


def degrees_per_pixel(width_mm: float = 470.0, width_px: int = 1920, distance_mm: float = 1050.0) -> float:
    """Visual angle of one pixel across the screen's width."""
    return 2 * math.degrees(math.atan(0.5 * (width_mm / width_px) / distance_mm))


def degrees_per_pixel_column(width_mm: Column, width_px: Column, distance_mm: Column) -> Column:
    return 2 * F.degrees(F.atan(0.5 * (width_mm / width_px) / distance_mm))


def distance(x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    return F.sqrt((x - to_x) * (x - to_x) + (y - to_y) * (y - to_y))


def rounded(x: Column) -> Column:
    """To one decimal, halves to even."""
    return F.rint(x * 10) / 10


def other(label: Column) -> Column:
    return F.when(label == HOUSE, FACE).otherwise(HOUSE)


def nearest(d1: Column, d2: Column, image1: Column) -> Column:
    """The image at the nearer point; ties and missing distances go to the second."""
    return F.when(d1 < d2, image1).otherwise(other(image1))


def nearest_or_mixed(d1: Column, d2: Column, center: Column, image1: Column) -> Column:
    """`mixed` if the centre is strictly nearest."""
    return F.when((center < d1) & (center < d2), MIXED).otherwise(nearest(d1, d2, image1))


def by_ratio(d1: Column, d2: Column, image1: Column, threshold: float) -> Column:
    """The nearer image if the log-ratio of distances is beyond the threshold, else `mixed`."""
    ratio = F.when(d1.isNotNull() & d2.isNotNull(), F.ln(F.greatest(d1, F.lit(1e-6)) / F.greatest(d2, F.lit(1e-6))))
    return F.when(ratio < -threshold, image1).when(ratio > threshold, other(image1)).otherwise(MIXED)


def encode(label: Column) -> Column:
    """house 1, face 0, mixed and missing 0.5."""
    return F.when(label == HOUSE, 1.0).when(label == FACE, 0.0).otherwise(0.5)


def decode(value: Column, mixed: bool = True) -> Column:
    if mixed:
        return F.when(value >= 0.75, HOUSE).when(value <= 0.25, FACE).when(value.isNotNull(), MIXED)
    return F.when(value >= 0.5, HOUSE).when(value.isNotNull(), FACE)


def dead_band(value: Column, threshold: float = 0.5, delta: float = 0.05, mixed: bool = True) -> Column:
    """1 from threshold + delta, 0 to threshold - delta, 0.5 between; without mixed, cut at the
    threshold."""
    if not mixed:
        return F.when(value >= threshold, 1.0).when(value.isNotNull(), 0.0)
    return F.when(value >= threshold + delta, 1.0).when(value <= threshold - delta, 0.0).when(value.isNotNull(), 0.5)


def band(value: Column, bad: Column, warn: Column) -> Column:
    return F.when(bad, "bad").when(warn, "warn").when(value.isNotNull(), "ok")

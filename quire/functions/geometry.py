"""Boxes: (x0, top, x1, bottom) in points, the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "top", "x1", "bottom")


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in BOX]


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def shared_area(a: list[Column], b: list[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Share of a that lies in b."""
    return shared_area(a, b) / F.greatest(area(a), F.lit(1e-6))


def overlaps(a: list[Column], b: list[Column], threshold: float = 0.35) -> Column:
    """Whether more than threshold of the smaller box is shared."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, shared_area(a, b) / smaller > threshold).otherwise(F.lit(False))


def centre_x(b: list[Column]) -> Column:
    return (b[0] + b[2]) / 2


def centre_y(b: list[Column]) -> Column:
    return (b[1] + b[3]) / 2


def merged() -> list[Column]:
    """Aggregates for the box around all boxes of a group, zeros for none."""
    pick = {"x0": F.min, "top": F.min, "x1": F.max, "bottom": F.max}
    return [F.coalesce(pick[k](k), F.lit(0.0)).alias(k) for k in BOX]

"""Box arithmetic as columns. A box is (x, y, w, h); with a prefix its columns are a_x, a_y and so on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Columns of a box by its left, top, right and bottom edges."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> "Box":
        x, y, w, h = (F.col(f"{prefix}{c}") for c in "xywh")
        return Box(x, y, x + w, y + h)

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)


def intersection(a: Box, b: Box) -> Column:
    """Common area; zero for boxes that only touch."""
    w, h = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def containment(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that is within ``outer``; zero where ``inner`` has no area."""
    inter = intersection(inner, outer)
    return F.when((inter > 0) & (inner.area > 0), inter / inner.area).otherwise(F.lit(0.0))


def viewport_share(box: Box, width, height) -> Column:
    return containment(box, Box(F.lit(0), F.lit(0), F.lit(width), F.lit(height)))


def nearly_equal(a: str, b: str, tolerance: int = 2) -> Column:
    out = F.lit(True)
    for c in "xywh":
        out = out & (F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) <= tolerance)
    return out


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))


def half_even(v: Column) -> Column:
    return F.rint(v).cast("long")


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], cell: int = 256) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose boxes have a common area: columns a_... and b_... beside the keys.

    Boxes meet only in the grid cells that they cover, and a pair counts in the cell that holds the upper left corner of
    its intersection. So a key with very many boxes is dealt out by cell, and boxes apart are never paired.
    """

    def celled(df, p):
        box = Box.of(p)
        span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor((hi - 1) / cell)))
        full = df.where((F.col(f"{p}w") > 0) & (F.col(f"{p}h") > 0))
        return full.withColumn("_cx", span(box.x1, box.x2)).withColumn("_cy", span(box.y1, box.y2))

    a, b = Box.of("a_"), Box.of("b_")
    both = celled(prefixed(left, "a_", keys), "a_").join(celled(prefixed(right, "b_", keys), "b_"), [*keys, "_cx", "_cy"])
    met = (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)
    once = (F.floor(F.greatest(a.x1, b.x1) / cell) == F.col("_cx")) & (F.floor(F.greatest(a.y1, b.y1) / cell) == F.col("_cy"))
    return both.where(met & once).drop("_cx", "_cy")

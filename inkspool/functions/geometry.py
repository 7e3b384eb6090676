"""Boxes as Catalyst expressions (GEO1 to GEO7). A box is four integer columns: left, top, right, bottom."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(prefix + n) for n in ("left", "top", "right", "bottom")])

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def middle(self) -> Column:
        return (self.left + self.right) / 2.0


def from_vertices(vertices: Column) -> Column:
    """GEO1: struct of edges, size and center (mean of the vertices) of a polygon; absent coordinates are 0."""
    xs = F.transform(vertices, lambda v: F.coalesce(v["x"], F.lit(0)))
    ys = F.transform(vertices, lambda v: F.coalesce(v["y"], F.lit(0)))
    n = F.size(vertices)

    def mean(a: Column) -> Column:
        return F.when(n > 0, F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x) / n.cast("double"))

    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), (right - left).alias("width"), (bottom - top).alias("height"), mean(xs).alias("center_x"), mean(ys).alias("center_y"))


def normalized_vertices(vertices: Column) -> Column:
    """SRC6: vertices with absent coordinates as 0."""
    return F.transform(vertices, lambda v: F.struct(F.coalesce(v["x"], F.lit(0)).alias("x"), F.coalesce(v["y"], F.lit(0)).alias("y")))


def union() -> list[Column]:
    """GEO2: aggregates for the box around all boxes of a group."""
    return [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")]


def vertical_overlap(a: Box, b: Box) -> Column:
    """GEO3: shared height over the larger height; negative if apart, 0 without height."""
    tall = F.greatest(a.height, b.height)
    return F.when(tall > 0, (F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)) / tall.cast("double")).otherwise(0.0)


def horizontal_gap(a: Box, b: Box) -> Column:
    """GEO4: distance between facing edges; negative if the boxes overlap."""
    return F.when(a.left > b.right, a.left - b.right).otherwise(b.left - a.right)


def vertical_gap(a: Box, b: Box) -> Column:
    return F.when(a.top > b.bottom, a.top - b.bottom).otherwise(b.top - a.bottom)


def horizontal_alignment(a: Box, b: Box) -> Column:
    """GEO5: shared width over the smaller width, less up to half for distant middles."""
    shared = F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.left, b.left))
    narrow = F.least(a.width, b.width)
    mean = (a.width + b.width) / 2.0
    apart = F.abs(a.middle - b.middle)
    share = shared / narrow.cast("double")
    moved = F.when((mean > 0) & (apart > 0.5 * mean), share * (1 - 0.5 * F.least(F.lit(1.0), apart / mean))).otherwise(share)
    return F.when((shared == 0) | (narrow == 0), 0.0).otherwise(F.least(F.lit(1.0), moved))


def width_similarity(a: Box, b: Box) -> Column:
    """GEO6."""
    return F.when((a.width == 0) | (b.width == 0), 0.0).otherwise(F.least(a.width, b.width) / F.greatest(a.width, b.width).cast("double"))


def area(a: Box) -> Column:
    return a.width.cast("long") * a.height


def area_ratio(a: Box, image_area: Column) -> Column:
    """GEO7: share of the image."""
    return F.when(image_area > 0, area(a) / image_area.cast("double")).otherwise(0.0)


def aspect_ratio(a: Box) -> Column:
    return F.when(a.height > 0, a.width / a.height.cast("double")).otherwise(1.0)


def text_density(text: Column, a: Box) -> Column:
    return F.when(area(a) > 0, F.length(text) / area(a).cast("double")).otherwise(0.0)

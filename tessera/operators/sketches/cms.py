"""Count-min as a small table (row, col, count): built, merged and queried by aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WIDTH, MAX_DEPTH, MAX_CELLS, MAX_COUNT = 1 << 26, 256, 1 << 28, 2**32 - 1


class SketchError(ValueError):
    """Dimensions or counts that a sketch refuses."""


@dataclass(frozen=True)
class Dims:
    width: int
    depth: int

    def __post_init__(self) -> None:
        if not (1 <= self.width <= MAX_WIDTH and 1 <= self.depth <= MAX_DEPTH and self.width * self.depth <= MAX_CELLS):
            raise SketchError("the dimensions are out of range")

    @staticmethod
    def by_error(error: float, probability: float) -> Dims:
        """Counts exceed the truth by error * total with at most that probability."""
        if not (0 < error < 1 and 0 < probability < 1):
            raise SketchError("error and probability must lie between 0 and 1")
        return Dims(math.ceil(math.e / error), max(1, math.ceil(math.log(1 / probability))))


def cells(item: Column, dims: Dims) -> Column:
    """array<struct<row, col>> of an item."""
    text = item.cast("string")
    return F.transform(F.sequence(F.lit(0), F.lit(dims.depth - 1)), lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(r, text), F.lit(dims.width)).alias("col")))


def build(df: DataFrame, item: str, dims: Dims, count: str | None = None) -> DataFrame:
    """The sketch of a column, each row counting once or by another column.

    Items are summed first, so rows are hashed once for each distinct item."""
    by = F.sum(count) if count else F.count(F.lit(1))
    sums = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("i")).agg(by.cast("bigint").alias("n"))
    at = sums.select(F.explode(cells(F.col("i"), dims)).alias("c"), "n")
    return at.groupBy(F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.sum("n").alias("count"))


def check(sketch: DataFrame) -> None:
    """Raises if a counter has left its range."""
    if not sketch.where((F.col("count") < 0) | (F.col("count") > MAX_COUNT)).isEmpty():
        raise SketchError("a counter is out of range")


def increase(sketch: DataFrame, changes: DataFrame, item: str, count: str, dims: Dims) -> DataFrame:
    """The sketch after signed increments; all are checked before any counts."""
    new = merge([sketch, build(changes, item, dims, count)])
    check(new)
    return new


def query(sketch: DataFrame, items: DataFrame, item: str, dims: Dims) -> DataFrame:
    """(item, estimate) of the distinct items of a column; never below the true count."""
    asked = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item")).distinct()
    at = asked.select("item", F.explode(cells(F.col("item"), dims)).alias("c")).select("item", "c.row", "c.col")
    return at.join(sketch, ["row", "col"], "left").groupBy("item").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def merge(sketches: Sequence[DataFrame], weights: Sequence[int] | None = None) -> DataFrame:
    """The weighted sum of sketches of one size, kept inside the counters' range."""
    weights = weights or [1] * len(sketches)
    if not sketches or len(weights) != len(sketches):
        raise SketchError("a weight for each sketch is expected")
    scaled = [s.select("row", "col", (F.col("count") * w).alias("count")) for s, w in zip(sketches, weights)]
    total = reduce(DataFrame.unionByName, scaled).groupBy("row", "col").agg(F.sum("count").alias("count"))
    return total.withColumn("count", F.least("count", F.lit(MAX_COUNT)))


def info(sketch: DataFrame, dims: Dims) -> DataFrame:
    """(width, depth, count)."""
    first = sketch.where("row = 0").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return first.select(F.lit(dims.width).alias("width"), F.lit(dims.depth).alias("depth"), "count")

"""Quantile digests: equal-weight centroids, merged in two steps, and exact counterparts.

A digest of compression c keeps centroids of about a c-th of the weight each. ``build``
makes one for each group: every partition compresses its own values first, and the parts
meet by key. The exact functions answer the same questions by counting.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.sketches.cms import SketchError

COMPRESSION, MAX_COMPRESSION = 100.0, 1e6


@dataclass
class Digest:
    compression: float = COMPRESSION
    means: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: float = math.nan
    high: float = math.nan
    merges: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.compression <= MAX_COMPRESSION:
            raise SketchError("the compression is out of range")

    @property
    def size(self) -> float:
        return float(self.weights.sum())

    def add(self, values: Sequence[float] | np.ndarray, weights: Sequence[float] | np.ndarray | None = None) -> Digest:
        """Adds values; those that are not finite, or weigh nothing, are left out."""
        v = np.asarray(values, float)
        w = np.ones(len(v)) if weights is None else np.asarray(weights, float)
        ok = np.isfinite(v) & np.isfinite(w) & (w > 0)
        return self._join([(v[ok], w[ok])], v[ok])

    def _join(self, parts: list[tuple[np.ndarray, np.ndarray]], edges: np.ndarray) -> Digest:
        v = np.concatenate([self.means, *(p[0] for p in parts)])
        w = np.concatenate([self.weights, *(p[1] for p in parts)])
        if len(edges):
            self.low, self.high = float(np.fmin(self.low, edges.min())), float(np.fmax(self.high, edges.max()))
        if len(v) > len(self.means):
            by = np.argsort(v, kind="stable")
            self.means, self.weights = squeeze(v[by], w[by], w.sum() / self.compression)
            self.merges += 1
        return self

    def merge(self, *others: Digest) -> Digest:
        edges = np.array([x for o in others if len(o.weights) for x in (o.low, o.high)])
        return self._join([(o.means, o.weights) for o in others], edges)

    def reset(self) -> Digest:
        return Digest(self.compression)

    def _value_at(self, rank: float) -> float:
        at = np.cumsum(self.weights) - self.weights / 2
        v = self.means.copy()
        v[0], v[-1] = self.low, self.high
        if len(v) == 1:
            return self.low
        return float(np.interp(rank, at, v))

    def quantile(self, q: float) -> float:
        if not len(self.weights) or not math.isfinite(q):
            return math.nan
        if q <= 0:
            return self.low
        return self.high if q >= 1 else self._value_at(q * self.size)

    def _below(self, v: float) -> float:
        return float(self.weights[self.means < v].sum() + self.weights[self.means == v].sum() / 2)

    def cdf(self, v: float) -> float:
        if not len(self.weights):
            return math.nan
        return 0.0 if v < self.low else 1.0 if v > self.high else self._below(v) / self.size

    def rank(self, v: float) -> int:
        """-2 for an empty digest, -1 below the least value, the size above the greatest."""
        if not len(self.weights):
            return -2
        return -1 if v < self.low else math.floor(self.size) if v > self.high else math.floor(self._below(v))

    def rev_rank(self, v: float) -> int:
        if not len(self.weights):
            return -2
        return -1 if v > self.high else math.floor(self.size) if v < self.low else math.floor(self.size - self._below(v))

    def by_rank(self, r: float) -> float:
        if not len(self.weights):
            return math.nan
        if r <= 0:
            return self.low
        return math.inf if r >= self.size else self.high if r >= self.size - 1 else self._value_at(r)

    def by_rev_rank(self, r: float) -> float:
        if not len(self.weights):
            return math.nan
        if r <= 0:
            return self.high
        return -math.inf if r >= self.size else self.low if r >= self.size - 1 else self._value_at(self.size - r)

    def trimmed_mean(self, lo: float, hi: float) -> float:
        if not len(self.weights) or not 0 <= lo < hi <= 1:
            return math.nan
        stop = np.cumsum(self.weights)
        part = np.clip(np.minimum(stop, hi * self.size) - np.maximum(stop - self.weights, lo * self.size), 0, None)
        return float((part * self.means).sum() / part.sum()) if part.sum() > 0 else math.nan

    def info(self) -> dict[str, float]:
        return {"compression": self.compression, "centroids": len(self.means), "weight": self.size, "min": self.low, "max": self.high, "merges": self.merges}

    def dump(self) -> bytes:
        return struct.pack("<dddqI", self.compression, self.low, self.high, self.merges, len(self.means)) + self.means.tobytes() + self.weights.tobytes()

    @staticmethod
    def load(raw: bytes) -> Digest:
        head = struct.calcsize("<dddqI")
        try:
            c, low, high, merges, n = struct.unpack_from("<dddqI", raw)
            made = Digest(c, np.frombuffer(raw, float, n, head).copy(), np.frombuffer(raw, float, n, head + 8 * n).copy(), low, high, merges)
        except (struct.error, ValueError) as e:
            raise SketchError(f"not a dump of a digest: {e}") from None
        if len(raw) != head + 16 * n or (made.weights <= 0).any() or (np.diff(made.means) < 0).any() or (n and not low <= high):
            raise SketchError("not a dump of a digest: its centroids are wrong")
        return made


def squeeze(v: np.ndarray, w: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours put together while their weight stays within target; v is sorted."""
    total = np.concatenate([[0.0], np.cumsum(w)])
    sums = np.concatenate([[0.0], np.cumsum(w * v)])
    cuts, i, n = [0], 0, len(w)
    while i < n:
        i = max(i + 1, int(np.searchsorted(total, total[i] + target * (1 + 1e-12), "right")) - 1)
        cuts.append(i)
    at = np.array(cuts)
    weights = np.diff(total[at])
    means = np.maximum.accumulate(np.diff(sums[at]) / weights)
    return np.clip(means, v[at[:-1]], v[np.maximum(at[1:] - 1, 0)]), weights


def build(df: DataFrame, value: str, keys: Sequence[str] = (), compression: float = COMPRESSION) -> DataFrame:
    """(keys, digest): partitions compress their values, then the parts of a key are merged."""
    src = df.select(*keys, F.col(value).cast("double").alias("v"))
    own = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    kinds = (own + ", " if own else "") + "digest binary"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Digest] = {}
        for pdf in batches:
            groups = pdf.groupby(list(keys), dropna=False) if keys else [((), pdf)]
            for k, g in groups:
                k = tuple(None if x != x else x for x in (k if isinstance(k, tuple) else (k,)))
                held.setdefault(k, Digest(compression * 4 if compression * 4 <= MAX_COMPRESSION else compression)).add(g["v"].to_numpy(float))
        if held:
            yield pd.DataFrame([(*k, d.dump()) for k, d in held.items()], columns=[*keys, "digest"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        d = Digest(compression).merge(*(Digest.load(x) for x in pdf["digest"]))
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), d.dump())], columns=[*keys, "digest"])

    parts = src.mapInPandas(partial, kinds)
    if not keys:
        parts = parts.withColumn("__one", F.lit(1))
        return parts.groupBy("__one").applyInPandas(lambda pdf: final(pdf), kinds)
    return parts.groupBy(*keys).applyInPandas(final, kinds)


def merge_frames(digests: DataFrame, compression: float | None = None) -> DataFrame:
    """One digest of all of a frame; the compression of the finest if none is given."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [Digest.load(x) for x in pdf["digest"]]
        c = compression or max(p.compression for p in parts)
        return pd.DataFrame({"digest": [Digest(c).merge(*parts).dump()]})

    return digests.select("digest", F.lit(1).alias("__one")).groupBy("__one").applyInPandas(run, "digest binary")


def ask(col: Column, question: str, *args: float) -> Column:
    """An answer of a digest column: quantile, cdf, by_rank, trimmed_mean, low, high, .."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        def one(raw: bytes) -> float:
            got = getattr(Digest.load(raw), question)
            return float(got(*args) if callable(got) else got)

        return s.map(one, na_action="ignore").astype(float)

    return run(col)


# exact counterparts


def exact_cdf(value: Column, at: float) -> Column:
    """Share below, equal ones counting half; an aggregate."""
    return F.avg(F.when(value < at, 1.0).when(value == at, 0.5).otherwise(0.0))


def exact_rank(value: Column, at: float) -> Column:
    half = F.sum(F.when(value < at, 1.0).when(value == at, 0.5).otherwise(0.0))
    n = F.count(value)
    rank = F.when(at < F.min(value), F.lit(-1)).when(at > F.max(value), n).otherwise(F.floor(half))
    return F.when(n == 0, F.lit(-2)).otherwise(rank).cast("bigint")


def exact_rev_rank(value: Column, at: float) -> Column:
    half = F.sum(F.when(value < at, 1.0).when(value == at, 0.5).otherwise(0.0))
    n = F.count(value)
    rank = F.when(at > F.max(value), F.lit(-1)).when(at < F.min(value), n).otherwise(F.floor(n - half))
    return F.when(n == 0, F.lit(-2)).otherwise(rank).cast("bigint")


def running(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, v, n, upto, total): distinct values with counts and running counts.

    Equal values are counted before they are put in order, and without keys the order is
    made in two steps (ranges, then sums of ranges), so that no task holds all values."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        w = Window.partitionBy(*keys)
        return c.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    placed = c.repartitionByRange("v").withColumn("p", F.spark_partition_id()).persist()
    sums = placed.groupBy("p").agg(F.sum("n").alias("s"))
    w = Window.orderBy("p")
    before = sums.select("p", (F.sum("s").over(w) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("inside", inside).join(F.broadcast(before), "p").select("v", "n", (F.col("inside") + F.col("before")).alias("upto"), "total")


def exact_many(df: DataFrame, value: str, shares: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a column for each share): sorted[floor(share * (n - 1))] of each group, no
    interpolation; all shares in one pass."""
    r = running(df, value, keys)
    at = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1) + 1e-9), F.col("v"))).alias(name) for name, p in shares.items()]
    return r.groupBy(*keys).agg(*at)


def exact_at(df: DataFrame, value: str, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value): the same for one share."""
    return exact_many(df, value, {"value": share}, keys)


def exact_trimmed_mean(df: DataFrame, value: str, lo: float, hi: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value): mean between two quantiles, values at the edges counting in part."""
    r = running(df, value, keys)
    part = F.greatest(F.lit(0.0), F.least(F.col("upto").cast("double"), F.col("total") * hi) - F.greatest((F.col("upto") - F.col("n")).cast("double"), F.col("total") * lo))
    return r.withColumn("w", part).groupBy(*keys).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))

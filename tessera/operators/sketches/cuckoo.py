"""Cuckoo filters: eight-bit fingerprints in two candidate buckets, with deletion.

``Chain`` is the growing filter of one key. ``build`` makes a partitioned filter of a whole
column: items are spread over parts by a hash, each part is a chain of its own, and
``probe`` and ``remove`` meet the parts by the same hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sketches.bloom import FilterError, item_bytes


@dataclass(frozen=True)
class Params:
    capacity: int = 1024
    bucket: int = 2
    iterations: int = 20
    expansion: int = 1
    layers: int = 32

    def __post_init__(self) -> None:
        if not 1 <= self.capacity <= 1 << 32 or not 1 <= self.bucket <= 255 or not 1 <= self.iterations <= 65535 or not 0 <= self.expansion <= 32768:
            raise FilterError("a parameter is out of range")


def fingerprint(item: bytes) -> int:
    return (xxhash.xxh32_intdigest(item, 1) & 0xFF) or 1


def home(item: bytes, buckets: int) -> int:
    return xxhash.xxh32_intdigest(item, 2) & (buckets - 1)


def other(index: int, mark: int, buckets: int) -> int:
    """The second bucket; from there it leads back to the first."""
    return index ^ (xxhash.xxh32_intdigest(bytes([mark]), 3) & (buckets - 1))


def bucket_columns(item: Column, buckets: int) -> tuple[Column, Column, Column]:
    """(mark, first bucket, second bucket) as columns."""
    text = item.cast("string")
    low = F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(255))
    mark = F.when(low == 0, F.lit(1)).otherwise(low)
    first = F.xxhash64(F.lit(2), text).bitwiseAND(F.lit(buckets - 1))
    return mark, first, alternate_column(first, mark, buckets)


def alternate_column(index: Column, mark: Column, buckets: int) -> Column:
    return index.bitwiseXOR(F.xxhash64(F.lit(3), mark).bitwiseAND(F.lit(buckets - 1)))


def next_state(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


class Layer:
    def __init__(self, buckets: int, slots: int, iterations: int, data: np.ndarray | None = None):
        self.buckets, self.iterations = buckets, iterations
        self.data = np.zeros((buckets, slots), np.uint8) if data is None else data

    def spots(self, item: bytes) -> tuple[int, int, int]:
        mark = fingerprint(item)
        a = home(item, self.buckets)
        return mark, a, other(a, mark, self.buckets)

    def put_in(self, i: int, mark: int) -> bool:
        free = np.flatnonzero(self.data[i] == 0)
        if len(free):
            self.data[i, free[0]] = mark
        return len(free) > 0

    def add(self, item: bytes) -> bool:
        """Places the mark, moving others aside; a failure leaves all as it was."""
        mark, a, b = self.spots(item)
        if self.put_in(a, mark) or self.put_in(b, mark):
            return True
        state = a ^ (mark << 32) ^ (b << 16)
        at, undo = (b if state & 1 else a), []
        for i in range(self.iterations):
            state = next_state(state + i)
            slot = state % self.data.shape[1]
            undo.append((at, slot, self.data[at, slot]))
            mark, self.data[at, slot] = int(self.data[at, slot]), mark
            at = other(at, mark, self.buckets)
            if self.put_in(at, mark):
                return True
        for i, slot, old in reversed(undo):
            self.data[i, slot] = old
        return False

    def count(self, item: bytes) -> int:
        mark, a, b = self.spots(item)
        return int(sum((self.data[i] == mark).sum() for i in {a, b}))

    def remove(self, item: bytes) -> bool:
        mark, a, b = self.spots(item)
        for i in (a, b):
            hit = np.flatnonzero(self.data[i] == mark)
            if len(hit):
                self.data[i, hit[0]] = 0
                return True
        return False


@dataclass
class Chain:
    """A filter that adds layers when an item finds no place."""

    params: Params = Params()
    layers: list[Layer] = field(default_factory=list)
    inserted: int = 0
    deleted: int = 0

    def __post_init__(self) -> None:
        if not self.layers:
            self._grow(self.params.capacity)

    def _grow(self, capacity: int) -> None:
        need = max(1, capacity // self.params.bucket)
        self.layers.append(Layer(1 << (need - 1).bit_length(), self.params.bucket, self.params.iterations))

    def add(self, item: object) -> bool:
        """False if no layer has a place and none can be added."""
        raw = item_bytes(item)
        if not self.layers[-1].add(raw) and not any(y.add(raw) for y in self.layers[:-1]):
            if self.params.expansion == 0 or len(self.layers) >= self.params.layers:
                return False
            self._grow(self.params.capacity * self.params.expansion ** len(self.layers))
            if not self.layers[-1].add(raw):
                return False
        self.inserted += 1
        return True

    def add_new(self, item: object) -> bool | None:
        """None if the item seems to be there already."""
        return None if item in self else self.add(item)

    def add_many(self, items: Iterable[object], only_new: bool = False) -> list[int]:
        """1 added, 0 there already, -1 no place; all items are tried."""
        got = (self.add_new(x) if only_new else self.add(x) for x in items)
        return [0 if g is None else 1 if g else -1 for g in got]

    def __contains__(self, item: object) -> bool:
        return self.count(item) > 0

    def count(self, item: object) -> int:
        raw = item_bytes(item)
        return sum(y.count(raw) for y in self.layers)

    def remove(self, item: object) -> bool:
        """Takes one mark away, from the largest layer that has it.

        The mark may be another item's. Items that share a mark's buckets in one layer share
        them in all smaller ones too, so that item still finds the mark of the removed one,
        which lies in this layer or a smaller one."""
        raw = item_bytes(item)
        done = any(y.remove(raw) for y in sorted(self.layers, key=lambda y: -y.buckets))
        self.deleted += done
        return done

    def info(self) -> dict[str, int]:
        return {
            "size": sum(y.data.size for y in self.layers), "buckets": sum(y.buckets for y in self.layers), "filters": len(self.layers), "inserted": self.inserted,
            "deleted": self.deleted, "bucket_size": self.params.bucket, "expansion": self.params.expansion, "max_iterations": self.params.iterations,
        }

    def dump(self) -> bytes:
        p = self.params
        head = struct.pack("<qiiiiqqI", p.capacity, p.bucket, p.iterations, p.expansion, p.layers, self.inserted, self.deleted, len(self.layers))
        return head + b"".join(struct.pack("<q", y.buckets) + y.data.tobytes() for y in self.layers)

    @staticmethod
    def load(raw: bytes) -> Chain:
        try:
            *p, inserted, deleted, n = struct.unpack_from("<qiiiiqqI", raw)
            params, at, layers = Params(*p), struct.calcsize("<qiiiiqqI"), []
            for _ in range(n):
                buckets = struct.unpack_from("<q", raw, at)[0]
                size = buckets * params.bucket
                layers.append(Layer(buckets, params.bucket, params.iterations, np.frombuffer(raw, np.uint8, size, at + 8).reshape(buckets, -1).copy()))
                at += 8 + size
        except (struct.error, ValueError) as e:
            raise FilterError(f"not a dump of a filter: {e}") from None
        made = Chain(params, layers, inserted, deleted)
        if at != len(raw) or sum(int((y.data > 0).sum()) for y in layers) != inserted - deleted:
            raise FilterError("not a dump of a filter: its counts are wrong")
        return made


def part_of(item: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), item.cast("string")), F.lit(parts)).cast("int")


def build(df: DataFrame, item: str, parts: int, params: Params = Params(), order: str | None = None) -> DataFrame:
    """(part, filter): chains of a column, null items left out; equal orders give equal filters."""
    cols = [F.col(item).cast("string").alias("item"), *([F.col(order).alias("o")] if order else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chain(params)
        c.add_many(pdf.sort_values(["o", "item"] if order else ["item"])["item"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "filter": [c.dump()]})

    rows = df.where(F.col(item).isNotNull()).select(part_of(F.col(item), parts).alias("part"), *cols)
    return rows.groupBy("part").applyInPandas(run, "part int, filter binary")


def probe(filters: DataFrame, df: DataFrame, item: str, parts: int) -> DataFrame:
    """(item, copies) of the distinct items of a column: fingerprints found, never too few."""

    def run(f: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        c = Chain.load(f["filter"].iloc[0]) if len(f) else None
        return pd.DataFrame({"item": q["item"], "copies": [c.count(x) if c else 0 for x in q["item"]]})

    asked = df.where(F.col(item).isNotNull()).select(part_of(F.col(item), parts).alias("part"), F.col(item).cast("string").alias("item")).distinct()
    return filters.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(run, "item string, copies bigint")


def remove(filters: DataFrame, df: DataFrame, item: str, parts: int) -> DataFrame:
    """The filters after one deletion for each row of df."""

    def run(f: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame({"part": pd.Series([], dtype="int32"), "filter": pd.Series([], dtype=object)})
        c = Chain.load(f["filter"].iloc[0])
        for x in sorted(q["item"]):
            c.remove(x)
        return pd.DataFrame({"part": [f["part"].iloc[0]], "filter": [c.dump()]})

    gone = df.where(F.col(item).isNotNull()).select(part_of(F.col(item), parts).alias("part"), F.col(item).cast("string").alias("item"))
    return filters.groupBy("part").cogroup(gone.groupBy("part")).applyInPandas(run, "part int, filter binary")

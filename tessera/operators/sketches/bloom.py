"""Bloom filters.

``build`` makes a filter of a whole column as a table of 4 KB bitmaps, with built-in bitmap
aggregates that combine on the map side; ``probe`` tests a column against it by a join.
``Chain`` is the scaling filter of one key, layer by layer in the order of its items;
``fold`` runs it for every key of a frame.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sketches.turns import in_turn

ERROR_RATE, INITIAL_SIZE, EXPANSION = 0.01, 100, 2
MAX_CAPACITY, MAX_EXPANSION, MAX_LAYER_BITS = 1 << 30, 32768, 1 << 34
LEAST_RATE = 1e-15
BITMAP = 32768  # bits in one built-in bitmap
AT_ONCE = 65536  # items that are put in a layer at once


class FilterError(ValueError):
    """Parameters or a dump that a filter refuses, or a full filter."""


@dataclass(frozen=True)
class Params:
    """rate, capacity of the first layer, growth of the next ones (0: fixed size)."""

    rate: float = ERROR_RATE
    capacity: int = INITIAL_SIZE
    expansion: int = EXPANSION

    def __post_init__(self) -> None:
        if not 0 < self.rate < 1:
            raise FilterError("the error rate must lie between 0 and 1")
        if not 1 <= self.capacity <= MAX_CAPACITY:
            raise FilterError("the capacity is out of range")
        if not 0 <= self.expansion <= MAX_EXPANSION:
            raise FilterError("the expansion is out of range")


def layout(rate: float, capacity: int) -> tuple[int, int]:
    """(bits, hashes) of a layer."""
    per = -math.log(rate) / math.log(2) ** 2
    bits = -(-int(max(math.ceil(capacity * per), 1024)) // 64) * 64
    if bits > MAX_LAYER_BITS:
        raise FilterError("the layer is too large")
    return bits, math.ceil(math.log(2) * per)


def positions(item: Column, bits: int, hashes: int) -> Column:
    """The bits of an item: an array of hashes positions."""
    text = item.cast("string")
    a, b = F.pmod(F.xxhash64(text), F.lit(bits)), F.pmod(F.xxhash64(F.lit(17), text), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (a + i * b) % bits)


@dataclass
class Table:
    """A filter as a frame (bucket, bitmap) with its layout."""

    frame: DataFrame
    bits: int
    hashes: int


def build(df: DataFrame, item: str, rate: float = ERROR_RATE, capacity: int | None = None) -> Table:
    """One layer for all items of a column; its size is the number of distinct ones if not given."""
    if capacity is None:
        capacity = max(1, df.agg(F.approx_count_distinct(item, 0.02)).first()[0] * 11 // 10)
    bits, hashes = layout(rate, capacity)
    at = df.where(F.col(item).isNotNull()).select(item).distinct().select(F.explode(positions(F.col(item), bits, hashes)).alias("p"))
    parts = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bitmap"))
    return Table(parts, bits, hashes)


def merge(a: Table, b: Table) -> Table:
    """The union of two filters of one layout."""
    if (a.bits, a.hashes) != (b.bits, b.hashes):
        raise FilterError("the layouts differ")
    both = a.frame.unionByName(b.frame).groupBy("bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    return Table(both, a.bits, a.hashes)


def probe(df: DataFrame, item: str, table: Table, out: str = "seen") -> DataFrame:
    """df with whether each item may be in the filter; null items are not.

    Distinct items are tested, each position against its bitmap, and joined back."""
    asked = df.where(F.col(item).isNotNull()).select(F.col(item).alias("__item")).distinct()
    at = asked.select("__item", F.explode(positions(F.col("__item"), table.bits, table.hashes)).alias("p"))
    at = at.select("__item", F.expr("bitmap_bucket_number(p)").alias("bucket"), F.expr("bitmap_bit_position(p)").alias("bit"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")).cast("int"), F.lit(0))
    found = at.join(table.frame, "bucket", "left").groupBy("__item").agg((F.min(hit) == 1).alias(out))
    return df.join(found, F.col(item) == F.col("__item"), "left").drop("__item").withColumn(out, F.coalesce(out, F.lit(False)))


def item_bytes(item: object) -> bytes:
    return item if isinstance(item, bytes) else str(item).encode("utf-8", "surrogatepass")


def hashes_of(items: Iterable[object]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each item that its places come from."""
    raw = [item_bytes(x) for x in items]
    a = [xxhash.xxh64_intdigest(x, 0) for x in raw]
    b = [xxhash.xxh64_intdigest(x, h & 0xFFFFFFFF) for x, h in zip(raw, a)]
    return np.array(a, np.uint64), np.array(b, np.uint64)


@dataclass
class Layer:
    capacity: int
    rate: float
    bits: int
    hashes: int
    data: np.ndarray
    count: int = 0

    def places(self, item: bytes) -> np.ndarray:
        a = xxhash.xxh64_intdigest(item, 0)
        b = xxhash.xxh64_intdigest(item, a & 0xFFFFFFFF)
        return np.array([(a + i * b) % self.bits for i in range(self.hashes)], np.int64)

    def place(self, a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
        """The place by hash i of each item."""
        bits = np.uint64(self.bits)
        return ((a % bits + np.uint64(i) * (b % bits)) % bits).astype(np.int64)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each item is there."""
        left = np.arange(len(a))
        for i in range(self.hashes):
            p = self.place(a[left], b[left], i)
            left = left[(self.data[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
        out = np.zeros(len(a), bool)
        out[left] = True
        return out

    def put(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds items in turn. An item is new if it is the first to set one of its bits; one
        that isn't new sets none, so all can be set at once."""
        p = np.stack([self.place(a, b, i) for i in range(self.hashes)], 1).ravel()
        free = np.flatnonzero(~(self.data[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))
        bit, first = np.unique(p[free], return_index=True)
        self.count += len(np.unique(free[first] // self.hashes))
        np.bitwise_or.at(self.data, bit >> 3, (1 << (bit & 7)).astype(np.uint8))


@dataclass
class Chain:
    """A filter that adds layers as it fills."""

    params: Params = Params()
    layers: list[Layer] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.layers:
            first = self.params.rate if self.params.expansion == 0 else self.params.rate * 0.5
            self._grow(self.params.capacity, first)

    def _grow(self, capacity: int, rate: float) -> None:
        rate = max(rate, LEAST_RATE)
        bits, hashes = layout(rate, capacity)
        self.layers.append(Layer(capacity, rate, bits, hashes, np.zeros(bits // 8, np.uint8)))

    def __contains__(self, item: object) -> bool:
        raw = item_bytes(item)
        for y in self.layers:
            p = y.places(raw)
            if (y.data[p >> 3] >> (p & 7).astype(np.uint8) & 1).all():
                return True
        return False

    def add(self, item: object) -> bool:
        """True if the item is new; a full filter of fixed size refuses it."""
        if item in self:
            return False
        last = self.layers[-1]
        if last.count >= last.capacity:
            if self.params.expansion == 0:
                raise FilterError("the filter is full")
            self._grow(last.capacity * self.params.expansion, last.rate * 0.5)
            last = self.layers[-1]
        p = last.places(item_bytes(item))
        np.bitwise_or.at(last.data, p >> 3, (1 << (p & 7)).astype(np.uint8))
        last.count += 1
        return True

    def add_many(self, items: Iterable[object]) -> list[bool]:
        """One answer an item, up to the first that is refused."""
        out = []
        for x in items:
            try:
                out.append(self.add(x))
            except FilterError:
                break
        return out

    def add_hashed(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Adds items in turn by their hashes, as add_many does; False once one is refused."""
        left = np.arange(len(a))
        for y in self.layers[:-1]:
            left = left[~y.has(a[left], b[left])]
        while len(left):
            last = self.layers[-1]
            room = min(last.capacity - last.count, AT_ONCE)
            if room:
                part, left = left[:room], left[room:]
                last.put(a[part], b[part])
                continue
            left = left[~last.has(a[left], b[left])]
            if len(left):
                if self.params.expansion == 0:
                    return False
                self._grow(last.capacity * self.params.expansion, last.rate * 0.5)
        return True

    def has_hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left = np.arange(len(a))
        for y in self.layers:
            left = left[~y.has(a[left], b[left])]
        out = np.ones(len(a), bool)
        out[left] = False
        return out

    @property
    def cardinality(self) -> int:
        return sum(y.count for y in self.layers)

    def info(self) -> dict[str, int]:
        return {"capacity": sum(y.capacity for y in self.layers), "size": sum(len(y.data) for y in self.layers) + 64 * len(self.layers), "filters": len(self.layers), "items": self.cardinality, "expansion": self.params.expansion}

    def dump(self) -> bytes:
        head = struct.pack("<dqiI", self.params.rate, self.params.capacity, self.params.expansion, len(self.layers))
        return head + b"".join(struct.pack("<qdqiq", y.capacity, y.rate, y.bits, y.hashes, y.count) + y.data.tobytes() for y in self.layers)

    def chunks(self) -> list[bytes]:
        """The header and each layer, to be loaded in this order."""
        return [self.dump()[:24] + struct.pack("<q", self.cardinality), *(struct.pack("<qdqiq", y.capacity, y.rate, y.bits, y.hashes, y.count) + y.data.tobytes() for y in self.layers)]

    @staticmethod
    def load(raw: bytes) -> Chain:
        """The filter of a dump; every field is checked against what it must be."""
        try:
            rate, capacity, expansion, n = struct.unpack_from("<dqiI", raw)
            at, layers = 24, []
            params = Params(rate, capacity, expansion)
            for k in range(n):
                y = Layer(*struct.unpack_from("<qdqi", raw, at), np.zeros(0, np.uint8), *struct.unpack_from("<q", raw, at + 28))
                at += 36
                want_rate = max(rate * 0.5 ** (k + (expansion > 0)), LEAST_RATE)
                if y.capacity != capacity * max(expansion, 1) ** k or not math.isclose(y.rate, want_rate) or (y.bits, y.hashes) != layout(y.rate, y.capacity) or not 0 <= y.count <= y.capacity:
                    raise FilterError("a layer does not fit the filter")
                y.data = np.frombuffer(raw, np.uint8, y.bits // 8, at).copy()
                at += y.bits // 8
                layers.append(y)
        except (struct.error, ValueError) as e:
            raise FilterError(f"not a dump of a filter: {e}") from None
        if at != len(raw) or not layers:
            raise FilterError("not a dump of a filter: its length is wrong")
        return Chain(params, layers)

    @staticmethod
    def from_chunks(chunks: list[bytes]) -> Chain:
        total = struct.unpack_from("<q", chunks[0], 24)[0]
        made = Chain.load(chunks[0][:24] + b"".join(chunks[1:]))
        if made.cardinality != total:
            raise FilterError("the counts do not add up")
        return made


@dataclass
class Filling:
    """A chain that is filled until it refuses an item."""

    chain: Chain
    open: bool = True

    def feed(self, rows: pa.RecordBatch) -> None:
        if self.open:
            self.open = self.chain.add_hashed(*hashes_of(rows.column("item").to_pylist()))

    def end(self) -> dict[str, list]:
        c = self.chain
        return {"filter": [c.dump()], "items": pa.array([c.cardinality], pa.int64()), "filters": pa.array([len(c.layers)], pa.int32())}


def fold(df: DataFrame, key: str, item: str, order: str, params: Params = Params()) -> DataFrame:
    """(key, filter, items, filters): the chain of each key, its items taken by order.

    A repeated item changes nothing, so each is taken once, where it comes first."""
    once = df.groupBy(F.col(key).alias("key"), F.col(item).alias("item")).agg(F.min(order).alias("o"))
    return in_turn(once, ["o", "item"], "filter binary, items bigint, filters int", lambda: Filling(Chain(params)), Filling.feed, Filling.end)


def fold_probe(filters: DataFrame, df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, seen) of each row of df against the filter of its key.

    The rows of a key stream past its filter."""
    kinds = [df.schema[c].dataType.simpleString() for c in (key, item)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = of = None
        for b in batches:
            raw, k = b.column("filter"), b.column("key")
            heads = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False))
            codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = sorted({0, *heads.tolist(), *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)})
            for at, end in zip(ends, ends[1:]):
                own = repr(k[at].as_py())
                if own != of:
                    chain, of = None, own
                if raw[at].is_valid:
                    chain, at = Chain.load(raw[at].as_py()), at + 1
                part = b.slice(at, end - at)
                seen = chain.has_hashed(*hashes_of(part.column("item").to_pylist())) if chain else np.zeros(len(part), bool)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("item"), pa.array(seen)], names=["key", "item", "seen"])

    rows = df.select(F.col(key).alias("key"), F.lit(1).alias("side"), F.col(item).alias("item"), F.lit(None).cast("binary").alias("filter"))
    heads = filters.select("key", F.lit(0).alias("side"), F.lit(None).cast(kinds[1]).alias("item"), "filter")
    both = heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "side")
    return both.mapInArrow(run, f"key {kinds[0]}, item {kinds[1]}, seen boolean")

"""The most frequent items: exact, by the engine's sketch, or by HeavyKeeper for each key."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sketches.bloom import item_bytes
from tessera.operators.sketches.cms import SketchError
from tessera.operators.sketches.cuckoo import next_state
from tessera.operators.sketches.turns import in_turn

WIDTH, DEPTH, DECAY = 8, 7, 0.9
MAX_INCREMENT = 100_000
KNOWN = 10_000  # items whose places are kept


def counts(df: DataFrame, item: str, weight: str | None = None) -> DataFrame:
    """(item, count) of a column."""
    by = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(by.cast("bigint").alias("count"))


def top(df: DataFrame, item: str, k: int, weight: str | None = None) -> DataFrame:
    """The k most frequent, ties by item; exact."""
    return counts(df, item, weight).orderBy(F.desc("count"), "item").limit(k)


def approx_top(df: DataFrame, item: str, k: int, tracked: int = 10_000) -> DataFrame:
    """The k most frequent by the built-in sketch, in one pass without a shuffle of items."""
    found = df.where(F.col(item).isNotNull()).agg(F.expr(f"approx_top_k(`{item}`, {int(k)}, {int(tracked)})").alias("t"))
    return found.select(F.explode("t").alias("e")).select(F.col("e.item").alias("item"), F.col("e.count").alias("count"))


def member(items: DataFrame, item: str, best: DataFrame) -> DataFrame:
    """(item, is_top) of a column against a top list."""
    marked = best.select(F.col("item").alias("__i"), F.lit(True).alias("is_top"))
    return items.select(F.col(item).alias("item")).join(marked, F.col("item") == F.col("__i"), "left").select("item", F.coalesce("is_top", F.lit(False)).alias("is_top"))


@dataclass
class HeavyKeeper:
    """Counters that decay when other items meet them, and the list of the k largest."""

    k: int
    width: int = WIDTH
    depth: int = DEPTH
    decay: float = DECAY

    def __post_init__(self) -> None:
        if self.k < 1 or self.width < 1 or self.depth < 1 or not 0 <= self.decay <= 1 or self.width * self.depth > 1 << 27:
            raise SketchError("a parameter is out of range")
        self.marks = np.zeros((self.depth, self.width), np.uint32)
        self.cells = np.zeros((self.depth, self.width), np.int64)
        self.best: list[list] = []
        self.state = 0x5EED
        self.known: dict[str, tuple[int, list[int]]] = {}  # marks and columns of late items

    def _chance(self) -> float:
        self.state = next_state(self.state)
        return (self.state >> 11) / 9007199254740992.0

    def _spots(self, raw: bytes) -> tuple[int, list[int]]:
        return xxhash.xxh32_intdigest(raw, 99) or 1, [xxhash.xxh32_intdigest(raw, 100 + r) % self.width for r in range(self.depth)]

    def add(self, item: str, n: int = 1) -> str | None:
        """Counts the item n times; the item that left the list last, if one did."""
        if not 1 <= n <= MAX_INCREMENT:
            raise SketchError("the increment is out of range")
        if item not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[item] = self._spots(item_bytes(item))
        mark, cols = self.known[item]
        gone, marks, cells = None, self.marks, self.cells
        for _ in range(n):
            seen = 0
            for r, c in enumerate(cols):
                if (have := cells.item(r, c)) and marks.item(r, c) != mark:
                    if self._chance() >= self.decay ** float(have):
                        continue
                    cells[r, c] = have = have - 1
                    if have:
                        continue
                marks[r, c] = mark
                cells[r, c] = have + 1
                seen = max(seen, have + 1)
            gone = self._rank(item, max(seen, 1)) or gone
        return gone

    def _rank(self, item: str, count: int) -> str | None:
        gone = None
        at = next((i for i, e in enumerate(self.best) if e[0] == item), None)
        if at is not None:
            self.best[at][1] += 1
        elif len(self.best) < self.k:
            self.best.append([item, count])
            at = len(self.best) - 1
        elif count > self.best[-1][1]:
            gone, at = self.best[-1][0], self.k - 1
            self.best[-1] = [item, count]
        else:
            return None
        while at and self.best[at - 1][1] < self.best[at][1]:
            self.best[at - 1], self.best[at] = self.best[at], self.best[at - 1]
            at -= 1
        return gone

    def count(self, item: str) -> int:
        for x, n in self.best:
            if x == item:
                return n
        mark, cols = self._spots(item_bytes(item))
        return max([0, *(int(self.cells[r, c]) for r, c in enumerate(cols) if self.marks[r, c] == mark)])

    def __contains__(self, item: str) -> bool:
        return any(x == item for x, _ in self.best)

    def list(self) -> list[tuple[str, int]]:
        return [(x, n) for x, n in self.best]

    def info(self) -> dict[str, float]:
        return {"k": self.k, "width": self.width, "depth": self.depth, "decay": self.decay}

    def dump(self) -> bytes:
        names = [(item_bytes(x), n) for x, n in self.best]
        head = struct.pack("<iiidQI", self.k, self.width, self.depth, self.decay, self.state, len(names))
        return head + self.marks.tobytes() + self.cells.tobytes() + b"".join(struct.pack("<Iq", len(x), n) + x for x, n in names)

    @staticmethod
    def load(raw: bytes) -> HeavyKeeper:
        try:
            k, w, d, decay, state, n = struct.unpack_from("<iiidQI", raw)
            made, at = HeavyKeeper(k, w, d, decay), struct.calcsize("<iiidQI")
            made.state = state
            made.marks = np.frombuffer(raw, np.uint32, w * d, at).reshape(d, w).copy()
            made.cells = np.frombuffer(raw, np.int64, w * d, at + 4 * w * d).reshape(d, w).copy()
            at += 12 * w * d
            for _ in range(n):
                size, count = struct.unpack_from("<Iq", raw, at)
                made.best.append([raw[at + 12 : at + 12 + size].decode("utf-8", "surrogatepass"), count])
                at += 12 + size
        except (struct.error, ValueError) as e:
            raise SketchError(f"not a dump of a sketch: {e}") from None
        if at != len(raw) or n > k or any(a[1] < b[1] for a, b in zip(made.best, made.best[1:])):
            raise SketchError("not a dump of a sketch: its list is wrong")
        return made


def keep_heavy(df: DataFrame, key: str, item: str, order: str, k: int, width: int = WIDTH, depth: int = DEPTH, decay: float = DECAY) -> DataFrame:
    """(key, item, count, rank): HeavyKeeper's list for each key, its items taken by order."""

    def feed(s: HeavyKeeper, rows: pa.RecordBatch) -> None:
        for x in rows.column("item").to_pylist():
            s.add(str(x))

    def end(s: HeavyKeeper) -> dict[str, list]:
        best = s.list()
        return {"item": pa.array([x for x, _ in best], pa.string()), "count": pa.array([n for _, n in best], pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32())}

    rows = df.where(F.col(item).isNotNull()).select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(order).alias("o"))
    return in_turn(rows, ["o", "item"], "item string, count bigint, rank int", lambda: HeavyKeeper(k, width, depth, decay), feed, end)


def add_all(sketch: HeavyKeeper, items: Iterable[str]) -> list[str | None]:
    return [sketch.add(x) for x in items]

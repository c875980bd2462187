"""Operator 2: benchmark decontamination by template canonicalisation.

Words of a text become template tokens: numbers, names (capitalised words) and units (a unit
word right after a number) turn into typed placeholders, and a run of equal placeholders is
one slot. A capitalised word that opens a sentence may be a name or not, so a text is read
in two ways: such words stay literal in the one and are names in the other. Windows of
``WINDOW`` template tokens, with ``LITERALS`` ordinary words at least, are hashed and joined
with the windows of the benchmark items that were read in the same way.

Slot consistency: joined windows of a document and an item are put together by alignment
(the difference of their positions). Within an alignment each slot value of the item must
stand for one value of the document and the other way round; of an alignment that breaks
this only the windows without a slot count, as they are word for word. Slots at the edges of
an item are not compared, since a run may go on outside of it. A document leaks an item when
the windows that count, in one way of reading, cover at least ``COVER`` of the item's windows
and are ``LEAST_HIT`` or more.

An item is usable for this with ``LEAST_HIT`` windows or more, so with eight tokens at least.
Of shorter ones, and of those that are almost nothing but slots (``unusable_items`` lists
them), a document leaks only what is its whole text, case and punctuation aside.

A bitmap of the benchmark's window hashes is tested before windows leave Python; it is only
a filter for the join. It has 64 bits a window, up to ``BITMAP_BITS`` in all, beyond which
more windows pass it and nothing else changes; it is put together by the executors.

Defined results: null ids, null or empty texts leak nothing; rows that share an id are
taken together; an empty benchmark gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm._text import DIGIT, U, Scan, chunks, mix, slices

WINDOW = 5
LITERALS = 3
COVER = 0.4
#: Windows that an item must have, and that must be found, at least.
LEAST_HIT = 4
#: Size of the largest bitmap: 32 MB.
BITMAP_BITS = 1 << 28
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds gram grams "
    "ton tons tonnes ml cl l liter liters litre litres ms s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years hz khz mhz ghz w kw mw kwh v kv a ma j kj cal kcal k c f degrees kb mb gb tb "
    "usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres kmh mph acres hectares"
).split()
NUM, NAME, UNIT = (U(0x1111111111111111 * x) for x in (3, 5, 7))


def _unit_codes() -> np.ndarray:
    return np.sort(Scan(UNITS).codes())


UNIT_CODES = _unit_codes()


class Template:
    """Template tokens of several texts: doc, code, and for slots the value (else 0).

    opening: capitalised words that open a sentence are names too."""

    def __init__(self, texts: list[str], opening: bool = False, scan: Scan | None = None):
        scan = scan or Scan(texts, digits_join=True)
        code, n = scan.codes(), len(scan.s)
        doc = scan.doc
        same = np.concatenate([[False], doc[1:] == doc[:-1]]) if n else np.zeros(0, bool)
        num = scan.kind == DIGIT
        name = ~num & scan.capitalised()
        if not opening:
            name &= ~scan.after_stop()
        near = np.searchsorted(UNIT_CODES, code)
        known = UNIT_CODES[np.minimum(near, len(UNIT_CODES) - 1)] == code
        unit = known & same & np.concatenate([[False], num[:-1]]) if n else known
        name &= ~unit
        kind = np.select([num, name, unit], [1, 2, 3], 0)
        first = np.ones(n, bool)
        if n:
            first[1:] = ~(same[1:] & (kind[1:] == kind[:-1]) & (kind[1:] > 0))
        at = np.flatnonzero(first)
        value = np.where(kind > 0, code, U(0))
        self.value = np.add.reduceat(value, at) if n else value
        self.kind, self.doc = kind[at], doc[at]
        self.code = np.where(self.kind == 0, code[at], np.array([0, NUM, NAME, UNIT], U)[self.kind])
        self.salt = U(WINDOW + int(opening))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first token, hash) of the windows that have words enough."""
        n = len(self.code) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h, lit = np.full(n, self.salt), np.zeros(n, np.int8)
        for j in range(WINDOW):
            h = h * U(0x9E3779B97F4A7C15) + self.code[j : j + n]
            lit += self.kind[j : j + n] == 0
        at = np.flatnonzero((self.doc[:n] == self.doc[WINDOW - 1 :]) & (lit >= LITERALS))
        return at, mix(h[at])


def whole_hashes(scan: Scan, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of all words in order, number of words) of each of the n texts of a scan."""
    lo = np.searchsorted(scan.doc, np.arange(n + 1))
    size = np.diff(lo)
    own = mix(scan.codes() + (np.arange(len(scan.doc)) - lo[scan.doc] + 1).astype(U) * U(0x9E3779B97F4A7C15))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(own, dtype=U)])
    return mix(sums[lo[1:]] - sums[lo[:-1]] + U(0x632BE59BD9B4E019)), size


COLS = ["id", "way", "pos", "hash", "slots"]
#: Values of way: how a window was read, or that the hash is that of a whole text.
STRICT, OPEN, WHOLE = 0, 1, 2


def _rows(t: Template, ids: pa.Array, at: np.ndarray, h: np.ndarray, way: int) -> pa.RecordBatch:
    first = np.searchsorted(t.doc, t.doc[at])
    slots = t.value[at[:, None] + np.arange(WINDOW)].view(np.int64) if len(at) else np.zeros((0, WINDOW), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, WINDOW * len(at) + 1, WINDOW, dtype=np.int32)), pa.array(slots.ravel()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(t.doc[at])), pa.array(np.full(len(at), way, np.int8)), pa.array((at - first).astype(np.int32)), pa.array(h.view(np.int64)), lists], names=COLS)


def _whole_rows(ids: pa.Array, rows: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(rows) + 1, np.int32)), pa.array([], pa.int64()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.full(len(rows), WHOLE, np.int8)), pa.array(np.zeros(len(rows), np.int32)), pa.array(h.view(np.int64)), none], names=COLS)


def text_windows(rows: DataFrame, id_col: str, text_col: str, items: bool = False, bits: np.ndarray | None = None) -> DataFrame:
    """(id, way, pos, hash, slots): the windows of every text, and one row for texts that
    have fewer than ``LEAST_HIT`` of them; with bits only those that the bitmap may hold.

    Of items, slots at the edges have the value 0, which is not compared."""
    src = B.narrow(rows, id=id_col, text=text_col).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for at0, part in chunks(b.column(1).to_pylist()):
                ids, scan = b.column(0).slice(at0, len(part)), Scan(part, digits_join=True)
                short, size = np.ones(len(part), bool), None
                for way in (STRICT, OPEN):
                    t = Template(part, way == OPEN, scan)
                    at, h = t.windows()
                    few = np.bincount(t.doc[at], minlength=len(part)) < LEAST_HIT
                    short &= few
                    use = ~few[t.doc[at]] if items else np.ones(len(at), bool)
                    if items and len(t.doc):
                        edge = np.flatnonzero(np.concatenate([[True], t.doc[1:] != t.doc[:-1]]))
                        t.value[edge] = t.value[np.concatenate([edge[1:], [len(t.doc)]]) - 1] = 0
                    use &= maybe(bits, h)
                    if use.any():
                        yield _rows(t, ids, at[use], h[use], way)
                if short.any():
                    h, size = whole_hashes(scan, len(part))
                    rows_ = np.flatnonzero(short & (size > 0) & maybe(bits, h))
                    if len(rows_):
                        yield _whole_rows(ids, rows_, h[rows_])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, way tinyint, pos int, hash bigint, slots array<bigint>")


def maybe(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the hashes; all, without a bitmap."""
    if bits is None:
        return np.ones(len(h), bool)
    at = h & U(len(bits) * 64 - 1)
    return (bits[at >> U(6)] >> (at & U(63))) & U(1) == 1


def bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits of the n hashes of a frame (hash), as 64-bit words; at most ``BITMAP_BITS``."""
    size = min(BITMAP_BITS, 1 << max(12, (n * 64).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(hash & 63 as int))")).alias("b")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return bits.view(U)


def unusable_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id) of the items that are too short, or have too few words besides their slots."""
    found = text_windows(items, item_col, text_col, items=True)
    return found.where(F.col("way") == WHOLE).select(F.col("id").alias("item_id")).distinct()


def agree(windows: list[dict]) -> tuple[int, int]:
    """Item positions that windows of one document and one item cover, by way of reading."""
    best = (set(), set())
    by: dict[tuple[int, int], list[dict]] = {}
    for w in windows:
        if w["way"] != WHOLE:
            by.setdefault((w["way"], w["pos"] - w["item_pos"]), []).append(w)
    for (way, _), own in by.items():
        pairs = {(x, y) for w in own for x, y in zip(w["slots"], w["item_slots"]) if x and y}
        fair = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
        best[way].update(w["item_pos"] for w in own if fair or not any(w["slots"]))
    return len(best[0]), len(best[1])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, coverage) of every document that leaks an item."""
    bench = text_windows(items, item_col, item_text, items=True)
    bench = B.cut(bench.select(F.col("id").alias("item"), F.col("way").alias("item_way"), F.col("pos").alias("item_pos"), F.col("hash").alias("item_hash"), F.col("slots").alias("item_slots")))
    n = bench.count()
    seen = text_windows(docs, id_col, text_col, bits=bitmap(bench.select(F.col("item_hash").alias("hash")), n))
    side = F.broadcast(bench) if n * 150 <= B.BROADCAST_BYTES else bench
    met = seen.join(side, (F.col("hash") == F.col("item_hash")) & (F.col("way") == F.col("item_way")))
    hits = met.groupBy("id", "item").agg(F.collect_list(F.struct("way", "pos", "item_pos", "slots", "item_slots")).alias("windows"), F.max("way").alias("way"))
    hits = hits.where((F.size("windows") >= LEAST_HIT) | (F.col("way") == WHOLE)).select("id", "item", (F.col("way") == WHOLE).alias("whole"), "windows")
    kinds = [hits.schema[c].dataType.simpleString() for c in ("id", "item")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [agree(w) for w in b.column(3).to_pylist()]
            cols = [pa.array([x[k] for x in both], pa.int32()) for k in (STRICT, OPEN)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["id", "item", "whole", "hit0", "hit1"])

    hit = hits.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, whole boolean, hit0 int, hit1 int")
    windows = bench.where(F.col("item_way") != WHOLE)
    sizes = windows.groupBy("item").agg(*[F.count_distinct(F.when(F.col("item_way") == k, F.col("item_pos"))).alias(f"of{k}") for k in (STRICT, OPEN)])
    share = [F.when(F.col(f"hit{k}") >= LEAST_HIT, F.col(f"hit{k}") / F.col(f"of{k}")) for k in (STRICT, OPEN)]
    out = hit.join(sizes, "item", "left").withColumn("coverage", F.when(F.col("whole"), 1.0).otherwise(F.greatest(*share)))
    return out.where(F.col("coverage") >= cover).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that leak any item, all columns as they were."""
    gone = B.cut(find_leaks(docs, items, id_col, text_col).select("doc_id").distinct())
    return B.keep_rows(docs, id_col, gone, "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the whole benchmark table in the whole documents table."""
    return find_leaks(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark"))

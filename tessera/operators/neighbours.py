"""Nearest neighbours over stored vectors, exact, for one or many queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vector

#: Most queries that a task holds, about; vectors that pass them at once; queries compared at once.
BLOCK, PIECE, SLICE = 32768, 8192, 1024
FOUND = "query_id {query}, doc_id {doc}, distance double, rank int, compared bigint"


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "L2", vec: str = "embedding") -> DataFrame:
    """(query_id, doc_id, distance, rank) of the k nearest for each of (query_id, q); exact.

    The queries go to every task, so they should be few (``nearest_blocks`` takes many); ties
    go by doc_id."""
    d = vector.METRICS[metric](F.col(vec), F.col("q"))
    pairs = vectors.where(F.col(vec).isNotNull()).crossJoin(F.broadcast(queries)).select("query_id", "doc_id", d.alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distances(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    x, c = x.astype(np.float64), c.astype(np.float64)
    dot = x @ c.T
    if metric == "IP":
        return -dot
    if metric == "COSINE":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
        return 1 - np.divide(dot, n, out=np.zeros_like(dot), where=n > 0)
    return (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * dot


def nearest_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "L2", vec: str = "embedding") -> DataFrame:
    """What ``nearest`` finds, for any number of queries.

    Still every pair: the queries lie in blocks, past each of which all vectors stream in
    pieces. Products find what can be among the k nearest, whose distances are then taken
    pair by pair."""
    src = vectors.where(F.col("doc_id").isNotNull() & F.col(vec).isNotNull()).select("doc_id", F.col(vec).cast("array<float>").alias("v"))
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-src.count() // PIECE)))).cast("int")

    def meet(best: Best, rows: pa.Table) -> None:
        ids, x = rows["doc_id"].to_numpy(), matrix(rows["v"])
        for at in range(0, len(best.q), SLICE):
            own = slice(at, at + SLICE)
            d = distances(best.q[own], x, metric)
            most = best.most[own]
            if len(x) > k and np.isinf(most).any():
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
            scale = 1.0 if metric == "COSINE" else (best.q[own] ** 2).sum(1).max() + (x**2).sum(1).max()
            r, c = np.nonzero(~(d > (most + 1e-9 * scale)[:, None]))
            best.offer(r + at, ids[c], paired(best.q[own][r], x[c][:, None, :], metric)[:, 0])
        best.compared += len(x)

    return past(queries, src.withColumns({"piece": piece, "place": F.lit(0)}), k, meet).drop("compared")


class Best:
    """The k nearest so far of a block of queries, ties by id."""

    def __init__(self, keys: pa.ChunkedArray, q: np.ndarray, k: int):
        self.keys, self.q, self.k = keys, q, k
        self.row, self.dist = np.zeros(0, np.int64), np.zeros(0)
        self.ids: np.ndarray | None = None
        #: The distance of the k-th, infinite before there are k; vectors compared.
        self.most, self.compared = np.full(len(q), np.inf), np.zeros(len(q), np.int64)

    def offer(self, row: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        if not len(row):
            return
        # only the lists of these queries are gone through
        first, last = np.searchsorted(self.row, [row.min(), row.max() + 1])
        old = slice(first, last)
        was = ids[:0] if self.ids is None else self.ids
        r, d, i = np.concatenate([self.row[old], row]), np.concatenate([self.dist[old], dist]), np.concatenate([was[old], ids])
        by = np.lexsort((np.unique(i, return_inverse=True)[1], d, r))
        r, d, i = r[by], d[by], i[by]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        self.most[r[rank == self.k - 1]] = d[rank == self.k - 1]
        ok = rank < self.k
        put = lambda a, b: np.concatenate([a[:first], b[ok], a[last:]])
        self.row, self.dist, self.ids = put(self.row, r), put(self.dist, d), put(was, i)

    def batch(self) -> pa.RecordBatch:
        rank = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1
        keys = self.keys.combine_chunks().take(pa.array(self.row))
        ids = pa.nulls(0, self.keys.type) if self.ids is None else pa.array(self.ids)
        return pa.RecordBatch.from_arrays([keys, ids, pa.array(self.dist), pa.array(rank.astype(np.int32)), pa.array(self.compared[self.row])], FOUND_NAMES)


FOUND_NAMES = [w.split()[0] for w in FOUND.split(", ")]


def past(queries: DataFrame, others: DataFrame, k: int, meet: Callable[[Best, pa.Table], None]) -> DataFrame:
    """(query_id, doc_id, distance, rank, compared): blocks of queries (query_id, q) are held,
    and the pieces of others (piece, place, doc_id, v, ..) go past each of them in order.

    A vector is sent once a block, a query once; a task holds a block and a piece."""
    asked = queries.where(F.col("q").isNotNull()).select("query_id", F.col("q").cast("array<float>").alias("v"))
    blocks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // BLOCK))
    kind, own = asked.schema["query_id"].dataType, others.schema["doc_id"].dataType
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in others.schema if f.name != "v"]
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "query_id", "v", *none)
    right = others.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("query_id"), *others.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = at = None
        for (block, side, _), rows in runs(batches):
            if block != at and best is not None:
                yield best.batch()
                best = None
            at = block
            if side == 0:
                best = Best(rows["query_id"], matrix(rows["v"]), k)
            elif best is not None:
                meet(best, rows)
        if best is not None:
            yield best.batch()

    rows = left.unionByName(right).repartitionById(blocks, "block").sortWithinPartitions("block", "side", "piece", "place")
    return rows.mapInArrow(run, FOUND.format(query=kind.simpleString(), doc=own.simpleString()))


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """((block, side, piece), rows) of batches that are sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = np.stack([b.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in map(b.schema.get_field_index, ("block", "side", "piece"))], 1)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        at = 0
        for end in ends:
            if end == at:
                continue
            key = tuple(int(x) for x in keys[at])
            if key != last and held:
                yield last, pa.Table.from_batches(held)  # type: ignore[misc]
                held = []
            last = key
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield last, pa.Table.from_batches(held)  # type: ignore[misc]


def matrix(vectors: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """The rows of a column of lists of one length."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(kind)


def paired(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each q (m x d) to its own x (m x c x d)."""
    dot = np.einsum("md,mcd->mc", q, x)
    if metric == "IP":
        return -dot
    if metric == "COSINE":
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=2)
        return 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
    return ((q[:, None, :] - x) ** 2).sum(2)

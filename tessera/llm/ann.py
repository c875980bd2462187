"""Operator 5: nearest neighbours by a block matrix join.

Vectors are spread over blocks by a hash of their id. A task holds one block and streams all
vectors past it, a tile at a time, its own block first. Both sides of a tile are quantised to
int8 with a scale for each side; the products of the int8 values are exact, as a matrix product
over floating-point numbers that hold them (32 bits up to ``EXACT_DIM`` dimensions, 64 beyond).
With the norms of the rounding errors they bound each squared distance from both sides: if
x = s q + e, then x . y differs from the product of the quantised vectors by at most
|e_x| |y| + |x - e_x| |e_y|. A pair survives if its lower bound is not over the k-th distance that
its query has so far (at first, the k-th smallest upper bound), and survivors alone are computed
in float64 and merged into the query's heap of its k best. So the result is exact. Every row is
a query.

The join is quadratic by design: a vector goes once to each block's task, and a block is as
large as ``BLOCK_BYTES`` allows, though there are ``TASKS`` blocks or more unless they would
have less than ``LEAST_BLOCK`` vectors.

Defined results: ids of a type other than integers are taken as strings; rows that share an id
are one vector (the least); null ids, null vectors, vectors with null or non-finite values and
those not of the commonest dimension are left out; a vector is not its own neighbour; ties go to
the smaller id; with fewer than k others there are fewer than k rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _base as B

K = 10
#: Bytes of a block's vectors, at most about; vectors of a block, at least about.
BLOCK_BYTES, LEAST_BLOCK = 32 << 20, 8192
#: Blocks that there are at least, for tasks to run side by side.
TASKS = 4
#: Rows and columns of a tile that are compared at a time.
STRIP, COLUMNS = 256, 2048
#: Products of int8 values of so many dimensions are exact in 24 bits.
EXACT_DIM = (1 << 24) // (127 * 127)


class Quantised:
    """Vectors as int8 values (held as floats for the matrix product) with their scale."""

    def __init__(self, x: np.ndarray):
        self.x = x = x.astype(np.float64)
        top = np.abs(x).max(initial=0.0)
        self.scale = top / 127 if top > 0 else 1.0
        q = np.rint(x / self.scale)
        self.q = np.ascontiguousarray(q.astype(np.float32 if x.shape[1] <= EXACT_DIM else np.float64))
        back = q * self.scale
        self.error = np.linalg.norm(x - back, axis=1)
        self.held = np.linalg.norm(back, axis=1)
        self.norm = np.linalg.norm(x, axis=1)

    def part(self, rows: slice) -> Quantised:
        out = object.__new__(Quantised)
        out.scale = self.scale
        for k in ("x", "q", "error", "held", "norm"):
            setattr(out, k, getattr(self, k)[rows])
        return out


def bounds(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(estimates of the squared distances less the square of a's norm, greatest error of a row)."""
    est = a.q @ b.q.T
    est *= est.dtype.type(-2 * a.scale * b.scale)
    est += (b.norm**2).astype(est.dtype)[None, :]
    far, off = b.norm.max(initial=0.0), b.error.max(initial=0.0)
    return est, 2 * (a.error * far + a.held * off) + 1e-5 * (a.norm + far) ** 2  # the last for rounded sums


class Last(str):
    """A string that sorts the other way round."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)

    def __gt__(self, other: str) -> bool:
        return str.__lt__(self, other)


class Best:
    """The k best neighbours of every vector of a block: heaps with the worst on top."""

    def __init__(self, ids: list, x: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, Quantised(x), k
        self.back = (lambda i: -i) if not ids or isinstance(ids[0], int) else Last
        self.heaps: list[list[tuple]] = [[] for _ in ids]
        self.worst = np.full(len(ids), np.inf)

    def meet(self, ids: list, x: np.ndarray) -> None:
        """Compares the block with more vectors."""
        other = Quantised(x)
        for c in range(0, len(ids), COLUMNS):
            b = other.part(slice(c, c + COLUMNS))
            for r in range(0, len(self.ids), STRIP):
                self.tile(r, self.q.part(slice(r, r + STRIP)), ids[c : c + COLUMNS], b)

    def tile(self, at: int, a: Quantised, ids: list, b: Quantised) -> None:
        est, err = bounds(a, b)
        own = self.worst[at : at + len(a.q)]
        limit = own - a.norm**2 + err
        if np.isinf(own).any():
            n = min(self.k, len(ids) - 1)  # the vector itself may be among them
            if n == self.k:
                limit = np.minimum(limit, np.partition(est, n, axis=1)[:, n] + 2 * err)
        row, col = np.nonzero(est <= limit.astype(est.dtype)[:, None])
        d = a.x[row] - b.x[col]
        d = np.einsum("ij,ij->i", d, d)
        fine = d <= own[row]
        k, back = self.k, self.back
        for i, j, v in zip((row[fine] + at).tolist(), col[fine].tolist(), d[fine].tolist()):
            if ids[j] == self.ids[i]:
                continue
            heap, new = self.heaps[i], (-v, back(ids[j]))
            if len(heap) < k:
                heapq.heappush(heap, new)
            elif new > heap[0]:
                heapq.heapreplace(heap, new)
            if len(heap) == k:
                self.worst[i] = -heap[0][0]

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 5000):
            part = [sorted(h, reverse=True) for h in self.heaps[at : at + 5000]]
            sizes = np.array([len(h) for h in part])
            flat = [x for h in part for x in h]
            cols = [
                pa.array(self.ids[at : at + 5000], kind).take(pa.array(np.repeat(np.arange(len(part)), sizes))),
                pa.array(np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32) if flat else [], pa.int32()),
                pa.array([str(x[1]) if isinstance(x[1], Last) else -x[1] for x in flat], kind),
                pa.array([math.sqrt(-x[0]) for x in flat], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "rank", "neighbour_id", "distance"])


def matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(v), -1)


def stream(batches: Iterator[pa.RecordBatch], k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Results of batches (i, far, id, v) that are sorted by block i, its own vectors first."""
    own: list[tuple[list, np.ndarray]] = []
    best, block = None, None

    def ready() -> Best:
        new = Best([i for ids, _ in own for i in ids], np.concatenate([x for _, x in own]), k)
        for ids, x in own:
            new.meet(ids, x)
        return new

    for whole in batches:
        i, far = whole.column(0).to_numpy(), whole.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((i[1:] != i[:-1]) | (far[1:] != far[:-1])) + 1 if len(i) else []
        for a, z in zip([0, *cuts], [*cuts, len(i)]) if len(i) else ():
            b = whole.slice(a, z - a)
            if i[a] != block:
                if own:
                    yield from (best or ready()).rows(kind)
                own, best, block = [], None, i[a]
            ids, x = b.column(2).to_pylist(), matrix(b.column(3))
            if not far[a]:
                own.append((ids, x))
            elif own:
                best = best or ready()
                best.meet(ids, x)
    if own:
        yield from (best or ready()).rows(kind)


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, blocks: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the k nearest of every vector, Euclidean."""
    src = B.narrow(vectors, id=id_col, v=vector_col)
    whole = isinstance(src.schema["id"].dataType, T.IntegralType)
    key, kind = ("bigint", pa.int64()) if whole else ("string", pa.string())
    schema = f"vec_id {key}, rank int, neighbour_id {key}, distance double"
    src = src.select(F.col("id").cast(key).alias("id"), F.col("v").cast("array<float>").alias("v"))
    fine = src.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    fine = B.cut(fine.groupBy("id").agg(F.min("v").alias("v")))
    dims = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return fine.sparkSession.createDataFrame([], schema)
    d, n = dims["d"], dims["count"]
    if blocks is None:
        blocks = max(math.ceil(4 * d * n / BLOCK_BYTES), min(TASKS, math.ceil(n / LEAST_BLOCK)))
    rows = fine.where(F.size("v") == d).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    sent = rows.withColumn("i", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).select("i", (F.col("i") != F.col("own")).alias("far"), "id", "v")
    tiles = sent.repartitionById(blocks, F.col("i").cast("int")).sortWithinPartitions("i", "far")
    return tiles.mapInArrow(lambda batches: stream(batches, k, kind), schema)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours of every row of the whole embeddings table."""
    found = neighbours(B.table(spark, sf_dir, "embeddings"))
    return found.withColumn("distance", F.round("distance", 6))


OP5_SQL = f"""
with p as (
  select a.vec_id, b.vec_id as neighbour_id, list_distance(a.embedding::double[], b.embedding::double[]) as d
  from embeddings a join embeddings b on a.vec_id <> b.vec_id
), r as (
  select *, row_number() over (partition by vec_id order by d, neighbour_id)::int as rank from p
)
select vec_id, rank, neighbour_id, round(d, 6) as distance from r where rank <= {K}
"""

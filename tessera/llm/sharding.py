"""Operator 3: sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``VNODES`` points on a ring of 64-bit hashes. A key belongs to the first
point clockwise of its own hash; no shard takes more than
ceil((1 + ``SLACK``) * keys / shards) keys, and a key that finds its shard full goes on
clockwise to the next point whose shard is not.

Keys are served in a fixed order: by bucket (a hash of the key, ``BUCKETS`` values), then
by arc (the point they fall before), then by another hash. So only the number of keys of
each cell, arc by bucket, is needed to serve all keys exactly: at most
shards * VNODES * BUCKETS numbers, whatever the size of the data, go to the driver. The
resulting table of cells is of that size too, so it is broadcast and each row finds its shard
where it lies, without a join on ids. In the few cells in which a shard becomes full, keys are
ranked by another hash, and the table has the last key of each shard there.

Defined results: a key is an id, rows that share it share its shard, and null is a key
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _base as B

SHARDS = 64
VNODES = 128
BUCKETS = 32
SLACK = 0.05
#: Cells that the driver holds at most; their table, at 100 bytes each, is broadcast.
CELLS = B.BROADCAST_BYTES // 100


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions as signed 64-bit integers, shard of each)."""
    at = np.array([xxhash.xxh64_intdigest(f"shard {s} point {v}") for s in range(shards) for v in range(vnodes)], np.uint64).view(np.int64)
    of = np.repeat(np.arange(shards, dtype=np.int32), vnodes)
    by = np.lexsort((of, at))
    return at[by], of[by]


def serve(counts: dict[tuple[int, int], int], owner: np.ndarray, shards: int, cap: int) -> list[tuple[int, int, int, int, int]]:
    """Serves the cells (arc, bucket) in order of bucket and arc.

    Returns (arc, bucket, shard, first rank, last rank), ranks from 1."""
    points, load, full = len(owner), [0] * shards, [False] * shards
    ahead = list(range(points))  # a point whose shard isn't full, or one nearer to such

    def free(v: int) -> int:
        path = []
        while full[owner[v]]:
            path.append(v)
            v = ahead[v] if ahead[v] != v else (v + 1) % points
        for x in path:
            ahead[x] = v
        return v

    out = []
    for bucket, arc in sorted((b, a) for a, b in counts):
        n, rank = counts[arc, bucket], 1
        while n:
            s = int(owner[free(arc)])
            take = min(n, cap - load[s])
            out.append((arc, bucket, s, rank, rank + take - 1))
            load[s] += take
            n, rank, full[s] = n - take, rank + take, load[s] >= cap
    return out


def cell_of(key: Column, positions: np.ndarray, buckets: int) -> Column:
    """arc * buckets + bucket of a key."""
    points = len(positions)

    @F.pandas_udf("bigint")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, h.to_numpy(np.int64), "left") % points)

    return arc(F.xxhash64(key, F.lit(31))) * buckets + F.pmod(F.xxhash64(key, F.lit(32)), F.lit(buckets))


def assign(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, buckets: int = BUCKETS, slack: float = SLACK) -> tuple[Column, DataFrame]:
    """(cell of a row of docs, (of, parts) with the shards of each cell, to be broadcast).

    parts: (turn, shard, h, id), in order; h and id are those of the last key of a shard, null
    for the shard that takes the rest of the cell."""
    if shards * vnodes * buckets > CELLS:
        raise ValueError(f"shards * vnodes * buckets is over {CELLS}")
    positions, owner = ring(shards, vnodes)
    ids = B.narrow(docs, id=id_col)
    cell = cell_of(F.col("id"), positions, buckets)
    sizes = ids.distinct().select(cell.alias("cell")).groupBy("cell").count().toPandas()
    counts = {(int(c) // buckets, int(c) % buckets): int(n) for c, n in zip(sizes["cell"], sizes["count"])}
    cap = math.ceil((1 + slack) * sum(counts.values()) / shards)
    parts = pd.DataFrame(serve(counts, owner, shards, cap), columns=["arc", "bucket", "shard", "lo", "hi"])
    parts["of"] = parts["arc"] * buckets + parts["bucket"]
    parts["last"] = ~parts["of"].duplicated(keep="last")
    spark = docs.sparkSession
    table = spark.createDataFrame(parts[["of", "shard", "hi"]].astype("int64").assign(last=parts["last"]), "of bigint, shard bigint, hi bigint, last boolean")
    torn = spark.createDataFrame(parts.loc[~parts["last"], ["of"]].astype("int64").drop_duplicates(), "of bigint")
    few = ids.withColumn("cell", cell).join(F.broadcast(torn), F.col("cell") == F.col("of"), "left_semi").distinct()
    order = few.withColumn("h", F.xxhash64("id", F.lit(33)))
    ranked = order.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("h", "id")))
    ends = ranked.join(F.broadcast(table.where("not last")), (F.col("cell") == F.col("of")) & (F.col("rank") == F.col("hi"))).select("of", "hi", "h", "id")
    both = table.join(F.broadcast(B.cut(ends)), ["of", "hi"], "left")
    turns = F.sort_array(F.collect_list(F.struct(F.col("hi").alias("turn"), F.col("shard").cast("int").alias("shard"), "h", "id")))
    return cell_of(docs[B.q(id_col)], positions, buckets), B.cut(both.groupBy("of").agg(turns.alias("parts")))


def shard_rows(docs: DataFrame, id_col: str = "doc_id", shard_col: str = "shard", **ring_options: object) -> DataFrame:
    """docs with the shard of each row; docs are not shuffled for it."""
    cell, table = assign(docs, id_col, **ring_options)
    at, of, parts, sh = (B.fresh(n, docs) for n in ("__cell", "__of", "__parts", shard_col))
    key = docs[B.q(id_col)]
    h = F.xxhash64(key, F.lit(33))
    met = docs.withColumn(at, cell).join(F.broadcast(table.toDF(of, parts)), F.col(at) == F.col(of))
    mine = F.filter(parts, lambda p: p["h"].isNull() | (h < p["h"]) | ((h == p["h"]) & (key.isNull() | (key <= p["id"]))))
    return met.withColumn(sh, F.element_at(mine, 1)["shard"]).drop(at, of, parts)


def shard_keys(docs: DataFrame, id_col: str = "doc_id", **ring_options: object) -> DataFrame:
    """(doc_id, shard), one row for each key."""
    keys = B.narrow(docs, doc_id=id_col).distinct()
    return shard_rows(keys, "doc_id", **ring_options)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document of the whole documents table."""
    return shard_keys(B.table(spark, sf_dir, "documents"))

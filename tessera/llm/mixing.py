"""Operator 6: mixing sources to target weights by pivotal dependent rounding.

A source of n_s rows with target weight w_s (weights sum to 1) gets w_s * total / n_s
copies of each of its documents: the whole part for sure, the fraction by pivotal
rounding. Two fractions a and b meet; if a + b < 1 one of them takes the sum and the other
becomes 0, else one becomes 1 and the other keeps a + b - 1, each way with the probability
that keeps both expectations. So the number of copies of a source is its expectation
rounded up or down, and every document keeps its own expectation.

Documents of a source are spread over buckets by a hash of their id. A bucket settles all
but one of its documents in one task (pairs at a time, in arrays); what is left climbs a
tree, ``FANOUT`` buckets to a node and a level, then all sources together, and the last one
is settled by its fraction alone. Random numbers are hashes of the ids that meet and the
seed, so the result does not depend on how the data lie.

Without weights, w_s is in proportion to n_s ** ``ALPHA``. Sources not named in given
weights get none. ``total`` is the number of rows if not given.

Defined results: rows that share an id are copied alike (by the least of their sources);
null ids are one such id, null sources one source; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm._text import U, mix

ALPHA = 0.5
FANOUT = 64
#: Documents that one task settles at a time, about.
BUCKET_ROWS = 50_000
EDGE = 1e-9


def pivot(keys: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds fractions p in place, in pairs by order of key, until at most one is left.

    Returns (p, index of the one left or -1)."""
    p = p.copy()
    live = np.argsort(keys, kind="stable")
    live = live[(p[live] > EDGE) & (p[live] < 1 - EDGE)]
    level = 0
    while len(live) > 1:
        level += 1
        odd = live[len(live) // 2 * 2 :]
        i, j = live[0 : len(live) // 2 * 2 : 2], live[1::2]
        a, b = p[i], p[j]
        u = (mix(mix(keys[i].view(U) + U(seed)) ^ keys[j].view(U) ^ U(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U(11)).astype(float) / 2.0**53
        s = a + b
        low = s < 1
        first = np.where(low, u < a / s, u < (1 - b) / np.maximum(2 - s, 1e-300))
        hi, lo = np.where(low, s, 1.0), np.where(low, 0.0, s - 1)
        p[i], p[j] = np.where(first, hi, lo), np.where(first, lo, hi)
        live = np.stack([i, j], 1).ravel()
        live = np.concatenate([live[(p[live] > EDGE) & (p[live] < 1 - EDGE)], odd])
    p[p <= EDGE] = 0
    p[p >= 1 - EDGE] = 1
    return p, int(live[0]) if len(live) else -1


def settle(units: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Pivotal rounding inside each group of units (.., key, p); p is 0 or 1 but for one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, p = pdf["key"].to_numpy(np.int64), pdf["p"].to_numpy(float)
        return pdf.assign(p=pivot(keys, p, seed)[0])

    return units.groupBy(*by).applyInPandas(run, units.schema)


def pivotal(units: DataFrame, rows: int, seed: int = 6) -> DataFrame:
    """Settles every p of units (id, source, p); the sum is kept but for its fraction."""
    buckets = 1
    while buckets * BUCKET_ROWS < rows:
        buckets *= 2
    level = units.withColumn("key", F.xxhash64("id", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(buckets)))
    done, whole = [], (F.col("p") == 0) | (F.col("p") == 1)
    first = True
    while True:
        level = B.cut(settle(level.where(~whole) if not first else level, ["source", "bucket"], seed))
        done.append(level.where(whole))
        level, first = level.where(~whole), False
        if buckets == 1:
            break
        buckets = -(-buckets // FANOUT)
        level = level.withColumn("bucket", F.pmod(F.col("bucket"), F.lit(buckets)))
    root = B.cut(settle(level.withColumn("bucket", F.lit(0).cast("bigint")), ["bucket"], seed))
    coin = F.pmod(F.xxhash64("key", F.lit(seed + 2)), F.lit(1 << 40)) / float(1 << 40)
    done.append(root.withColumn("p", F.when(whole, F.col("p")).otherwise((coin < F.col("p")).cast("double"))))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "source", "p")


def mix_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float | None = None, seed: int = 6) -> DataFrame:
    """(doc_id, source, copies), one row for each id."""
    src = B.narrow(docs, id=id_col, source=source_col)
    sizes = B.cut(src.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = rows if total is None else total
    if weights is None:
        wanted = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = sorted((str(k), float(v)) for k, v in weights.items())
        w = F.element_at(F.create_map(*[F.lit(x) for kv in given for x in kv]), F.col("source").cast("string")) if given else F.lit(0.0)
        wanted = sizes.withColumn("w", F.coalesce(w, F.lit(0.0)))
    sum_w = wanted.agg(F.sum("w")).first()[0] or 1.0
    rate = wanted.select(F.col("source").alias("of"), (F.col("w") / sum_w * float(total) / F.col("n")).alias("x"))
    units = src.groupBy("id").agg(F.min("source").alias("source"))
    units = units.join(B.sized(rate, 64), F.col("source").eqNullSafe(F.col("of"))).withColumn("whole", F.floor("x"))
    units = B.cut(units.select("id", "source", "whole", (F.col("x") - F.col("whole")).alias("p")))
    done = pivotal(units.select("id", "source", "p"), rows, seed)
    sure = B.cut(units.groupBy("source").agg(F.max("whole").alias("whole")).withColumnRenamed("source", "of"))
    out = done.join(B.sized(sure, 64), F.col("source").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("doc_id"), "source", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options: object) -> DataFrame:
    """docs with every row as often as its document has copies, all columns as they were."""
    made = B.cut(mix_copies(docs, id_col, source_col, **options).select("doc_id", "copies"))
    own, n, k = B.fresh("__id", docs), B.fresh("__n", docs), B.fresh("__k", docs)
    made = B.sized(made.toDF(own, n))
    rows = docs.join(made, docs[B.q(id_col)].eqNullSafe(made[own])).where(F.col(n) > 0)
    return rows.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[B.q(c)] for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document of the whole documents table."""
    return mix_copies(B.table(spark, sf_dir, "documents"))

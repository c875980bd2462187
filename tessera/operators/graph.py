"""Approximate nearest neighbours by proximity graphs, one for each shard of the vectors.

A shard's graph links every vector to near ones in different directions (a neighbour is left
out if a nearer one is closer to it than the vector itself) and back. A query walks each
graph best-first from a few entries and keeps ``ef`` candidates; the answers of the shards are
merged. Shards are rows of a table, (shard, ids, vectors, links, ef), so they are built, stored,
searched and changed in parallel, and only vectors that a walk touches are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import Best, distances, matrix, paired, past

#: Vectors of a shard, about; links of a vector; candidates that building and a walk keep.
SHARD, LINKS, POOL, EF, ENTRIES = 8192, 16, 64, 32, 4
#: For queries that a shard does not hold: trials that set the width of their walks, the recall
#: wanted of them among so many nearest.
TRIALS, RECALL, TOP = 256, 0.97, 10


def link(x: np.ndarray, metric: str, m: int = LINKS, pool: int = POOL) -> np.ndarray:
    """Links of each vector, filled up with -1: up to m chosen ones and as many back."""
    n = len(x)
    chosen: list[list[int]] = []
    for at in range(0, n, 512):
        d = distances(x[at : at + 512], x, metric)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, min(pool, n - 1) - 1, axis=1)[:, : min(pool, n - 1)] if n > 1 else np.zeros((len(d), 0), int)
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        for i, own in enumerate(near):
            between = distances(x[own], x[own], metric)
            away, keep, spare = d[i, own], [], []
            for j in range(len(own)):
                if len(keep) == m:
                    break
                (keep if not keep or (between[j, keep] >= away[j]).all() else spare).append(j)
            chosen.append(own[(keep + spare)[:m]].tolist())
    out = np.full((n, 2 * m), -1, np.int32)
    fill = np.zeros(n, np.int64)
    for i, own in enumerate(chosen):
        out[i, : len(own)] = own
        fill[i] = len(own)
    for i, own in enumerate(chosen):
        for j in own:
            if fill[j] < 2 * m and i not in chosen[j]:
                out[j, fill[j]] = i
                fill[j] += 1
    return out


def width(x: np.ndarray, links: np.ndarray, metric: str) -> int:
    """How many candidates a walk has to keep for a query that the graph does not hold.

    Vectors of the graph, which their walks pass over, stand for such queries: the least
    width is taken at which TRIALS of them find RECALL of their TOP nearest."""
    n = len(x)
    own = np.unique(np.linspace(0, n - 1, min(TRIALS, n)).astype(int))
    d = distances(x[own], x, metric)
    d[np.arange(len(own)), own] = np.inf
    most = np.sort(d, axis=1)[:, : min(TOP, n - 1)]
    ef = EF
    while most.size and ef < n:
        got = walk(x[own], x, links, most.shape[1], ef, metric, own)[1]
        if (got <= most[:, -1:] + 1e-9 * (1 + np.abs(most[:, -1:]))).mean() >= RECALL:
            break
        ef = ef * 5 // 4
    return ef


def walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, k: int, ef: int, metric: str, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, distances, vectors compared) of the k nearest that best-first walks find;
    hidden: a place for each query that its walk passes over."""
    n, m = len(x), len(q)
    ef = max(ef, k)
    seen = np.zeros((m, n), bool)
    if hidden is not None:
        seen[np.arange(m), hidden] = True
    place, dist = np.full((m, ef), -1), np.full((m, ef), np.inf)
    done = np.zeros((m, ef), bool)

    def offer(rows: np.ndarray, cand: np.ndarray) -> None:
        """Adds candidates (rows x c, -1 for none) to the lists of rows."""
        nonlocal place, dist, done
        ok = cand >= 0
        ok[ok] = ~seen[np.repeat(rows, ok.sum(1)), cand[ok]]
        seen[np.repeat(rows, ok.sum(1)), cand[ok]] = True
        c = np.where(ok, cand, 0)
        d = np.where(ok, paired(q[rows], x[c], metric), np.inf)
        both = np.concatenate([dist[rows], d], 1)
        by = np.argsort(both, axis=1, kind="stable")[:, :ef]
        take = lambda a: np.take_along_axis(a, by, 1)
        dist[rows] = take(both)
        place[rows] = take(np.concatenate([place[rows], np.where(ok, cand, -1)], 1))
        done[rows] = take(np.concatenate([done[rows], ~ok], 1))

    first = np.linspace(0, n - 1, min(ENTRIES, n)).astype(int)
    offer(np.arange(m), np.repeat(first[None, :], m, 0))
    while True:
        todo = ~done & (place >= 0)
        rows = np.flatnonzero(todo.any(1))
        if not len(rows):
            break
        nxt = todo[rows].argmax(1)
        done[rows, nxt] = True
        cand = links[place[rows, nxt]]
        offer(rows, cand)
    return place[:, :k], dist[:, :k], seen.sum(1)


def whole(x: np.ndarray) -> np.ndarray:
    """Each row as one value."""
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0]


@dataclass
class Graphs:
    """Shards (shard, ids, vectors, links, ef) of an index; ef: how wide a shard is searched
    for vectors that it does not hold."""

    frame: DataFrame
    metric: str
    key: str
    shards: int

    def vectors(self) -> DataFrame:
        """(doc_id, embedding) of what the index holds."""
        return self.frame.select(F.explode(F.arrays_zip("ids", "vectors")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.vectors").alias("embedding"))

    def remove(self, ids: DataFrame) -> Graphs:
        """Without some documents: the shards that hold one are linked anew."""
        left = self.vectors().join(ids.select("doc_id"), "doc_id", "left_anti")
        return build(left, self.metric, shards=self.shards)

    def add(self, vectors: DataFrame, vec: str = "embedding") -> Graphs:
        """With more documents; one that is there is replaced."""
        new = vectors.select("doc_id", F.col(vec).alias("embedding"))
        left = self.vectors().join(new.select("doc_id"), "doc_id", "left_anti")
        return build(left.unionByName(new), self.metric, shards=self.shards)

    def search(self, queries: DataFrame, k: int, ef: int = EF) -> DataFrame:
        """(query_id, doc_id, distance, rank, compared) of each (query_id, q); compared: the
        vectors of all shards that were compared with the query."""
        metric = self.metric

        def meet(best: Best, rows: pa.Table) -> None:
            ids, x, links = rows["doc_id"].to_numpy(), matrix(rows["v"]), matrix(rows["links"], np.int32)
            wide = max(ef, rows["ef"][0].as_py() * max(k, TOP) // TOP)
            held = np.isin(whole(best.q), whole(x))
            for own, most in ((np.flatnonzero(held), ef), (np.flatnonzero(~held), wide)):
                for at in range(0, len(own), 256):
                    part = own[at : at + 256]
                    place, d, n = walk(best.q[part], x, links, k, most, metric)
                    best.compared[part] += n
                    r, c = np.nonzero(place >= 0)
                    best.offer(part[r], ids[place[r, c]], d[r, c])

        node = F.posexplode(F.arrays_zip("ids", "vectors", "links")).alias("place", "x")
        nodes = self.frame.select(F.col("shard").alias("piece"), "ef", node).select("piece", "place", "ef", F.col("x.ids").alias("doc_id"), F.col("x.vectors").alias("v"), F.col("x.links").alias("links"))
        return past(queries, nodes, k, meet)  # every query walks every shard


def build(vectors: DataFrame, metric: str = "L2", vec: str = "embedding", size: int = SHARD, shards: int | None = None, m: int = LINKS) -> Graphs:
    """Graphs of all vectors; null ones are left out. A shard has about size vectors."""
    src = vectors.where(F.col("doc_id").isNotNull() & F.col(vec).isNotNull()).select("doc_id", F.col(vec).cast("array<float>").alias("embedding"))
    key = src.schema["doc_id"].dataType.simpleString()
    if shards is None:
        shards = max(1, -(-src.count() // size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = np.stack(pdf["embedding"])
        made = link(x.astype(np.float64), metric, m)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "ids": [pdf["doc_id"].to_numpy()], "vectors": [list(x)], "links": [list(made)], "ef": [width(x.astype(np.float64), made, metric)]})

    placed = src.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    made = placed.groupBy("shard").applyInPandas(run, f"shard int, ids array<{key}>, vectors array<array<float>>, links array<array<int>>, ef int")
    return Graphs(made, metric, key, shards)

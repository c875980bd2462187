"""Aggregation pipelines: a query, then stages in the order written, folded into one plan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.reducers import Reducer, aggregate, number, parse_reducer, quantile_share
from tessera.operators.sketches.digest import exact_many
from tessera.plans.expr import compile_expr, parse_expr, truth
from tessera.plans.query import parse_query, simplify
from tessera.plans.search import Compiler, Options
from tessera.spec import Index

DEFAULT_BATCH = 1000


class PipelineError(ValueError):
    """A pipeline that cannot be read."""


@dataclass(frozen=True)
class Stage:
    """kind: LOAD, APPLY, FILTER, GROUPBY, SORTBY, LIMIT."""

    kind: str
    names: tuple[str, ...] = ()
    text: str = ""
    reducers: tuple[Reducer, ...] = ()
    ascending: bool = True
    offset: int = 0
    count: int = 0


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...]
    cursor: bool = False
    batch: int = DEFAULT_BATCH


def parse_pipeline(words: Sequence[str]) -> Pipeline:
    """Stages from the words that follow the query; expressions are checked here."""
    w, i, stages = [str(x) for x in words], 0, []
    cursor, batch = False, DEFAULT_BATCH

    def count() -> tuple[str, ...]:
        nonlocal i
        if i >= len(w) or not w[i].isdigit() or i + int(w[i]) >= len(w):
            raise PipelineError("a count and as many words are expected")
        n = int(w[i])
        got, i = tuple(w[i + 1 : i + 1 + n]), i + 1 + n
        return got

    bare = lambda xs: tuple(x.removeprefix("@") for x in xs)
    while i < len(w):
        kind, i = w[i].upper(), i + 1
        if kind == "LOAD":
            stages.append(Stage("LOAD", bare(count())))
        elif kind in ("APPLY", "FILTER"):
            if i >= len(w):
                raise PipelineError(f"{kind} takes an expression")
            text, i = w[i], i + 1
            parse_expr(text)
            if kind == "FILTER":
                stages.append(Stage("FILTER", text=text))
            elif i + 1 < len(w) and w[i].upper() == "AS":
                stages.append(Stage("APPLY", (w[i + 1],), text))
                i += 2
            else:
                raise PipelineError("APPLY needs AS and a name")
        elif kind == "GROUPBY":
            stages.append(Stage("GROUPBY", bare(count())))
        elif kind == "REDUCE":
            r, i = parse_reducer(w, i)
            if stages and stages[-1].kind == "GROUPBY":
                last = stages.pop()
                stages.append(Stage("GROUPBY", last.names, reducers=(*last.reducers, r)))
            else:
                stages.append(Stage("GROUPBY", reducers=(r,)))
        elif kind == "SORTBY":
            got = count()
            if not got:
                raise PipelineError("SORTBY takes a field")
            stages.append(Stage("SORTBY", bare(got[:1]), ascending=not (len(got) > 1 and got[1].upper() == "DESC")))
        elif kind == "LIMIT":
            if i + 1 >= len(w) or not (w[i].isdigit() and w[i + 1].isdigit()):
                raise PipelineError("LIMIT takes an offset and a count")
            stages.append(Stage("LIMIT", offset=int(w[i]), count=int(w[i + 1])))
            i += 2
        elif kind == "WITHCURSOR":
            cursor = True
        elif kind in ("COUNT", "MAXIDLE") and i < len(w) and w[i].isdigit():
            batch, i = int(w[i]) if kind == "COUNT" else batch, i + 1
        else:
            raise PipelineError(f"unknown stage {kind!r}")
    return Pipeline(tuple(stages), cursor, batch)


def run_stage(df: DataFrame, s: Stage) -> DataFrame:
    """One stage as a frame transform."""
    if s.kind == "LOAD":
        return df
    if s.kind == "APPLY":
        return df.withColumn(s.names[0], compile_expr(s.text, df.schema).col)
    if s.kind == "FILTER":
        return df.where(truth(compile_expr(s.text, df.schema)))
    if s.kind == "SORTBY":
        name = s.names[0]
        if name not in df.columns:
            return df
        c = F.col(f"`{name}`")
        ties = [F.col(f"`{c}`") for c in df.columns if c == "doc_id"] or [F.col(f"`{x}`") for x in df.columns if x != name]
        return df.orderBy(c.asc() if s.ascending else c.desc(), *ties)
    if s.kind == "LIMIT":
        return df.offset(s.offset).limit(s.count)
    return group(df, s)


def group(df: DataFrame, s: Stage) -> DataFrame:
    """GROUPBY with its reducers: partial and final aggregation; quantiles by counting.

    Without keys there is one group, which is not there when there are no rows."""
    keys = {n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) if n in df.columns else F.lit("") for n in s.names}
    if not s.reducers:
        return df.select(*[c.alias(n) for n, c in keys.items()]).distinct()
    own = {n: f"__key{i}" for i, n in enumerate(keys)} or {"": "__key0"}
    df = df.withColumns({k: keys.get(n, F.lit("")) for n, k in own.items()})
    plain = [aggregate(r, df.schema) for r in s.reducers if r.name != "QUANTILE"]
    out = df.groupBy(*own.values()).agg(*plain) if plain else df.select(*own.values()).distinct()
    asked: dict[str, dict[str, float]] = {}
    for r in s.reducers:
        if r.name == "QUANTILE":
            asked.setdefault(r.args[0].removeprefix("@"), {})[r.alias] = quantile_share(r)
    for field, shares in asked.items():  # one pass a field
        found = exact_many(df.withColumn("__v", number(df.schema, field)), "__v", shares, list(own.values()))
        out = out.join(found, list(own.values()), "left").withColumns({a: F.coalesce(F.col(f"`{a}`"), F.lit(0.0)) for a in shares})
    return out.select(*[F.col(own[n]).alias(n) for n in keys], *[F.col(f"`{r.alias}`") for r in s.reducers])


def run_aggregate(index: Index, query: str, words: Sequence[str] | Pipeline) -> DataFrame:
    """The documents that match a query, through the stages; scores and nearest-neighbour
    clauses play no part here."""
    pipeline = words if isinstance(words, Pipeline) else parse_pipeline(words)
    comp = Compiler(index, Options(), {})
    rows = comp.rows(simplify(parse_query(query).root))
    df = rows.select(*[F.col(f"`{c}`") for c in index.docs.columns])
    for s in pipeline.stages:
        df = run_stage(df, s)
    return df


class Cursors:
    """Open results that are read a batch at a time.

    The frame is kept and its rows numbered from the sizes of its partitions, in order."""

    def __init__(self) -> None:
        self.open: dict[str, tuple[DataFrame, int, int, int]] = {}
        self.held: dict[str, DataFrame] = {}

    def start(self, df: DataFrame, batch: int = DEFAULT_BATCH) -> tuple[str, DataFrame]:
        """(id, first batch); the id is '0' once all is read."""
        mark = F.monotonically_increasing_id()  # the partition's number, then the row's in 33 bits
        placed = df.withColumn("__at", mark).persist()
        part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect())
        before = dict(zip((p for p, _ in sizes), accumulate([0, *(n for _, n in sizes)])))
        starts = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__p long, __before long")
        kept = placed.join(F.broadcast(starts), part == F.col("__p")).withColumn("__row", F.col("__before") + place + 1).drop("__p", "__before", "__at")
        key = uuid.uuid4().hex
        self.open[key] = (kept, 0, sum(n for _, n in sizes), batch)
        self.held[key] = placed
        return self.read(key)

    def read(self, key: str, batch: int | None = None) -> tuple[str, DataFrame]:
        if key not in self.open:
            raise PipelineError("no such cursor")
        df, at, total, usual = self.open[key]
        stop = at + (batch or usual)
        rows = df.where((F.col("__row") > at) & (F.col("__row") <= stop)).orderBy("__row").drop("__row")
        if stop >= total:
            del self.open[key]
            self.held.pop(key)
            return "0", rows
        self.open[key] = (df, stop, total, usual)
        return key, rows

    def close(self, key: str) -> None:
        if key not in self.open:
            raise PipelineError("no such cursor")
        self.open.pop(key)
        self.held.pop(key).unpersist()


def batches(df: DataFrame, size: int = DEFAULT_BATCH) -> Iterator[list]:
    """All rows in lists of at most size, a partition at a time."""
    held: list = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held

"""Explaining, timing and limiting queries."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessera.plans.pipeline import run_aggregate
from tessera.plans.query import QueryError, explain, parse_query
from tessera.plans.search import search
from tessera.spec import Index


def explain_query(query: str) -> str:
    """The query's tree as text."""
    return explain(parse_query(query))


def explain_lines(index: Index, query: str) -> DataFrame:
    """The same, a line a row."""
    lines = explain_query(query).split("\n")
    return index.docs.sparkSession.createDataFrame(list(enumerate(lines)), "line int, text string")


def profile(index: Index, query: str, words: Sequence[str] | None = None) -> DataFrame:
    """One row: microseconds to read the query, to plan and to run it, documents, results."""
    t0 = time.perf_counter()
    parse_query(query)
    t1 = time.perf_counter()
    df = search(index, query, nocontent=True) if words is None else run_aggregate(index, query, words)
    t2 = time.perf_counter()
    n = df.count()
    t3 = time.perf_counter()
    us = lambda a, b: int((b - a) * 1e6)
    return index.docs.sparkSession.createDataFrame([(us(t0, t1), us(t1, t2), us(t2, t3), us(t0, t3), index.docs.count(), n)], "parse_us long, plan_us long, run_us long, total_us long, documents long, results long")


def collect_within(df: DataFrame, ms: int) -> list:
    """The rows of df; its jobs are cancelled after ms milliseconds, which raises."""
    spark, group = df.sparkSession, f"tessera-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(group) if hasattr(spark, "interruptTag") else spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(ms / 1000, stop)
    spark.addTag(group)
    timer.start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            raise QueryError("the query took too long") from None
        raise
    finally:
        timer.cancel()
        spark.removeTag(group)

"""Sketches that take the items of each key in turn, read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_turn[S](rows: DataFrame, order: list[str], out: str, start: Callable[[], S], feed: Callable[[S, pa.RecordBatch], None], end: Callable[[S], dict[str, list]]) -> DataFrame:
    """(key, ..) of rows with a column key: a state of each key is started, fed with its rows
    by order, nulls last, and gives its columns at the end.

    The engine sorts and spills; a task holds a state and a batch, however many rows a key has."""
    kind = rows.schema["key"].dataType.simpleString()
    at = rows.columns.index("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = last = key = None

        def done() -> pa.RecordBatch:
            cols = end(state)  # type: ignore[arg-type]
            n = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([pa.repeat(key, n), *map(pa.array, cols.values())], names=["key", *cols])

        for b in batches:
            codes = b.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), len(codes)]
            for a, z in zip(ends, ends[1:]):
                if a == z:
                    continue
                own = repr(b.column(at)[a].as_py())
                if own != last:
                    if state is not None:
                        yield done()
                    state, last, key = start(), own, pa.scalar(b.column(at)[a].as_py(), b.column(at).type)
                feed(state, b.slice(a, z - a))  # type: ignore[arg-type]
        if state is not None:
            yield done()

    by = [F.col(c).asc_nulls_last() for c in order]
    return rows.repartition("key").sortWithinPartitions("key", *by).mapInArrow(run, f"key {kind}, {out}")

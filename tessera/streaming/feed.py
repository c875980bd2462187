"""Change feeds: a stream of writes and deletes keeps a table of documents up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.store import upsert


def fold_changes(base: DataFrame | None, changes: DataFrame, key: str = "doc_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """base after changes, rows with an op of 'delete' taking their document away."""
    last = upsert(None, changes, key, seq)
    kept = last.where(F.col(op) != "delete").drop(op)
    if base is None:
        return kept
    return base.join(last.select(key), key, "left_anti").unionByName(kept)


class TableFeed:
    """foreachBatch target: versions of a parquet table, the newest named by ``current``.

    Each batch writes a new version from the last and the batch alone, under the batch's
    number, so a batch that is run again gives the same version."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", after: Callable[[DataFrame], None] | None = None):
        self.spark, self.root, self.key, self.after = spark, root, key, after
        self.done = -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        base = self.spark.read.parquet(f"{self.root}/v{number - 1}") if number > 0 else None
        fold_changes(base, batch, self.key).write.mode("overwrite").parquet(f"{self.root}/v{number}")
        self.done = number
        if self.after:
            self.after(self.current())

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.done}")


def follow(changes: DataFrame, feed: TableFeed, checkpoint: str) -> StreamingQuery:
    """Runs a feed over a stream until what is there now is done."""
    return changes.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and key of a stream; late rows beyond the watermark go."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), by).agg(F.count(F.lit(1)).alias("n"))

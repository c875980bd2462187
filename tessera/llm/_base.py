"""Shared plumbing of the corpus operators: names, checkpoints, sized joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.sources.folders import new_folder, remove, shared_folder

#: A side of a join is broadcast only when it holds at most this many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, letter case ignored."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that whatever
    else the table holds cannot clash with them."""
    return df.select(*[df[q(src)].alias(own) for own, src in cols.items()])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """(df, written as a Parquet table in the shared folder and read again, the table's path)."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def sized(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """df with a broadcast hint if its counted rows, at row_bytes in memory, are small
    enough, else as it is.
    To be called on checkpointed frames, where counting costs next to nothing."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def keep_rows(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of docs with the one id column of a checkpointed frame."""
    own = fresh("__id", docs)
    ids = sized(ids.toDF(own))
    return docs.join(ids, docs[q(id_col)] == ids[own], how)


def one_row_per_id(docs: DataFrame, id_col: str) -> DataFrame:
    """One row for each id; of repeated rows the first by content stays, null ids all.

    Only the repeated ids are sorted: everything else passes without a shuffle."""
    ids = docs.select(docs[q(id_col)].alias("k")).where("k is not null")
    twice = cut(ids.groupBy("k").count().where("count > 1").select("k"))
    if twice.isEmpty():
        return docs
    rank, body = fresh("__rank", docs), F.xxhash64(F.to_json(F.struct(*[docs[q(c)] for c in docs.columns])))
    many = keep_rows(docs, id_col, twice, "left_semi").withColumn(
        rank, F.row_number().over(Window.partitionBy(q(id_col)).orderBy(body))
    )
    first = many.where(F.col(rank) == 1).drop(rank)
    return keep_rows(docs, id_col, twice, "left_anti").unionByName(first)


def id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) by alternating large-star and small-star steps.

    Returns (u, v) with v the smallest id of u's component, for every u that is not
    itself the smallest. Rounds grow with the logarithm of the largest component.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = (
            both.withColumn("m", F.least("u", F.min("v").over(w)))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        small = large.withColumn("m", F.min("v").over(w))
        e = cut(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        seen = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            return e
        mark = seen

"""The corpus pipeline: five stages over the documents table, each on all that the one
before it kept. ``STAGES`` are (name, function) pairs; a function takes (spark, docs,
sf_dir) and returns a DataFrame. All but the last return the columns of their input, in
order, whatever other columns there are.

Defined results: null and empty texts and empty tables pass every function; what each stage
does with them, with null ids and with repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm._base import remove, stored, table
from tessera.llm.decontam import drop_leaks
from tessera.llm.langid import fit_model, keep_identified
from tessera.llm.mixing import mix_sources
from tessera.llm.sharding import shard_rows
from tessera.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: those without a letter (null and empty
    texts too) and those of which half or more is in no language. Rows are judged one by one,
    so null ids and repeated rows make no difference. No shuffle."""
    return keep_identified(docs, fit_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id. Of rows that
    share an id the first by content stays; rows with a null id stay, as do null texts."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, all rows of their id; null ids and null texts
    stay, and everything if the benchmark is empty."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it copied, so some go and some
    are repeated. Rows that share an id are copied alike, null being one id and one source."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard of its id; rows that share an id share it, null being one."""
    return shard_rows(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: SimHash groups, language models and keyed random rounding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents table. The result of each but the last is written
    as Parquet in the shared folder and read again; it is removed once the next one is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, path = stored(docs)
            if old:
                remove(spark, old)
            old = path
    return docs

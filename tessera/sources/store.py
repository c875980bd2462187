"""Upserts, deletes and snapshots of document frames."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.spec import Catalog, Field, Index, Spec

VERSION = 1


def upsert(base: DataFrame | None, changes: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """base with whole rows replaced by id.

    Among changes the row of greatest seq wins (any one of equal ids without seq). One
    aggregation picks it, with partial results on the map side, so a key with many changes
    does not gather in one task; base is only filtered."""
    cols = [c for c in changes.columns if c not in (key, seq)]
    if seq in changes.columns:
        row = F.struct(*[F.col(f"`{c}`") for c in cols])
        latest = changes.groupBy(key).agg(F.max_by(row, seq).alias("r")).select(key, *[F.col(f"r.`{c}`") for c in cols])
    else:
        latest = changes.dropDuplicates([key])
    if base is None:
        return latest
    return base.join(latest.select(key), key, "left_anti").unionByName(latest)


def delete(base: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """base without the ids."""
    return base.join(ids.select(key), key, "left_anti")


def snapshot(index: Index, path: str) -> None:
    """Writes the documents and the definition, which keeps everything it declares."""
    index.docs.write.mode("overwrite").parquet(f"{path}/documents")
    text = json.dumps({"version": VERSION, "spec": asdict(index.spec), "synonyms": {k: list(v) for k, v in index.synonyms.items()}})
    index.docs.sparkSession.createDataFrame([(text,)], "definition string").coalesce(1).write.mode("overwrite").text(f"{path}/definition")


def restore(catalog: Catalog, path: str, name: str | None = None) -> Index:
    """Reads a snapshot back into a catalogue; what does not fit is refused."""
    spark: SparkSession = catalog.spark
    got = json.loads(spark.read.text(f"{path}/definition", wholetext=True).first()[0])
    if got.get("version") != VERSION:
        raise ValueError("unknown snapshot version")
    s = got["spec"]
    spec = Spec(**{**s, "name": name or s["name"], "fields": tuple(Field(**f) for f in s["fields"]), **{k: tuple(s[k]) for k in ("prefixes", "flags")}, "stopwords": None if s["stopwords"] is None else tuple(s["stopwords"])})
    docs = spark.read.parquet(f"{path}/documents")
    if missing := {f.name for f in spec.fields} - set(docs.columns):
        raise ValueError(f"the snapshot lacks {sorted(missing)}")
    index = catalog.create(spec, docs)
    index.synonyms = {k: tuple(v) for k, v in got["synonyms"].items()}
    return index


def save_frame(df: DataFrame, path: str) -> None:
    """Sketches and JSON documents are frames; a parquet directory keeps them."""
    df.write.mode("overwrite").parquet(path)

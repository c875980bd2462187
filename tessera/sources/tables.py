"""Document sources: tables, keyed hashes and keyed JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.json_path import json_query, loads, parse_path
from tessera.spec import Spec, has_prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str) -> DataFrame:
    """df with its key as doc_id."""
    return df.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else df


def scan_keys(keys: DataFrame, spec: Spec, key: str = "key") -> DataFrame:
    """The rows whose key has one of the prefixes of an index; all without prefixes."""
    return keys.where(has_prefix(F.col(key), spec.prefixes)) if spec.prefixes else keys


def hash_source(df: DataFrame, spec: Spec, key: str = "key", fields: str = "fields") -> DataFrame:
    """Documents from (key, map<string,string>): the index's fields, vectors left out.

    A hash with none of the fields is no document."""
    names = [f.name for f in spec.fields if f.type != "VECTOR"]
    cols = [F.try_element_at(F.col(fields), F.lit(n)).alias(n) for n in names]
    some = F.coalesce(*[F.try_element_at(F.col(fields), F.lit(n)) for n in names])
    return scan_keys(df, spec, key).where(some.isNotNull()).select(F.col(key).alias("doc_id"), *cols)


def json_source(df: DataFrame, spec: Spec, key: str = "key", json: str = "json") -> DataFrame:
    """Documents from (key, JSON text), a path for each field; tags keep all matches."""
    cols = []
    for f in spec.fields:
        path = f.path or f"$.{f.name}"
        if f.type == "TAG":
            found = json_query(F.col(json), path)
            bare = F.transform(found, lambda t: F.when(t.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")).otherwise(t))
            cols.append(F.when(F.size(bare) > 0, bare).alias(f.name))
        elif f.type == "VECTOR":
            cols.append(F.from_json(F.get_json_object(json, path), "array<float>").alias(f.name))
        else:
            parse_path(path)
            cols.append(F.get_json_object(json, path).alias(f.name))
    return scan_keys(df, spec, key).select(F.col(key).alias("doc_id"), *cols)


__all__ = ["documents", "hash_source", "json_source", "loads", "scan_keys", "table"]

"""Suggestion dictionaries, term dictionaries, synonyms and spelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.query import parse_query, plain_terms
from tessera.plans.search import vocabulary
from tessera.spec import Index


def add_suggestions(entries: DataFrame, new: DataFrame, increase: bool = False) -> DataFrame:
    """(term, score, payload) after (term, score, payload, seq): the last score of a term
    wins, or all are added; terms are lower case and a null payload keeps the old one."""
    low = F.lower("term").alias("term")
    both = entries.select(low, F.col("score").cast("double"), "payload", F.lit(-1).cast("bigint").alias("seq")).unionByName(new.select(low, F.col("score").cast("double"), "payload", F.col("seq").cast("bigint")))
    score = F.sum("score") if increase else F.max_by("score", "seq")
    return both.groupBy("term").agg(score.alias("score"), F.max_by("payload", F.when(F.col("payload").isNotNull(), F.col("seq"))).alias("payload"))


def suggest(entries: DataFrame, prefix: str, most: int = 5, fuzzy: bool = False) -> DataFrame:
    """Entries that begin with the prefix, or are one edit from it, best score first."""
    p = prefix.lower()
    near = F.levenshtein(F.col("term"), F.lit(p), 1).between(0, 1) if fuzzy else F.lit(False)
    return entries.where(F.col("term").startswith(p) | near if not fuzzy else near).orderBy(F.desc("score"), "term").limit(most)


def remove_terms(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """entries without the terms."""
    return entries.join(terms.select(F.lower("term").alias("term")), "term", "left_anti")


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """The distinct terms of a column, in order."""
    return df.select(F.col(col).alias("term")).where("term is not null").distinct().orderBy("term")


def dictionary_add(terms: DataFrame, new: DataFrame) -> DataFrame:
    return terms.select("term").union(new.select("term")).distinct()


def dictionary_remove(terms: DataFrame, gone: DataFrame) -> DataFrame:
    return terms.join(gone.select("term"), "term", "left_anti")


def synonym_groups(pairs: DataFrame) -> DataFrame:
    """(term, groups) of (group_id, term): the groups of each term, in order."""
    return pairs.groupBy(F.lower("term").alias("term")).agg(F.array_sort(F.collect_set("group_id")).alias("groups"))


def expand_synonyms(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(term, other): each term with all terms of its groups, itself too."""
    p = pairs.select("group_id", F.lower("term").alias("other"))
    own = p.select("group_id", F.col("other").alias("term"))
    found = terms.select(F.lower("term").alias("term")).join(own, "term").join(p, "group_id").select("term", "other")
    return found.union(terms.select(F.lower("term").alias("term"), F.lower("term").alias("other"))).distinct()


def update_synonyms(index: Index, group: str, terms: Sequence[str]) -> None:
    """Adds terms to a group of an index; searches use them if they ask to."""
    index.synonyms[group] = tuple(dict.fromkeys([*index.synonyms.get(group, ()), *(t.lower() for t in terms)]))


def spellcheck(index: Index, query: str, distance: int = 1, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(term, suggestion, score) for the query's words that no document has.

    Words of the index score by the share of documents that have them; words of an include
    dictionary by 1 / distance; the better score stays."""
    spark = index.docs.sparkSession
    words = sorted(set(plain_terms(parse_query(query).root)))
    asked = spark.createDataFrame([(w,) for w in words], "term string")
    vocab = None
    for f in index.spec.of("TEXT"):
        v = vocabulary(index, f.name)
        vocab = v if vocab is None else vocab.unionByName(v)
    if vocab is None:
        return spark.createDataFrame([], "term string, suggestion string, score double")
    vocab = vocab.groupBy("term").agg(F.max("df").alias("df"))
    asked = asked.join(vocab, "term", "left_anti")
    for known in (include, exclude):
        if known is not None:
            asked = asked.join(known.select("term"), "term", "left_anti")
    n = index.docs.count()
    edits = lambda a, b: F.levenshtein(a, b, distance)
    left = [r.term for r in asked.collect()]  # as many as the query has words
    found = None
    for w in left:
        d = edits(F.col("term"), F.lit(w))
        own = vocab.where(d.between(1, distance)).select(F.lit(w).alias("term"), F.col("term").alias("suggestion"), (F.col("df") / max(n, 1)).alias("score"))
        if include is not None:
            d = edits(F.col("term"), F.lit(w))
            own = own.unionByName(include.where(d.between(1, distance)).select(F.lit(w).alias("term"), F.col("term").alias("suggestion"), (1.0 / d).alias("score")))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "term string, suggestion string, score double")
    return found.groupBy("term", "suggestion").agg(F.max("score").alias("score")).orderBy("term", F.desc("score"), "suggestion")


def score_of(entries: DataFrame, term: str) -> Column:
    return F.max(F.when(F.col("term") == term.lower(), F.col("score")))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Mapping", "Sequence", "Column", "DataFrame")]

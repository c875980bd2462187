"""Inverted lists of text fields as stored tables.

``write_lists`` tokenises a frame once and leaves two tables a field in a folder: ``lists``
with (term, doc_id, tf, positions, size) and ``terms`` with (term, df, total). Lists lie in
``buckets`` folders by a hash of the term, sorted by term, so a query reads the folders and row
groups of its terms alone; a bucket, and so the list of a frequent term, is spread over ``parts``
files by a hash of the document. Parts grow in number with the text, so no task writes or reads
more of a larger table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

BUCKETS = 32
LISTS = "size int, term string, tf int, positions array<int>, bucket int"
TERMS = "term string, df bigint, total bigint"
#: Characters of text for each part of the buckets, about; a task makes one part of one bucket.
PART_CHARS = 200_000_000
ROWS_AT_ONCE = 500


@dataclass
class TextLists:
    """Stored lists of an index, and how many documents have each field."""

    spark: SparkSession
    path: str
    docs: dict[str, int]
    key: str
    buckets: int = BUCKETS
    means: dict[str, float] = field(default_factory=dict)

    def terms(self, name: str) -> DataFrame:
        return self.spark.read.schema(TERMS).parquet(f"{self.path}/{name}/terms")

    def all(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"doc_id {self.key}, {LISTS}").parquet(f"{self.path}/{name}/lists")

    def lists(self, name: str, terms: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
        """The lists of some terms, and of all that begin with one of some prefixes."""
        rows = self.all(name)
        test = F.lit(False)
        if terms:
            test = F.col("term").isin(*terms)
            if not prefixes:
                own = self.spark.range(1).select(*[bucket_of(F.lit(t), self.buckets) for t in terms]).first()
                test = test & F.col("bucket").isin(*sorted(set(own)))
        for p in prefixes:
            test = test | F.col("term").startswith(p)
        return rows.where(test)

    def mean(self, name: str) -> float:
        """Words of the documents that have the field, on average."""
        if name not in self.means:
            total = self.terms(name).agg(F.sum("total")).first()[0] or 0
            self.means[name] = total / self.docs[name] if self.docs[name] else 0.0
        return self.means[name]

    def hits(self, name: str, terms: Sequence[str], prefixes: Sequence[str], hit: str, size: str) -> DataFrame:
        """(doc_id, map from term to (tf, positions), words) of documents with any of the terms."""
        one = F.struct("term", F.struct("tf", "positions").alias("at"))
        rows = self.lists(name, terms, prefixes).groupBy("doc_id")
        return rows.agg(F.map_from_entries(F.collect_list(one)).alias(hit), F.first("size").alias(size))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def own_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, size, term, tf, positions) of docs (doc_id, x), document by document: a text's
    words are grouped where it is read, so only its list entries are shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                of, sizes, terms, places = [], [], [], []
                for i, x in enumerate(b.column(1).to_pylist()):
                    words = text.words(x)
                    own: dict[str, list[int]] = {}
                    for k, w in enumerate(words):
                        own.setdefault(w, []).append(k)
                    of += [i] * len(own)
                    sizes += [len(words)] * len(own)
                    terms += own.keys()
                    places += own.values()
                tf = [len(p) for p in places]
                ends = np.concatenate([[0], np.cumsum(np.array(tf, np.int64))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array([k for p in places for k in p], pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(sizes, pa.int32()), pa.array(terms, pa.string()), pa.array(tf, pa.int32()), lists], names=["doc_id", "size", "term", "tf", "positions"])

    return docs.mapInArrow(run, f"doc_id {kind}, size int, term string, tf int, positions array<int>")


def write_lists(docs: DataFrame, names: Sequence[str], path: str, buckets: int = BUCKETS) -> TextLists:
    """Tokenises the text fields of docs (doc_id, ..) and writes their lists under path.

    Where there are fewer partitions than tasks can run, documents are hashed by id first."""
    spark, sizes = docs.sparkSession, {}
    made = TextLists(spark, path, sizes, docs.schema["doc_id"].dataType.simpleString(), buckets)
    tasks = spark.sparkContext.defaultParallelism
    for name in names:
        c = F.col(f"`{name}`")
        have = docs.where(c.isNotNull()).select("doc_id", c.alias("x"))
        sizes[name], chars = have.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("x")), F.lit(0))).first()
        parts = max(1, -(-chars // PART_CHARS))
        if have.rdd.getNumPartitions() < max(tasks, parts):
            have = have.repartition(max(tasks, parts), "doc_id")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
        spread = own_lists(have).withColumn("bucket", bucket_of(F.col("term"), buckets)).repartitionById(buckets * parts, F.col("bucket") * parts + part)
        spread.sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/{name}/lists")
        counts = made.all(name).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        counts.select("term", "df", "total").sortWithinPartitions("term").write.parquet(f"{path}/{name}/terms")
    return made

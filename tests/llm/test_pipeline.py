"""The pipeline against brute-force versions of its stages, each on its own input."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import simhash as S
from tessera.llm.langid import fit_model, identify

from .test_decontam import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows of documents, then of each stage, written and read again."""
    out, docs, root = [], spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("steps")
    out.append(docs.collect())
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs.collect())
    return out


def test_stages_and_columns(spark, steps):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for rows in steps[:-1]:
        assert rows and list(rows[0].asDict()) == columns
    assert list(steps[-1][0].asDict()) == [*columns, "shard"]


def test_language_id_keeps_what_it_identifies(spark, steps):
    model = fit_model(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = {r.doc_id for r in steps[0] if identify(model, [r.text]).lang != ["und"]}
    assert {r.doc_id for r in steps[1]} == kept and len(kept) >= 0.99 * len(steps[0])


def test_near_dedup_against_all_pairs(steps):
    rows = sorted(steps[1], key=lambda r: r.doc_id)
    f, _ = S.fingerprint_batch([r.text for r in rows])
    bits = np.unpackbits(f.view(np.uint8), axis=1)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero((bits[i] != bits[:i]).sum(1) <= S.RADIUS):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    want = {rows[i].doc_id for i in range(len(rows)) if find(i) == i}
    got = {r.doc_id for r in steps[2]}
    assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want))


def test_decontamination_against_brute_force(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, _ in brute([(r.doc_id, r.text) for r in steps[2]], items)}
    assert {r.doc_id for r in steps[3]} == {r.doc_id for r in steps[2]} - gone


def test_mix_reaches_targets(steps):
    n, got = Counter(r.source for r in steps[3]), Counter(r.source for r in steps[4])
    total = sum(math.sqrt(k) for k in n.values())
    for s, k in n.items():
        assert abs(got[s] - len(steps[3]) * math.sqrt(k) / total) <= 1


def test_shards_hold_every_row_in_bounds(steps):
    assert Counter((r.doc_id, r.text) for r in steps[5]) == Counter((r.doc_id, r.text) for r in steps[4])
    shard = {}
    assert all(shard.setdefault(r.doc_id, r.shard) == r.shard for r in steps[5])
    assert max(Counter(shard.values()).values()) <= math.ceil(1.05 * len(shard) / 64)


def test_run_equals_the_stages(spark, steps):
    key = lambda r: (r.doc_id, r.source, r.shard)
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, steps[-1]))


def test_odd_documents(spark, tmp_path):
    bench = spark.createDataFrame([(1, None), (None, "a b c")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None, "en", "s", 0, 1), (2, "", None, "s", 0, 1), (None, "this is what they said of it", "en", None, 0, 1), (3, "this is what they said of all", None, "s", 0, 1), (3, "this is what they said of all", None, "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, KEEP int")
    for d in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            columns = d.columns
            stage(spark, d, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            d = spark.read.parquet(f"{tmp_path}/{name}")
            assert d.columns[: len(columns)] == columns
    assert d.count() == 0
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/language_id").select(F.col("doc_id")).collect()} == set()

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, neighbours
from tessera.operators.sketches import bloom, cms, cuckoo, digest, topk
from tessera.operators.sketches.bloom import FilterError
from tessera.operators.sketches.cms import SketchError


@pytest.mark.parametrize("rate,bits,hashes", [(0.01, 1024, 7), (0.005, 1152, 8), (0.001, 1472, 10)])
def test_bloom_layout(rate, bits, hashes):
    assert bloom.layout(rate, 100) == (bits, hashes)


@pytest.mark.parametrize("rate,capacity,expansion,n", [(0.01, 100, 2, 500), (0.001, 50, 1, 200), (0.05, 1000, 0, 900), (0.01, 64, 4, 2000)])
def test_bloom_chain(rate, capacity, expansion, n):
    c = bloom.Chain(bloom.Params(rate, capacity, expansion))
    c.add_many(f"k:item:{i}" for i in range(n))
    assert all(f"k:item:{i}" in c for i in range(n))
    assert sum(f"k:probe:{i}" in c for i in range(2000)) / 2000 < max(3 * rate, 0.01)
    assert c.cardinality <= n and c.info()["filters"] == len(c.layers)
    for made in (bloom.Chain.load(c.dump()), bloom.Chain.from_chunks(c.chunks())):
        assert made.dump() == c.dump() and made.add("k:item:0") is False


def test_bloom_refusals():
    for p in (dict(rate=0), dict(rate=1), dict(capacity=0), dict(capacity=2**31), dict(expansion=-1), dict(expansion=40000)):
        with pytest.raises(FilterError):
            bloom.Params(**p)
    full = bloom.Chain(bloom.Params(0.01, 3, 0))
    assert full.add_many(range(9)).count(True) == 3
    with pytest.raises(FilterError):
        [full.add(100 + i) for i in range(9)]
    raw = full.dump()
    for bad in (b"", raw[:-1], raw + b"x", raw[:30] + b"\xff" + raw[31:]):
        with pytest.raises(FilterError):
            bloom.Chain.load(bad)


def test_bloom_frames(spark):
    df = spark.range(5000).select(F.concat(F.lit("i"), "id").alias("x")).union(spark.createDataFrame([(None,)], "x string"))
    t = bloom.build(df, "x", 0.01)
    assert bloom.probe(df.where("x is not null"), "x", t).where("not seen").count() == 0
    other = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("x"))
    assert bloom.probe(other, "x", t).where("seen").count() < 150
    assert bloom.probe(df.where("x is null"), "x", t).first().seen is False
    with pytest.raises(FilterError):
        bloom.merge(t, bloom.build(df, "x", 0.001))


def test_bloom_items_by_their_hashes_in_turn():
    for params, n in ((bloom.Params(0.05, 8, 2), 3000), (bloom.Params(0.2, 16, 1), 400), (bloom.Params(0.1, 50, 0), 300)):
        items = [str(random.Random(3).randrange(n)) for _ in range(7)] + [str(i % (n * 2 // 3)) for i in range(n)]
        one, many = bloom.Chain(params), bloom.Chain(params)
        told = one.add_many(items)
        for at in range(0, n + 7, 97):
            if not many.add_hashed(*bloom.hashes_of(items[at : at + 97])):
                assert len(told) < len(items)
                break
        assert many.dump() == one.dump()
        asked = [str(i) for i in range(2 * n)]
        assert many.has_hashed(*bloom.hashes_of(asked)).tolist() == [x in one for x in asked]


def test_bloom_fold_is_read_as_a_stream(spark):
    rows = [(k, f"{k}-{i % 50}", 1000 - i) for i in range(500) for k in ("a", "b", None)]
    df = spark.createDataFrame(rows, "k string, x string, o long")
    f = bloom.fold(df, "k", "x", "o", bloom.Params(0.01, 8, 2))
    assert "FlatMapGroups" not in f._jdf.queryExecution().toString()
    got = {r.key: bytes(r.filter) for r in f.collect()}
    for k in ("a", "b", None):
        c = bloom.Chain(bloom.Params(0.01, 8, 2))
        c.add_many(x for own, x, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]))
        assert got[k] == c.dump()
    asked = spark.createDataFrame([("a", "a-1"), ("b", "a-1"), ("z", "a-1"), (None, "None-3")], "k string, x string")
    assert {(r.key, r.item): r.seen for r in bloom.fold_probe(f, asked, "k", "x").collect()} == {("a", "a-1"): True, ("b", "a-1"): False, ("z", "a-1"): False, (None, "None-3"): True}


def test_cuckoo_chain():
    c = cuckoo.Chain(cuckoo.Params(64, 4, 20, 2))
    items = [f"i{i}" for i in range(500)]
    assert c.add_many(items) == [1] * 500 and all(x in c for x in items) and len(c.layers) > 1
    assert c.add_many(["i1", "zz"], only_new=True)[0] == 0
    assert cuckoo.Chain.load(c.dump()).dump() == c.dump()
    before = c.count("i7")
    assert c.remove("i7") and c.count("i7") == before - 1 and all(x in c for x in items if x != "i7")
    assert not cuckoo.Chain().remove("x") and c.info()["deleted"] == 1
    fixed = cuckoo.Chain(cuckoo.Params(8, 2, 5, 0))
    got = fixed.add_many(items)
    assert -1 in got and all(x in fixed for x, g in zip(items, got) if g == 1)
    with pytest.raises(FilterError):
        cuckoo.Chain.load(c.dump()[:-1])


def test_cuckoo_remove_leaves_the_others():
    c = cuckoo.Chain(cuckoo.Params(1024, 4, 50, 2))
    items = [str(i) for i in range(15_000)]
    assert all(c.add(x) for x in items) and len(c.layers) > 2
    assert all(c.remove(x) for x in items[::2])
    assert all(x in c for x in items[1::2]) and c.info()["deleted"] == 7_500


def test_cuckoo_involution():
    for i in range(2000):
        raw = f"x{i}".encode()
        mark, a = cuckoo.fingerprint(raw), cuckoo.home(raw, 256)
        assert 1 <= mark <= 255 and cuckoo.other(cuckoo.other(a, mark, 256), mark, 256) == a


def test_cms(spark):
    assert cms.Dims.by_error(0.01, 0.01) == cms.Dims(272, 5)
    r = random.Random(1)
    data = [f"w{min(int(r.paretovariate(1)), 300)}" for _ in range(5000)]
    df, dims, real = spark.createDataFrame([(x,) for x in data], "x string"), cms.Dims(300, 4), Counter(data)
    s = cms.build(df, "x", dims)
    est = {q.item: q.estimate for q in cms.query(s, df, "x", dims).collect()}
    assert all(est[k] >= v for k, v in real.items()) and sum(est[k] - v for k, v in real.items()) / len(real) < 60
    m = cms.merge([s, s], [2, -1])
    assert sorted(map(tuple, m.select("row", "col", "count").collect())) == sorted(map(tuple, s.select("row", "col", "count").collect()))
    assert cms.info(s, dims).first()["count"] == 5000
    with pytest.raises(SketchError):
        cms.increase(s, spark.createDataFrame([("w1", -99999)], "x string, n long"), "x", "n", dims)
    for bad in ((0, 1), (1, 0), (1 << 27, 1), (1 << 26, 256)):
        with pytest.raises(SketchError):
            cms.Dims(*bad)


def test_heavy_keeper():
    r = random.Random(2)
    data = [f"w{min(int(r.paretovariate(0.9)), 2000)}" for _ in range(20000)]
    s, real = topk.HeavyKeeper(5, 256, 5), Counter(data)
    topk.add_all(s, data)
    assert {x for x, _ in s.list()} == {x for x, _ in real.most_common(5)} and all(n <= real[x] for x, n in s.list())
    assert [n for _, n in s.list()] == sorted((n for _, n in s.list()), reverse=True) and "w1" in s and s.count("w1") <= real["w1"] and s.count("never") == 0
    assert topk.HeavyKeeper.load(s.dump()).dump() == s.dump()
    small = topk.HeavyKeeper(1)
    small.add("a")
    assert small.add("b", 3) == "a"
    for bad in (lambda: topk.HeavyKeeper(0), lambda: s.add("x", 0), lambda: topk.HeavyKeeper.load(s.dump()[:-1])):
        with pytest.raises(SketchError):
            bad()


def test_digest_expected_values():
    d = digest.Digest(100).add(np.arange(1, 101))
    assert [d.quantile(q) for q in (0, 0.25, 0.5, 0.9, 1)] == [1, 25.5, 50.5, 90.5, 100]
    assert (d.cdf(0), d.cdf(101), d.cdf(50)) == (0.0, 1.0, 0.495)
    assert (d.rank(0), d.rank(101), d.rank(50), d.rev_rank(101), d.rev_rank(0), d.rev_rank(50)) == (-1, 100, 49, -1, 100, 50)
    assert (d.by_rank(0), d.by_rank(99), d.by_rank(100), d.by_rev_rank(0), d.by_rev_rank(100)) == (1, 100, math.inf, 100, -math.inf)
    assert d.trimmed_mean(0.1, 0.9) == 50.5 and math.isnan(d.trimmed_mean(0.5, 0.5))
    e = digest.Digest()
    assert math.isnan(e.quantile(0.5)) and e.rank(1) == -2 and math.isnan(e.low) and math.isnan(e.cdf(1))


def test_digest_bounds_merge_and_dump():
    d = digest.Digest(200).add(np.arange(1, 10001))
    assert abs(d.quantile(0.5) - 5000) <= 200 and abs(d.quantile(0.9) - 9000) <= 300 and len(d.means) <= 420
    a, b = digest.Digest(100).add(np.arange(0, 5000)), digest.Digest(100).add(np.arange(5000, 10000))
    m = digest.Digest(100).merge(a, b)
    assert m.size == 10000 and m.low == 0 and m.high == 9999 and abs(m.quantile(0.5) - 5000) < 300
    assert digest.Digest.load(m.dump()).dump() == m.dump() and m.reset().size == 0
    m.add([math.nan, math.inf], None)
    assert m.size == 10000
    for bad in (lambda: digest.Digest(0), lambda: digest.Digest.load(m.dump()[:-1]), lambda: digest.Digest.load(b"")):
        with pytest.raises(SketchError):
            bad()


def test_digest_frames(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows = digest.build(df, "v", ["k"], 200).select("k", digest.ask(F.col("digest"), "quantile", 0.5).alias("q"), digest.ask(F.col("digest"), "size").alias("n")).collect()
    assert {r.k for r in rows} == {0, 1, 2} and all(abs(r.q - 4500) < 150 and r.n == 3000 for r in rows)
    assert digest.build(df, "v").count() == 1
    assert digest.exact_at(df, "v", 0.5, ["k"]).where("k = 0").first().value == 4497.0 and digest.exact_at(df, "v", 0.5).first().value == 4499.0


def test_graph_recall(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(-1, 1, (500, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(i, rng.uniform(-1, 1, 32).tolist()) for i in range(60)], "query_id long, q array<float>")
    for metric in ("L2", "COSINE", "IP"):
        exact = {(r.query_id, r.doc_id) for r in neighbours.nearest(df, q, 10, metric).collect()}
        for shards in (1, 3):
            got = {(r.query_id, r.doc_id) for r in graph.build(df, metric, shards=shards).search(q, 10).collect()}
            assert len(exact & got) / len(exact) > 0.95, (metric, shards)
    g = graph.build(df, shards=2)
    less = g.remove(df.where("doc_id < 250"))
    assert less.vectors().count() == 250 and less.add(df.where("doc_id < 260")).vectors().count() == 500
    assert less.search(q, 10).where("doc_id < 250").count() == 0
    assert graph.build(df.limit(0)).search(q, 3).count() == 0


def test_nearest_blocks_against_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 50)
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (300, 3)).astype(np.float32)  # many equal distances, some zero vectors
    for kind, as_id in (("long", int), ("string", str)):
        df = spark.createDataFrame([(as_id(i), v.tolist()) for i, v in enumerate(x)] + [(as_id(999), None)], f"doc_id {kind}, embedding array<float>")
        q = df.where("embedding is not null").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
        for metric in ("L2", "IP"):
            want, got = neighbours.nearest(df, q, 7, metric), neighbours.nearest_blocks(df, q, 7, metric)
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert neighbours.nearest_blocks(df.limit(0), q, 3).count() == 0


def test_graph_search_sends_a_shard_once_a_block(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"))
    q = df.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    found = graph.build(df, shards=2).search(q, 5)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.count() == 1500 and found.where("rank = 1 and query_id <> doc_id").count() == 0


def test_graph_recall_across_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = df.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    found = graph.build(df, shards=3).search(q, 10)
    assert neighbours.nearest_blocks(df, q, 10).join(found, ["query_id", "doc_id"], "left_semi").count() >= 9.5 * df.count()


def test_graph_recall_and_reach_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = df.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    exact, got = neighbours.nearest(df, q, 10), graph.build(df).search(q, 10).persist()
    hits, n = exact.join(got, ["query_id", "doc_id"], "left_semi").count(), df.count()
    assert hits / (10 * n) >= 0.95
    assert got.where("rank = 1").agg(F.avg("compared")).first()[0] <= 0.25 * n
    got.unpersist()


def test_heavy_keeper_is_fed_from_a_stream(spark):
    rng = random.Random(5)
    rows = [(k, f"i{min(rng.randrange(60), rng.randrange(60))}", o) for k in ("a", None) for o in range(3000)]
    rng.shuffle(rows)
    best = topk.keep_heavy(spark.createDataFrame([*rows, ("a", None, 7)], "k string, x string, o long"), "k", "x", "o", 4, 16, 3)
    assert "MapGroups" not in best._jdf.queryExecution().toString()
    got = [tuple(r) for r in best.collect()]
    for k in ("a", None):
        s = topk.HeavyKeeper(4, 16, 3)
        topk.add_all(s, [x for own, x, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[2])])
        assert sorted(r[1:] for r in got if r[0] == k) == sorted((x, n, i + 1) for i, (x, n) in enumerate(s.list()))

"""What runs where a side is too large to be broadcast gives the same results."""

from tessera.llm import _base as B
from tessera.llm import decontam, langid, linededup, mixing, sharding, simhash

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_without_broadcasts(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    jobs = (
        lambda: simhash.drop_near_copies(docs.unionByName(docs.limit(3))), lambda: decontam.drop_leaks(docs, items), lambda: decontam.find_leaks(docs, items),
        lambda: mixing.mix_sources(docs), lambda: sharding.shard_rows(docs, shards=5, vnodes=7), lambda: linededup.dedup_lines(docs),
    )
    want = [rows(j()) for j in jobs]
    monkeypatch.setattr(B, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontam, "BITMAP_BITS", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [rows(j()) for j in jobs] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_groups_do_not_change_languages(monkeypatch):
    model = langid.Model.fit([], [])
    texts = ["this is what they would have said", "nous sommes dans une autre ville", "Это русский текст", "", "αβγ δεζ"] * 7
    one = langid.identify(model, texts)
    monkeypatch.setattr(langid, "CELLS_AT_ONCE", 1)
    two = langid.identify(model, texts)
    assert one.lang == two.lang and (one.start == two.start).all() and (one.label == two.label).all()


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r.u: r.v for r in B.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 0, 201: 200, 202: 200}

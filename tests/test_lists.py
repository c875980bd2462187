"""Stored inverted lists, and what of a predicate reaches the scan."""

import re

import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.plans.pipeline import run_aggregate
from tessera.plans.search import postings, search, vocabulary
from tessera.spec import Catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    return Q.docs(spark, SF), Q.plain_docs(spark, SF)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize(
    "query,options",
    [
        ("from thing", {}), ("@text:(from thing) -@lang:{de}", {}), ("wha*", {}), ("%thens%", {}), ("which | -from", {}), ('"of the"', {}), ('"from the"', {"slop": 2, "in_order": True}),
        ('"thing from"', {"slop": 3}), ('"of"', {}), ("~from @lang:{en}", {}), ("-from", {}), ("nosuchword", {}), ("nosuchword | @n_chars:[0 300]", {}), ("from from wha* | %%anether%%", {"verbatim": True}), ("thing", {"dedup_terms": True, "weights": True}), ("*", {}), ("thens", {"phonetic": True}),
    ],
)
@pytest.mark.parametrize("scored", [False, True])
def test_lists_give_what_tokens_give(both, query, options, scored):
    with_lists, plain = (search(i, query, nocontent=True, with_scores=scored, **options) for i in both)
    assert rows(with_lists) == rows(plain)


def test_other_readers(both):
    a, b = both
    assert rows(vocabulary(a, "text")) == rows(vocabulary(b, "text")) and rows(postings(a, "text")) == rows(postings(b, "text"))
    words = "GROUPBY 1 @lang REDUCE COUNT 0 AS n".split()
    assert rows(run_aggregate(a, "from", words)) == rows(run_aggregate(b, "from", words))
    shown = [search(i, "from", fields=["lang", "text"], highlight={"tags": ("<", ">")}) for i in both]
    assert shown[0].columns == shown[1].columns and rows(shown[0]) == rows(shown[1])


def test_odd_texts(spark, tmp_path):
    data = [(1, None, "a b"), (2, "", None), (3, "x " * 50_000 + "Y", "a"), (3, "x y", "b"), (None, "x", "b a"), (4, "..!", "c")]
    df = spark.createDataFrame(data, "doc_id long, t string, u string")
    words = "o SCHEMA t TEXT u TEXT".split()
    for k, d in enumerate((df.where("doc_id is not null").dropDuplicates(["doc_id"]), df.limit(0))):
        one, two = Catalog(spark).create(words, d, f"{tmp_path}/{k}"), Catalog(spark).create(words, d)
        for q in ("y", "@u:a x", '"x y"', "-x", "@u:(a b)"):
            for scored in (False, True):
                assert rows(search(one, q, nocontent=True, with_scores=scored)) == rows(search(two, q, nocontent=True, with_scores=scored)), q


def test_changed_documents_are_searched_without_lists(spark, tmp_path):
    cat = Catalog(spark)
    cat.create("c SCHEMA t TEXT".split(), spark.createDataFrame([(1, "old")], "doc_id long, t string"), str(tmp_path / "c"))
    cat.put("c", spark.createDataFrame([(2, "new")], "doc_id long, t string"))
    assert rows(search(cat.resolve("c"), "new", nocontent=True)) == [("2",)] and rows(search(cat.resolve("c"), "old", nocontent=True)) == [("1",)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        return " ".join(re.findall(r"PushedFilters: (.*?), ReadSchema", plan(Q.QUERIES[name](spark, SF))))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize(
    "name,parts",
    [
        ("filter_tag_numeric", ["In(p_brand", "GreaterThanOrEqual(p_size,10)", "LessThan(p_size,30)"]), ("filter_or_not", ["Or("]), ("geo_filter_option", ["GreaterThan(s_acctbal,0.0)"]),
        ("flagship", ["EqualTo(l_returnflag,R)", "GreaterThanOrEqual(l_quantity,10.0)"]), ("knn_filtered", ["GreaterThanOrEqual(label,2)"]), ("agg_global", ["GreaterThan(o_totalprice"]), ("joined_source", ["GreaterThan(c_acctbal"]),
    ],
)
def test_predicates_reach_the_scan(spark, name, parts):
    got = pushed(spark, name)
    assert all(p in got for p in parts), got


def test_only_the_lists_of_the_terms_are_read(spark, both):
    text = plan(search(both[0], "from thing", nocontent=True, verbatim=True))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text)
    assert "regexp_extract_all" not in text and "ReadSchema: struct<doc_id:bigint>" in text


def test_numbers_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    i = Catalog(spark).create("n SCHEMA v NUMERIC".split(), spark.createDataFrame([(1, nan), (2, inf), (3, -inf), (4, 1.0), (5, None)], "doc_id long, v double"))
    s = lambda q: [r.doc_id for r in search(i, q, nocontent=True).collect()]
    assert s("@v:[-inf inf]") == [4] and s("@v:[0 inf]") == [4] and s("@v:[-inf 5]") == [4] and s("-@v:[0 5]") == [1, 2, 3, 5] and s("@v:[inf inf]") == []
    got = run_aggregate(i, "*", "GROUPBY 0 REDUCE SUM 1 @v AS s REDUCE MAX 1 @v AS m".split()).first()
    assert (got.s, got.m) == (1.0, 1.0) and F is not None


def test_parts_grow_with_the_text(spark, tmp_path, monkeypatch):
    from tessera.plans import lists

    df = spark.createDataFrame([(i, f"common w{i % 40} of a b c d") for i in range(400)], "doc_id long, t string")
    small = lists.write_lists(df, ["t"], f"{tmp_path}/small", 4)
    monkeypatch.setattr(lists, "PART_CHARS", 2000)
    large = lists.write_lists(df, ["t"], f"{tmp_path}/large", 4)
    most = lambda made: made.all("t").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    files = lambda made: made.all("t").select("bucket", F.input_file_name().alias("f")).distinct()
    assert files(small).count() == 4 and files(large).count() == 20  # a task for each part of each bucket
    assert most(large) < most(small) / 3
    assert rows(small.all("t")) == rows(large.all("t")) and rows(small.terms("t")) == rows(large.terms("t"))

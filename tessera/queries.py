"""Named queries over the driver's tables, each with the SQL it must agree with.

A key of QUERIES is a function of (spark, directory); ORACLES has DuckDB SQL for those that
SQL can express. Counts are BIGINT, measures DOUBLE; scores and distances are rounded, as
their sums go in another order there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo, json_ops, json_path, text
from tessera.commands import Session
from tessera.operators import graph, neighbours, present, suggest
from tessera.operators.sketches import bloom, cms, cuckoo, digest, topk
from tessera.plans.expr import compile_expr
from tessera.plans.pipeline import Cursors, run_aggregate
from tessera.plans.profile import explain_lines, profile
from tessera.plans.search import knn, postings, search, vocabulary
from tessera.sources import store
from tessera.sources.folders import changed, new_folder, shared_folder
from tessera.sources.tables import documents, hash_source, json_source, scan_keys, table
from tessera.spec import Catalog, Index, Spec
from tessera.streaming.feed import TableFeed, follow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# indexes over the driver's tables

PART = "SCHEMA p_name TEXT p_brand TAG p_type TAG p_size NUMERIC p_retailprice NUMERIC".split()
LINE = "SCHEMA l_returnflag TAG l_linestatus TAG l_quantity NUMERIC l_extendedprice NUMERIC l_discount NUMERIC l_partkey NUMERIC".split()
ORDER = "SCHEMA o_orderstatus TAG o_orderpriority TAG o_totalprice NUMERIC o_custkey NUMERIC".split()
DOCS = "SCHEMA text TEXT lang TAG source TAG n_chars NUMERIC".split()
VECS = "SCHEMA embedding VECTOR FLAT 4 DIM 64 DISTANCE_METRIC L2 label NUMERIC".split()


def index(spark: SparkSession, sf: str, name: str, key: str, words: list[str]) -> Index:
    return Catalog(spark).create([name, *words], documents(table(spark, sf, name), key))


def part(spark: SparkSession, sf: str) -> Index:
    return index(spark, sf, "part", "p_partkey", PART)


def orders(spark: SparkSession, sf: str) -> Index:
    return index(spark, sf, "orders", "o_orderkey", ORDER)


STORED: dict[tuple[str, str, int], Index] = {}


def docs(spark: SparkSession, sf: str) -> Index:
    """The documents with stored lists, which are made once a session for a table as it is."""
    path = f"{sf}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, changed(spark, path))
    if key not in STORED:
        STORED[key] = Catalog(spark).create(["documents", *DOCS], table(spark, sf, "documents"), new_folder(spark))
    return STORED[key]


def plain_docs(spark: SparkSession, sf: str) -> Index:
    """The documents without stored lists."""
    return index(spark, sf, "documents", "doc_id", DOCS)


def lines(spark: SparkSession, sf: str) -> Index:
    li = table(spark, sf, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Catalog(spark).create(["lineitem", *LINE], li)


def places(spark: SparkSession, sf: str) -> Index:
    s = table(spark, sf, "supplier")
    lon, lat = F.pmod(F.col("s_suppkey") * 37, F.lit(360)) - 180, F.pmod(F.col("s_suppkey") * 17, F.lit(180)) - 90
    rows = s.select(F.col("s_suppkey").alias("doc_id"), F.concat_ws(",", lon, lat).alias("at"), F.concat(F.lit("POINT("), lon, F.lit(" "), lat, F.lit(")")).alias("shape"), "s_acctbal")
    return Catalog(spark).create("supplier SCHEMA at GEO shape GEOSHAPE s_acctbal NUMERIC".split(), rows)


def vectors(spark: SparkSession, sf: str, metric: str = "L2") -> Index:
    words = [metric if w == "L2" else w for w in VECS]
    return index(spark, sf, "embeddings", "vec_id", words)


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])


# filters, sorting, paging


@query("select p_partkey as doc_id, p_brand, p_size::double as p_size from part where p_brand in ('Brand#12', 'Brand#23') and p_size >= 10 and p_size < 30")
def filter_tag_numeric(spark, sf):
    return search(part(spark, sf), "@p_brand:{Brand#12|Brand#23} @p_size:[10 (30]", fields=["p_brand", "p_size"])


@query("select p_partkey as doc_id from part where (p_size between 1 and 5 or p_brand = 'Brand#11') and not (p_retailprice >= 1500)")
def filter_or_not(spark, sf):
    return search(part(spark, sf), "(@p_size:[1 5] | @p_brand:{Brand#11}) -@p_retailprice:[1500 inf]", nocontent=True)


@query("select p_partkey as doc_id, p_retailprice from part order by p_retailprice desc, p_partkey limit 10 offset 5")
def filter_match_all_limit(spark, sf):
    return search(part(spark, sf), "*", fields=["p_retailprice"], sort_by="p_retailprice", ascending=False, limit=(5, 10))


@query("select p_partkey as doc_id from part where p_brand = 'Brand#13'")
def filter_optional(spark, sf):
    return search(part(spark, sf), "@p_brand:{Brand#13} ~@p_size:[1 3]", nocontent=True)


@query("select p_partkey as doc_id, round(1.0 + case when p_size between 1 and 3 then 1.0 else 0.0 end, 6)::double as __search_score from part where p_brand = 'Brand#13'")
def score_optional(spark, sf):
    return search(part(spark, sf), "@p_brand:{Brand#13} ~@p_size:[1 3]", nocontent=True, with_scores=True)


@query("select p_partkey as doc_id from part where not (p_size > 10 and p_brand = 'Brand#11') and not (p_size < 3 or p_size > 40)")
def filter_de_morgan(spark, sf):
    return search(part(spark, sf), "-(@p_size:[(10 inf] @p_brand:{Brand#11}) -(@p_size:[-inf (3] | @p_size:[(40 inf])", nocontent=True)


@query("select p_partkey as doc_id, p_name, '' as nothing, p_brand from part where p_partkey in (1, 5, 7) and p_size between 1 and 50")
def search_inkeys_return(spark, sf):
    return search(part(spark, sf), "@p_size:[1 50]", inkeys=[1, 5, 7, -4], fields=["p_name", "nothing", "p_brand"])


@query("select o_orderkey as doc_id, o_orderpriority from orders where o_totalprice > 300000 order by o_orderpriority, o_orderkey limit 20")
def search_sort_string(spark, sf):
    return search(orders(spark, sf), "@o_totalprice:[(300000 inf]", fields=["o_orderpriority"], sort_by="o_orderpriority", limit=(0, 20))


# aggregation


@query("select l_linestatus, count(*) as n, sum(l_extendedprice) as total from lineitem where l_returnflag = 'R' and l_quantity between 10 and 30 group by 1")
def flagship(spark, sf):
    words = "GROUPBY 1 @l_linestatus REDUCE COUNT 0 AS n REDUCE SUM 1 @l_extendedprice AS total SORTBY 2 @total DESC LIMIT 0 10".split()
    out = run_aggregate(lines(spark, sf), "@l_returnflag:{R} @l_quantity:[10 30]", words)
    return out.select("l_linestatus", "n", F.round("total", 2).alias("total"))


ORACLES["flagship"] = ORACLES["flagship"].replace("sum(l_extendedprice) as", "round(sum(l_extendedprice), 2) as")


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as s, round(avg(l_extendedprice), 4) as a from lineitem group by 1, 2")
def agg_group_count_sum_avg(spark, sf):
    words = "GROUPBY 2 @l_returnflag @l_linestatus REDUCE COUNT 0 AS n REDUCE SUM 1 @l_quantity AS s REDUCE AVG 1 @l_extendedprice AS a".split()
    return run_aggregate(lines(spark, sf), "*", words).select("l_returnflag", "l_linestatus", "n", F.round("s", 2).alias("s"), F.round("a", 4).alias("a"))


@query("select o_orderpriority, min(o_totalprice) as lo, max(o_totalprice) as hi, round(stddev_pop(o_totalprice), 4) as sd from orders group by 1")
def agg_min_max_stddev(spark, sf):
    words = "GROUPBY 1 @o_orderpriority REDUCE MIN 1 @o_totalprice AS lo REDUCE MAX 1 @o_totalprice AS hi REDUCE STDDEV 1 @o_totalprice AS sd".split()
    return run_aggregate(orders(spark, sf), "*", words).withColumn("sd", F.round("sd", 4))


@query("select o_orderstatus, count(distinct o_custkey) as c, count(distinct o_orderpriority) as p from orders group by 1")
def agg_distinct(spark, sf):
    words = "GROUPBY 1 @o_orderstatus REDUCE COUNT_DISTINCT 1 @o_custkey AS c REDUCE COUNT_DISTINCTISH 1 @o_orderpriority AS p".split()
    return run_aggregate(orders(spark, sf), "*", words)


_RANKED = "select *, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as r, count(*) over (partition by l_returnflag) as n from lineitem"


@query(f"select l_returnflag, max(case when r = floor(0.5 * (n - 1)) then l_extendedprice end) as med, max(case when r = floor(0.9 * (n - 1)) then l_extendedprice end) as p90, count(*) as n from ({_RANKED}) group by 1")
def agg_quantile(spark, sf):
    words = "GROUPBY 1 @l_returnflag REDUCE QUANTILE 2 @l_extendedprice 0.5 AS med REDUCE QUANTILE 2 @l_extendedprice 0.9 AS p90 REDUCE COUNT 0 AS n".split()
    return run_aggregate(lines(spark, sf), "*", words)


@query("select p_brand, string_agg(p_name, ',' order by p_partkey) as names from part where p_size between 1 and 3 group by 1")
def agg_tolist(spark, sf):
    return run_aggregate(part(spark, sf), "@p_size:[1 3]", "GROUPBY 1 @p_brand REDUCE TOLIST 1 @p_name AS names".split())


@query("select p_brand, arg_min(p_name, p_partkey) as a, arg_min(p_name, p_retailprice * 1e9 + p_partkey) as b, arg_min(p_name, -p_retailprice * 1e9 + p_partkey) as c from part group by 1")
def agg_first_value(spark, sf):
    words = "GROUPBY 1 @p_brand REDUCE FIRST_VALUE 1 @p_name AS a REDUCE FIRST_VALUE 3 @p_name BY @p_retailprice AS b REDUCE FIRST_VALUE 4 @p_name BY @p_retailprice DESC AS c".split()
    return run_aggregate(part(spark, sf), "*", words)


@query("with l as (select p_brand, list(p_name order by p_partkey) as v from part group by 1) select p_brand, array_to_string(list_transform(range(0, least(3, len(v))), lambda i: v[(i * len(v) // 3) + 1]), ',') as some from l")
def agg_random_sample(spark, sf):
    return run_aggregate(part(spark, sf), "*", "GROUPBY 1 @p_brand REDUCE RANDOM_SAMPLE 2 @p_name 3 AS some".split())


@query("with a as (select o_custkey, o_orderstatus, count(*) as n, sum(o_totalprice) as s from orders group by 1, 2) select o_orderstatus, count(*) as customers, round(avg(s), 4) as mean from a where n > 2 group by 1")
def agg_having_two_stage(spark, sf):
    words = ["GROUPBY", "2", "@o_custkey", "@o_orderstatus", "REDUCE", "COUNT", "0", "AS", "n", "REDUCE", "SUM", "1", "@o_totalprice", "AS", "s", "FILTER", "@n > 2", "GROUPBY", "1", "@o_orderstatus", "REDUCE", "COUNT", "0", "AS", "customers", "REDUCE", "AVG", "1", "@s", "AS", "mean"]
    return run_aggregate(orders(spark, sf), "*", words).withColumn("mean", F.round("mean", 4))


@query("select count(*) as n, round(sum(o_totalprice), 2) as s from orders where o_totalprice > 100000")
def agg_global(spark, sf):
    return run_aggregate(orders(spark, sf), "@o_totalprice:[(100000 inf]", "REDUCE COUNT 0 AS n REDUCE SUM 1 @o_totalprice AS s".split()).withColumn("s", F.round("s", 2))


@query("select count(*) as n from orders where false having count(*) > 0")
def agg_global_no_rows(spark, sf):
    return run_aggregate(orders(spark, sf), "@o_totalprice:[-5 -1]", "REDUCE COUNT 0 AS n".split())


@query("select p_brand, count(*) as n from (select * from part order by p_retailprice desc, p_partkey limit 100) group by 1")
def agg_limit_before_group(spark, sf):
    return run_aggregate(part(spark, sf), "*", "SORTBY 2 @p_retailprice DESC LIMIT 0 100 GROUPBY 1 @p_brand REDUCE COUNT 0 AS n".split())


@query("select p_brand, n from (select p_brand, count(*) as n from part group by 1) order by n desc, p_brand limit 3 offset 1")
def agg_group_sort_limit(spark, sf):
    return run_aggregate(part(spark, sf), "*", "GROUPBY 1 @p_brand REDUCE COUNT 0 AS n SORTBY 2 @n DESC LIMIT 1 3".split())


@query("select p_partkey as doc_id, round(p_retailprice * (1 - p_size / 100.0), 4)::double as net from part where p_size % 2 = 0 and p_retailprice / p_size < 100")
def agg_apply_filter(spark, sf):
    words = ["LOAD", "2", "@p_size", "@p_retailprice", "FILTER", "@p_size % 2 == 0 && @p_retailprice / @p_size < 100", "APPLY", "@p_retailprice * (1 - @p_size / 100)", "AS", "net"]
    return run_aggregate(part(spark, sf), "*", words).select("doc_id", F.round("net", 4).alias("net"))


@query("select distinct p_brand, '' as nothing from part")
def agg_group_missing_key(spark, sf):
    return run_aggregate(part(spark, sf), "*", "GROUPBY 2 @p_brand @nothing".split())


# expressions


def _apply(spark: SparkSession, sf: str, exprs: dict[str, str], digits: int = 6) -> DataFrame:
    df = part(spark, sf).docs
    cols = []
    for name, e in exprs.items():
        v = compile_expr(e, df.schema)
        cols.append((F.round(v.col, digits) if v.number else v.col).alias(name))
    return df.select("doc_id", *cols)


@query("select p_partkey as doc_id, round(4.0, 6)::double as a, round(p_size + p_retailprice * 2 - 1, 6)::double as b, 0.0::double as c, round(p_retailprice % 7, 6)::double as d, round(power(power(p_size, 2), 0.5), 6)::double as e, (case when p_size = 10 then 1 else 0 end)::double as f from part")
def expr_arith(spark, sf):
    return _apply(spark, sf, {"a": "-2^2", "b": "@p_size + @p_retailprice * 2 - 1", "c": "@p_size / 0 + @p_size % 0", "d": "@p_retailprice % 7", "e": "@p_size ^ 2 ^ 0.5", "f": "@p_size == 10"})


@query("select p_partkey as doc_id, lower(p_brand) as a, upper(p_name) as b, strlen(p_name)::double as c, substring(p_name, 3, 4) as d, p_brand || '/' || p_size || '!' as e from part")
def expr_string(spark, sf):
    return _apply(spark, sf, {"a": "lower(@p_brand)", "b": "upper(@p_name)", "c": "strlen(@p_name)", "d": "substr(@p_name, 2, 4)", "e": "format('%s/%s!', @p_brand, @p_size)"})


@query("select p_partkey as doc_id, case when p_size > 25 then 'big' else 'small' end as a, (case when p_size > 40 or p_brand = 'Brand#11' then 1 else 0 end)::double as b, (case when p_size <> 7 then 0 else 1 end)::double as c, case when p_size > 25 then p_retailprice else 0 end::double as d, '' as e, 12.0::double as f from part")
def expr_if_logic(spark, sf):
    return _apply(spark, sf, {"a": "if(@p_size > 25, 'big', 'small')", "b": "@p_size > 40 || @p_brand == 'Brand#11'", "c": "!(@p_size != 7)", "d": "if(@p_size > 25, @p_retailprice, 0)", "e": "format('%s')", "f": "'12abc' + 'abc'"})


@query("select p_partkey as doc_id, round(sqrt(p_retailprice), 6) as a, round(ln(p_retailprice), 6) as b, round(log2(p_size), 6) as c, abs(-p_size)::double as d, ceil(p_retailprice)::double as e, floor(p_retailprice)::double as f, round(p_size / 2.0)::double as g, '-Infinity'::double as h from part")
def expr_math(spark, sf):
    return _apply(spark, sf, {"a": "sqrt(@p_retailprice)", "b": "log(@p_retailprice)", "c": "log2(@p_size)", "d": "abs(-@p_size)", "e": "ceil(@p_retailprice)", "f": "floor(@p_retailprice)", "g": "round(@p_size / 2)"}).withColumn("h", compile_expr("log(0)", T.StructType()).col)


# text

TOK = "with tok as (select doc_id, text, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as t, lang from documents) "


@query(TOK + "select doc_id from tok where list_contains(t, 'from') and list_contains(t, 'thing')")
def text_terms_and(spark, sf):
    return search(docs(spark, sf), "from thing", nocontent=True, verbatim=True)


@query(TOK + "select doc_id from tok where (list_contains(t, 'from') or list_contains(t, 'thing')) and lang = 'en'")
def text_field_or(spark, sf):
    return search(docs(spark, sf), "@text:(from thing) @lang:{en}", nocontent=True, verbatim=True)


@query(TOK + "select doc_id from tok where false")
def text_stop_word(spark, sf):
    return search(docs(spark, sf), "the from", nocontent=True)


@query(TOK + "select doc_id from tok where list_contains(t, 'which') or not list_contains(t, 'from')")
def text_or_not(spark, sf):
    return search(docs(spark, sf), "which | -@text:from", nocontent=True, verbatim=True)


@query(TOK + "select doc_id from tok where len(list_filter(t, lambda x: starts_with(x, 'wha'))) > 0 and lang <> 'en'")
def text_prefix(spark, sf):
    return search(docs(spark, sf), "wha* -@lang:{en}", nocontent=True)


@query(TOK + "select doc_id from tok where len(list_filter(t, lambda x: levenshtein(x, 'thens') <= 1)) > 0")
def text_fuzzy(spark, sf):
    return search(docs(spark, sf), "%thens%", nocontent=True)


@query(TOK + "select doc_id from tok where len(list_filter(t, lambda x: levenshtein(x, 'anether') <= 2)) > 0")
def text_fuzzy_two(spark, sf):
    return search(docs(spark, sf), "%%anether%%", nocontent=True)


@query(TOK + "select doc_id from tok where contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
def text_phrase(spark, sf):
    return search(docs(spark, sf), '"of the"', nocontent=True)


@query(TOK + ", p as (select doc_id, unnest(t) as w, generate_subscripts(t, 1) as i from tok where len(t) > 0) select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and a.w = 'from' and b.w = 'the' and b.i > a.i and b.i - a.i - 1 <= 2")
def text_phrase_slop(spark, sf):
    return search(docs(spark, sf), '"from the"', nocontent=True, slop=2, in_order=True)


@query(TOK + ", p as (select doc_id, unnest(t) as w, generate_subscripts(t, 1) as i from tok where len(t) > 0) select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id and a.w = 'thing' and b.w = 'from' and a.i <> b.i and abs(b.i - a.i) - 1 <= 3")
def text_phrase_any_order(spark, sf):
    return search(docs(spark, sf), '@text:"thing from"', nocontent=True, slop=3)


@query()
def text_stem(spark, sf):
    return search(docs(spark, sf), "thing", nocontent=True)


@query("with v as (select unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)))) as term from documents) select term, count(*) as df from v group by 1")
def text_vocabulary(spark, sf):
    return vocabulary(docs(spark, sf), "text")


@query(TOK + ", p as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) as i from tok where len(t) > 0) select term, doc_id, count(*) as tf, min(i)::bigint - 1 as first_at from p where term in ('from', 'thing', 'which') group by 1, 2")
def text_postings(spark, sf):
    p = postings(docs(spark, sf), "text").where(F.col("term").isin("from", "thing", "which"))
    return p.select("term", "doc_id", "tf", F.element_at("positions", 1).cast("bigint").alias("first_at"))


def _bm25(terms: dict[str, int], where: str, key: str = "x") -> str:
    """DuckDB SQL of BM25 over documents: terms with how often each counts."""
    vals = ", ".join(f"('{t}', {m})" for t, m in terms.items())
    return (
        TOK + f", q(w, m) as (values {vals}), n as (select count(*)::double as n, avg(len(t)) as mean from tok), "
        "p as (select doc_id, unnest(t) as w, len(t) as dl from tok where len(t) > 0), "
        "tf as (select doc_id, w, count(*)::double as tf, max(dl) as dl from p where w in (select w from q) group by 1, 2), "
        "df as (select w, count(*)::double as df from tf group by 1), "
        "s as (select doc_id, sum(m * ln(1 + (0.5 + n - df) / (0.5 + df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) as score from tf join df using (w) join q using (w), n group by 1) "
        f"select doc_id, round(score, 6) as score from s {where}"
    )


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("__search_score").alias("score"))


@query(_bm25({"from": 1, "thing": 1}, ""))
def bm25_or(spark, sf):
    return _scored(search(docs(spark, sf), "@text:(from thing)", with_scores=True, nocontent=True, verbatim=True))


@query(_bm25({"from": 1, "thing": 1}, "where doc_id in (select doc_id from tok where list_contains(t, 'from') and list_contains(t, 'thing'))"))
def bm25_and(spark, sf):
    return _scored(search(docs(spark, sf), "from thing", with_scores=True, nocontent=True, verbatim=True))


@query(_bm25({"from": 2}, ""))
def bm25_repeated_term(spark, sf):
    return _scored(search(docs(spark, sf), "@text:(from from)", with_scores=True, nocontent=True, verbatim=True))


@query(_bm25({"of": 1, "the": 1}, "where doc_id in (select doc_id from tok where contains(' ' || array_to_string(t, ' ') || ' ', ' of the '))"))
def bm25_phrase(spark, sf):
    return _scored(search(docs(spark, sf), '"of the"', with_scores=True, nocontent=True))


@query(_bm25({"from": 1}, "").replace("select doc_id, round(score, 6) as score from s ", "select doc_id, round(score + 1.0, 6) as score from s join documents using (doc_id) where lang = 'en'"))
def bm25_with_filter(spark, sf):
    return _scored(search(docs(spark, sf), "from @lang:{en}", with_scores=True, nocontent=True, verbatim=True))


_PREFIXED = _bm25({"from": 1}, "").replace("q(w, m) as (values ('from', 1))", "q as (select distinct w, 1 as m from (select unnest(t) as w from tok) where starts_with(w, 'wha'))")


@query(_PREFIXED)
def bm25_prefix(spark, sf):
    return _scored(search(docs(spark, sf), "wha*", with_scores=True, nocontent=True))


@query("select doc_id, regexp_replace(left(text, 200), '(^|[^A-Za-z0-9])(from|thing)($|[^A-Za-z0-9])', '\\1<b>\\2</b>\\3', 'gi') as shown from documents where doc_id < 50")
def text_highlight(spark, sf):
    d = table(spark, sf, "documents").where("doc_id < 50")
    return d.select("doc_id", present.highlight(F.substring("text", 1, 200), ["from", "thing"]).alias("shown"))


@query("with w as (select doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+') as w from documents), h as (select *, coalesce(list_position(list_transform(w, lambda x: lower(x)), 'from'), 0) as p from w) select doc_id, case when len(w) = 0 then text when p = 0 then array_to_string(w[1:5], ' ') || '...' else array_to_string(w[greatest(1, least(greatest(p - 2, 1), len(w) - 4)):greatest(1, least(greatest(p - 2, 1), len(w) - 4)) + 4], ' ') end as shown from h")
def text_summarize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", present.summarize(F.col("text"), ["from"], frags=1, length=5).alias("shown"))


# geography

_LON, _LAT = "((s_suppkey * 37) % 360 - 180)", "((s_suppkey * 17) % 180 - 90)"
_DIST = f"2 * 6372797.560856 * asin(sqrt(least(1.0, pow(sin(radians({_LAT} - 40) / 2), 2) + cos(radians(40)) * cos(radians({_LAT})) * pow(sin(radians({_LON} - 10) / 2), 2))))"


@query(f"select s_suppkey as doc_id from supplier where {_DIST} <= 4000000")
def geo_radius(spark, sf):
    return search(places(spark, sf), "@at:[10 40 4000 km]", nocontent=True)


@query(f"select s_suppkey as doc_id from supplier where {_DIST} <= 3000 * 1609.344 and s_acctbal > 0")
def geo_filter_option(spark, sf):
    return search(places(spark, sf), "@s_acctbal:[(0 inf]", nocontent=True, geofilter=("at", 10, 40, 3000, "mi"))


_RING = "POLYGON((-100.5 -50.5, 120.5 -40.5, 60.5 70.5, -60.5 60.5, -100.5 -50.5))"
_EDGES = [((-100.5, -50.5), (-60.5, 60.5)), ((120.5, -40.5), (-100.5, -50.5)), ((60.5, 70.5), (120.5, -40.5)), ((-60.5, 60.5), (60.5, 70.5))]
_CROSS = " + ".join(f"(case when ({y1} > lat) <> ({y2} > lat) and lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} then 1 else 0 end)" for (x1, y1), (x2, y2) in [(tuple(f"({v})" for v in a), tuple(f"({v})" for v in b)) for a, b in _EDGES])
_INSIDE = f"select doc_id from (select s_suppkey as doc_id, {_LON}::double as lon, {_LAT}::double as lat from supplier) where ({_CROSS}) % 2 = 1"


@query(_INSIDE)
def geo_shape_within(spark, sf):
    return search(places(spark, sf), "@shape:[WITHIN $area]", nocontent=True, params={"area": _RING})


@query(_INSIDE)
def geo_point_in_polygon(spark, sf):
    d = places(spark, sf).docs
    lon, lat = geo.point(F.col("at"))
    return d.where(geo.point_in_polygon(lon, lat, geo.parse_shape(_RING))).select("doc_id")


@query(f"select s_suppkey as doc_id from supplier where s_suppkey not in ({_INSIDE})")
def geo_shape_disjoint(spark, sf):
    return search(places(spark, sf), "@shape:[DISJOINT $area]", nocontent=True, params={"area": _RING})


# vectors

_PAIR = "select a.vec_id as doc_id, a.label, {d} as d from embeddings a, embeddings q where q.vec_id = 0"
_L2 = "list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda x: (x[1]::double - x[2]::double) ** 2))"
_DOT = "list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda x: x[1]::double * x[2]::double))"
_NORM = "(sqrt(list_sum(list_transform(a.embedding, lambda x: x::double ** 2))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::double ** 2))))"


def _knn(spark: SparkSession, sf: str, metric: str, text_: str = "*=>[KNN 10 @embedding $v]", **options: object) -> DataFrame:
    out = search(vectors(spark, sf, metric), text_, params={"v": first_vector(spark, sf)}, nocontent=True, **options)
    return out.select("doc_id", F.round("__vec_score", 4).alias("score"))


@query(f"select doc_id, round(d, 4) as score from ({_PAIR.format(d=_L2)}) order by d, doc_id limit 10")
def knn_l2(spark, sf):
    return _knn(spark, sf, "L2")


@query(f"select doc_id, round(d, 4) as score from ({_PAIR.format(d=f'1 - {_DOT} / {_NORM}')}) order by d, doc_id limit 10")
def knn_cosine(spark, sf):
    return _knn(spark, sf, "COSINE").withColumn("score", F.abs("score"))


ORACLES["knn_cosine"] = ORACLES["knn_cosine"].replace("round(d, 4)", "abs(round(d, 4))")


@query(f"select doc_id, round(d, 4) as score from ({_PAIR.format(d=f'-{_DOT}')}) order by d, doc_id limit 10")
def knn_ip(spark, sf):
    return _knn(spark, sf, "IP")


@query(f"select doc_id, round(d, 4) as score from ({_PAIR.format(d=_L2)}) where label between 2 and 4 order by d, doc_id limit 10")
def knn_filtered(spark, sf):
    return _knn(spark, sf, "L2", "@label:[2 4]=>[KNN 10 @embedding $v]")


@query(f"select doc_id, round(d, 4) as score from (select * from ({_PAIR.format(d=_L2)}) order by d, doc_id limit 10) where doc_id > 20 order by d limit 3 offset 1")
def knn_then_keys_and_limit(spark, sf):
    keys = table(spark, sf, "embeddings").where("vec_id > 20").select(F.col("vec_id").alias("doc_id"))
    return _knn(spark, sf, "L2", inkeys=keys, limit=(1, 3))


@query(f"select query_id, doc_id, round(d, 4) as distance, rank from (select q.vec_id as query_id, a.vec_id as doc_id, {_L2} as d, row_number() over (partition by q.vec_id order by {_L2}, a.vec_id)::int as rank from embeddings a, embeddings q where q.vec_id < 5) where rank <= 5")
def knn_batch(spark, sf):
    v = documents(table(spark, sf, "embeddings"), "vec_id")
    asked = v.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    return neighbours.nearest(v, asked, 5).withColumn("distance", F.round("distance", 4))


@query("select true as good_recall, count(*) as queries from embeddings")
def ann_graph_recall(spark, sf):
    """Every row is a query; of the ten nearest 0.95 are found."""
    v = documents(table(spark, sf, "embeddings"), "vec_id")
    asked = v.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    found = graph.build(v).search(asked, 10)
    hit = neighbours.nearest_blocks(v, asked, 10).join(found, ["query_id", "doc_id"], "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return hit.crossJoin(v.agg(F.count(F.lit(1)).alias("queries"))).select((F.col("n") >= 9.5 * F.col("queries")).alias("good_recall"), "queries")


@query("select q.vec_id as query_id, true as found from embeddings q where q.vec_id % 3 <> 0 and q.vec_id < 60")
def ann_graph_remove(spark, sf):
    """After every third vector is removed, those left find themselves and none that is gone."""
    v = documents(table(spark, sf, "embeddings"), "vec_id")
    left = graph.build(v).remove(v.where("doc_id % 3 = 0"))
    found = left.search(v.where("doc_id % 3 <> 0 and doc_id < 60").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q")), 5)
    own = found.groupBy("query_id").agg(F.min(F.col("doc_id") % 3 != 0).alias("a"), F.max((F.col("doc_id") == F.col("query_id")) & (F.col("distance") < 1e-6)).alias("b"))
    return own.select("query_id", (F.col("a") & F.col("b")).alias("found"))


# JSON


def order_json(spark: SparkSession, sf: str) -> DataFrame:
    """(key, json): each order with its lines as an array."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey")
    items = li.agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty")))).alias("items"))
    doc = F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.struct(F.size("items").alias("n"), F.lit("x").alias("tag")).alias("head"), "items"))
    return items.select(F.col("l_orderkey").alias("key"), doc.alias("json"))


def first_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The orders that the SQL of most queries names."""
    return order_json(spark, sf).where("key <= 200")


LI = "with l as (select l_orderkey as key, list({'line': l_linenumber, 'part': l_partkey, 'qty': l_quantity::int} order by l_linenumber, l_partkey, l_quantity::int) as items from lineitem where l_orderkey <= 200 group by 1) "


@query("select event_id, props->>'$.k' as k, json_type(props->'$.k') is not null as has from events")
def json_get_key(spark, sf):
    e = table(spark, sf, "events")
    k = json_path.json_get(F.col("props"), "$.k")
    return e.select("event_id", k.alias("k"), k.isNotNull().alias("has"))


@query("select event_id, json_keys(props)[1] as k, len(json_keys(props))::bigint as n, json_valid(props) as ok from events")
def json_keys_len(spark, sf):
    e = table(spark, sf, "events")
    keys = json_ops.keys_column(F.col("props"))
    return e.select("event_id", F.try_element_at(keys, F.lit(1)).alias("k"), F.size(keys).cast("bigint").alias("n"), json_ops.valid_column(F.col("props")).alias("ok"))


@query(LI + "select key, items[1].part::varchar as first, items[-1].part::varchar as last from l")
def json_index(spark, sf):
    d = first_orders(spark, sf)
    return d.select("key", json_path.json_get(F.col("json"), "$.items[0].part").alias("first"), json_path.json_get(F.col("json"), "$.items[-1].part").alias("last"))


@query(LI + "select key, array_to_string(list_transform(items[2:3], lambda x: x.qty), ',') as mid, array_to_string(list_transform(list_reverse(items), lambda x: x.line), ',') as back from l")
def json_slice(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    return d.select("key", F.array_join(json_path.json_query(c, "$.items[1:3].qty"), ",").alias("mid"), F.array_join(json_path.json_query(c, "$.items[::-1].line"), ",").alias("back"))


@query(LI + "select key, array_to_string(list_transform(list_filter(items, lambda x: x.qty > 30), lambda x: x.part), ',') as big from l")
def json_filter(spark, sf):
    d = first_orders(spark, sf)
    return d.select("key", F.array_join(json_path.json_query(F.col("json"), "$.items[?(@.qty > 30)].part"), ",").alias("big"))


@query(LI + "select key, array_to_string(list_transform(items, lambda x: x.qty), ',') as deep, array_to_string(list_transform(items, lambda x: x.part), ',') as wild, items[1].line || ',' || items[1].qty as pair from l")
def json_recursive_wildcard_union(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    get = lambda p: F.array_join(json_path.json_query(c, p), ",")
    return d.select("key", get("$..qty").alias("deep"), get("$.items[*].part").alias("wild"), get("$.items[0]['line','qty']").alias("pair"))


@query(LI + "select key, 'object' as a, 'array' as b, 'integer' as c, 'string' as d from l")
def json_type(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    get = lambda p: F.element_at(json_ops.type_column(c, p), 1)
    return d.select("key", get("$").alias("a"), get("$.items").alias("b"), get("$.id").alias("c"), get("$.head.tag").alias("d"))


@query(LI + "select key, len(items)::int as arr, 3 as obj, 1 as str from l")
def json_lengths(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    get = lambda p, k: F.element_at(json_ops.length_column(c, p, k), 1)
    return d.select("key", get("$.items", list).alias("arr"), get("$", dict).alias("obj"), get("$.head.tag", str).alias("str"))


@query(LI + "select key, (key + 5)::varchar as plus, (key * 2)::varchar as times, 'xy' as app, (len(items) + 1)::varchar as grown from l")
def json_edit_numbers_strings_arrays(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    one = lambda f, *a: json_ops.edit_column(c, f, *a)["json"]
    get = F.get_json_object
    return d.select(
        "key", get(one(json_ops.number_add, "$.id", 5), "$.id").alias("plus"), get(one(json_ops.number_multiply, "$.id", 2), "$.id").alias("times"), get(one(json_ops.string_append, "$.head.tag", "y"), "$.head.tag").alias("app"),
        F.json_array_length(get(one(json_ops.array_append, "$.items", 1), "$.items")).cast("string").alias("grown"),
    )


@query(LI + "select key, json_array_length(to_json(items))::varchar || ',7' as ins, (items[-1].line)::varchar as popped, least(len(items), 2)::varchar as trimmed, '0' as cleared, null::varchar as gone from l")
def json_edit_places(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    edit = lambda f, *a: json_ops.edit_column(c, f, *a)
    get = F.get_json_object
    ins = edit(json_ops.array_insert, "$.items", 0, 7)["json"]
    return d.select(
        "key", F.concat_ws(",", (F.json_array_length(get(ins, "$.items")) - 1).cast("string"), get(ins, "$.items[0]")).alias("ins"),
        get(get(edit(json_ops.array_pop, "$.items")["reply"], "$[0]"), "$.line").alias("popped"), F.json_array_length(get(edit(json_ops.array_trim, "$.items", 0, 1)["json"], "$.items")).cast("string").alias("trimmed"),
        get(edit(json_ops.clear, "$.id")["json"], "$.id").alias("cleared"), get(edit(json_ops.delete, "$.head")["json"], "$.head").alias("gone"),
    )


@query(LI + "select key, 'z' as tag, null::varchar as n, '1' as more, 'new' as fresh from l")
def json_merge_set(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    patch = {"head": {"tag": "z", "n": None, "more": 1}}
    merged = json_ops.edit_column(c, json_ops.merge, "$", patch)["json"]
    put = json_ops.edit_column(c, json_ops.set_value, "$.head.fresh", "new")["json"]
    get = F.get_json_object
    return d.select("key", get(merged, "$.head.tag").alias("tag"), get(merged, "$.head.n").alias("n"), get(merged, "$.head.more").alias("more"), get(put, "$.head.fresh").alias("fresh"))


@query("with k as (select unnest([1, 2, 3, 999999]) as key) select key::bigint as key, case when exists (select 1 from lineitem where l_orderkey = key) then '[' || key || ']' end as json from k")
def json_multi_get(spark, sf):
    keys = spark.createDataFrame([(1,), (2,), (3,), (999999,)], "key long")
    return json_ops.multi_get(keys, order_json(spark, sf), "$.id")


@query(LI + "select key, array_to_string(list_transform(items, lambda x: '[' || x.line), ',') as n, octet_length(encode(key::varchar)) > 0 as sized from l")
def json_flat_and_memory(spark, sf):
    d, c = first_orders(spark, sf), F.col("json")
    flat = json_ops.flat_column(c, "$.items[*].line")
    return d.select("key", F.array_join(F.transform(flat, lambda x: F.concat(F.lit("["), x)), ",").alias("n"), (json_ops.memory_column(c) > 0).alias("sized"))


# suggestions, dictionaries, spelling


def names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    new = p.select(F.col("p_name").alias("term"), F.col("p_size").cast("double").alias("score"), F.col("p_brand").alias("payload"), F.col("p_partkey").alias("seq"))
    none = spark.createDataFrame([], "term string, score double, payload string")
    return suggest.add_suggestions(none, new)


_NAMES = "with s as (select lower(p_name) as term, arg_max(p_size, p_partkey)::double as score, arg_max(p_brand, p_partkey) as payload from part group by 1) "


@query(_NAMES + "select * from s")
def suggest_add(spark, sf):
    return names(spark, sf)


@query(_NAMES + "select * from s where starts_with(term, 'p') order by score desc, term limit 5")
def suggest_prefix(spark, sf):
    return suggest.suggest(names(spark, sf), "P")


@query(_NAMES + "select * from s where levenshtein(term, (select min(term) from s)) <= 1 order by score desc, term limit 7")
def suggest_fuzzy(spark, sf):
    s = names(spark, sf)
    return suggest.suggest(s, s.agg(F.min("term")).first()[0], 7, fuzzy=True)


@query("select lower(p_brand) as term, sum(p_size)::double as score, arg_max(p_type, p_partkey) as payload from part group by 1")
def suggest_increase(spark, sf):
    new = table(spark, sf, "part").select(F.col("p_brand").alias("term"), F.col("p_size").alias("score"), F.col("p_type").alias("payload"), F.col("p_partkey").alias("seq"))
    return suggest.add_suggestions(spark.createDataFrame([], "term string, score double, payload string"), new, increase=True)


@query("select distinct p_brand as value from part")
def tag_values(spark, sf):
    cat = Catalog(spark)
    cat.create(["part", *PART], documents(table(spark, sf, "part"), "p_partkey"))
    return cat.tag_values("part", "p_brand")


@query("select distinct c_mktsegment as term from customer where c_mktsegment <> 'BUILDING' union select 'EXTRA'")
def dictionary_edit(spark, sf):
    d = suggest.dictionary(table(spark, sf, "customer"), "c_mktsegment")
    one = lambda x: spark.createDataFrame([(x,)], "term string")
    return suggest.dictionary_add(suggest.dictionary_remove(d, one("BUILDING")), one("EXTRA"))


@query("select distinct n_name as term, m.n_name as other from (select lower(n_name) as n_name, n_regionkey from nation) a join (select lower(n_name) as n_name, n_regionkey from nation) m using (n_regionkey)".replace("select distinct n_name", "select distinct a.n_name"))
def synonyms_expand(spark, sf):
    pairs = table(spark, sf, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("term"))
    return suggest.expand_synonyms(pairs.select("term"), pairs)


@query(TOK + ", v as (select w, count(*) as df from (select distinct doc_id, unnest(t) as w from tok) group by 1) select 'fromm' as term, w as suggestion, round(df / (select count(*) from documents)::double, 6) as score from v where levenshtein(w, 'fromm') = 1")
def spellcheck(spark, sf):
    return suggest.spellcheck(docs(spark, sf), "fromm thing", 1).withColumn("score", F.round("score", 6))


# sketches


@query("select count(distinct l_partkey) as n, true as all_found, true as few_false from lineitem")
def bloom_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    t = bloom.build(li, "l_partkey", 0.01)
    own = bloom.probe(li.select("l_partkey").distinct(), "l_partkey", t).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("all_found"))
    others = spark.range(10_000_000, 10_005_000).toDF("x")
    return own.crossJoin(bloom.probe(others, "x", t).agg((F.avg(F.col("seen").cast("int")) < 0.03).alias("few_false")))


@query("select true as same")
def bloom_merge(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = [bloom.build(li.where(f"l_partkey % 2 = {k}"), "l_partkey", 0.01, 50_000) for k in (0, 1)]
    whole, both = bloom.build(li, "l_partkey", 0.01, 50_000), bloom.merge(*parts)
    return whole.frame.exceptAll(both.frame).agg((F.count(F.lit(1)) == 0).alias("same"))


@query("select event_type as key, count(distinct user_id) as distinct_users, true as all_found, true as grew from events group by 1")
def bloom_scaling(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"), "event_id")
    f = bloom.fold(e, "event_type", "user_id", "event_id", bloom.Params(0.001, 8, 2))
    shared_folder(spark)
    f = f.checkpoint()  # asked three times
    seen = bloom.fold_probe(f, e.select("event_type", "user_id").distinct(), "event_type", "user_id")
    ok = seen.groupBy("key").agg(F.count(F.lit(1)).alias("distinct_users"), F.min("seen").alias("all_found"))
    most = f.agg(F.max("filters").alias("most"))  # one filter at least has to have grown
    grew = ((F.col("filters") > 1) == (F.col("items") > 8)) & (F.col("items") <= F.col("distinct_users")) & (F.col("most") > 1)
    return ok.join(f, "key").crossJoin(most).select("key", "distinct_users", "all_found", grew.alias("grew"))


@query("select r::double as rate, greatest(ceil(100 * -ln(r) / (ln(2) * ln(2)))::bigint, 1024) as least_bits, ceil(ln(2) * -ln(r) / (ln(2) * ln(2)))::bigint as hashes from (values (0.01), (0.005), (0.001)) t(r)")
def bloom_sizing(spark, sf):
    rows = []
    for r in (0.01, 0.005, 0.001):
        bits, hashes = bloom.layout(r, 100)
        least = max(int(-(-100 * -__import__("math").log(r) // __import__("math").log(2) ** 2)), 1024)
        rows.append((r, least if least <= bits < least + 64 else -1, hashes))
    return spark.createDataFrame(rows, "rate double, least_bits long, hashes long")


@query("select count(distinct l_partkey) as n, true as all_found, true as enough from lineitem")
def cuckoo_filter(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("p"))
    f = cuckoo.build(li.distinct(), "p", 8, cuckoo.Params(1024, 4, 50, 2))
    found = cuckoo.probe(f, li, "p", 8)
    return found.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("copies") > 0).alias("all_found"), (F.sum("copies") >= F.count(F.lit(1))).alias("enough"))


@query("select count(distinct l_partkey) filter (where l_partkey % 2 = 1) as n, true as kept from lineitem")
def cuckoo_delete(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("p")).distinct()
    even = li.where("cast(p as bigint) % 2 = 0")
    f = cuckoo.remove(cuckoo.build(li, "p", 8, cuckoo.Params(1024, 4, 50, 2)), even, "p", 8)
    odd = cuckoo.probe(f, li.where("cast(p as bigint) % 2 = 1"), "p", 8)
    return odd.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("copies") > 0).alias("kept"))


@query("select count(*) as n, true as involutive from (select distinct l_partkey from lineitem)")
def cuckoo_involution(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey").distinct()
    mark, a, b = cuckoo.bucket_columns(F.col("l_partkey"), 1024)
    back = cuckoo.alternate_column(b, mark, 1024)
    return li.select((back == a).alias("ok"), mark.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ok") & F.col("m").between(1, 255)).alias("involutive"))


@query("select user_id as item, count(*) as exact, true as upper from events group by 1")
def cms_upper_bound(spark, sf):
    e, dims = table(spark, sf, "events"), cms.Dims.by_error(0.001, 0.01)
    est = cms.query(cms.build(e, "user_id", dims), e, "user_id", dims)
    exact = e.groupBy(F.col("user_id").alias("item")).agg(F.count(F.lit(1)).alias("exact"))
    return exact.join(est, "item").select("item", "exact", (F.col("estimate") >= F.col("exact")).alias("upper"))


@query("select 272 as width, 5 as depth, (select count(*) + 2 * count(*) from events) as count")
def cms_merge_info(spark, sf):
    e, dims = table(spark, sf, "events"), cms.Dims.by_error(0.01, 0.01)
    one = cms.build(e, "event_type", dims)
    return cms.info(cms.merge([one, one], [1, 2]), dims)


@query("select event_type as item, count(*) as estimate from events group by 1")
def cms_weighted(spark, sf):
    e, dims = table(spark, sf, "events").withColumn("one", F.lit(1)), cms.Dims(4096, 6)
    s = cms.increase(cms.build(e.where("event_id % 2 = 0"), "event_type", dims), e.where("event_id % 2 = 1"), "event_type", "one", dims)
    return cms.query(s, e, "event_type", dims)


@query("select l_partkey as item, count(*) as count from lineitem group by 1 order by 2 desc, 1 limit 10")
def topk_exact(spark, sf):
    return topk.top(table(spark, sf, "lineitem"), "l_partkey", 10)


@query("select l_suppkey as item, sum(l_quantity)::bigint as count from lineitem group by 1 order by 2 desc, 1 limit 5")
def topk_weighted(spark, sf):
    return topk.top(table(spark, sf, "lineitem"), "l_suppkey", 5, "l_quantity")


@query("select event_type as item, count(*) as count from events group by 1 order by 2 desc, 1 limit 5")
def topk_approx(spark, sf):
    return topk.approx_top(table(spark, sf, "events"), "event_type", 5)


@query("with t as (select l_partkey from lineitem group by 1 order by count(*) desc, 1 limit 10) select p_partkey as item, p_partkey in (select l_partkey from t) as is_top from part where p_partkey <= 100")
def topk_member(spark, sf):
    best = topk.top(table(spark, sf, "lineitem"), "l_partkey", 10)
    return topk.member(table(spark, sf, "part").where("p_partkey <= 100"), "p_partkey", best)


@query("select 'all' as key, 5::bigint as n, true as right_order")
def topk_heavykeeper(spark, sf):
    e = table(spark, sf, "events").select(F.lit("all").alias("key"), "event_type", "event_id")
    best = topk.keep_heavy(e, "key", "event_type", "event_id", 5, 64, 5)
    real = e.groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("real"))
    return best.join(real, "item").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("count") <= F.col("real")).alias("right_order"))


@query("select l_returnflag, true as close from lineitem group by 1")
def digest_rank_error(spark, sf):
    li = table(spark, sf, "lineitem")
    d = digest.build(li, "l_extendedprice", ["l_returnflag"], 200)
    q = d.select("l_returnflag", digest.ask(F.col("digest"), "quantile", 0.5).alias("q50"), digest.ask(F.col("digest"), "quantile", 0.9).alias("q90"))
    share = lambda c: F.avg((F.col("l_extendedprice") < F.col(c)).cast("double"))
    r = li.join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag").agg(share("q50").alias("a"), share("q90").alias("b"))
    return r.select("l_returnflag", ((F.abs(F.col("a") - 0.5) < 0.02) & (F.abs(F.col("b") - 0.9) < 0.02)).alias("close"))


@query("select min(value) as lo, max(value) as hi, count(value) as n, true as close from events")
def digest_merge(spark, sf):
    e = table(spark, sf, "events")
    parts = [digest.build(e.where(f"event_id % 3 = {k}"), "value") for k in range(3)]
    m = digest.merge_frames(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    ask = lambda *a: digest.ask(F.col("digest"), *a)
    real = e.agg(F.expr("percentile(value, 0.5)").alias("p"), F.stddev("value").alias("sd"))
    return m.crossJoin(real).select(ask("low").alias("lo"), ask("high").alias("hi"), ask("size").cast("bigint").alias("n"), (F.abs(ask("quantile", 0.5) - F.col("p")) < 0.1 * F.col("sd")).alias("close"))


@query("select l_returnflag, round(avg(case when l_quantity < 20 then 1 when l_quantity = 20 then 0.5 else 0 end), 9)::double as cdf, floor(sum(case when l_quantity < 20 then 1 when l_quantity = 20 then 0.5 else 0 end))::bigint as rank, floor(count(*) - sum(case when l_quantity < 20 then 1 when l_quantity = 20 then 0.5 else 0 end))::bigint as rev, -1::bigint as below, count(*) as above, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1")
def digest_rank_exact(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(digest.exact_cdf(q, 20), 9).alias("cdf"), digest.exact_rank(q, 20).alias("rank"), digest.exact_rev_rank(q, 20).alias("rev"), digest.exact_rank(q, -1).alias("below"), digest.exact_rank(q, 1e9).alias("above"), F.min(q).alias("lo"), F.max(q).alias("hi")
    )


@query("with r as (select l_extendedprice as v, row_number() over (order by l_extendedprice) - 1 as r, count(*) over () as n from lineitem) select max(case when r = floor(0.25 * (n - 1)) then v end) as value from r")
def digest_by_rank_exact(spark, sf):
    return digest.exact_at(table(spark, sf, "lineitem"), "l_extendedprice", 0.25)


@query("with r as (select l_returnflag, l_quantity as v, row_number() over (partition by l_returnflag order by l_quantity) as r, count(*) over (partition by l_returnflag) as n from lineitem), w as (select *, greatest(0, least(r, 0.9 * n) - greatest(r - 1, 0.1 * n)) as w from r) select l_returnflag, round(sum(w * v) / sum(w), 6)::double as value from w group by 1")
def digest_trimmed_mean_exact(spark, sf):
    return digest.exact_trimmed_mean(table(spark, sf, "lineitem"), "l_quantity", 0.1, 0.9, ["l_returnflag"]).withColumn("value", F.round("value", 6))


# sets, joins, stores


def _ids(spark: SparkSession, sf: str, q: str) -> DataFrame:
    return search(part(spark, sf), q, nocontent=True)


@query("select p_partkey as doc_id from part where p_size < 10 union select p_partkey from part where p_brand = 'Brand#11'")
def set_union(spark, sf):
    return _ids(spark, sf, "@p_size:[-inf (10]").union(_ids(spark, sf, "@p_brand:{Brand#11}")).distinct()


@query("select p_partkey as doc_id from part where p_size < 30 intersect select p_partkey from part where p_size > 10")
def set_intersect(spark, sf):
    return _ids(spark, sf, "@p_size:[-inf (30]").intersect(_ids(spark, sf, "@p_size:[(10 inf]"))


@query("select p_partkey as doc_id from part where p_size < 30 except select p_partkey from part where p_size > 10")
def set_except(spark, sf):
    return _ids(spark, sf, "@p_size:[-inf (30]").join(_ids(spark, sf, "@p_size:[(10 inf]"), "doc_id", "left_anti")


@query("select doc_id, sum(s)::double as score from (select p_partkey as doc_id, 1.0 as s from part where p_size < 20 union all select p_partkey, 1.0 from part where p_retailprice > 1200) group by 1")
def scored_union(spark, sf):
    i = part(spark, sf)
    return search(i, "@p_size:[-inf (20] | @p_retailprice:[(1200 inf]", with_scores=True, nocontent=True).select("doc_id", F.col("__search_score").alias("score"))


@query("with c as (select o_custkey as doc_id, o_orderstatus, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) select doc_id, o_orderstatus, o_totalprice from c where r = 1")
def upsert_last_wins(spark, sf):
    changes = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("seq"))
    return store.upsert(None, changes)


@query("select p_partkey as doc_id, case when p_partkey % 10 = 0 then 'Brand#99' else p_brand end as p_brand from part union all select 10000001, 'Brand#99'")
def index_put(spark, sf):
    cat = Catalog(spark)
    base = documents(table(spark, sf, "part"), "p_partkey").select("doc_id", "p_brand")
    cat.create("part SCHEMA p_brand TAG".split(), base)
    more = base.where("doc_id % 10 = 0").select("doc_id").union(spark.createDataFrame([(10000001,)], "doc_id long"))
    return cat.put("part", more.withColumn("p_brand", F.lit("Brand#99"))).docs


@query("select o_orderkey as doc_id from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def delete_anti(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return store.delete(documents(table(spark, sf, "orders"), "o_orderkey").select("doc_id"), gone)


@query("select c_custkey as doc_id, c_name, n_name from customer join nation on c_nationkey = n_nationkey where n_name = 'FRANCE' and c_acctbal > 5000")
def joined_source(spark, sf):
    j = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    i = Catalog(spark).create("c SCHEMA c_name TEXT n_name TAG c_acctbal NUMERIC".split(), documents(j, "c_custkey"))
    return search(i, "@n_name:{FRANCE} @c_acctbal:[(5000 inf]", fields=["c_name", "n_name"])


@query("select 'part' as index_name, count(*) as num_docs, 'english' as language, '' as prefixes from part")
def index_info(spark, sf):
    cat = Catalog(spark)
    cat.create(["part", *PART], documents(table(spark, sf, "part"), "p_partkey"))
    return cat.info("part").drop("fields")


@query("select 'Customer' || c_custkey as key from customer where starts_with('Customer' || c_custkey, 'Customer1') or starts_with('Customer' || c_custkey, 'Customer77')")
def source_scan_prefix(spark, sf):
    spec = Spec.parse("i ON HASH PREFIX 2 Customer1 Customer77 SCHEMA a TAG".split())
    keys = table(spark, sf, "customer").select(F.concat(F.lit("Customer"), F.col("c_custkey")).alias("key"))
    return scan_keys(keys, spec)


@query("select 'p:' || p_partkey as doc_id, p_brand, case when p_partkey % 2 = 0 then p_size::varchar end as p_size from part")
def source_hash(spark, sf):
    spec = Spec.parse("i ON HASH PREFIX 1 p: SCHEMA p_brand TAG p_size NUMERIC v VECTOR FLAT 2 DIM 4".split())
    size = F.when(F.col("p_partkey") % 2 == 0, F.map_concat(F.create_map(F.lit("p_brand"), F.col("p_brand")), F.create_map(F.lit("p_size"), F.col("p_size").cast("string"))))
    rows = table(spark, sf, "part").select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("key"), F.coalesce(size, F.create_map(F.lit("p_brand"), F.col("p_brand"))).alias("fields"))
    return hash_source(rows, spec)


@query(LI + "select key as doc_id from l where len(list_filter(items, lambda x: x.qty = 10)) > 0 and len(items) >= 2")
def source_json(spark, sf):
    spec = Spec.parse("i ON JSON SCHEMA $.items[*].qty AS qty TAG $.head.n AS n NUMERIC".split())
    i = Catalog(spark).create(spec, json_source(first_orders(spark, sf), spec))
    return search(i, "@qty:{10} @n:[2 inf]", nocontent=True)


@query("select p_partkey as doc_id, p_brand from part where p_size > 40")
def snapshot_restore(spark, sf):
    root = new_folder(spark)
    store.snapshot(part(spark, sf), root)
    return search(store.restore(Catalog(spark), root), "@p_size:[(40 inf]", fields=["p_brand"])


@query("with c as (select user_id as doc_id, event_type, row_number() over (partition by user_id order by event_id desc) as r from events) select doc_id, event_type from c where r = 1 and event_type <> 'error'")
def stream_upsert(spark, sf):
    root = new_folder(spark)
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("write")
    rows = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), op.alias("op"), "event_type")
    for k in range(3):  # three files, three batches, in order
        n = e.count()
        rows.where((F.col("seq") >= n * k // 3) & (F.col("seq") < (n + 3) * (k + 1) // 3 if k < 2 else F.lit(True))).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feed = TableFeed(spark, f"{root}/table")
    follow(stream, feed, f"{root}/log").awaitTermination()
    return feed.current()


@query("select p_partkey as doc_id from part order by p_partkey limit 50 offset 50")
def cursor_second_batch(spark, sf):
    c = Cursors()
    key, _ = c.start(search(part(spark, sf), "*", nocontent=True), 50)
    return c.read(key)[1]


@query()
def query_explain(spark, sf):
    return explain_lines(part(spark, sf), "(@p_size:[1 5] | from*) -@p_brand:{a|b} \"x y\"")


@query()
def query_profile(spark, sf):
    return profile(part(spark, sf), "@p_size:[1 5]")


@query()
def vocabulary_stems_and_sounds(spark, sf):
    v = vocabulary(docs(spark, sf), "text").select("term")
    return v.select("term", text.stem_udf("term").alias("stem"), text.sound_udf("term").alias("code"))


@query(f"select doc_id, round(d, 4) as score from ({_PAIR.format(d=_L2)}) where doc_id % 2 = 1 order by d, doc_id limit 5")
def knn_direct(spark, sf):
    i = vectors(spark, sf)
    return knn(i, "embedding", first_vector(spark, sf), 5, i.docs.where("doc_id % 2 = 1")).select("doc_id", F.round("__vec_score", 4).alias("score"))


_FUZZY = _bm25({"from": 1}, "").replace("q(w, m) as (values ('from', 1))", "q as (select distinct w, 1 as m from (select unnest(t) as w from tok) where levenshtein(w, 'thens') <= 1)")


@query(_FUZZY)
def bm25_fuzzy(spark, sf):
    return _scored(search(docs(spark, sf), "%thens%", with_scores=True, nocontent=True))


@query("select p_partkey as doc_id from part where list_contains(list_transform(regexp_extract_all(p_type, '[A-Za-z0-9]+'), lambda x: lower(x)), 'brass')")
def text_infields(spark, sf):
    i = index(spark, sf, "part", "p_partkey", "SCHEMA p_name TEXT p_type TEXT".split())
    return search(i, "brass", nocontent=True, infields=("p_type",), verbatim=True)


# catalogue


@query("select p_partkey as doc_id, p_size::double as p_size from part where p_brand = 'Brand#12' and p_size >= 40")
def catalog_alter(spark, sf):
    cat, base = Catalog(spark), documents(table(spark, sf, "part"), "p_partkey")
    cat.create("part SCHEMA p_brand TAG".split(), base)
    cat.alter("part", "p_size NUMERIC".split(), base)
    return search(cat.resolve("part"), "@p_brand:{Brand#12} @p_size:[40 inf]", fields=["p_size"])


@query("select * from (values ('customer'), ('part')) t(name)")
def catalog_list_after_drop(spark, sf):
    cat = Catalog(spark)
    for name, field in (("part", "p_brand"), ("supplier", "s_name"), ("customer", "c_mktsegment")):
        cat.create([name, "SCHEMA", field, "TAG"], documents(table(spark, sf, name), f"{name[0]}_{'cust' if name == 'customer' else 'supp' if name == 'supplier' else 'part'}key"))
    cat.alias("gone", "supplier")
    cat.drop("gone")
    return cat.list()


@query("select count(*) as customers from customer")
def catalog_alias_update(spark, sf):
    cat = Catalog(spark)
    cat.create("a SCHEMA p_brand TAG".split(), documents(table(spark, sf, "part"), "p_partkey"))
    cat.create("b SCHEMA c_mktsegment TAG".split(), documents(table(spark, sf, "customer"), "c_custkey"))
    cat.alias("now", "a")
    cat.alias("now", "b", update=True)
    return cat.info("now").select(F.col("num_docs").alias("customers"))


# the command surface: answers as JSON, by hand from what each command is to answer


def _said(spark: SparkSession, *commands: list[str]) -> DataFrame:
    s = Session(spark)
    return spark.createDataFrame([(k, json.dumps(s.execute(*c))) for k, c in enumerate(commands)], "step int, answer string")


def _answers(*values: object) -> str:
    rows = ", ".join(f"({k}, '{json.dumps(v)}')" for k, v in enumerate(values))
    return f"select step::int as step, answer from (values {rows}) t(step, answer)"


@query(_answers("OK", [1, 1, 0], {"capacity": 50, "size": 192, "filters": 1, "items": 2, "expansion": 2}, 2, [1, 1, 0], [1, 0]))
def commands_bloom(spark, sf):
    return _said(spark, *map(str.split, ("BF.RESERVE b 0.01 100 EXPANSION 2", "BF.INSERT c CAPACITY 50 ERROR 0.001 ITEMS x y x", "BF.INFO c", "BF.CARD c", "BF.MADD b a b a", "BF.MEXISTS b a z")))


@query(_answers("OK", 1, 0, [1, 1, 1], 2, {"size": 1024, "buckets": 512, "filters": 1, "inserted": 4, "deleted": 0, "bucket_size": 2, "expansion": 1, "max_iterations": 20}, 1, [1, 1, 0]))
def commands_cuckoo(spark, sf):
    return _said(spark, *map(str.split, ("CF.RESERVE k 1000", "CF.ADD k a", "CF.ADDNX k a", "CF.INSERT k ITEMS a b c", "CF.COUNT k a", "CF.INFO k", "CF.DEL k a", "CF.MEXISTS k a b z")))


@query(_answers("OK", [None, None, None], {"k": 3, "width": 8, "depth": 7, "decay": 0.9}, ["a", "b"], "OK", "OK", [5.0], [1.0, 5.0], [-1, 2, 5], [0.0, 0.5, 1.0], 3.0, "OK"))
def commands_topk_digest(spark, sf):
    return _said(spark, *map(str.split, ("TOPK.RESERVE t 3", "TOPK.ADD t a b a", "TOPK.INFO t", "TOPK.LIST t", "TDIGEST.CREATE d COMPRESSION 100", "TDIGEST.ADD d 1 2 3 4 5", "TDIGEST.BYREVRANK d 0", "TDIGEST.BYRANK d 0 4", "TDIGEST.RANK d 0 3 9", "TDIGEST.CDF d 0 3 9", "TDIGEST.TRIMMED_MEAN d 0.2 0.8", "TDIGEST.RESET d")))


@query(_answers("OK", [0], [0], [2], [-1], "OK", '{"$.c":[5],"$.d":[6]}', ["boolean"]))
def commands_json(spark, sf):
    doc = '{"a":[1,2,1],"b":true,"c":"x"}'
    return _said(spark, ["JSON.SET", "q", "$", doc], *map(str.split, ("JSON.TOGGLE q $.b", "JSON.ARRINDEX q $.a 1", "JSON.ARRINDEX q $.a 1 1", "JSON.ARRINDEX q $.a 9", "JSON.MSET q $.c 5 q $.d 6", "JSON.GET q $.c $.d", "JSON.TYPE q $.b")))


@query(_answers(1, 2, 2, 1, [["hello"]], {"TIMEOUT": "500"}))
def commands_suggest_config(spark, sf):
    return _said(spark, *map(str.split, ("FT.SUGADD g hello 1", "FT.SUGADD g help 2", "FT.SUGLEN g", "FT.SUGDEL g help", "FT.SUGGET g he", "FT.CONFIG GET TIMEOUT")))


# digests against exact answers


@query("select l_returnflag, true as cdf, true as rank, true as at_rank, true as trimmed from lineitem group by 1")
def digest_answers(spark, sf):
    """The sketch's own answers on prices, each within 2 % of ranks or of the value's spread."""
    li, p = table(spark, sf, "lineitem"), F.col("l_extendedprice")
    d = digest.build(li, "l_extendedprice", ["l_returnflag"], 200)
    ask = lambda *a: digest.ask(F.col("digest"), *a)
    got = d.select("l_returnflag", ask("cdf", 40000.0).alias("c"), ask("rank", 40000.0).alias("r"), ask("by_rank", 100).alias("v"), ask("trimmed_mean", 0.1, 0.9).alias("t"), ask("size").alias("n"))
    real = li.groupBy("l_returnflag").agg(digest.exact_cdf(p, 40000.0).alias("rc"), digest.exact_rank(p, 40000.0).alias("rr"), F.stddev(p).alias("sd"), F.sort_array(F.collect_list(p))[100].alias("rv"))
    both = got.join(real, "l_returnflag").join(digest.exact_trimmed_mean(li, "l_extendedprice", 0.1, 0.9, ["l_returnflag"]), "l_returnflag")
    near = lambda a, b, most: F.abs(F.col(a) - F.col(b)) <= most
    return both.select("l_returnflag", near("c", "rc", 0.02).alias("cdf"), near("r", "rr", 0.02 * F.col("n")).alias("rank"), near("v", "rv", 0.05 * F.col("sd")).alias("at_rank"), near("t", "value", 0.05 * F.col("sd")).alias("trimmed"))

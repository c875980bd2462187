import re

import duckdb
import numpy as np
import pytest

from tessera.llm import ann as A
from tessera.llm import chatfmt as C
from tessera.llm import htmlblocks as H

SF = "/root/testdata/sf0.001"


def oracle(table, sql):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    return sorted(con.execute(sql).fetchall())


# chat formatting


@pytest.mark.parametrize(
    "source,want",
    [
        ("{{ 1 + 2 * 3 }}{{ 'a' ~ 2 }}{{ -3 + 1 }}{{ 7 // 2 }}{{ 2 == 2 and not false }}", "7a2-23true"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role[0] }}{% if not loop.last %},{% endif %}{% endfor %}", "1s,2u,3a"),
        ("{% for m in messages if m['role'] != 'system' %}{{ m.text | upper | trim }}{% else %}none{% endfor %}", "HIYO"),
        ("a  {%- if messages[0].role == 'system' -%}  b  {%- elif x %}c{% else %}d{% endif %}", "ab"),
        ("{% set ns = namespace(n=0) %}{% for m in messages %}{% set ns.n = ns.n + 1 %}{% endfor %}{{ ns.n }}", "3"),
        ("{{ messages[1:] | length }}{{ messages[-1].text }}{{ nothing.there | default('-') }}{{ nothing is defined }}", "2yo-false"),
        ("{{ 'x' if bos is defined else 'y' }}{{ ['a','b'] | join('+') }}{{ {'k': [1, 2]} | tojson }}{# no #}", 'ya+b{"k": [1, 2]}'),
        ("{{ 'ab'.upper() }}{{ 'a,b'.split(',')[1] }}{{ 'b' in 'abc' }}{{ 'z' not in ['z'] }}", "ABbtruefalse"),
    ],
)
def test_language(source, want):
    messages = [{"role": "system", "text": "be"}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert C.Template(source).render(messages)[0] == want


def test_constants_are_folded():
    t = C.Template("a{{ 1 + 1 }}{% if 2 > 1 %}b{{ 'c' ~ 'd' | upper }}{% else %}{{ x }}{% endif %}{% if false %}e{% endif %}")
    assert t.tree == [("text", "a2bcD")]


def test_sandbox():
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ open('f') }}", "{{ x.format(1) }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{{ 'a' }", "{{ 1 + }}"):
        with pytest.raises(C.TemplateError):
            C.Template(bad).render([]) if bad != "{{ 'a' }" else C.Template("{{ 'a' }}{% endif %}")
    for bad in ("{{ range(10000000) }}", "{{ 'a' * 100000000 }}", "{{ raise_exception('no') }}"):
        with pytest.raises(C.TemplateError):
            C.Template(bad).render([])
    assert C.Template("{{ x.real }}{{ x.append }}").render([], x=3)[0] == ""


@pytest.mark.parametrize(
    "bad",
    [
        "{% set ns = namespace(s='ab') %}{% for i in range(40) %}{% set ns.s = ns.s ~ ns.s %}{% endfor %}",
        "{% set ns = namespace(s=['a']) %}{% for i in range(40) %}{% set ns.s = ns.s + ns.s %}{% endfor %}",
        "{% set ns = namespace(s=['a']) %}{% for i in range(60) %}{% set ns.s = [ns.s, ns.s] %}{% endfor %}{{ ns.s }}",
        "{% set ns = namespace(s=['a']) %}{% for i in range(60) %}{% set ns.s = [ns.s, ns.s] %}{% endfor %}{{ ns.s | tojson }}",
        "{% set ns = namespace(n=3) %}{% for i in range(60) %}{% set ns.n = ns.n * ns.n %}{% endfor %}",
        "{% for a in range(5000) %}{% for b in range(5000) %}{% for c in range(5000) %}{% endfor %}{% endfor %}{% endfor %}",
        "{% set a = 'a' * 900000 %}{{ a | replace('a', a) }}", "{% set a = 'a' * 900000 %}{{ a.replace('a', a) }}", "{{ ['a' * 900000, 'b' * 900000] | join }}",
        "{% set a = 'a' * 900000 %}{% for i in range(9) %}{{ a }}{% endfor %}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}",
    ],
)
def test_sandbox_bounds(bad):
    with pytest.raises(C.TemplateError):
        C.Template(bad).render([{"role": "user", "text": "hi"}])


def test_bounds_grow_with_the_conversation():
    long = [{"role": "user", "text": "x" * 3_000_000}] * 3 + [{"role": "assistant", "text": "y"}] * 3000
    text, spans = C.compiled(C.CHATML).render(long)
    assert len(text) > 9_000_000 and len(spans) == 3000
    with pytest.raises(C.TemplateError):
        C.Template("{% for i in range(100) %}{{ messages[0].text }}{% endfor %}").render([{"role": "user", "text": "x" * 100_000}])


def test_generation_marks():
    text, spans = C.compiled(C.CHATML).render([{"role": "user", "text": "hé"}, {"role": "assistant", "text": "yo"}])
    assert text == "<|im_start|>user\nhé<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert [text[a:b] for a, b in spans] == ["yo<|im_end|>"]


def test_chats_against_sql(spark):
    got = sorted(map(tuple, C.op4_chat_formatting(spark, SF).collect()))
    assert got == oracle("conversations", C.OP4_SQL)


def test_chat_edge_cases(spark):
    rows = [(1, 1, "user", "b", 0), (1, 0, "user", None, 0), (1, 1, "user", "b", 0), (1, None, None, "x", 0), (None, 0, "assistant", "n", 0), (2, 0, "assistant", "y" * 300_000, 0), (3, 0, "user", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, m int").withColumnRenamed("m", "id")
    got = {r.conv_id: r for r in C.format_chats(df, "{% for m in messages %}[{{ m.role }}:{{ m.text }}]{% endfor %}").collect()}
    assert got[1].text == "[:x][user:][user:b][user:b]" and got[None].text == "[assistant:n]" and len(got[2].text) == 300_012 and got[3].text == "[user:]"
    assert C.format_chats(df.limit(0)).count() == 0


# nearest neighbours


def test_neighbours_against_sql(spark):
    got = sorted(map(tuple, A.op5_nearest_neighbours(spark, SF).collect()))
    assert got == oracle("embeddings", A.OP5_SQL)


@pytest.mark.parametrize("name", ["long", "string"])
def test_neighbours_over_many_tiles(spark, monkeypatch, name):
    monkeypatch.setattr(A, "STRIP", 17)
    monkeypatch.setattr(A, "COLUMNS", 23)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:60] = x[0]
    x[70] *= 1000
    key = (lambda i: i) if name == "long" else (lambda i: f"v{i:03}")
    df = spark.createDataFrame([(key(i), v.tolist()) for i, v in enumerate(x)], f"vec_id {name}, embedding array<float>")
    got = {}
    for r in A.neighbours(df, k=5, blocks=4).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour_id
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        want = sorted(range(300), key=lambda j: (d[i, j], j))[:5]
        assert [got[key(i)][k] for k in range(1, 6)] == [key(j) for j in want]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for dim in (33, A.EXACT_DIM + 50):
        a, b = rng.normal(size=(40, dim)) * 10 ** rng.uniform(-3, 3, (40, 1)), rng.normal(size=(50, dim))
        a, b = a.astype(np.float32), b.astype(np.float32)
        qa, qb = A.Quantised(a), A.Quantised(b)
        est, err = A.bounds(qa, qb)
        true = ((a[:, None].astype(float) - b[None].astype(float)) ** 2).sum(2)
        assert (np.abs(est + (qa.norm**2)[:, None] - true) <= err[:, None] * (1 + 1e-6)).all()
        assert (qa.q @ qb.q.T == (qa.q.astype(object) @ qb.q.T.astype(object)).astype(float)).all()


def test_neighbour_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (None, [1.0, 1.0], 0), (5, [], 0), (6, [1.0], 0), (7, [nan, 0.0], 0), (8, [inf, 0.0], 0), (9, [None, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q int").withColumnRenamed("q", "ids")
    got = sorted((r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in A.neighbours(df).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]
    assert A.neighbours(df.limit(0)).count() == 0 and A.neighbours(df.where("vec_id = 1")).count() == 0


# HTML


def test_held_out_pages():
    model, held = H.default_labeller(), H.examples(150, 1234)
    assert len(held) > 120
    got = model.label([x for x, _ in held])
    y, p = np.concatenate([y for _, y in held]), np.concatenate(got)
    assert (y == p).mean() >= 0.95


def test_gradients_against_differences():
    H_old, r = H.HIDDEN, np.random.default_rng(0)
    model = H.Labeller(3)
    x, mask = r.normal(size=(4, 3, H.DIM)).astype(np.float32), np.ones((4, 3), np.float32)
    mask[3, 0] = mask[2:, 1] = 0
    y = r.integers(0, 3, (4, 3))
    _, g = model.gradients(x, mask, y)
    for k in ("hf", "xb", "cf", "o"):
        flat, at = model.p[k].reshape(-1), int(np.abs(g[k]).argmax())
        old = flat[at]
        both = []
        for eps in (1e-2, -1e-2):
            flat[at] = old + eps
            both.append(model.gradients(x, mask, y)[0])
        flat[at] = old
        assert abs((both[0] - both[1]) / 2e-2 - g[k].reshape(-1)[at]) < 2e-3, k
    assert H_old == H.HIDDEN


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 200_000, "<a x='" * 100_000, "<a x='>' " * 50_000, "<div>" * 100_000 + "x", "<div>" * 50_000 + "</q>" * 50_000, "<!--" * 200_000, "<script>" * 50_000, "<" * 200_000,
        "<p><div>" + "<b>" * 50_000 + "<p>x</p>" * 20_000, "</script" * 50_000 + "<script>" * 50_000, "&amp" * 100_000,
    ],
)
def test_broken_pages_take_linear_time(page):
    from time import process_time

    took = []
    for p in (page[: len(page) // 4], page):
        at = process_time()
        H.vectors(H.leaves(p))
        took.append(process_time() - at)
    assert took[1] < 12 and took[1] < 10 * took[0] + 0.5


def test_reading():
    read = lambda page: [(x.text, page[x.start : x.stop]) for x in H.leaves(page)]
    assert read('<p title="a > b">hello') == [("hello", "hello")]
    assert read("<p class=x>one<b>two<p>three &lt;</p>four<br>5") == [("onetwo", "one<b>two"), ("three <", "three &lt;"), ("four", "four"), ("5", "5")]
    assert read("<!-- <p>no</p> -->a<script>if (a < b) '</p>'</script>b <! x> 1 < 2") == [("ab 1 < 2", "a<script>if (a < b) '</p>'</script>b <! x> 1 < 2")]
    assert read("a <b x='1") == [("a <b x='1", "a <b x='1")] and read("<style>p") == [] and read("</p></p>") == []


def test_the_whole_path_counts():
    deep = "<div>" * 30 + "<p>x"
    a, b = (H.vectors(H.leaves(f"<{t}>{deep}"))[0] for t in ("article", "footer"))
    assert np.abs(a - b).max() > 0
    one, two = H.leaves("<article><p><b>a<p><b>b</article>c")[1:]
    assert one.text == "b" and not two.path.any()


def test_batches_do_not_change_labels():
    model, pages = H.default_labeller(), [x for x, _ in H.examples(40, 55)]
    one = [model.label([p])[0] for p in pages]
    assert all((a == b).all() for a, b in zip(one, model.label(pages)))


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages, H.default_labeller()).collect()}
    good = n = 0
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)
        lo, hi = article.span() if article else (0, 0)
        for b in got[r.page_id].blocks:
            n += 1
            good += (b.label != "boilerplate") == (lo <= b.start < hi)
    assert good >= 0.97 * n


def test_html_edge_cases(spark):
    long = "<article>" + "<p>one two three four five six.</p>" * 20_000
    rows = [(1, None, 0), (2, "", 0), (None, "<p>x", 0), (3, "<script>a</script><!-- b", 0), (4, long, 0), (4, "a < b <<p>> &amp; c", 0), (5, "<div" * 5000, 0)]
    df = spark.createDataFrame(rows, "page_id long, html string, text int")
    got = H.extract(df, H.default_labeller()).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got if r.page_id != 4}
    assert by[1].blocks == by[2].blocks == by[3].blocks == [] and by[1].text == by[3].text == "" and len(by[None].blocks) == 1
    assert max(len(r.blocks) for r in got) == 20_000
    assert H.extract(df.limit(0), H.default_labeller()).count() == 0

import re
from collections import defaultdict

from tessera.llm import decontam as D

SF = "/root/testdata/sf0.01"
ITEM = "A train leaves with 120 people from Berlin and needs 3 hours at 80 km speed, so how far does Berlin lie from the sea"


def tokens(text, opening):
    """Brute-force reading: (template token, slot value) of a text."""
    out, last_end, prev = [], 0, None
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text):
        w = m.group()
        gap = text[last_end : m.start()]
        fresh = not out and prev is None or re.search(r"[.!?:;\n\r…]", gap)
        if w[0].isdigit():
            kind = "<num>"
        elif w.lower() in D.UNITS and prev == "<num>":
            kind = "<unit>"
        elif w[0].isupper() and not w[1:2].isupper() and (opening or not fresh):
            kind = "<name>"
        else:
            kind = w.lower()
        if kind.startswith("<") and kind == prev:
            out[-1] = (kind, out[-1][1] + " " + w.lower())
        else:
            out.append((kind, w.lower() if kind.startswith("<") else None))
        prev, last_end = kind, m.end()
    return out


def windows(text, opening, item=False):
    t = tokens(text, opening)
    if item:
        t = [(x, None if i in (0, len(t) - 1) else v) for i, (x, v) in enumerate(t)]
    k = D.WINDOW
    w = [(i, tuple(x for x, _ in t[i : i + k]), [v for _, v in t[i : i + k]]) for i in range(len(t) - k + 1)]
    return [x for x in w if sum(not y.startswith("<") for y in x[1]) >= D.LITERALS]


def whole(text):
    """The words of a text, if it has too few windows."""
    if all(len(windows(text, o)) < D.LEAST_HIT for o in (False, True)):
        return tuple(re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text.lower()))
    return ()


def brute(docs, items):
    table, of, short = defaultdict(list), {}, defaultdict(list)
    for item, text in items:
        for o in (False, True):
            w = windows(text, o, item=True)
            if len(w) >= D.LEAST_HIT:
                of[item, o] = len(w)
                for i, key, slots in w:
                    table[o, key].append((item, i, slots))
        if whole(text):
            short[whole(text)].append(item)
    out = {}
    for doc, text in docs:
        groups = defaultdict(list)
        for o in (False, True):
            for i, key, slots in windows(text or "", o):
                for item, j, other in table.get((o, key), ()):
                    groups[item, o, i - j].append((j, slots, other))
        hit = defaultdict(set)
        for (item, o, _), own in groups.items():
            pairs = {(a, b) for _, slots, other in own for a, b in zip(slots, other) if a and b}
            fair = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
            hit[item, o] |= {j for j, slots, _ in own if fair or not any(slots)}
        for (item, o), at in hit.items():
            share = len(at) / of[item, o]
            if len(at) >= D.LEAST_HIT and share >= D.COVER:
                out[doc, item] = max(share, out.get((doc, item), 0))
        for item in short.get(whole(text or ""), ()) if whole(text or "") else ():
            out[doc, item] = 1.0
    return out


def test_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.coverage for r in D.find_leaks(docs, items).collect()}
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_reparameterised_questions(spark):
    swap = ITEM.replace("120", "45").replace("Berlin", "Paris").replace("80 km", "62.5 miles")
    torn = ITEM.replace("from Berlin and", "from Paris and").replace("does Berlin", "does Rome")
    docs = spark.createDataFrame([(1, "Intro words. " + swap + ". And more words"), (2, "Intro. " + torn), (3, "Nothing of the sort is here to be seen by anyone at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = {r.doc_id: r.coverage for r in D.find_leaks(docs, items).collect()}
    assert got.keys() == {1} and got[1] > 0.9


def test_opening_names_and_outer_slots(spark):
    item = "Alice bakes seven cakes for the summer fair. Alice sells each of them for a small price to Bob"
    rows = [
        (1, item.replace("Alice", "Carol").replace("Bob", "Dora")),
        (2, "They say that Xavier knows: " + item + " Marley went home"),  # the last name goes on outside
        (3, item.replace("Alice bakes", "Carol bakes").replace("Alice sells", "Dora sells").replace("seven cakes", "some bread").replace("each", "none")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in D.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == set(d for d, _ in brute(rows, [(1, item)])) and {1, 2} <= got


def test_short_items_remove_nothing_but_their_equals(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = [(1, "42"), (2, "The"), (3, "3 km"), (4, "two words"), (5, "12 34 56 Ann Bob 7 km 12 and 4"), (6, "is it in the")]
    items = spark.createDataFrame(short, "item_id long, text string")
    assert D.drop_leaks(docs, items).count() == docs.count()
    assert {r.item_id for r in D.unusable_items(items).collect()} == {1, 2, 3, 4, 5, 6}
    same = spark.createDataFrame([(1, "The!"), (2, "42"), (3, "the end"), (4, "Two, words."), (5, "only two words more"), (6, "43")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(same, items).collect()} == {(1, 2), (2, 1), (4, 4)}


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, D.find_leaks(docs, items).collect()))
    monkeypatch.setattr(D, "BITMAP_BITS", 64)  # nearly every window passes
    assert sorted(map(tuple, D.find_leaks(docs, items).collect())) == want


def test_edge_cases(spark):
    long = "filler words of some kind here " * 20_000 + ITEM
    rows = [(1, None, 0), (None, ITEM, 0), (2, "", 0), (3, ITEM.upper() + "!!", 0), (4, long, 0), (5, ITEM, 1), (5, ITEM, 1), (6, "two words", 0), (7, "only two words more", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int").withColumnRenamed("item_id", "hash")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, ""), (4, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    assert got == {(3, 1), (4, 1), (5, 1), (6, 4)}  # 3: windows without the name in capitals are enough; 7 only holds a short item
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {1, 2, None} <= {r.doc_id for r in kept.collect()}
    assert D.find_leaks(docs, items.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), items).count() == 0

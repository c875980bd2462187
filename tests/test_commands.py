import pytest

from tessera.commands import COMMANDS, CommandError, Session


@pytest.fixture
def s(spark):
    return Session(spark)


def test_inventory():
    from collections import Counter

    assert Counter(n.split(".")[0] for n in COMMANDS) == {"FT": 29, "JSON": 24, "BF": 10, "CF": 12, "CMS": 7, "TOPK": 8, "TDIGEST": 15}


def run(s, text, *more):
    return s.execute(*text.split(), *more)


def test_search_commands(s):
    assert run(s, "FT.CREATE i SCHEMA title TEXT k TAG n NUMERIC at GEO v VECTOR FLAT 4 DIM 2 DISTANCE_METRIC L2") == "OK"
    for i, (t, k, n, at, v) in enumerate([("quick brown fox", "a", 1, "0,0", [0, 0]), ("lazy dog", "b", 2, "1,1", [1, 0]), ("quick dog", "a", 3, "50,50", [5, 5])], 1):
        s.execute("FT.ADD", "i", f"d{i}", "FIELDS", "title", t, "k", k, "n", n, "at", at, "v", [float(x) for x in v])
    ids = lambda df: [r.doc_id for r in (df if isinstance(df, list) else df.collect())]
    assert ids(s.execute("FT.SEARCH", "i", "quick", "NOCONTENT")) == ["d1", "d3"]
    assert ids(s.execute("FT.SEARCH", "i", "*", "SORTBY", "n", "DESC", "LIMIT", 0, 2, "RETURN", 1, "n")) == ["d3", "d2"]
    assert ids(s.execute("FT.SEARCH", "i", "@k:{a}", "INKEYS", 2, "d3", "d2", "TIMEOUT", 60000, "DIALECT", 2)) == ["d3"]
    assert ids(s.execute("FT.SEARCH", "i", "*", "GEOFILTER", "at", 0, 0, 200, "km", "NOCONTENT")) == ["d1", "d2"]
    assert ids(s.execute("FT.SEARCH", "i", "@k:{a}=>[KNN 1 @v $q]", "PARAMS", 2, "q", [4.0, 4.0], "NOCONTENT")) == ["d3"]
    shown = s.execute("FT.SEARCH", "i", "fox", "HIGHLIGHT", "TAGS", "<", ">", "SUMMARIZE", "FIELDS", 1, "title", "LEN", 2, "FRAGS", 1).first()
    assert shown.title == "brown <fox>"
    assert s.execute("FT.SEARCH", "i", "dog", "WITHSCORES", "VERBATIM").count() == 2
    with pytest.raises(CommandError):
        s.execute("FT.SEARCH", "i", "dog", "NOPE")
    assert sorted(map(tuple, s.execute("FT.AGGREGATE", "i", "*", "GROUPBY", "1", "@k", "REDUCE", "COUNT", "0", "AS", "c").collect())) == [("a", 2), ("b", 1)]
    key, first = s.execute("FT.AGGREGATE", "i", "*", "SORTBY", "1", "@n", "WITHCURSOR", "COUNT", "2")
    key2, rest = s.execute("FT.CURSOR", "READ", "i", key)
    assert (first.count(), rest.count(), key2) == (2, 1, "0")
    assert s.execute("FT.EXPLAIN", "i", "@k:{a}") == "TAG @k:{a}" and s.execute("FT.EXPLAINCLI", "i", "a b")[0] == "AND"
    assert s.execute("FT.PROFILE", "i", "SEARCH", "*").first().results == 3
    assert [r.value for r in run(s, "FT.TAGVALS i k").collect()] == ["a", "b"] and run(s, "FT._LIST") == ["i"] and run(s, "FT.INFO i").first().num_docs == 3
    assert run(s, "FT.ALIASADD al i") == run(s, "FT.ALIASUPDATE al i") == "OK" and s.execute("FT.SEARCH", "al", "fox").count() == 1 and run(s, "FT.ALIASDEL al") == "OK"
    assert run(s, "FT.ALTER i SCHEMA ADD extra TEXT") == "OK" and run(s, "FT.DEL i d1") == "OK"
    with pytest.raises(CommandError):
        run(s, "FT.DEL i d1")
    with pytest.raises(CommandError):
        s.execute("FT.ADD", "i", "x", "FIELDS", "v", [1.0])
    run(s, "FT.SYNUPDATE i g1 dog hound")
    assert run(s, "FT.SYNDUMP i") == {"dog": ["g1"], "hound": ["g1"]}
    assert [(r.term, r.suggestion) for r in s.execute("FT.SPELLCHECK", "i", "dogg", "DISTANCE", 1).collect()] == [("dogg", "dog")]
    assert run(s, "FT.CONFIG SET TIMEOUT 7") == "OK" and run(s, "FT.CONFIG GET TIMEOUT") == {"TIMEOUT": "7"} and run(s, "FT._DEBUG") == "OK" and run(s, "FT.DROPINDEX i") == "OK"
    with pytest.raises(CommandError):
        run(s, "FT.NOPE")


def test_dictionaries(s):
    assert (run(s, "FT.SUGADD d Hello 1"), run(s, "FT.SUGADD d help 3 PAYLOAD p"), run(s, "FT.SUGADD d hello 4 INCR"), run(s, "FT.SUGLEN d")) == (1, 2, 2, 2)
    assert run(s, "FT.SUGGET d HE WITHSCORES WITHPAYLOADS MAX 1") == [("hello", 5.0, None)] and run(s, "FT.SUGGET d helo FUZZY") == [("hello",), ("help",)]
    assert run(s, "FT.SUGDEL d hello") == 1 and run(s, "FT.SUGDEL d hello") == 0
    assert run(s, "FT.DICTADD x b a b") == 2 and run(s, "FT.DICTDEL x a z") == 1 and run(s, "FT.DICTDUMP x") == ["b"]


def test_json_commands(s):
    j = lambda *w: s.execute(*w)
    assert j("JSON.SET", "k", "$", '{"a":1,"l":[1,2,3],"s":"x","b":true,"o":{"p":2}}') == "OK" and j("JSON.SET", "k", "$", "1", "NX") is None
    assert j("JSON.GET", "k", "$.a") == "[1]" and j("JSON.GET", "k", "a") == "1" and j("JSON.GET", "none") is None
    assert j("JSON.GET", "k", "INDENT", " ", "NEWLINE", "\n", "SPACE", " ", "o") == '{\n "p": 2\n}'
    assert j("JSON.TYPE", "k", "$.*") == ["integer", "array", "string", "boolean", "object"] and j("JSON.TYPE", "k", "a") == "integer"
    assert j("JSON.NUMINCRBY", "k", "$.a", "2") == [3] and j("JSON.NUMMULTBY", "k", "a", "2") == 6.0 and j("JSON.GET", "k", "a") == "6"
    assert j("JSON.ARRAPPEND", "k", "l", "4") == 4 and j("JSON.ARRLEN", "k", "l") == 4 and j("JSON.ARRINSERT", "k", "$.l", "0", "0") == [5]
    assert j("JSON.ARRPOP", "k", "l") == "4" and j("JSON.ARRINDEX", "k", "l", "3") == 3 and j("JSON.ARRTRIM", "k", "l", "1", "2") == 2
    assert j("JSON.STRAPPEND", "k", "s", '"yz"') == 3 and j("JSON.STRLEN", "k", "s") == 3 and j("JSON.TOGGLE", "k", "b") == "false" and j("JSON.TOGGLE", "k", "$.b") == [1]
    assert j("JSON.OBJKEYS", "k", "o") == ["p"] and j("JSON.OBJLEN", "k") == 5 and j("JSON.RESP", "k", "l") == ["[", "1", "2"] and j("JSON.DEBUG", "MEMORY", "k") > 0 and len(j("JSON.DEBUG", "HELP")) == 2
    assert j("JSON.MERGE", "k", "$", '{"o":{"p":null,"q":1}}') == "OK" and j("JSON.GET", "k", "o") == '{"q":1}'
    assert j("JSON.MSET", "m1", "$", "1", "m2", "$", '{"z":2}') == "OK" and j("JSON.MGET", "m1", "m2", "m3", "$.z") == [None, "[2]", None]
    assert j("JSON.CLEAR", "k", "$.o") == 1 and j("JSON.DEL", "k", "$.o") == 1 and j("JSON.FORGET", "k") == 1 and j("JSON.DEL", "k") == 0
    for bad in (("JSON.SET", "n", "$.a", "1"), ("JSON.NUMINCRBY", "m1", "$.q", "1"), ("JSON.CLEAR", "gone"), ("JSON.SET", "m1", "$", "{bad"), ("JSON.MSET", "a", "$")):
        with pytest.raises(ValueError):
            j(*bad)


def test_filters(s):
    assert run(s, "BF.RESERVE b 0.01 100 EXPANSION 2") == "OK" and run(s, "BF.ADD b x") == 1 and run(s, "BF.ADD b x") == 0 and run(s, "BF.MADD b y z x") == [1, 1, 0]
    assert run(s, "BF.EXISTS b x") == 1 and run(s, "BF.MEXISTS b q x") == [0, 1] and run(s, "BF.EXISTS none x") == 0 and run(s, "BF.CARD b") == 3 and run(s, "BF.INFO b ITEMS") == 3
    assert run(s, "BF.INSERT c CAPACITY 10 ERROR 0.1 NONSCALING ITEMS a b") == [1, 1]
    at, chunk = run(s, "BF.SCANDUMP b 0")
    assert s.execute("BF.LOADCHUNK", "b2", at, chunk) == "OK" and run(s, "BF.MEXISTS b2 x y z") == [1, 1, 1] and run(s, "BF.SCANDUMP b 1") == (0, b"")
    for bad in ("BF.RESERVE b 0.1 10", "BF.INSERT new NOCREATE ITEMS x", "BF.RESERVE q 2 10"):
        with pytest.raises(ValueError):
            run(s, bad)
    assert run(s, "CF.RESERVE f 100 BUCKETSIZE 4") == "OK" and run(s, "CF.ADD f x") == 1 and run(s, "CF.ADDNX f x") == 0 and run(s, "CF.INSERT f ITEMS x y") == [1, 1] and run(s, "CF.INSERTNX f ITEMS y w") == [0, 1]
    assert run(s, "CF.COUNT f x") == 2 and run(s, "CF.DEL f x") == 1 and run(s, "CF.MEXISTS f x y q") == [1, 1, 0] and run(s, "CF.EXISTS f y") == 1 and run(s, "CF.INFO f")["deleted"] == 1
    assert s.execute("CF.LOADCHUNK", "f2", 1, run(s, "CF.SCANDUMP f 0")[1]) == "OK" and run(s, "CF.COUNT f2 x") == 1


def test_counters_and_digests(s):
    assert run(s, "CMS.INITBYDIM m 100 4") == "OK" and run(s, "CMS.INITBYPROB n 0.01 0.01") == "OK" and run(s, "CMS.INCRBY m a 3 b 1") == [3, 1] and run(s, "CMS.QUERY m a z") == [3, 0]
    run(s, "CMS.INITBYDIM t 100 4")
    assert run(s, "CMS.MERGE t 2 m m WEIGHTS 1 2") == "OK" and run(s, "CMS.QUERY t a") == [9] and run(s, "CMS.INFO t") == {"width": 100, "depth": 4, "count": 12}
    assert run(s, "CMS.MERGE m 1 m") == "OK" and run(s, "CMS.QUERY m a") == [3]
    assert s.execute("CMS.LOADCHUNK", "u", s.keys["t"].dump()) == "OK" and run(s, "CMS.QUERY u a") == [9]
    with pytest.raises(ValueError):
        run(s, "CMS.INCRBY m a -9")
    assert run(s, "TOPK.RESERVE k 2 50 4 0.9") == "OK" and run(s, "TOPK.ADD k a a b") == [None] * 3 and run(s, "TOPK.INCRBY k c 9") == ["b"]
    assert run(s, "TOPK.QUERY k a b") == [1, 0] and run(s, "TOPK.COUNT k c") == [9] and run(s, "TOPK.LIST k WITHCOUNT") == [("c", 9), ("a", 2)] and run(s, "TOPK.INFO k")["k"] == 2
    assert s.execute("TOPK.LOADCHUNK", "k2", s.keys["k"].dump()) == "OK" and run(s, "TOPK.LIST k2") == ["c", "a"]
    assert run(s, "TDIGEST.CREATE d COMPRESSION 100") == "OK" and s.execute("TDIGEST.ADD", "d", *range(1, 101)) == "OK"
    assert run(s, "TDIGEST.QUANTILE d 0 0.5 1") == [1, 50.5, 100] and run(s, "TDIGEST.CDF d 0 50") == [0.0, 0.495] and run(s, "TDIGEST.RANK d 0 50") == [-1, 49] and run(s, "TDIGEST.REVRANK d 101") == [-1]
    assert run(s, "TDIGEST.BYRANK d 0 200") == [1, float("inf")] and run(s, "TDIGEST.BYREVRANK d 0") == [100] and run(s, "TDIGEST.TRIMMED_MEAN d 0.1 0.9") == 50.5 and run(s, "TDIGEST.MIN d") == 1 and run(s, "TDIGEST.MAX d") == 100
    assert run(s, "TDIGEST.MERGE e 2 d d") == "OK" and run(s, "TDIGEST.INFO e")["weight"] == 200 and run(s, "TDIGEST.MERGE e 1 d OVERRIDE COMPRESSION 50") == "OK" and run(s, "TDIGEST.INFO e")["weight"] == 100
    assert s.execute("TDIGEST.LOADCHUNK", "x", s.keys["d"].dump()) == "OK" and run(s, "TDIGEST.RESET d") == "OK" and run(s, "TDIGEST.RANK d 5") == [-2]
    with pytest.raises(ValueError):
        run(s, "TDIGEST.ADD d nan")

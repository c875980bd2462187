"""The command surface: every command by name, over one session's indexes and keys.

Searches and aggregations are frames over the catalogue's indexes; they return DataFrames.
JSON documents and sketches live under keys, one small object each, as their commands
address them one at a time; whole columns of them are the business of the frame functions
in ``functions.json_ops`` and ``operators.sketches``.
"""

from __future__ import annotations

import json as _json
import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json_ops as J
from tessera.functions.json_path import JsonError, dumps, loads, parse_path, places, type_name, values
from tessera.operators import suggest as S
from tessera.operators.sketches import bloom, cms, cuckoo, digest, topk
from tessera.plans.pipeline import Cursors, parse_pipeline, run_aggregate
from tessera.plans.profile import collect_within, explain_query, profile
from tessera.plans.query import parse_query
from tessera.plans.search import search
from tessera.spec import Catalog, Spec

Words = list[str]
COMMANDS: dict[str, Callable[..., Any]] = {}


class CommandError(ValueError):
    """A command that is not known or whose words do not fit."""


def command(*names: str) -> Callable:
    def keep(f: Callable) -> Callable:
        for n in names:
            COMMANDS[n] = f
        return f

    return keep


def number(w: str) -> int | float:
    try:
        return int(w)
    except ValueError:
        return float(w)


class Reader:
    """Words taken from the left; keywords are met in any letter case."""

    def __init__(self, words: Sequence[Any]):
        self.words, self.at = list(words), 0

    def __bool__(self) -> bool:
        return self.at < len(self.words)

    def take(self) -> Any:
        if not self:
            raise CommandError("a word is missing")
        self.at += 1
        return self.words[self.at - 1]

    def key(self) -> str:
        return str(self.take()).upper()

    def counted(self) -> list[Any]:
        return [self.take() for _ in range(int(self.take()))]

    def met(self, word: str) -> bool:
        if self and str(self.words[self.at]).upper() == word:
            self.at += 1
            return True
        return False

    def rest(self) -> list[Any]:
        out, self.at = self.words[self.at :], len(self.words)
        return out


class CountMin:
    """A count-min sketch under a key: dense counters."""

    def __init__(self, dims: cms.Dims):
        self.dims, self.cells, self.total = dims, np.zeros((dims.depth, dims.width), np.int64), 0

    def spots(self, item: str) -> list[int]:
        import xxhash

        return [xxhash.xxh64_intdigest(bloom.item_bytes(item), r) % self.dims.width for r in range(self.dims.depth)]

    def add(self, item: str, n: int) -> int:
        rows, cols = range(self.dims.depth), self.spots(item)
        new = self.cells[rows, cols] + n
        if (new < 0).any() or (new > cms.MAX_COUNT).any():
            raise cms.SketchError("a counter is out of range")
        self.cells[rows, cols] = new
        self.total += n
        return int(new.min())

    def count(self, item: str) -> int:
        return int(self.cells[range(self.dims.depth), self.spots(item)].min())

    def merged(self, others: Sequence[CountMin], weights: Sequence[int]) -> CountMin:
        if any(o.dims != self.dims for o in others):
            raise cms.SketchError("the dimensions differ")
        out = CountMin(self.dims)
        out.cells = np.clip(sum(o.cells * w for o, w in zip(others, weights)), 0, cms.MAX_COUNT)
        out.total = sum(o.total * w for o, w in zip(others, weights))
        return out

    def dump(self) -> bytes:
        return _json.dumps([self.dims.width, self.dims.depth, self.total]).encode() + b"\n" + self.cells.tobytes()

    @staticmethod
    def load(raw: bytes) -> CountMin:
        head, _, body = raw.partition(b"\n")
        w, d, total = _json.loads(head)
        out = CountMin(cms.Dims(w, d))
        out.cells, out.total = np.frombuffer(body, np.int64).reshape(d, w).copy(), total
        return out


class Session:
    """Indexes, dictionaries, documents and sketches of one user."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog, self.cursors = spark, Catalog(spark), Cursors()
        self.keys: dict[str, Any] = {}
        self.suggestions: dict[str, dict[str, tuple[float, str | None]]] = {}
        self.sources: dict[str, DataFrame] = {}

    def execute(self, name: str, *words: Any) -> Any:
        f = COMMANDS.get(name.upper())
        if f is None:
            raise CommandError(f"no command {name!r}")
        return f(self, Reader(words))

    def get(self, key: str, kind: type, what: str) -> Any:
        v = self.keys.get(key)
        if not isinstance(v, kind):
            raise CommandError(f"{key!r} is no {what}")
        return v

    def new(self, key: str, value: Any) -> str:
        if key in self.keys:
            raise CommandError(f"{key!r} exists")
        self.keys[key] = value
        return "OK"


class Doc:
    """A JSON document under a key."""

    def __init__(self, value: Any):
        self.value = value


# search


@command("FT.CREATE")
def ft_create(s: Session, r: Reader) -> str:
    spec = Spec.parse([str(w) for w in r.rest()])
    s.catalog.create(spec, s.sources.get(spec.name))
    return "OK"


@command("FT.DROPINDEX")
def ft_drop(s: Session, r: Reader) -> str:
    s.catalog.drop(r.take())
    return "OK"


@command("FT.INFO")
def ft_info(s: Session, r: Reader) -> DataFrame:
    return s.catalog.info(r.take())


@command("FT._LIST")
def ft_list(s: Session, r: Reader) -> list[str]:
    return s.catalog.names()


@command("FT.ADD")
def ft_add(s: Session, r: Reader) -> str:
    name, key = r.take(), r.take()
    if not r.met("FIELDS"):
        raise CommandError("FIELDS is expected")
    words = r.rest()
    row = {"doc_id": key} | dict(zip(words[::2], words[1::2]))
    kinds = ["array<float>" if isinstance(v, (list, tuple)) else "string" for v in row.values()]
    index = s.catalog.indexes.get(name)
    if index is not None:
        for f in index.spec.of("VECTOR"):
            if f.name in row and len(row[f.name]) != f.dim:
                raise CommandError(f"field {f.name!r} takes {f.dim} values")
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(row, kinds))
    s.catalog.put(name, s.spark.createDataFrame([tuple(v if isinstance(v, (list, tuple)) else str(v) for v in row.values())], schema))
    return "OK"


@command("FT.DEL")
def ft_del(s: Session, r: Reader) -> str:
    name, key = r.take(), r.take()
    if s.catalog.resolve(name).docs.where(F.col("doc_id") == key).isEmpty():
        raise CommandError(f"no document {key!r}")
    s.catalog.delete(name, [key])
    return "OK"


@command("FT.ALTER")
def ft_alter(s: Session, r: Reader) -> str:
    name = r.take()
    if not (r.met("SCHEMA") and r.met("ADD")):
        raise CommandError("SCHEMA ADD is expected")
    s.catalog.alter(name, r.rest(), s.sources.get(s.catalog.resolve(name).spec.name))
    return "OK"


@command("FT.ALIASADD")
def ft_alias_add(s: Session, r: Reader) -> str:
    s.catalog.alias(r.take(), r.take())
    return "OK"


@command("FT.ALIASUPDATE")
def ft_alias_update(s: Session, r: Reader) -> str:
    s.catalog.alias(r.take(), r.take(), update=True)
    return "OK"


@command("FT.ALIASDEL")
def ft_alias_del(s: Session, r: Reader) -> str:
    s.catalog.unalias(r.take())
    return "OK"


@command("FT.TAGVALS")
def ft_tagvals(s: Session, r: Reader) -> DataFrame:
    return s.catalog.tag_values(r.take(), r.take())


def search_options(r: Reader) -> dict[str, Any]:
    """Keyword arguments of search from the words after a query."""
    o: dict[str, Any] = {}
    while r:
        k = r.key()
        if k in ("NOCONTENT", "VERBATIM"):
            o[k.lower()] = True
        elif k == "WITHSCORES":
            o["with_scores"] = True
        elif k == "NOSTOPWORDS":
            o["no_stopwords"] = True
        elif k == "INORDER":
            o["in_order"] = True
        elif k in ("INKEYS", "INFIELDS"):
            o[k.lower()] = r.counted()
        elif k == "RETURN":
            o["fields"] = r.counted()
        elif k == "PARAMS":
            got = r.counted()
            o["params"] = dict(zip(got[::2], got[1::2]))
        elif k in ("SLOP", "TIMEOUT"):
            o[k.lower()] = int(r.take())
        elif k == "LANGUAGE":
            o["language"] = str(r.take()).lower()
        elif k == "DIALECT":
            r.take()  # accepted, without effect
        elif k == "SORTBY":
            o["sort_by"] = r.take()
            o["ascending"] = not r.met("DESC")
            r.met("ASC")
        elif k == "LIMIT":
            o["limit"] = (int(r.take()), int(r.take()))
        elif k == "GEOFILTER":
            o["geofilter"] = (r.take(), float(r.take()), float(r.take()), float(r.take()), r.take())
        elif k in ("HIGHLIGHT", "SUMMARIZE"):
            own: dict[str, Any] = {}
            if r.met("FIELDS"):
                own["fields"] = r.counted()
            if k == "HIGHLIGHT" and r.met("TAGS"):
                own["tags"] = (r.take(), r.take())
            while k == "SUMMARIZE":
                w = next((x for x in ("FRAGS", "LEN", "SEPARATOR") if r.met(x)), None)
                if w is None:
                    break
                own[{"FRAGS": "frags", "LEN": "length", "SEPARATOR": "separator"}[w]] = r.take() if w == "SEPARATOR" else int(r.take())
            o[k.lower()] = own
        else:
            raise CommandError(f"unknown option {k!r}")
    return o


@command("FT.SEARCH")
def ft_search(s: Session, r: Reader) -> DataFrame | list:
    index, query = s.catalog.resolve(r.take()), r.take()
    o = search_options(r)
    ms = o.pop("timeout", None)
    df = search(index, query, **o)
    return collect_within(df, ms) if ms else df


@command("FT.AGGREGATE")
def ft_aggregate(s: Session, r: Reader) -> Any:
    index, query = s.catalog.resolve(r.take()), r.take()
    pipeline = parse_pipeline(r.rest())
    df = run_aggregate(index, query, pipeline)
    return s.cursors.start(df, pipeline.batch) if pipeline.cursor else df


@command("FT.CURSOR")
def ft_cursor(s: Session, r: Reader) -> Any:
    what, _, key = r.key(), r.take(), r.take()
    if what == "DEL":
        s.cursors.close(key)
        return "OK"
    if what != "READ":
        raise CommandError("READ or DEL is expected")
    return s.cursors.read(key, int(r.take()) if r.met("COUNT") else None)


@command("FT.EXPLAIN")
def ft_explain(s: Session, r: Reader) -> str:
    s.catalog.resolve(r.take())
    return explain_query(r.take())


@command("FT.EXPLAINCLI")
def ft_explain_cli(s: Session, r: Reader) -> list[str]:
    return ft_explain(s, r).split("\n")


@command("FT.PROFILE")
def ft_profile(s: Session, r: Reader) -> DataFrame:
    index, kind, query = s.catalog.resolve(r.take()), r.key(), r.take()
    return profile(index, query, r.rest() if kind == "AGGREGATE" else None)


@command("FT.CONFIG")
def ft_config(s: Session, r: Reader) -> Any:
    if r.key() == "GET":
        return s.catalog.get_config(r.take())
    s.catalog.set_config(r.take(), r.take())
    return "OK"


@command("FT._DEBUG")
def ft_debug(s: Session, r: Reader) -> str:
    return "OK"


@command("FT.SUGADD")
def ft_sugadd(s: Session, r: Reader) -> int:
    d, term, score = s.suggestions.setdefault(r.take(), {}), str(r.take()).lower(), float(r.take())
    old = d.get(term, (0.0, None))
    add, payload = False, old[1]
    while r:
        k = r.key()
        if k == "INCR":
            add = True
        elif k == "PAYLOAD":
            payload = r.take()
        else:
            raise CommandError(f"unknown option {k!r}")
    d[term] = (old[0] + score if add else score, payload)
    return len(d)


@command("FT.SUGGET")
def ft_sugget(s: Session, r: Reader) -> list[tuple]:
    name, prefix = r.take(), r.take()
    fuzzy = scores = payloads = False
    most = 5
    while r:
        k = r.key()
        if k == "MAX":
            most = int(r.take())
        elif k in ("FUZZY", "WITHSCORES", "WITHPAYLOADS"):
            fuzzy, scores, payloads = fuzzy or k == "FUZZY", scores or k == "WITHSCORES", payloads or k == "WITHPAYLOADS"
        else:
            raise CommandError(f"unknown option {k!r}")
    entries = s.spark.createDataFrame([(t, *v) for t, v in s.suggestions.get(name, {}).items()], "term string, score double, payload string")
    rows = S.suggest(entries, prefix, most, fuzzy).collect()
    return [(x.term, *([x.score] if scores else []), *([x.payload] if payloads else [])) for x in rows]


@command("FT.SUGDEL")
def ft_sugdel(s: Session, r: Reader) -> int:
    return int(s.suggestions.get(r.take(), {}).pop(str(r.take()).lower(), None) is not None)


@command("FT.SUGLEN")
def ft_suglen(s: Session, r: Reader) -> int:
    return len(s.suggestions.get(r.take(), {}))


@command("FT.DICTADD")
def ft_dictadd(s: Session, r: Reader) -> int:
    d, new = s.catalog.dictionaries.setdefault(r.take(), set()), set(r.rest())
    n = len(new - d)
    d |= new
    return n


@command("FT.DICTDEL")
def ft_dictdel(s: Session, r: Reader) -> int:
    d, gone = s.catalog.dictionaries.setdefault(r.take(), set()), set(r.rest())
    n = len(gone & d)
    d -= gone
    return n


@command("FT.DICTDUMP")
def ft_dictdump(s: Session, r: Reader) -> list[str]:
    return sorted(s.catalog.dictionaries.get(r.take(), ()))


@command("FT.SYNUPDATE")
def ft_synupdate(s: Session, r: Reader) -> str:
    index, group = s.catalog.resolve(r.take()), r.take()
    r.met("SKIPINITIALSCAN")
    S.update_synonyms(index, group, r.rest())
    return "OK"


@command("FT.SYNDUMP")
def ft_syndump(s: Session, r: Reader) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for group, terms in sorted(s.catalog.resolve(r.take()).synonyms.items()):
        for t in terms:
            out.setdefault(t, []).append(group)
    return dict(sorted(out.items()))


@command("FT.SPELLCHECK")
def ft_spellcheck(s: Session, r: Reader) -> DataFrame:
    index, query = s.catalog.resolve(r.take()), r.take()
    distance, sides = 1, {}
    while r:
        k = r.key()
        if k == "DISTANCE":
            distance = int(r.take())
        elif k == "TERMS":
            kind, name = r.key().lower(), r.take()
            sides[kind] = s.spark.createDataFrame([(t,) for t in sorted(s.catalog.dictionaries.get(name, ()))], "term string")
        else:
            raise CommandError(f"unknown option {k!r}")
    return S.spellcheck(index, query, distance, sides.get("include"), sides.get("exclude"))


# JSON


def doc(s: Session, key: str) -> Doc | None:
    v = s.keys.get(key)
    if v is not None and not isinstance(v, Doc):
        raise CommandError(f"{key!r} is no JSON document")
    return v


def there(s: Session, key: str) -> Doc:
    d = doc(s, key)
    if d is None:
        raise CommandError(f"no document {key!r}")
    return d


def optional_path(r: Reader, default: str = ".") -> str:
    return str(r.take()) if r else default


def reply(path: str, got: list) -> Any:
    """All replies for a $ path; the first one, which must be there, for a legacy path."""
    if not parse_path(path).legacy:
        return got
    if not got or got[0] is None:
        raise JsonError(f"nothing fits at {path!r}")
    return got[0]


@command("JSON.SET")
def json_set(s: Session, r: Reader) -> str | None:
    key, path, value = r.take(), str(r.take()), loads(str(r.take()))
    mode = r.key() if r else ""
    old = doc(s, key)
    new, done = J.set_value(J.MISSING if old is None else old.value, path, value, mode)
    if done:
        s.keys[key] = Doc(new)
    return "OK" if done else None


@command("JSON.GET")
def json_get(s: Session, r: Reader) -> str | None:
    d, fmt, paths = doc(s, r.take()), {}, []
    while r:
        w = r.take()
        if str(w).upper() in ("INDENT", "NEWLINE", "SPACE"):
            fmt[str(w).lower()] = str(r.take())
        else:
            paths.append(str(w))
    return None if d is None else J.get_values(d.value, paths, **fmt)


@command("JSON.DEL", "JSON.FORGET")
def json_del(s: Session, r: Reader) -> int:
    key = r.take()
    d = doc(s, key)
    if d is None:
        return 0
    d.value, n = J.delete(d.value, optional_path(r))
    if d.value is J.GONE:
        del s.keys[key]
    return n


def _read(f: Callable[[Any, str], list]) -> Callable[[Session, Reader], Any]:
    def run(s: Session, r: Reader) -> Any:
        d = doc(s, r.take())
        return None if d is None else reply(path := optional_path(r), f(d.value, path))

    return run


command("JSON.TYPE")(_read(lambda v, p: [type_name(x) for x in values(v, parse_path(p))]))
command("JSON.ARRLEN")(_read(lambda v, p: J.sizes(v, p, list)))
command("JSON.OBJLEN")(_read(lambda v, p: J.sizes(v, p, dict)))
command("JSON.STRLEN")(_read(lambda v, p: J.sizes(v, p, str)))
command("JSON.OBJKEYS")(_read(lambda v, p: [list(x) if isinstance(x, dict) else None for x in values(v, parse_path(p))]))
command("JSON.RESP")(_read(lambda v, p: [J.flat(x) for x in values(v, parse_path(p))]))


@command("JSON.DEBUG")
def json_debug(s: Session, r: Reader) -> Any:
    if r.key() == "HELP":
        return ["JSON.DEBUG MEMORY key [path]", "JSON.DEBUG HELP"]
    d = there(s, r.take())
    return sum(map(J.memory, values(d.value, parse_path(optional_path(r)))))


def _edit(f: Callable[..., tuple[Any, Any]], args: Callable[[Reader], tuple[str, list[Any]]]) -> Callable[[Session, Reader], Any]:
    def run(s: Session, r: Reader) -> Any:
        d = there(s, r.take())
        path, more = args(r)
        if not places(d.value, parse_path(path)):
            raise JsonError(f"nothing is at {path!r}")
        d.value, got = f(d.value, path, *more)
        return reply(path, got)

    return run


command("JSON.ARRAPPEND")(_edit(J.array_append, lambda r: (str(r.take()), [loads(str(w)) for w in r.rest()])))
command("JSON.ARRINSERT")(_edit(J.array_insert, lambda r: (str(r.take()), [int(r.take()), *(loads(str(w)) for w in r.rest())])))
command("JSON.ARRTRIM")(_edit(J.array_trim, lambda r: (str(r.take()), [int(r.take()), int(r.take())])))
command("JSON.NUMINCRBY")(_edit(J.number_add, lambda r: (str(r.take()), [loads(str(r.take()))])))
command("JSON.NUMMULTBY")(_edit(J.number_multiply, lambda r: (str(r.take()), [loads(str(r.take()))])))
command("JSON.STRAPPEND")(_edit(J.string_append, lambda r: (str(r.take()) if len(r.words) - r.at > 1 else ".", [loads(str(r.take()))])))


@command("JSON.ARRPOP")
def json_arrpop(s: Session, r: Reader) -> Any:
    d, path = there(s, r.take()), optional_path(r)
    d.value, got = J.array_pop(d.value, path, int(r.take()) if r else -1)
    return got if not parse_path(path).legacy else (got[0] if got else None)


@command("JSON.ARRINDEX")
def json_arrindex(s: Session, r: Reader) -> Any:
    d, path, value = there(s, r.take()), str(r.take()), loads(str(r.take()))
    return reply(path, J.array_index(d.value, path, value, *(int(w) for w in r.rest())))


@command("JSON.TOGGLE")
def json_toggle(s: Session, r: Reader) -> Any:
    d, path = there(s, r.take()), optional_path(r)
    d.value, got = J.toggle(d.value, path)
    return [None if g is None else int(g) for g in got] if not parse_path(path).legacy else dumps(reply(path, got))


@command("JSON.CLEAR")
def json_clear(s: Session, r: Reader) -> int:
    d = there(s, r.take())
    d.value, n = J.clear(d.value, optional_path(r))
    return n


@command("JSON.MERGE")
def json_merge(s: Session, r: Reader) -> str:
    key, path, patch = r.take(), str(r.take()), loads(str(r.take()))
    old = doc(s, key)
    new, _ = J.merge(J.MISSING if old is None else old.value, path, patch)
    if new is J.GONE:
        s.keys.pop(key, None)
    else:
        s.keys[key] = Doc(new)
    return "OK"


@command("JSON.MGET")
def json_mget(s: Session, r: Reader) -> list[str | None]:
    *keys, path = r.rest()
    p = parse_path(str(path))
    out: list[str | None] = []
    for k in keys:
        d = s.keys.get(k)
        found = values(d.value, p) if isinstance(d, Doc) else []
        out.append(None if not found else dumps(found[0] if p.legacy else found))
    return out


@command("JSON.MSET")
def json_mset(s: Session, r: Reader) -> str:
    words = r.rest()
    if len(words) % 3:
        raise CommandError("keys, paths and values are expected")
    todo = [(k, str(p), loads(str(v))) for k, p, v in zip(words[::3], words[1::3], words[2::3])]
    for k, p, v in todo:
        old = doc(s, k)
        s.keys[k] = Doc(J.set_value(J.MISSING if old is None else old.value, p, v)[0])
    return "OK"


# Bloom filters


@command("BF.RESERVE")
def bf_reserve(s: Session, r: Reader) -> str:
    key, rate, cap, expansion = r.take(), float(r.take()), int(r.take()), bloom.EXPANSION
    while r:
        k = r.key()
        expansion = 0 if k == "NONSCALING" else int(r.take())
    return s.new(key, bloom.Chain(bloom.Params(rate, cap, expansion)))


def bf(s: Session, key: str, create: bool = False, params: bloom.Params = bloom.Params()) -> bloom.Chain:
    if create and key not in s.keys:
        s.keys[key] = bloom.Chain(params)
    return s.get(key, bloom.Chain, "Bloom filter")


@command("BF.ADD")
def bf_add(s: Session, r: Reader) -> int:
    return int(bf(s, r.take(), True).add(r.take()))


@command("BF.MADD")
def bf_madd(s: Session, r: Reader) -> list[int]:
    return [int(x) for x in bf(s, r.take(), True).add_many(r.rest())]


@command("BF.INSERT")
def bf_insert(s: Session, r: Reader) -> list[int]:
    key, rate, cap, expansion, create = r.take(), bloom.ERROR_RATE, bloom.INITIAL_SIZE, bloom.EXPANSION, True
    while not r.met("ITEMS"):
        k = r.key()
        if k == "NOCREATE":
            create = False
        elif k == "NONSCALING":
            expansion = 0
        elif k == "ERROR":
            rate = float(r.take())
        elif k == "CAPACITY":
            cap = int(r.take())
        elif k == "EXPANSION":
            expansion = int(r.take())
        else:
            raise CommandError(f"unknown option {k!r}")
    return [int(x) for x in bf(s, key, create, bloom.Params(rate, cap, expansion)).add_many(r.rest())]


@command("BF.MEXISTS")
def bf_mexists(s: Session, r: Reader) -> list[int]:
    f = s.keys.get(r.take())
    return [int(isinstance(f, bloom.Chain) and x in f) for x in r.rest()]


@command("BF.EXISTS")
def bf_exists(s: Session, r: Reader) -> int:
    return bf_mexists(s, r)[0]


@command("BF.CARD")
def bf_card(s: Session, r: Reader) -> int:
    f = s.keys.get(r.take())
    return f.cardinality if isinstance(f, bloom.Chain) else 0


@command("BF.INFO")
def bf_info(s: Session, r: Reader) -> Any:
    info = bf(s, r.take()).info()
    return info[r.take().lower()] if r else info


def _dump(kind: type) -> Callable[[Session, Reader], tuple[int, bytes]]:
    """SCANDUMP: one chunk and its number, then number 0 and nothing."""
    return lambda s, r: (lambda f, at: (1, f.dump()) if at == 0 else (0, b""))(s.get(r.take(), kind, "such sketch"), int(r.take()))


def _load(kind: type) -> Callable[[Session, Reader], str]:
    """LOADCHUNK: the chunk of a dump under its number, or as it is."""

    def run(s: Session, r: Reader) -> str:
        key, *rest = r.rest()
        if key in s.keys and not isinstance(s.keys[key], kind):
            raise CommandError(f"{key!r} is no such sketch")
        s.keys[key] = kind.load(rest[-1])
        return "OK"

    return run


command("BF.SCANDUMP")(_dump(bloom.Chain))
command("BF.LOADCHUNK")(_load(bloom.Chain))
command("CF.SCANDUMP")(_dump(cuckoo.Chain))
command("CF.LOADCHUNK")(_load(cuckoo.Chain))
command("CMS.LOADCHUNK")(_load(CountMin))
command("TOPK.LOADCHUNK")(_load(topk.HeavyKeeper))
command("TDIGEST.LOADCHUNK")(_load(digest.Digest))

# cuckoo filters


@command("CF.RESERVE")
def cf_reserve(s: Session, r: Reader) -> str:
    key, got = r.take(), {"capacity": int(r.take())}
    names = {"BUCKETSIZE": "bucket", "MAXITERATIONS": "iterations", "EXPANSION": "expansion"}
    while r:
        k = r.key()
        if k not in names:
            raise CommandError(f"unknown option {k!r}")
        got[names[k]] = int(r.take())
    return s.new(key, cuckoo.Chain(cuckoo.Params(**got)))


def cf(s: Session, key: str, create: bool = False, params: cuckoo.Params = cuckoo.Params()) -> cuckoo.Chain:
    if create and key not in s.keys:
        s.keys[key] = cuckoo.Chain(params)
    return s.get(key, cuckoo.Chain, "cuckoo filter")


@command("CF.ADD")
def cf_add(s: Session, r: Reader) -> int:
    if not cf(s, r.take(), True).add(r.take()):
        raise CommandError("the filter is full")
    return 1


@command("CF.ADDNX")
def cf_addnx(s: Session, r: Reader) -> int:
    got = cf(s, r.take(), True).add_new(r.take())
    if got is False:
        raise CommandError("the filter is full")
    return int(bool(got))


def _cf_insert(only_new: bool) -> Callable[[Session, Reader], list[int]]:
    def run(s: Session, r: Reader) -> list[int]:
        key, cap, create = r.take(), 1024, True
        while not r.met("ITEMS"):
            k = r.key()
            if k == "NOCREATE":
                create = False
            elif k == "CAPACITY":
                cap = int(r.take())
            else:
                raise CommandError(f"unknown option {k!r}")
        return cf(s, key, create, cuckoo.Params(cap)).add_many(r.rest(), only_new)

    return run


command("CF.INSERT")(_cf_insert(False))
command("CF.INSERTNX")(_cf_insert(True))


@command("CF.MEXISTS")
def cf_mexists(s: Session, r: Reader) -> list[int]:
    f = s.keys.get(r.take())
    return [int(isinstance(f, cuckoo.Chain) and x in f) for x in r.rest()]


@command("CF.EXISTS")
def cf_exists(s: Session, r: Reader) -> int:
    return cf_mexists(s, r)[0]


@command("CF.DEL")
def cf_del(s: Session, r: Reader) -> int:
    return int(cf(s, r.take()).remove(r.take()))


@command("CF.COUNT")
def cf_count(s: Session, r: Reader) -> int:
    f = s.keys.get(r.take())
    return f.count(r.take()) if isinstance(f, cuckoo.Chain) else 0


@command("CF.INFO")
def cf_info(s: Session, r: Reader) -> dict[str, int]:
    return cf(s, r.take()).info()


# count-min


@command("CMS.INITBYDIM")
def cms_by_dim(s: Session, r: Reader) -> str:
    return s.new(r.take(), CountMin(cms.Dims(int(r.take()), int(r.take()))))


@command("CMS.INITBYPROB")
def cms_by_prob(s: Session, r: Reader) -> str:
    return s.new(r.take(), CountMin(cms.Dims.by_error(float(r.take()), float(r.take()))))


@command("CMS.INCRBY")
def cms_incrby(s: Session, r: Reader) -> list[int]:
    f, words = s.get(r.take(), CountMin, "count-min sketch"), r.rest()
    return [f.add(x, int(n)) for x, n in zip(words[::2], words[1::2])]


@command("CMS.QUERY")
def cms_query(s: Session, r: Reader) -> list[int]:
    f = s.get(r.take(), CountMin, "count-min sketch")
    return [f.count(x) for x in r.rest()]


@command("CMS.MERGE")
def cms_merge(s: Session, r: Reader) -> str:
    key, names = r.take(), r.counted()
    weights = [int(w) for w in r.rest()] if r.met("WEIGHTS") else [1] * len(names)
    if len(weights) != len(names):
        raise CommandError("a weight for each sketch is expected")
    own = s.get(key, CountMin, "count-min sketch")
    s.keys[key] = own.merged([s.get(n, CountMin, "count-min sketch") for n in names], weights)
    return "OK"


@command("CMS.INFO")
def cms_info(s: Session, r: Reader) -> dict[str, int]:
    f = s.get(r.take(), CountMin, "count-min sketch")
    return {"width": f.dims.width, "depth": f.dims.depth, "count": f.total}


# top-k


@command("TOPK.RESERVE")
def topk_reserve(s: Session, r: Reader) -> str:
    key, k, rest = r.take(), int(r.take()), r.rest()
    args = (int(rest[0]), int(rest[1]), float(rest[2])) if rest else ()
    return s.new(key, topk.HeavyKeeper(k, *args))


def tk(s: Session, key: str) -> topk.HeavyKeeper:
    return s.get(key, topk.HeavyKeeper, "top-k sketch")


@command("TOPK.ADD")
def topk_add(s: Session, r: Reader) -> list[str | None]:
    return topk.add_all(tk(s, r.take()), r.rest())


@command("TOPK.INCRBY")
def topk_incrby(s: Session, r: Reader) -> list[str | None]:
    f, words = tk(s, r.take()), r.rest()
    return [f.add(x, int(n)) for x, n in zip(words[::2], words[1::2])]


@command("TOPK.QUERY")
def topk_query(s: Session, r: Reader) -> list[int]:
    f = tk(s, r.take())
    return [int(x in f) for x in r.rest()]


@command("TOPK.COUNT")
def topk_count(s: Session, r: Reader) -> list[int]:
    f = tk(s, r.take())
    return [f.count(x) for x in r.rest()]


@command("TOPK.LIST")
def topk_list(s: Session, r: Reader) -> list:
    f = tk(s, r.take())
    return f.list() if r.met("WITHCOUNT") else [x for x, _ in f.list()]


@command("TOPK.INFO")
def topk_info(s: Session, r: Reader) -> dict[str, float]:
    return tk(s, r.take()).info()


# digests


def td(s: Session, key: str) -> digest.Digest:
    return s.get(key, digest.Digest, "digest")


@command("TDIGEST.CREATE")
def td_create(s: Session, r: Reader) -> str:
    key = r.take()
    return s.new(key, digest.Digest(float(r.take()) if r.met("COMPRESSION") else digest.COMPRESSION))


@command("TDIGEST.ADD")
def td_add(s: Session, r: Reader) -> str:
    d, v = td(s, r.take()), [float(w) for w in r.rest()]
    if not all(map(math.isfinite, v)):
        raise CommandError("values must be finite")
    d.add(v)
    return "OK"


def _ask(name: str, kind: type = float) -> Callable[[Session, Reader], list]:
    return lambda s, r: (lambda d: [getattr(d, name)(kind(w)) for w in r.rest()])(td(s, r.take()))


for _word, _name in (("QUANTILE", "quantile"), ("CDF", "cdf"), ("RANK", "rank"), ("REVRANK", "rev_rank"), ("BYRANK", "by_rank"), ("BYREVRANK", "by_rev_rank")):
    command(f"TDIGEST.{_word}")(_ask(_name))


@command("TDIGEST.TRIMMED_MEAN")
def td_trimmed(s: Session, r: Reader) -> float:
    return td(s, r.take()).trimmed_mean(float(r.take()), float(r.take()))


@command("TDIGEST.MIN")
def td_min(s: Session, r: Reader) -> float:
    return td(s, r.take()).low


@command("TDIGEST.MAX")
def td_max(s: Session, r: Reader) -> float:
    return td(s, r.take()).high


@command("TDIGEST.RESET")
def td_reset(s: Session, r: Reader) -> str:
    key = r.take()
    s.keys[key] = td(s, key).reset()
    return "OK"


@command("TDIGEST.MERGE")
def td_merge(s: Session, r: Reader) -> str:
    key, names, c, fresh = r.take(), r.counted(), None, False
    while r:
        k = r.key()
        if k == "COMPRESSION":
            c = float(r.take())
        elif k == "OVERRIDE":
            fresh = True
        else:
            raise CommandError(f"unknown option {k!r}")
    parts = [td(s, n) for n in names]
    old = s.keys.get(key)
    if old is not None and not fresh:
        parts.append(td(s, key))
        c = c or old.compression
    s.keys[key] = digest.Digest(c or max(p.compression for p in parts)).merge(*parts)
    return "OK"


@command("TDIGEST.INFO")
def td_info(s: Session, r: Reader) -> dict[str, float]:
    return td(s, r.take()).info()


__all__ = ["COMMANDS", "CommandError", "Session", "number", "parse_query"]

"""Search: a query tree becomes one boolean column and, if asked for, one score column.

Every leaf is resolved against the index definition before any job runs. The predicate is an
ordinary column over the source's own columns, so numeric ranges and string tags reach the scan
(points and shapes are parsed from text and do not). Text leaves are answered from the stored
lists of an index, joined by document, or without such lists from the tokens of the rows that
are left. A negated range of a whole number is evaluated after the scan, as its null check is on a
cast. Two things look at data beforehand: the vocabulary words that a prefix, fuzzy or
stemmed term stands for, and the document counts of scored terms.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo, text, vector
from tessera.operators import present
from tessera.plans.query import Node, Query, QueryError, Term, parse_query, plain_terms, simplify
from tessera.spec import Field, Index, SchemaError

K1, B = 1.2, 0.75
#: The largest finite number.
MOST = sys.float_info.max
MIN_PREFIX = 2


@dataclass(frozen=True)
class Options:
    """How a query is read: fields of bare terms, phrase slack, stemming, stop words."""

    infields: tuple[str, ...] = ()
    slop: int = 0
    in_order: bool = False
    verbatim: bool = False
    no_stopwords: bool = False
    language: str | None = None
    dedup_terms: bool = False
    synonyms: bool = False
    phonetic: bool = False
    weights: bool = False
    own_stopwords: bool = False

    def stop(self, index: Index) -> frozenset[str]:
        if self.verbatim or self.no_stopwords:
            return frozenset()
        if self.own_stopwords and index.spec.stopwords is not None:
            return frozenset(index.spec.stopwords)
        return text.STOP_WORDS


def vocabulary(index: Index, name: str) -> DataFrame:
    """(term, df): every word of a text field with its number of documents."""
    if index.text:
        return index.text.terms(name).select("term", "df")
    toks = F.array_distinct(text.tokens(F.col(f"`{name}`")))
    return index.docs.select(F.explode(toks).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(index: Index, name: str) -> DataFrame:
    """(term, doc_id, tf, positions): the inverted lists of a text field."""
    if index.text:
        return index.text.lists(name, prefixes=("",)).select("term", "doc_id", "tf", "positions")
    at = index.docs.select("doc_id", F.posexplode(text.tokens(F.col(f"`{name}`"))).alias("pos", "term"))
    return at.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


class Compiler:
    """Turns trees into columns for one index and one set of options."""

    def __init__(self, index: Index, options: Options, params: Mapping[str, object]):
        self.index, self.options, self.params = index, options, params
        self.asked: dict[str, tuple[set[str], set[str]]] = {}  # terms and prefixes by field

    # leaves

    def text_fields(self, name: str) -> list[Field]:
        if name:
            return [self.index.spec.field(name, "TEXT")]
        fields = self.index.spec.of("TEXT")
        if self.options.infields:
            fields = [f for f in fields if f.name in self.options.infields]
        return fields

    def stems(self, f: Field) -> bool:
        lang = self.options.language or self.index.spec.language
        return lang == "english" and not f.nostem and not self.options.verbatim

    def expand(self, f: Field, term: Term) -> list[str]:
        """The vocabulary words that a term stands for, with the repeats that scoring counts."""
        key = (f.name, term, self.stems(f), self.options)
        if key in self.index.stats:
            return self.index.stats[key]  # type: ignore[return-value]
        word = F.col("term")
        found: list[str]
        if term.edits:
            found = self._words(f, F.levenshtein(word, F.lit(term.text), term.edits).between(0, term.edits))
        elif term.prefix:
            found = self._words(f, word.startswith(term.text)) if len(term.text) >= MIN_PREFIX else []
        else:
            found = [term.text]
            if self.stems(f):
                root = text.stem(term.text)
                likely = F.lit(True) if len(root) < 3 else word.startswith(root[: len(root) - 2])
                kin = self._words(f, likely, root)
                found += [w for w in kin if w != root] + ([root] if root != term.text else [])
            if self.options.synonyms:
                found += [w for g in self.index.synonyms.values() if term.text in g for w in g if w != term.text]
            if self.options.phonetic:
                code = text.sound(term.text)[0]
                found += [w for w in self._words(f, text.sound_udf("term")["p"] == code) if w != term.text]
        self.index.stats[key] = found
        return found

    def _words(self, f: Field, test: Column, root: str | None = None) -> list[str]:
        v = vocabulary(self.index, f.name).where(test)
        if root is not None:
            v = v.where(text.stem_udf("term") == root)
        return sorted(r.term for r in v.select("term").collect())

    def toks(self, f: Field) -> Column:
        return text.tokens(F.col(f"`{f.name}`"))

    # predicates

    def rows(self, root: Node) -> DataFrame:
        """The documents that match, with what scores need of the stored lists."""
        index, test = self.index, self.passes(root)
        base = index.docs if index.scan is None else index.scan
        for name, (terms, prefixes) in self.asked.items():
            base = base.join(index.text.hits(name, sorted(terms), sorted(prefixes), f"__hit_{name}", f"__size_{name}"), "doc_id", "left")
        return index.guarded(base.where(test))

    def passes(self, n: Node) -> Column:
        """The predicate of a tree where it chooses rows; null stands for false."""
        if n.kind in ("AND", "OR"):
            cols = [self.passes(c) for c in n.children]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if n.kind == "AND" else out | c
            return out
        if n.kind == "NOT":
            return self.fails(n.children[0])
        return self.test(n) if n.kind in ("ALL", "MAYBE") else self.leaf(n)

    def fails(self, n: Node) -> Column:
        """Where a tree does not hold, missing fields included, in terms that scans understand."""
        if n.kind == "NOT":
            return self.passes(n.children[0])
        if n.kind in ("AND", "OR"):
            cols = [self.fails(c) for c in n.children]
            out = cols[0]
            for c in cols[1:]:
                out = out | c if n.kind == "AND" else out & c
            return out
        if n.kind == "NUMERIC" or n.kind == "TAG" and not isinstance(self.index.docs.schema[n.field].dataType, T.ArrayType):
            return ~self.leaf(n) | F.col(f"`{n.field}`").isNull()
        return ~self.test(n)

    def test(self, n: Node) -> Column:
        """The predicate of a tree; never null."""
        if n.kind in ("ALL", "MAYBE"):
            for c in n.children:
                self.test(c)
            return F.lit(True)
        if n.kind in ("AND", "OR"):
            cols = [self.test(c) for c in n.children]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if n.kind == "AND" else out | c
            return out
        if n.kind == "NOT":
            return ~self.test(n.children[0])
        return F.coalesce(self.leaf(n), F.lit(False))

    def leaf(self, n: Node) -> Column:
        spec = self.index.spec
        if n.kind == "TAG":
            c = F.col(f"`{spec.field(n.field, 'TAG').name}`")
            if isinstance(self.index.docs.schema[n.field].dataType, T.ArrayType):
                return F.arrays_overlap(c, F.array(*map(F.lit, n.values)))
            return c.isin(*n.values)
        if n.kind == "NUMERIC":
            c = F.col(f"`{spec.field(n.field, 'NUMERIC').name}`")
            if n.low == math.inf or n.high == -math.inf:
                return F.lit(False)
            bounds = []  # without a bound, what is no finite number is left out
            if not math.isinf(n.low) or n.field not in self.index.whole:
                bounds.append(c >= -MOST if math.isinf(n.low) else c > n.low if n.open_low else c >= n.low)
            if not math.isinf(n.high) or n.field not in self.index.whole:
                bounds.append(c <= MOST if math.isinf(n.high) else c < n.high if n.open_high else c <= n.high)
            return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else c.isNotNull()
        if n.kind == "GEO":
            lon, lat = geo.point(F.col(f"`{spec.field(n.field, 'GEO').name}`"))
            x, y, r, unit = n.circle  # type: ignore[misc]
            return geo.within_radius(lon, lat, x, y, geo.metres(r, unit))
        if n.kind == "SHAPE":
            c = F.col(f"`{spec.field(n.field, 'GEOSHAPE').name}`")
            if n.param not in self.params:
                raise QueryError(f"no parameter {n.param!r}")
            asked = geo.parse_shape(str(self.params[n.param]))
            if asked is None:
                raise QueryError(f"parameter {n.param!r} is no shape")
            return geo.shape_holds(c, n.relation, asked)
        out = F.lit(False)
        for f in self.text_fields(n.field):
            out = out | F.coalesce(self.text_test(f, n), F.lit(False))
        return out

    def need(self, f: Field, terms: Iterable[str] = (), prefixes: Iterable[str] = ()) -> Column:
        """The column of the stored lists' terms and places in a document."""
        own = self.asked.setdefault(f.name, (set(), set()))
        own[0].update(terms)
        own[1].update(prefixes)
        return F.col(f"`__hit_{f.name}`")

    def text_test(self, f: Field, n: Node) -> Column:
        stored = self.index.text is not None
        toks = None if stored else self.toks(f)
        if n.kind == "PHRASE":
            terms = [t.text for t in n.terms]
            if stored:
                hit = self.need(f, terms)
                places = lambda t: F.try_element_at(hit, F.lit(t))["positions"]
                if len(terms) == 1:
                    return places(terms[0]).isNotNull()
                if self.options.slop == 0:
                    return text.phrase_places(places, terms)
                return text.phrase_near(places, terms, self.options.slop, self.options.in_order)
            if len(terms) == 1:
                return F.array_contains(toks, terms[0])
            if self.options.slop == 0:
                return text.phrase_at(toks, terms)
            return text.let(toks, lambda tk: text.phrase_near(lambda t: text.places(tk, t), terms, self.options.slop, self.options.in_order))
        out = F.lit(False)
        plain: set[str] = set()
        for t in n.terms:
            if t.edits == 0 and t.prefix and len(t.text) >= MIN_PREFIX:
                words = F.map_keys(self.need(f, prefixes=(t.text,))) if stored else toks
                out = out | F.exists(words, _starts_with(t.text))
            else:
                plain |= set(self.expand(f, t))
        if plain:
            words = F.map_keys(self.need(f, plain)) if stored else toks
            out = F.arrays_overlap(words, F.array(*map(F.lit, sorted(plain)))) | out
        return out

    # scores

    def score(self, n: Node) -> Column:
        """The score of documents that the tree matches; 0 elsewhere."""
        if n.kind == "ALL":
            return F.lit(1.0)
        if n.kind in ("AND", "OR"):
            total = F.lit(0.0)
            for c in n.children:
                total = total + self.score(c)
            return F.when(self.test(n), total).otherwise(0.0)
        if n.kind == "NOT":
            return F.when(self.test(n), 1.0).otherwise(0.0)
        if n.kind == "MAYBE":
            return self.score(n.children[0])
        if n.kind not in ("TEXT", "PHRASE"):
            return F.when(self.test(n), 1.0).otherwise(0.0)
        total = F.lit(0.0)
        for f in self.text_fields(n.field):
            if n.kind == "PHRASE":
                own = self.bm25(f, Counter(t.text for t in n.terms))
                total = total + F.when(F.coalesce(self.text_test(f, n), F.lit(False)), own).otherwise(0.0)
                continue
            terms: Counter[str] = Counter()
            for t in n.terms:
                terms.update(self.expand(f, t))
            if self.options.dedup_terms:
                terms = Counter(dict.fromkeys(terms, 1))
            own = self.bm25(f, terms)
            total = total + (own * f.weight if self.options.weights else own)
        return total

    def bm25(self, f: Field, terms: Mapping[str, int]) -> Column:
        """Okapi BM25 of a field; terms with the number of times each counts."""
        if not terms:
            return F.lit(0.0)
        n, mean, df = self.counts(f, sorted(terms))
        rare = {t: terms[t] * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in sorted(terms) if df[t]}
        if not rare or not mean:
            return F.lit(0.0)
        any_of = F.array(*map(F.lit, rare))
        weight = F.map_from_arrays(any_of, F.array(*[F.lit(v) for v in rare.values()]))

        def part(t: Column, tf: Column, size: Column) -> Column:
            length = K1 * (1 - B + B * size / mean)
            return F.element_at(weight, t) * tf * (K1 + 1) / (tf + length)

        def total(parts: Column) -> Column:
            return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

        if self.index.text is not None:
            hit, size = self.need(f, rare), F.col(f"`__size_{f.name}`")
            own = F.filter(F.map_entries(hit), lambda x: F.array_contains(any_of, x["key"]))
            return F.coalesce(total(F.transform(own, lambda x: part(x["key"], x["value"]["tf"].cast("double"), size))), F.lit(0.0))

        def of_own(own: Column, size: Column) -> Column:
            count = lambda t: F.size(F.filter(own, lambda x: x == t)).cast("double")
            return total(F.transform(F.array_distinct(own), lambda t: part(t, count(t), size)))

        def of_tokens(tk: Column) -> Column:
            return text.let(F.filter(tk, lambda x: F.array_contains(any_of, x)), lambda own: of_own(own, F.size(tk)))

        return F.coalesce(text.let(self.toks(f), of_tokens), F.lit(0.0))

    def counts(self, f: Field, terms: Sequence[str]) -> tuple[int, float, dict[str, int]]:
        """(documents with the field, their mean length, documents of each term)."""
        known: dict = self.index.stats.setdefault(("df", f.name), {})  # type: ignore[assignment]
        todo = [t for t in terms if t not in known]
        if self.index.text is not None:
            lists = self.index.text
            found = {r.term: r.df for r in lists.terms(f.name).where(F.col("term").isin(*todo)).collect()} if todo else {}
            known.update({t: found.get(t, 0) for t in todo})
            return lists.docs[f.name], lists.mean(f.name), {t: known[t] for t in terms}
        if todo or "n" not in known:
            docs = self.index.docs.where(F.col(f"`{f.name}`").isNotNull())
            if "n" not in known:
                r = docs.agg(F.count(F.lit(1)), F.avg(F.size(self.toks(f)))).first()
                known["n"], known["mean"] = r[0], r[1] or 0.0
            have = docs.select(F.explode(F.array_distinct(F.filter(self.toks(f), lambda x: x.isin(*todo)))).alias("t")) if todo else None
            found = {r["t"]: r["count"] for r in have.groupBy("t").count().collect()} if have is not None else {}
            known.update({t: found.get(t, 0) for t in todo})
        return known["n"], known["mean"], {t: known[t] for t in terms}


def _starts_with(prefix: str) -> Callable[[Column], Column]:
    return lambda x: x.startswith(prefix)


def knn(index: Index, field_name: str, query: Sequence[float], k: int, candidates: DataFrame | None = None) -> DataFrame:
    """Documents with __vec_score: the k nearest to query, ties by id; exact."""
    f = index.spec.field(field_name, "VECTOR")
    if len(query) != f.dim:
        raise QueryError(f"the query vector has {len(query)} values, not {f.dim}")
    docs = index.docs if candidates is None else candidates
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vector.METRICS[f.metric](F.col(f"`{field_name}`"), q)
    return docs.where(F.col(f"`{field_name}`").isNotNull()).withColumn("__vec_score", d).orderBy("__vec_score", "doc_id").limit(k)


def search(index: Index, query: str | Query, *, params: Mapping[str, object] | None = None, fields: Sequence[str] | None = None, nocontent: bool = False, with_scores: bool = False, sort_by: str | None = None, ascending: bool = True, limit: tuple[int, int] | None = None, inkeys: Sequence[object] | DataFrame | None = None, geofilter: tuple[str, float, float, float, str] | None = None, highlight: Mapping[str, object] | None = None, summarize: Mapping[str, object] | None = None, **options: object) -> DataFrame:
    """The documents that match, in order: by score, by a field, or by id."""
    opts = Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})  # type: ignore[arg-type]
    parsed = parse_query(query, opts.stop(index)) if isinstance(query, str) else query
    params = params or {}
    comp = Compiler(index, opts, params)
    root = parsed.root if with_scores else simplify(parsed.root)
    score = comp.score(root) if with_scores and not parsed.knn else None  # before rows(), which reads all that is asked for
    docs = comp.rows(root)
    if parsed.knn:
        if parsed.knn.param not in params:
            raise QueryError(f"no parameter {parsed.knn.param!r}")
        rows = knn(index, parsed.knn.field, params[parsed.knn.param], parsed.knn.k, None if root.kind == "ALL" else docs)  # type: ignore[arg-type]
        order = [F.col("__vec_score"), F.col("doc_id")]
    else:
        rows, order = docs, [F.col("doc_id")]
        if with_scores:
            rows = rows.withColumn("__search_score", score)
            order = [F.desc("__search_score"), F.col("doc_id")]
        if geofilter:
            name, lon, lat, radius, unit = geofilter
            x, y = geo.point(F.col(f"`{index.spec.field(name, 'GEO').name}`"))
            rows = rows.where(F.coalesce(geo.within_radius(x, y, lon, lat, geo.metres(radius, unit)), F.lit(False)))
        if sort_by:
            c = F.col(f"`{index.spec.field(sort_by).name}`")
            c = F.coalesce(c, F.lit(0.0) if index.spec.field(sort_by).type == "NUMERIC" else F.lit(""))
            order = [c.asc() if ascending else c.desc(), F.col("doc_id")]
    if inkeys is not None:
        rows = rows.join(inkeys, "doc_id", "left_semi") if isinstance(inkeys, DataFrame) else rows.where(F.col("doc_id").isin(*inkeys))
    rows = rows.orderBy(*order)
    if limit:
        rows = rows.offset(limit[0]).limit(limit[1])
    extra = [c for c in ("__search_score", "__vec_score") if c in rows.columns]
    if nocontent:
        return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in extra])
    terms = sorted(set(plain_terms(parsed.root)))
    shown = [f.name for f in index.spec.fields] if fields is None else list(fields)
    cols = []
    for name in shown:
        if name not in rows.columns:
            cols.append(F.lit("").alias(name))
            continue
        c, kind = F.col(f"`{name}`"), index.spec.field(name).type if name != "doc_id" else "TAG"
        if kind == "TEXT":
            if summarize is not None and name in summarize.get("fields", shown):  # type: ignore[operator]
                c = present.summarize(c, terms, **{k: v for k, v in summarize.items() if k != "fields"})  # type: ignore[arg-type]
            if highlight is not None and name in highlight.get("fields", shown):  # type: ignore[operator]
                c = present.highlight(c, terms, *highlight.get("tags", ("<b>", "</b>")))  # type: ignore[misc]
        if kind in ("TEXT", "GEO", "GEOSHAPE", "TAG") and not isinstance(rows.schema[name].dataType, (T.ArrayType, T.NumericType)):
            c = F.coalesce(c, F.lit("")) if fields is not None else c
        cols.append(c.alias(name))
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in extra], *[c for c, n in zip(cols, shown) if n != "doc_id"])


def with_field(n: Node, **changes: object) -> Node:
    return replace(n, **changes)  # type: ignore[arg-type]


__all__ = ["Compiler", "Options", "SchemaError", "knn", "postings", "search", "vocabulary"]

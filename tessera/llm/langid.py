"""Operator 9: language identification with spans.

Each word's script (from code-point ranges) narrows the languages it may belong to. A
word's score for a trained language is the summed log probability of its letter trigrams,
word edges included, from a hashed table counted over a bounded sample of labelled
documents; a language known only by its script has a flat score a letter, with a bonus
for letters that tell it from its neighbours. One more state, ``und``, scores a flat value
between what a trained language expects of its own text and of noise. Viterbi over the
words of a document, with a penalty ``SWITCH`` for every change of state, labels the
spans. Documents are scored and decoded whole, many at a time with array operations.

The labelled sample is bounded by ``TRAIN_DOCS`` (a parameter); everything else covers all
rows. Without usable labels a small built-in text of seven languages is counted instead.

A document's language is the one that covers most of its letters. Rejected (keep false,
lang ``und``) are documents of whose letters ``und`` covers a share of ``REJECT`` or more, and
those without a letter: null and empty texts, numbers and punctuation only. Every row gives one row, repeated rows
and null ids included; offsets count code points, end exclusive. Ties go to the language
first in alphabetical order, ``und`` last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm._text import LETTER, LIMIT, Scan, chunks, slices

#: Labelled documents that the model is fitted on, at most (about).
TRAIN_DOCS = 3000
#: Cost, in nats, of a change of language between two words.
SWITCH = 15.0
BITS = 16
SMOOTH = 0.5
FOREIGN = -30.0
UND = "und"
#: Share of letters in no language from which on a document is rejected.
REJECT = 0.5
#: States times words that are decoded at a time, about.
CELLS_AT_ONCE = 1_500_000

SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFEFC)],
    "devanagari": [(0x900, 0x97F)], "thai": [(0xE00, 0xE7F)], "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)], "han": [(0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, LIMIT - 1)],
    "armenian": [(0x530, 0x58F)], "georgian": [(0x10A0, 0x10FF)],
}
#: Languages by script where no trained language uses it: (language, bonus a letter, telling letters).
BY_SCRIPT = {
    "greek": [("el", 0, "")], "cyrillic": [("ru", 0.1, "ыэъё"), ("uk", 0, "іїєґ")], "hebrew": [("he", 0, "")],
    "arabic": [("ar", 0.1, "ةىأإ"), ("fa", 0, "پچژگ")], "devanagari": [("hi", 0, "")], "thai": [("th", 0, "")],
    "hangul": [("ko", 0, "")], "kana": [("ja", 0, "")], "han": [("zh", 0.3, ""), ("ja", 0, "")],
    "armenian": [("hy", 0, "")], "georgian": [("ka", 0, "")],
}
SEEDS = {
    "en": "the of and to in is that it was for with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what about other into than its time only could these two may first then do any like my now over such our man me even most made after also did many",
    "fr": "le la les des de un une et est que qui dans pour pas sur avec ce cette il elle nous vous ils sont par plus mais ou où comme tout être avoir fait bien aussi leur leurs peut deux même sans entre après très depuis ainsi encore toujours autre avant était été ses son sa aux du au ne se si on mon",
    "de": "der die das und ist nicht ein eine einen zu mit von auf für dem den des im sich auch als an es er sie wir ihr ich wird werden war sind hat haben aber oder wenn nach bei aus durch über unter nur noch kann mehr sehr schon wie was wer diese dieser dieses zum zur vom bis dann weil zwischen gegen ohne",
    "es": "el la los las de del que y en un una es por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto antes algunos qué unos otro ser está años",
    "it": "il lo la gli le di che è e un una in per con non si da del della dei delle sono come più ma anche al alla nel nella questo questa suo sua loro ha hanno essere fatto dopo molto quando tutto tutti perché così ancora sempre prima senza dove ogni stato due già solo noi voi degli",
    "pt": "o a os as de do da dos das que e em um uma é por com para não se no na mais mas como ao seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog door over uit naar heeft hebben wordt worden was waren kan meer geen of zo wel dit deze die wat wie hun haar hij zij wij jullie onder tussen tegen zonder omdat veel alle andere moet zou",
}


def script_table() -> np.ndarray:
    t = np.zeros(LIMIT, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            t[a : b + 1] = i
    return t


def trigrams(scan: Scan) -> np.ndarray:
    """Bucket of the trigram around each code point; letters only, all else an edge."""
    c = np.where(scan.classes == LETTER, scan.lower, np.uint32(32))
    p = np.concatenate([c[:1] * 0 + np.uint32(32), c[:-1]])
    n = np.concatenate([c[1:], c[:1] * 0 + np.uint32(32)])
    h = (p * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77) + n * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    """Trained tables and the states: trained languages, those by script, then und."""

    langs: list[str]
    trained: int
    table: np.ndarray
    flat: float
    allowed: np.ndarray  # scripts x states
    bonus: dict[int, list[tuple[int, float, str]]] = field(default_factory=dict)

    @staticmethod
    def fit(texts: list[str], labels: list[str]) -> Model:
        if not (use := [(t, x) for t, x in zip(texts, labels) if t and x and x != UND]):
            use = [(t, x) for x, t in SEEDS.items()]
        langs = sorted({x for _, x in use})
        scripts, counts, seen = script_table(), np.zeros((len(langs), 1 << BITS)), np.zeros((len(langs), len(SCRIPTS) + 1))
        for k, lang in enumerate(langs):
            for _, part in chunks([t for t, x in use if x == lang]):
                scan = Scan(part)
                letters = scan.classes == LETTER
                counts[k] += np.bincount(trigrams(scan)[letters], minlength=1 << BITS)
                seen[k] += np.bincount(scripts[scan.cp[letters]], minlength=seen.shape[1])
        total = counts.sum(1, keepdims=True)
        logp = np.log((counts + SMOOTH) / (total + SMOOTH * (1 << BITS)))
        expected, floor = float((counts * logp).sum(1).mean() / max(total.mean(), 1)), float(logp.min(1).mean())
        home = seen.argmax(1)
        by_script = {s: v for i, (s, v) in enumerate(zip(SCRIPTS, [BY_SCRIPT.get(s, []) for s in SCRIPTS]), 1) if v and i not in home}
        more = sorted({x for v in by_script.values() for x, _, _ in v} - set(langs))
        states = [*langs, *more, UND]
        allowed = np.zeros((len(SCRIPTS) + 1, len(states)), bool)
        allowed[:, -1] = True
        for k, s in enumerate(home):
            allowed[s, k] = True
        bonus = {}
        for i, s in enumerate(SCRIPTS, 1):
            for x, plus, letters in by_script.get(s, []):
                allowed[i, states.index(x)] = True
                bonus.setdefault(i, []).append((states.index(x), plus, letters))
        return Model(states, len(langs), logp.T.astype(np.float32), expected + 0.45 * (floor - expected), allowed, bonus)

    def scores(self, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
        """(which tokens are words, words x states).

        Where no word is in a script that only ``bonus`` languages use, their states are
        left out: the columns are the trained languages and und."""
        words = np.flatnonzero(scan.kind == LETTER)
        s, e = scan.s[words], scan.e[words]
        script = SCRIPT[scan.cp[s]] if len(words) else np.zeros(0, np.uint8)
        wide = bool(self.bonus) and bool(np.isin(script, list(self.bonus)).any())
        out = np.zeros((len(words), len(self.langs) if wide else self.trained + 1), np.float32)
        if not len(words):
            return words, out
        n = (e - s).astype(np.float32)
        tri = trigrams(scan)
        rows = self.table[tri]
        rows[scan.classes != LETTER] = 0
        edges = np.stack([s, e], 1).ravel()  # sums from each start to its end; the gaps in between are left out
        out[:, : self.trained] = np.add.reduceat(np.concatenate([rows, rows[:1] * 0]), edges, axis=0)[::2]
        flat = np.float32(self.flat)
        for i, v in self.bonus.items() if wide else ():
            of = np.flatnonzero(script == i)
            if len(of):
                for k, plus, letters in v:
                    got = np.float32(0)
                    if letters:
                        hit = np.isin(scan.lower, np.array([ord(c) for c in letters], np.uint32))
                        sums = np.concatenate([[0], np.cumsum(hit)])
                        got = (6 * (sums[e[of]] - sums[s[of]])).astype(np.float32)
                    out[of, k] = n[of] * (flat + np.float32(1.5 + plus)) + got
        out[:, -1] = n * flat
        allowed = self.allowed if wide else self.allowed[:, [*range(self.trained), -1]]
        return words, np.where(allowed[script], out, n[:, None] * np.float32(FOREIGN))


SCRIPT = script_table()


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best state of each row; sizes: rows of each sequence, longest first."""
    n, k = scores.shape
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t
    back, best = np.zeros((n, k), np.int16), scores[starts[: active[0]]].astype(np.float64) if longest else None
    ids = np.arange(k, dtype=np.int16)
    for t in range(1, longest):
        m = active[t]
        v = best[:m]
        top = v.argmax(1)
        jump = v.max(1, keepdims=True) - penalty
        better = jump > v
        at = starts[:m] + t
        back[at] = np.where(better, top[:, None].astype(np.int16), ids)
        best[:m] = np.where(better, jump, v) + scores[at]
    out = np.zeros(n, np.int16)
    if not longest:
        return out
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        out[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return out


@dataclass
class Found:
    lang: list[str]
    share: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray


def identify(model: Model, texts: list[str]) -> Found:
    """Languages and spans of a batch of texts, in the order given."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    k = len(model.langs)
    letters = np.zeros((len(texts), k))
    spans: list[tuple[np.ndarray, ...]] = []
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    cells: dict[int, int] = {}

    def decode(width: int) -> None:
        doc, s, e, sc = (np.concatenate([h[j] for h in held[width]]) for j in range(4))
        held[width], cells[width] = [], 0
        if not len(doc):
            return
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        sizes = np.diff(np.concatenate([cuts, [len(doc)]]))
        by = np.argsort(-sizes, kind="stable")
        rows = np.repeat(cuts[by] - np.concatenate([[0], np.cumsum(sizes[by])[:-1]]), sizes[by]) + np.arange(len(doc))
        label = np.empty(len(doc), np.int16)
        best = viterbi(sc[rows], sizes[by])
        label[rows] = best if width == k else np.where(best == width - 1, np.int16(k - 1), best)
        np.add.at(letters, (doc, label), e - s)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        spans.append((doc[first], s[first], e[last], label[first]))

    for at, part in chunks([texts[i] for i in order]):
        scan = Scan(part)
        own, sc = model.scores(scan)
        doc = np.array(order[at : at + len(part)], np.int64)[scan.doc[own]]
        width = sc.shape[1]
        held.setdefault(width, []).append((doc, scan.start[own].astype(np.int32), scan.end[own].astype(np.int32), sc))
        cells[width] = cells.get(width, 0) + sc.size
        if cells[width] >= CELLS_AT_ONCE:
            decode(width)
    for width in [w for w, n in cells.items() if n]:
        decode(width)
    if spans:
        doc, s, e, label = (np.concatenate([x[j] for x in spans]) for j in range(4))
        by = np.lexsort((s, doc))
        doc, s, e, label = doc[by], s[by], e[by], label[by]
    else:
        doc = s = e = label = np.zeros(0, np.int64)
    total = letters.sum(1)
    none = letters[:, -1] >= REJECT * total  # true where there is no letter
    top = np.where(none, k - 1, letters[:, :-1].argmax(1))
    share = np.where(total > 0, letters[np.arange(len(texts)), top] / np.maximum(total, 1), 0.0)
    return Found([model.langs[x] for x in top], share, np.searchsorted(doc, np.arange(len(texts) + 1)), s, e, label)


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from about train_docs labelled rows, picked by a hash of their id."""
    if lang_col.lower() not in {c.lower() for c in docs.columns}:
        return Model.fit([], [])
    src = B.narrow(docs, id=id_col, text=text_col, lang=lang_col)
    have = src.where("lang is not null").count()
    share = int(1e6 * min(1.0, train_docs / max(have, 1)))
    picked = src.where(f"lang is not null and text is not null and pmod(xxhash64(id), 1000000) <= {share}").limit(2 * train_docs)
    rows = picked.select("text", F.col("lang").cast("string").alias("lang")).toPandas()
    return Model.fit(list(rows["text"]), list(rows["lang"]))


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, share, keep, spans) for each row of docs."""
    src = B.narrow(docs, id=id_col, text=text_col)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.langs)
        for b in slices(batches):
            f = identify(model, [t or "" for t in b.column(1).to_pylist()])
            parts = [pa.array(f.start.astype(np.int32)), pa.array(f.end.astype(np.int32)), names.take(pa.array(f.label.astype(np.int32)))]
            spans = pa.ListArray.from_arrays(pa.array(f.offsets.astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(kind)))
            keep = [x != UND for x in f.lang]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.lang), pa.array(f.share), pa.array(keep, pa.bool_()), spans], names=["doc_id", "lang", "share", "keep", "spans"])

    schema = f"doc_id {src.schema['id'].dataType.simpleString()}, lang string, share double, keep boolean, spans array<struct<start:int,end:int,lang:string>>"
    return src.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs in which a language was found, all columns as they were; no shuffle."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = identify(model, [t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([x != UND for x in f.lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and spans of the whole documents table."""
    docs = B.table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_model(docs))

"""Operator 10: substring dedup by hashing lines and the passages inside them.

A text is cut in lines, and a line in units: a unit ends at a sentence end or before a
capitalised word, so that a passage set into other text begins and ends with a unit. What
is hashed are windows of whole units of one line: from each unit on, and back from each
unit, the fewest units that have ``MIN_WORDS`` words together; and every line of
``MIN_LINE`` words at least as a whole. Normalised, a window is the sequence of its
lower-cased words and numbers; its digest has 96 bits. A run of more than 12 letters
counts as a word for each 12, for scripts without spaces. A line without words, but not
blank, is a window of its characters without white space.

With ``inside`` there are windows of a second kind, for passages that begin or end inside a
sentence or are wrapped at other places: sentences and line breaks don't count, and a unit
begins at each word whose hash is the least of any ``CUT`` words in a row, ties included.
From each unit on, the fewest that have ``MIN_WORDS`` words are a window. As the cuts follow
from the words alone and are at most ``CUT`` words apart, equal passages are cut alike; of
theirs up to ``CUT`` words at the front and ``CUT + MIN_WORDS`` at the back may stay.

Of all windows with one digest, over all documents, the earliest by (doc_id, offset)
stays; the text of the others is removed. A unit is only removed if it stands in a window
that occurs earlier, so the first occurrence of any unit always stays. What remains keeps
the offsets, in code points, that it had in the original text; a line that goes as a whole
takes its line break with it.

The windows are shuffled once, by digest, and numbered in each digest by a streamed sort. Of
windows that a batch of documents holds more than once, all but the earliest are marked
before that and spread over all tasks, so a line that a large part of the corpus shares
gathers once a batch and not once a document.

Defined results: one row for each id (of repeated rows the first by content); rows with a
null id keep their text and take no part; a null text stays null with no spans; a text of
which everything is removed is empty with no spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _base as B
from tessera.llm._text import U, Scan, chunks, mix

MIN_WORDS, MIN_LINE = 8, 1
WORD_LETTERS = 12
CUT = 16
R1, R2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def running_hash(code: np.ndarray, a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """Hash of code[a:b] for many ranges: a polynomial in r, by sums from the start."""
    n = len(code)
    up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, r, U)]))
    down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, pow(r, -1, 2**64), U)]))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(code * up[:n])])
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * U(0xA0761D6478BD642F))


def wordless(scan: Scan, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(index of the text, start, stop, h, g) of every line that has no word and isn't blank."""
    breaks = np.flatnonzero(scan.cp == 10)
    begins = np.concatenate([[0], breaks[:-1] + 1])
    bare = breaks > begins
    bare[np.searchsorted(breaks, scan.s)] = False
    s, e = begins[bare], breaks[bare]
    doc = np.searchsorted(scan.base, s, "right") - 1
    s, e = s - scan.base[doc], e - scan.base[doc]
    signs = ["".join(texts[d][a:b].split()) for d, a, b in zip(doc.tolist(), s.tolist(), e.tolist())]
    full = np.array([bool(x) for x in signs], bool)
    digests = b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=12).digest() for x in signs if x)
    both = np.frombuffer(digests, np.dtype([("h", "<i8"), ("g", "<i4")]))
    return doc[full], s[full], e[full], both["h"], both["g"]


def windows(texts: list[str], min_words: int = MIN_WORDS, min_line: int = MIN_LINE, inside: bool = False) -> tuple[np.ndarray, ...]:
    """(index of the text, start, stop, h, g) of every window of the texts."""
    scan = Scan(texts)
    return tuple(np.concatenate(x) for x in zip(worded(scan, min_words, min_line, inside), wordless(scan, texts)))


def spans_of(first: np.ndarray, group: np.ndarray, words: np.ndarray, min_words: int, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first token, the one after the last) of the fewest units that have min_words words,
    from each unit on and, if both, back from each, in one group; words: before each token."""
    last = np.concatenate([first[1:], [len(words) - 1]])
    at, upto, own = words[first], words[last], group[first]
    k = np.arange(len(first))
    to = np.searchsorted(upto, at + min_words, "left")  # windows from k to to[k]
    ok = to < len(first)
    ok[ok] = own[to[ok]] == own[ok]
    if not both:
        return first[ok], last[to[ok]]
    frm = np.searchsorted(at, upto - min_words, "right") - 1  # windows from frm[k] to k
    back = frm >= 0
    back[back] = own[frm[back]] == own[back]
    return np.concatenate([first[k[ok]], first[frm[back]]]), np.concatenate([last[to[ok]], last[k[back]]])


def least(code: np.ndarray, doc: np.ndarray, w: int = CUT) -> np.ndarray:
    """Tokens whose hash is the least of w tokens in a row of their document."""
    n, view = len(code), np.lib.stride_tricks.sliding_window_view
    if n < w:
        return np.zeros(n, bool)
    v = mix(code) | U(1)
    low = np.where(doc[w - 1 :] == doc[: n - w + 1], view(v, w).min(1), U(0))
    edge = np.zeros(w - 1, U)
    return view(np.concatenate([edge, low, edge]), w).max(1) == v


def worded(scan: Scan, min_words: int, min_line: int, inside: bool) -> tuple[np.ndarray, ...]:
    """The windows that have words."""
    n = len(scan.s)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.int32)
    breaks = np.flatnonzero(scan.cp == 10)
    line = np.searchsorted(breaks, scan.s)
    opens = np.concatenate([[True], line[1:] != line[:-1]])
    first = np.flatnonzero(opens | scan.after_stop() | scan.capitalised())  # first token of each unit
    words = np.concatenate([[0], np.cumsum(-(-(scan.e - scan.s) // WORD_LETTERS))])
    code = scan.codes()
    line_first = np.flatnonzero(opens)
    line_last = np.concatenate([line_first[1:], [n]])
    whole = words[line_last] - words[line_first] >= min_line
    found = [spans_of(first, line, words, min_words), (line_first[whole], line_last[whole])]
    if inside:
        cut = np.concatenate([[True], scan.doc[1:] != scan.doc[:-1]])
        found.append(spans_of(np.flatnonzero(cut | least(code, scan.doc)), scan.doc, words, min_words, both=False))
    pairs = np.unique(np.concatenate([x * (n + 1) + y for x, y in found]))
    a, b = pairs // (n + 1), pairs % (n + 1)
    h = running_hash(code, a, b, R1).view(np.int64)
    g = (running_hash(code, a, b, R2) >> U(32)).astype(np.uint32).view(np.int32)
    starts = np.where(opens[a], np.concatenate([[0], breaks + 1])[line[a]], scan.s[a])
    after = np.minimum(b, n - 1)
    ends = np.where((b < n) & (line[after] == line[b - 1]), scan.s[after], breaks[line[b - 1]])
    doc = scan.doc[a]
    return doc, starts - scan.base[doc], ends - scan.base[doc], h, g


def rebuild(text: str, cuts: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the ranges, which may overlap, and the spans that stay."""
    spans, at = [], 0
    merged: list[list[int]] = []
    for s, e in sorted(cuts):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            if merged and text[merged[-1][1] : s] == "\n" and (merged[-1][0] == 0 or text[merged[-1][0] - 1] == "\n"):
                merged[-1][1] = e  # a whole line and more after it
                continue
            merged.append([s, e])
    for s, e in merged:
        if (s == 0 or text[s - 1] == "\n") and text[e : e + 1] == "\n":
            e += 1
        elif e == len(text) and s > at and text[s - 1] == "\n":
            s -= 1
        if s > at:
            spans.append((at, s))
        at = e
    if at < len(text):
        spans.append((at, len(text)))
    return "".join(text[s:e] for s, e in spans), spans


def all_windows(docs: DataFrame, min_words: int, min_line: int, inside: bool) -> DataFrame:
    """(id, s, e, h, g, late) of every window of docs (id, text).

    late: the same batch holds an earlier one; h is then a number of no meaning."""
    src = docs.where("id is not null and text is not null").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for at, part in chunks(b.column(1).to_pylist()):
                doc, *rest = windows(part, min_words, min_line, inside)
                found.append((doc + at, *rest))
            if not found:
                continue
            doc, s, e, h, g = (np.concatenate([f[i] for f in found]) for i in range(5))
            rank = np.asarray(pc.rank(b.column(0), tiebreaker="dense"))[doc]
            by = np.lexsort((s, rank, g, h))
            late = np.zeros(len(doc), bool)
            late[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (g[by[1:]] == g[by[:-1]])
            h = np.where(late, mix(h.view(U) + np.arange(len(h), dtype=U) * U(R1)).view(np.int64), h)
            cols = [b.column(0).take(pa.array(doc)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(h), pa.array(g), pa.array(late)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "s", "e", "h", "g", "late"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, s int, e int, h bigint, g int, late boolean")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, min_line: int = MIN_LINE, inside: bool = False) -> DataFrame:
    """(id, s, e) of every window of docs (id, text) that is not the earliest of its digest."""
    w = Window.partitionBy("h", "g").orderBy("id", "s")
    placed = all_windows(docs, min_words, min_line, inside).withColumn("nth", F.row_number().over(w))
    return placed.where("late or nth > 1").select("id", "s", "e")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line: int = MIN_LINE, inside: bool = False) -> DataFrame:
    """(doc_id, text, spans): every document without what occurs earlier."""
    src = B.one_row_per_id(B.narrow(docs, id=id_col, text=text_col), "id")
    gone = repeated(src, min_words, min_line, inside).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("gone")).withColumnRenamed("id", "of")
    both = src.join(gone, src["id"] == gone["of"], "left").select("id", "text", F.col("gone.s").alias("starts"), F.col("gone.e").alias("ends"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for text, s, e in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                t, kept = (text, []) if not text else (text, [(0, len(text))]) if not s else rebuild(text, list(zip(s, e)))
                texts.append(t)
                spans.append([{"start": x, "stop": y} for x, y in kept])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, span)], names=["doc_id", "text", "spans"])

    return both.mapInArrow(run, f"doc_id {src.schema['id'].dataType.simpleString()}, text string, spans array<struct<start:int,stop:int>>")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table without repeated passages; kept: spans as 'start-stop,..'."""
    done = dedup_lines(B.table(spark, sf_dir, "documents"), inside=True)
    kept = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")
    return done.select("doc_id", "text", kept.alias("kept"))

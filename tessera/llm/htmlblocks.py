"""Operator 7: text of HTML pages by a recurrent block labeller.

A page is read into its sequence of leaf blocks: runs of text between block-level tags, with
the path of all open tags (and their class and id words). Each leaf becomes a vector of hashed
path parts, the nearer ones with more weight, hashed words and a few counts. A bidirectional
LSTM, in numpy, reads the whole sequence both ways, so that every block is labelled with the
document around it in view: content, heading or boilerplate. Pages are run many at a time, one
step of the sequence for all of them, shorter ones dropping out as they end.

Reading takes time in proportion to the page, however broken it is: quoted attributes may hold
any sign, a tag without an end is text, an element that may not hold the next one is closed by
it, and a closing tag closes the nearest open element of its name or nothing.

The model is trained here, by back-propagation through time, on ``PAGES`` labelled pages
that ``labelled_pages`` makes (the bound of the training sample): nested layouts, menus,
advertisements, footers and broken mark-up around articles.

Defined results: one row for each row of pages; a null or empty page, or one without text,
has no blocks and an empty text; offsets are code points of the source, from the first to
the last character of the block's text; scripts, styles and comments are no blocks; of labels
with equal scores the first of ``LABELS`` is taken.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _base as B
from tessera.llm._text import chunks

LABELS = ("boilerplate", "content", "heading")
PAGES, EPOCHS, HIDDEN = 400, 8, 24
PATH_DIM, WORD_DIM, EXTRA = 48, 24, 8
DIM = PATH_DIM + WORD_DIM + EXTRA
#: Weight of an open tag against the one inside it.
FADE = 0.75
#: Characters of the pages that are labelled together, about.
CHARS_AT_ONCE = 4_000_000
WORD = re.compile(r"\w+")
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that may be left open, and the tags that close them: by default only their own.
ENDS = {"p": frozenset("p address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())}
ENDS |= {t: frozenset((t,)) for t in ("li", "tr", "option")} | {t: frozenset(("dt", "dd")) for t in ("dt", "dd")} | {t: frozenset(("td", "th", "tr")) for t in ("td", "th")}
RAW = frozenset("script style noscript template svg".split())
NAME = re.compile(r"/?[a-zA-Z][\w:-]*")
VALUE = re.compile(r"[>\"']")


class Tags:
    """Reads a page tag by tag; what isn't there any more is not looked for again."""

    def __init__(self, page: str):
        self.page, self.gone, self.quotes = page, set(), True

    def find(self, what: str, at: int) -> int:
        """The place of what from at on, or -1."""
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at at, or -1."""
        k = at
        while self.quotes:
            m = VALUE.search(self.page, k)
            if not m:
                break
            if m.group() == ">":
                return m.start()
            k = m.end()
            before = m.start() - 1
            while before > at and self.page[before].isspace():
                before -= 1
            if self.page[before] == "=":
                close = self.find(m.group(), k)
                k = k if close < 0 else close + 1
        self.quotes = False  # every > from here on stands between quotes
        return self.find(">", at)

    def raw(self, name: str, at: int) -> int:
        """Where the text of a script or the like ends: after its closing tag, or at the end."""
        key = "</" + name
        if key in self.gone:
            return len(self.page)
        m = re.compile(key + r"\b[^>]*>", re.I).search(self.page, at)
        if not m:
            self.gone.add(key)
            return len(self.page)
        return m.end()

    def __iter__(self) -> Iterator[tuple[int, int, str, str]]:
        """(start, stop, tag or "", attributes): tags, closing ones with a slash, and text."""
        page, at, n = self.page, 0, len(self.page)
        text = 0
        while at < n:
            lt = self.find("<", at)
            if lt < 0:
                break
            stop, tag, rest = lt + 1, "", ""
            if page.startswith("<!--", lt):
                stop = self.find("-->", lt + 4)
                stop = n if stop < 0 else stop + 3
                tag = "!"
            elif page.startswith(("<!", "<?"), lt):
                if (stop := self.find(">", lt)) < 0:
                    break
                stop, tag = stop + 1, "!"
            elif m := NAME.match(page, lt + 1):
                if (k := self.end(m.end())) >= 0:
                    stop, tag, rest = k + 1, m.group().lower(), page[m.end() : k]
                    if tag in RAW and not rest.endswith("/"):
                        stop, tag = self.raw(tag, stop), "!"
            if tag:
                if lt > text:
                    yield text, lt, "", ""
                yield lt, stop, tag, rest
                text = stop
            at = stop
        if text < n:
            yield text, n, "", ""


class Open:
    """The open elements; finding, closing and hashing them takes constant time on the whole."""

    def __init__(self) -> None:
        self.stack: list[list] = []  # tag, names, path vector or None
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, names: list[str]) -> None:
        if self.blocks and tag in ENDS.get(self.stack[self.blocks[-1]][0], ()):
            self.cut(self.blocks[-1])
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append([tag, names, None])

    def cut(self, to: int) -> None:
        for tag, _, _ in self.stack[to:]:
            self.at[tag].pop()
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
        del self.stack[to:]

    def close(self, tag: str) -> None:
        if self.at.get(tag):
            self.cut(self.at[tag][-1])

    def path(self) -> np.ndarray:
        """Hashed parts of the whole path."""
        if not self.stack:
            return np.zeros(PATH_DIM, np.float32)
        k = len(self.stack) - 1
        while k > 0 and self.stack[k - 1][2] is None:
            k -= 1
        for i in range(k, len(self.stack)):
            tag, names, have = self.stack[i]
            if have is None:
                v = self.stack[i - 1][2] * np.float32(FADE) if i else np.zeros(PATH_DIM, np.float32)
                for x in (tag, *names):
                    v[bucket(x, PATH_DIM)] += 1
                self.stack[i][2] = v
        v = self.stack[-1][2].copy()
        v[bucket("/" + self.stack[-1][0], PATH_DIM)] += 1
        return v


@dataclass
class Leaf:
    path: np.ndarray
    text: str
    start: int
    stop: int
    links: int
    last_link: bool


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page, in order."""
    out: list[Leaf] = []
    opened = Open()
    parts: list[str] = []
    start = stop = links = 0
    path = opened.path()
    in_link = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(path, text, start, stop, links, bool(in_link)))
        parts, links = [], 0

    for begin, end, tag, rest in Tags(page):
        if tag == "!":
            continue
        if not tag:
            t = page[begin:end]
            blank = t.isspace()
            if blank and not parts:
                continue
            if not parts:
                start = begin + len(t) - len(t.lstrip())
                path = opened.path()
            parts.append(t)
            if not blank:
                stop = begin + len(t.rstrip())
            if in_link:
                links += len(t)
            continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag not in INLINE:
            flush()
            if tag == "br":
                continue
        if tag == "a":
            in_link = max(0, in_link - 1) if closing else in_link + 1
        if closing:
            opened.close(tag)
        elif tag not in VOID and not rest.endswith("/"):
            names = [] if tag == "a" else [x for g in NAMED.findall(rest) for x in WORD.findall(" ".join(g).lower())]
            opened.push(tag, names)
    flush()
    return out


@lru_cache(65536)
def bucket(word: str, dim: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dim


def vectors(blocks: list[Leaf]) -> np.ndarray:
    """One row for each block: hashed path, hashed words, counts."""
    x = np.zeros((len(blocks), DIM), np.float32)
    for i, b in enumerate(blocks):
        row = x[i]
        row[:PATH_DIM] = b.path
        words = b.text.lower().split()
        w = PATH_DIM + np.fromiter((bucket(t, WORD_DIM) for t in words), np.int64, len(words))
        np.add.at(row, w, 1.0 / len(words))
        n = len(b.text)
        row[PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 6, np.log1p(len(words)) / 4, min(1.0, b.links / n), float(b.last_link),
            (b.text.count(".") + b.text.count(",")) / len(words), float(b.text[-1] in ".!?:"), i / max(len(blocks) - 1, 1), float(any(c in b.text for c in "©|»›")),
        )
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output layer; p holds all parameters."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = (r.normal(0, 0.15, (DIM, 4 * HIDDEN))).astype(np.float32)
            self.p["h" + d] = (r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["c" + d] = bias
        self.p["o"] = (r.normal(0, 0.2, (2 * HIDDEN + DIM, len(LABELS)))).astype(np.float32)
        self.p["e"] = np.zeros(len(LABELS), np.float32)

    def direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of x (time x pages x DIM); masked steps leave the state alone."""
        t_max, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((t_max, n, HIDDEN), np.float32), []
        pre = x @ self.p["x" + d] + self.p["c" + d]
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + d]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, th, m))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, tf = self.direction(x, mask, "f", keep)
        hb, tb = self.direction(x, mask, "b", keep)
        both = np.concatenate([hf, hb, x], 2)
        return both @ self.p["o"] + self.p["e"], (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, gradient of each parameter)."""
        z, (both, tf, tb) = self.logits(x, mask, True)
        z = z - z.max(2, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(2, keepdims=True)
        total = mask.sum()
        t, n = y.shape
        loss = -float((np.log(prob[np.arange(t)[:, None], np.arange(n), y] + 1e-9) * mask).sum() / total)
        dz = prob
        dz[np.arange(t)[:, None], np.arange(n), y] -= 1
        dz *= (mask / total)[:, :, None]
        g = {"o": np.einsum("tnd,tnk->dk", both, dz), "e": dz.sum((0, 1))}
        dboth = dz @ self.p["o"].T
        for d, tape, part in (("f", tf, dboth[:, :, :HIDDEN]), ("b", tb, dboth[:, :, HIDDEN : 2 * HIDDEN])):
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            wh, dpre, gh = self.p["h" + d], np.zeros((t, n, 4 * HIDDEN), np.float32), np.zeros_like(self.p["h" + d])
            for step, h, c, i, f, o, gg, th, m in reversed(tape):
                dh = dh + part[step]
                dnew = m * (dh * o * (1 - th * th)) + m * dc
                pre = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - gg * gg)], 1)
                dpre[step] = pre
                gh += h.T @ pre
                dh, dc = pre @ wh.T + (1 - m) * dh, dnew * f + (1 - m) * dc
            g["h" + d], g["x" + d], g["c" + d] = gh, np.einsum("tnd,tnk->dk", x, dpre), dpre.sum((0, 1))
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 20, rate: float = 0.01, seed: int = 7) -> Labeller:
        r = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][1]) // 4, r.random()))
            runs = [order[i : i + batch] for i in range(0, len(order), batch)]
            r.shuffle(runs)
            for run in runs:
                x, mask = pad([pages[i][0] for i in run])
                y = np.zeros(mask.shape, np.int64)
                for j, i in enumerate(run):
                    y[: len(pages[i][1]), j] = pages[i][1]
                _, g = self.gradients(x, mask, y)
                step += 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The label of every block of every page."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):  # pages of like length together, bounded in cells
            stop = at + 1
            while stop < len(order) and stop - at < 256 and (stop + 1 - at) * len(pages[order[stop]]) <= 20_000:
                stop += 1
            x, mask = pad([pages[i] for i in order[at:stop]])
            best = self.logits(x, mask)[0].argmax(2)
            for j, i in enumerate(order[at:stop]):
                out[i] = best[: len(pages[i]), j]
            at = stop
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), DIM), np.float32), np.zeros((t, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def labelled_pages(n: int = PAGES, seed: int = 7) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(page, (start of the text, label) of its blocks): invented pages with known labels."""
    r = random.Random(seed)
    syllables = "the an er on in re ti ed or es st nt ea ou ha le de que un ver sch lich ung tion ment ado las ci é ü ñ".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + r.choice(".....,!?") + r.choice(("", "", "", "%%%", "***"))
    for _ in range(n):
        truth: list[tuple[str, int]] = []

        def mark(text: str, label: int) -> str:
            truth.append((text.split()[0] if text.split() else "", label))
            return text

        def menu() -> str:
            items = "".join(f'<li><a href="/{word()}">{mark(words(1, 3), 0)}</a></li>' for _ in range(r.randint(2, 8)))
            return r.choice(("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<header><ul class="nav">{}</ul></header>', '<ul id="sidebar">{}</ul>')).format(items)

        def advert() -> str:
            return r.choice(('<div class="ad">{}</div>', '<aside>{}</aside>', '<div class="banner promo">{}</div>', '<div class="cookie-notice">{}</div>', '<div id="newsletter">{}</div>', '<div class="related">{}</div>')).format(mark(" ".join(sentence() for _ in range(r.randint(1, 3))), 0))

        def paragraph() -> str:
            text = mark(" ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5)))), 1)
            return r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", r.choice(("<p><b>{}", "<p><i>{}<br>", "<p><em>{}</em><br/>", "<p><span>{}", "<p><strong>{}<br>", "<p title='a > b'>{}")), "<div>{}</div>", "<blockquote>{}</blockquote>", "<li>{}</li>", "<td>{}</td>", "<pre>{}</pre>")).format(text)

        title = words(2, 8) + r.choice(("", "."))
        style = f"<style>.{word()} {{ {word()}: {r.randint(0, 99)}px }}</style>" if r.random() < 0.5 else ""
        script = f"<script>{word()}('<{word()}>', {r.randint(0, 9)} > {r.randint(0, 9)})</script>" if r.random() < 0.6 else ""
        meta = f"<meta name={word()} content='{words(1, 4)}'>" if r.random() < 0.5 else ""
        head = f"{r.choice(('<!DOCTYPE html>', ''))}<html lang=\"{word()[:2]}\"><head>{meta}<title>{mark(title, 0)}</title>{style}{script}</head><body>"
        body = []
        if r.random() < 0.9:
            body.append(menu())
        if r.random() < 0.15:
            body.append(f"<header><p>{mark(words(1, 5), 0)}</p></header>")
        for _ in range(r.choice((0, 1, 1, 1, 2))):
            body.append(r.choice((f"<!-- {words(1, 3)} -->", "")) + advert())
        opening = r.choice(("<article>", "<article>", "<main>", '<div class="content">', '<div id="post"><div class="entry">', "<section>", "<body>"))
        inner = []
        if r.random() < 0.92:
            inner.append(f"<h1>{mark(title if r.random() < 0.6 else words(2, 9), 2)}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 14, 25))):
            if r.random() < 0.1:
                inner.append("<h{0}>{1}</h{0}>".format(r.randint(2, 4), mark(words(1, 6), 2)))
            if r.random() < 0.05:
                inner.append(advert())
            inner.append(paragraph())
        closing = {"<article>": "</article>", "<main>": "</main>", "<section>": "</section>"}.get(opening, "" if opening == "<body>" else "</div>")
        body.append(opening + "".join(inner) + closing)
        if r.random() < 0.3:
            body.append(advert())
        if r.random() < 0.25:
            body.append(menu())
        if r.random() < 0.9:
            foot = mark(r.choice(("&copy; ", "© ", "")) + words(1, 3) + r.choice((".example.com &middot; ", " | ", " ")) + words(0, 4), 0)
            body.append(r.choice(("<footer>{}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>")).format(foot))
        yield head + "".join(body) + "</body></html>", truth


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of invented pages whose blocks are all found again."""
    out = []
    for page, truth in labelled_pages(n, seed):
        found = leaves(page)
        if len(found) == len(truth):
            out.append((vectors(found), np.array([y for _, y in truth])))
    return out


@lru_cache(1)
def default_labeller() -> Labeller:
    return Labeller().fit(examples(PAGES, 7))


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, blocks) of every page; text: headings and content, a line each."""
    src = B.narrow(pages, id=id_col, html=html_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in chunks([t or "" for t in b.column(1).to_pylist()], CHARS_AT_ONCE):
                found = [leaves(t) for t in part]
                labels = model.label([vectors(f) for f in found])
                text = ["\n".join(x.text for x, y in zip(f, ys) if y) for f, ys in zip(found, labels)]
                blocks = [[{"start": x.start, "stop": x.stop, "label": LABELS[y]} for x, y in zip(f, ys)] for f, ys in zip(found, labels)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(text, pa.string()), pa.array(blocks, kind)], names=["page_id", "text", "blocks"])

    return src.mapInArrow(run, f"page_id {src.schema['id'].dataType.simpleString()}, text string, blocks array<struct<start:int,stop:int,label:string>>")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and labelled blocks of the whole pages table."""
    return extract(B.table(spark, sf_dir, "pages"), default_labeller())

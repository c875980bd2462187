"""Vectorised reading of texts: a batch of strings becomes one array of code points,
and words, numbers and sentence ends are found for all of them with array operations."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LIMIT = 0x30000
OTHER, LETTER, DIGIT, STOP = 0, 1, 2, 3
CHUNK = 200_000
U = np.uint64


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, lower case of the same length, is upper case."""
    kind, low, upper = np.zeros(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.uint32), np.zeros(LIMIT, bool)
    for i in range(LIMIT):
        c = chr(i)
        if c.isalpha():
            kind[i] = LETTER
            if (x := c.lower()) != c:
                upper[i] = True
                if len(x) == 1:
                    low[i] = ord(x)
        elif c.isdigit():
            kind[i] = DIGIT
        elif 0x300 <= i < 0x370 or 0x900 <= i < 0xE00 or 0xE30 <= i < 0xE50:
            kind[i] = LETTER  # combining marks and vowel signs belong to their word
    for c in ".!?:;\n\r…。！？":
        kind[ord(c)] = STOP
    return kind, low, upper


@lru_cache(1)
def powers() -> np.ndarray:
    p = np.empty(4096, U)
    p[0] = 1
    for i in range(1, len(p)):
        p[i] = (int(p[i - 1]) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    return p


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Scan:
    """Words and numbers of several texts: parallel arrays over all of them.

    doc: index of the text, start and end: offsets in that text, code: hash of the
    lower-cased word, kind: LETTER or DIGIT. Offsets count code points."""

    def __init__(self, texts: list[str], digits_join: bool = False):
        kinds, low, upper = tables()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        raw = "\n".join(texts) + "\n"
        cp = np.minimum(np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32), LIMIT - 1)
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.cp, self.lower = cp, low[cp]
        k = kinds[cp]
        if digits_join:  # 1,234.5 is one number
            d = k == DIGIT
            dot = np.zeros(len(k), bool)
            dot[1:-1] = d[:-2] & d[2:] & ((cp[1:-1] == 46) | (cp[1:-1] == 44))
            k = np.where(dot, np.uint8(DIGIT), k)
        self.classes = k
        tok = (k == LETTER) | (k == DIGIT)
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = np.concatenate([[0], change, [len(k)]])
        if len(edges) > 1 and len(k):
            s, e = edges[:-1], edges[1:]
            use = tok[s]
            s, e = s[use], e[use]
        else:
            s = e = np.zeros(0, np.int64)
        self.s, self.e = s, e
        self.doc = np.searchsorted(self.base, s, "right") - 1
        self.kind = k[s] if len(s) else np.zeros(0, np.uint8)
        self.upper = upper

    @property
    def start(self) -> np.ndarray:
        return self.s - self.base[self.doc]

    @property
    def end(self) -> np.ndarray:
        return self.e - self.base[self.doc]

    def codes(self) -> np.ndarray:
        """64-bit hash of each lower-cased token."""
        if not len(self.s):
            return np.zeros(0, U)
        n = self.e - self.s
        inside = np.repeat(self.s - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        flat = np.arange(n.sum()) + inside
        pos = flat - np.repeat(self.s, n)
        v = (self.lower[flat].astype(U) + U(1)) * powers()[pos & 4095]
        return mix(np.add.reduceat(v, np.concatenate([[0], np.cumsum(n)[:-1]])) + n.astype(U))

    def capitalised(self) -> np.ndarray:
        """First letter upper case, the second, if any, not."""
        if not len(self.s):
            return np.zeros(0, bool)
        nxt = np.minimum(self.s + 1, len(self.cp) - 1)
        return self.upper[self.cp[self.s]] & ~(self.upper[self.cp[nxt]] & (self.e - self.s > 1))

    def after_stop(self) -> np.ndarray:
        """The token opens its text or follows a sentence end."""
        if not len(self.s):
            return np.zeros(0, bool)
        stops = np.cumsum(self.classes == STOP)
        prev = np.concatenate([[0], self.e[:-1]])
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        return first | (stops[self.s] > stops[np.maximum(prev - 1, 0)])


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches in parts of at most that many rows, so that few texts are held twice."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def release() -> None:
    """Gives memory that was freed back to the machine: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another allocator than glibc's


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about size characters; texts stay whole."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]

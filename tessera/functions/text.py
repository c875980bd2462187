"""Tokens, stop words, stems and sound codes of text columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STOPPED = (
    "with|was|will|to|this|they|these|there|then|their|the|that|such|or|on|of|not|no|"
    "it|is|into|in|if|for|by|but|be|at|as|are|and|an|a"
)
STOP_WORDS = frozenset(_STOPPED.split("|"))
ASCII_RUN = re.compile(r"[A-Za-z0-9]+")


def words(text: str, stop: Iterable[str] | None = None) -> list[str]:
    """Lower-cased ASCII letter and digit runs; those in stop are left out."""
    stop = frozenset(stop or ())
    return [t for t in (m.lower() for m in ASCII_RUN.findall(text)) if t not in stop]


def runs(col: Column) -> Column:
    """ASCII letter and digit runs as written."""
    return F.regexp_extract_all(col, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def tokens(col: Column) -> Column:
    """Lower-cased runs; extraction comes first so that case folding adds no ASCII letter."""
    return F.transform(runs(col), F.lower)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def phrase_at(toks: Column, terms: list[str]) -> Column:
    """Whether the terms stand next to each other, in order."""
    n, want = len(terms), F.array(*map(F.lit, terms))

    def found(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when(x == terms[0], i + 1).otherwise(F.lit(0))), lambda i: i > 0)
        return F.exists(starts, lambda i: F.slice(t, i, n) == want)

    return let(toks, found)


def places(tk: Column, t: str) -> Column:
    """Where a term stands among tokens."""
    return F.filter(F.transform(tk, lambda x, i: F.when(x == t, i).otherwise(F.lit(-1))), lambda i: i >= 0)


def phrase_places(at: Callable[[str], Column], terms: list[str]) -> Column:
    """Whether the terms stand next to each other, in order; at gives the places of a term."""

    def follows(p: Column) -> Column:
        out = F.lit(True)
        for k, t in enumerate(terms[1:], 1):
            out = out & F.array_contains(at(t), p + k)
        return out

    return F.exists(at(terms[0]), follows)


def phrase_near(at: Callable[[str], Column], terms: list[str], slop: int, in_order: bool) -> Column:
    """Whether a chain of the terms exists from some place of the first one; at gives the
    places of a term.

    The chain is greedy: each term takes its earliest place that is near enough to the one
    before; forward only if the order counts (or slop is 0), else either way."""

    def near(prev: Column, p: Column) -> Column:
        if in_order or slop == 0:
            return (p > prev) & (p - prev - 1 <= slop)
        return (p != prev) & (F.abs(p - prev) - 1 <= slop)

    def step(ends: Column, left: list[str]) -> Column:
        if not left:
            return F.size(ends) > 0

        def on(there: Column) -> Column:
            nxt = F.transform(ends, lambda prev: F.coalesce(F.array_min(F.filter(there, partial(near, prev))), F.lit(-1)))
            return let(F.filter(nxt, lambda p: p >= 0), lambda e: step(e, left[1:]))

        return let(at(left[0]), on)

    return let(at(terms[0]), lambda ends: step(ends, terms[1:]))


_ODD = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_FIXED = frozenset("sky news howe atlas cosmos bias andes".split())
_HELD = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_VOWELS = frozenset("aeiou")
#: By the last letter but one: endings and what replaces them where the first region allows.
_SECOND = {
    "a": (("ational", "ate"), ("tional", "tion")),
    "c": (("enci", "ence"), ("anci", "ance")),
    "e": (("izer", "ize"),),
    "g": (("ogi", "og"),),
    "l": (("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous")),
    "o": (("ization", "ize"), ("ation", "ate"), ("ator", "ate")),
    "s": (("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous")),
    "t": (("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")),
    "u": (("fulli", "ful"),),
    "i": (("li", ""),),
}
_FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS or w[i] == "y"


def _region(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if _vowel(w, i - 1) and not _vowel(w, i):
            return i + 1
    return len(w)


def _short_syllable(w: str, i: int) -> bool:
    if i == 0:
        return bool(w) and w[0] in _VOWELS and (len(w) == 1 or w[1] not in _VOWELS)
    if i < 0 or i + 1 >= len(w):
        return False
    return w[i - 1] not in _VOWELS and _vowel(w, i) and w[i + 1] not in _VOWELS and w[i + 1] not in "wxY"


def _swap(w: str, pairs: Iterable[tuple[str, str]], region: int) -> tuple[str, bool]:
    """The first ending that fits, replaced if it lies in the region; whether one fitted."""
    for old, new in pairs:
        if w.endswith(old):
            return (w[: -len(old)] + new if len(w) - len(old) >= region else w), True
    return w, False


def stem(word: str) -> str:
    """English stem, Porter's second algorithm as the engine's semantics have it."""
    if len(word) <= 2:
        return word
    if word in _ODD:
        return _ODD[word]
    if word in _FIXED:
        return word
    w = word[1:] if word[0] == "'" else word
    if not w:
        return word
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1 = _region(w, 0)
    r2 = _region(w, r1)
    if w.startswith(("gener", "arsen")):
        r1 = max(r1, 5)
    elif w.startswith("commun"):
        r1 = max(r1, 6)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if not w:
        return word
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w[-1] == "s" and len(w) > 2 and any(_vowel(w, i) for i in range(len(w) - 2)):
        w = w[:-1]
    if w in _HELD:
        return w
    # past and continuous forms
    if w.endswith("eedly"):
        w = w[:-3] if len(w) - 5 >= r1 else w
    elif w.endswith("eed"):
        w = w[:-1] if len(w) - 3 >= r1 else w
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), "")
        base = w[: len(w) - len(end)]
        if end and any(_vowel(base, i) for i in range(len(base))):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) >= 2 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                w = w[:-1]
            elif r1 >= len(w) and (len(w) < 2 or _short_syllable(w, len(w) - 2)):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    if len(w) >= 2:
        w, _ = _swap(w, _SECOND.get(w[-2], ()), r1)
    # third step: the first of these that fits ends it
    if w.endswith("ational") and len(w) - 7 >= r1:
        w = w[:-7] + "ate"
    else:
        w, done = _swap(w, (("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic")), r1)
        if not done:
            for end, cut, region in (("ical", 2, r1), ("ful", 3, r1), ("ness", 4, r1), ("ative", 5, r2)):
                if w.endswith(end) and len(w) - len(end) >= region:
                    w = w[:-cut]
                    break
    if len(w) >= 2:
        for end in _FOURTH:
            if w.endswith(end) and len(w) - len(end) >= r2:
                w = w[: -len(end)]
                break
        else:
            if w.endswith("ion") and len(w) >= 4 and len(w) - 3 >= r2 and w[-4] in "st":
                w = w[:-3]
    if w and w[-1] == "e" and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w, len(w) - 3))):
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_udf(s: pd.Series) -> pd.Series:
    """Stems, for vocabularies rather than running text."""
    return s.map(stem, na_action="ignore")


#: Letters that give one code, and the letters that they swallow when doubled.
_PLAIN = {"B": "P", "F": "F", "J": "J", "K": "K", "L": "L", "M": "M", "N": "N", "Q": "K", "R": "R", "V": "F", "Z": "S"}


def sound(word: str) -> tuple[str, str]:
    """Primary and secondary sound code of at most four letters."""
    w = word.upper()
    if not w:
        return "", ""
    n, i, a, b = len(w), 0, "", ""
    at = lambda k: w[k] if 0 <= k < n else ""
    if w[:2] in ("GN", "KN", "PN", "AE", "WR"):
        i = 1
    if w[0] == "X":
        a, b, i = "S", "S", 1
    while i < n and (len(a) < 4 or len(b) < 4):
        c, nxt = w[i], at(i + 1)
        one, two, step = "", None, 1
        soft = lambda x: x != "" and x in "IEY"
        if c in "AEIOU":
            one = "A" if i == 0 else ""
        elif c in _PLAIN:
            one, step = _PLAIN[c], 2 if nxt == c else 1
        elif c == "C":
            if nxt == "H":
                one, step = "X", 2
            elif soft(nxt):
                one, step = "S", 2
            else:
                one, step = "K", 2 if nxt in ("K", "C") else 1
        elif c == "D":
            if nxt == "G":
                one, step = ("J", 3) if soft(at(i + 2)) else ("TK", 2)
            else:
                one, step = "T", 2 if nxt == "D" else 1
        elif c == "G":
            if nxt == "H":
                step, one = 2, "K" if i == 0 or at(i - 1) not in "AEIOU" else ""
            elif nxt == "N":
                one, two = ("KN", "N") if i == 0 else ("", "")
                step = 3 if at(i + 2) == "N" else 2
            elif soft(nxt):
                one, two, step = "J", "K", 2
            else:
                one, step = "K", 2 if nxt == "G" else 1
        elif c == "H":
            if nxt and nxt in "AEIOU" and (i == 0 or at(i - 1) in "AEIOU"):
                one, step = "H", 2
        elif c == "P":
            one, step = ("F", 2) if nxt == "H" else ("P", 2 if nxt == "P" else 1)
        elif c == "S":
            if nxt == "H":
                one, step = "X", 2
            elif w[i : i + 3] in ("SIO", "SIA"):
                slavic = any(x in w for x in ("W", "K", "CZ", "WITZ"))
                one, two, step = "S" if slavic else "X", "S", 3
            elif nxt == "C":
                one, step = "S" if soft(at(i + 2)) else "SK", 3
            else:
                one, step = "S", 2 if nxt in ("S", "Z") else 1
        elif c == "T":
            if w[i : i + 4] == "TION" or w[i : i + 3] in ("TIA", "TCH"):
                one, step = "X", 3
            elif nxt == "H":
                one, two, step = "0", "T", 2
            else:
                one, step = "T", 2 if nxt in ("T", "D") else 1
        elif c == "W":
            if nxt and nxt in "AEIOU":
                one, two, step = "A", "F", 2
        elif c == "X":
            one, step = "KS", 2 if nxt == "X" else 1
        a += one
        b += one if two is None else two
        i += step
    return a[:4], b[:4]


@F.pandas_udf(T.StructType([T.StructField("p", T.StringType()), T.StructField("s", T.StringType())]))
def sound_udf(s: pd.Series) -> pd.DataFrame:
    """Sound codes, for vocabularies rather than running text."""
    both = [sound(x) if isinstance(x, str) else (None, None) for x in s]
    return pd.DataFrame(both, columns=["p", "s"])

"""What a search shows of a text: highlighted words and fragments around matches."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let, runs


def highlight(col: Column, terms: Sequence[str], opening: str = "<b>", closing: str = "</b>") -> Column:
    """Every whole ASCII word that is one of the terms, letter case aside, between tags."""
    if not terms:
        return col
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    any_of = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(col, f"(?i)(?<![A-Za-z0-9])({any_of})(?![A-Za-z0-9])", f"{quote(opening)}$1{quote(closing)}")


def summarize(col: Column, terms: Sequence[str], frags: int = 3, length: int = 20, separator: str = "...") -> Column:
    """Up to frags windows of length words around matches that no window covers yet.

    Without a match the first words and the separator; a text without words stays."""
    want = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(want, F.lower(x)), i).otherwise(F.lit(-1))), lambda i: i >= 0)

        def start(at: Column) -> Column:
            first = F.greatest(at - length // 2, F.lit(0))
            return F.when(first + length > n, F.greatest(n - length, F.lit(0))).otherwise(first)

        def pick(acc: Column, at: Column) -> Column:
            covered = F.exists(acc, lambda s: (at >= s) & (at < s + length))
            return F.when(covered | (F.size(acc) >= frags), acc).otherwise(F.array_append(acc, start(at)))

        starts = F.aggregate(hits, F.array().cast("array<int>"), lambda acc, at: pick(acc, at.cast("int")).cast("array<int>"))
        none = F.concat(F.array_join(F.slice(w, 1, length), " "), F.lit(separator))
        shown = let(starts, lambda s: F.when(F.size(s) == 0, none).otherwise(F.array_join(F.transform(s, lambda k: F.array_join(F.slice(w, k + 1, length), " ")), separator)))
        return F.when(n == 0, col).otherwise(shown)

    return let(runs(col), of_words)

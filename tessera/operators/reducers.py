"""The reducers of a group, each one aggregate column.

Numeric reducers see the values that are numbers; a group without any gives 0. Lists go by
the id of the rows, or by their values where the rows have no id any more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name: number of arguments, least and greatest.
ARITY = {
    "COUNT": (0, 0), "SUM": (1, 1), "AVG": (1, 1), "MIN": (1, 1), "MAX": (1, 1), "COUNT_DISTINCT": (1, 1), "COUNT_DISTINCTISH": (1, 1),
    "STDDEV": (1, 1), "QUANTILE": (2, 2), "TOLIST": (1, 1), "FIRST_VALUE": (1, 4), "RANDOM_SAMPLE": (2, 2),
}


class ReducerError(ValueError):
    """A reducer that cannot be read."""


@dataclass(frozen=True)
class Reducer:
    name: str
    args: tuple[str, ...]
    alias: str
    approx: bool = False


def parse_reducer(words: Sequence[str], at: int) -> tuple[Reducer, int]:
    """NAME count args.. AS alias, from words[at] on; surplus arguments are left out."""
    if at + 1 >= len(words):
        raise ReducerError("REDUCE takes a name and a count")
    name = words[at].upper()
    if name not in ARITY:
        raise ReducerError(f"no reducer {words[at]!r}")
    if not words[at + 1].isdigit():
        raise ReducerError("REDUCE takes a count")
    n = int(words[at + 1])
    args, at = list(words[at + 2 : at + 2 + n]), at + 2 + n
    least, most = ARITY[name]
    if len(args) < max(n, least):
        raise ReducerError(f"{name} takes {least} arguments")
    if at + 1 >= len(words) or words[at].upper() != "AS":
        raise ReducerError("REDUCE needs AS and a name")
    return Reducer(name, tuple(args[:most]), words[at + 1]), at + 2


def _field(word: str) -> str:
    return word[1:] if word.startswith("@") else word


def number(schema: T.StructType, name: str) -> Column:
    if name not in schema.fieldNames():
        return F.lit(None).cast("double")
    c = F.col(f"`{name}`")
    return c.cast("double") if isinstance(schema[name].dataType, T.NumericType) else c.cast("string").try_cast("double")


def _text(schema: T.StructType, name: str) -> Column:
    return F.col(f"`{name}`") if name in schema.fieldNames() else F.lit(None).cast("string")


def aggregate(r: Reducer, schema: T.StructType) -> Column:
    """The aggregate column of a reducer."""
    name = _field(r.args[0]) if r.args else ""
    order = F.col("doc_id") if "doc_id" in schema.fieldNames() else _text(schema, name)
    if r.name == "COUNT":
        out = F.count(F.lit(1))
    elif r.name in ("SUM", "AVG", "MIN", "MAX", "STDDEV"):
        f = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_pop}[r.name]
        out = F.coalesce(f(number(schema, name)), F.lit(0.0))
    elif r.name in ("COUNT_DISTINCT", "COUNT_DISTINCTISH"):
        c = _text(schema, name)
        out = F.approx_count_distinct(c) if r.approx else F.count_distinct(c)
    elif r.name == "TOLIST":
        rows = F.array_sort(F.collect_list(F.when(_text(schema, name).isNotNull(), F.struct(order.alias("o"), _text(schema, name).cast("string").alias("v")))))
        out = F.array_join(F.transform(rows, lambda x: x["v"]), ",")
    elif r.name == "RANDOM_SAMPLE":
        rows = F.array_sort(F.collect_list(F.when(_text(schema, name).isNotNull(), F.struct(order.alias("o"), _text(schema, name).cast("string").alias("v")))))
        k = int(r.args[1])
        n = F.size(rows)
        take = F.least(F.lit(k), n)
        picks = F.transform(F.sequence(F.lit(0), F.greatest(take - 1, F.lit(0))), lambda i: F.try_element_at(rows, (i * n / k).cast("int") + 1)["v"])
        out = F.when((n == 0) | (k == 0), F.lit("")).otherwise(F.array_join(picks, ","))
    else:
        out = _first_value(r, schema, name, order)
    return out.alias(r.alias)


def quantile_share(r: Reducer) -> float:
    """The share that a QUANTILE asks for; its value, sorted[floor(p * (n - 1))] without
    interpolation, is found by counting, not by a list in one task."""
    p = float(r.args[1])
    if not 0 <= p <= 1:
        raise ReducerError("QUANTILE takes a share between 0 and 1")
    return p


def _first_value(r: Reducer, schema: T.StructType, name: str, order: Column) -> Column:
    value = F.coalesce(_text(schema, name).cast("string"), F.lit(""))
    words = list(r.args[1:])
    if not words:
        return F.min_by(value, order)
    if words[0].upper() != "BY" or len(words) < 2:
        raise ReducerError("FIRST_VALUE takes BY @field [ASC|DESC]")
    by = F.coalesce(number(schema, _field(words[1])), F.lit(0.0))
    down = len(words) > 2 and words[2].upper() == "DESC"
    return F.min_by(value, F.struct((-by if down else by).alias("g"), order.alias("o")))

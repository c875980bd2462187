"""The expression language of APPLY and FILTER: text to tree to column.

Tightest to loosest: ``!`` and unary minus, ``^`` (left), ``* / %``, ``+ -``, comparisons
(chained, left), ``&&``, ``||``. Values are numbers or strings; a field keeps its column's
type. Comparisons are numeric when a side is a number or a numeric field, else by string
for ``==`` and ``!=`` and by leading number for the rest; this is where typed columns differ
from a language in which every field is a string. Truth: a number that is not 0, a string
that is not empty.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tree = tuple


class ExprError(ValueError):
    """An expression that cannot be read, or a call that does not fit."""


_LEXER = re.compile(r"""\s*(?:(\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+)|'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|@([A-Za-z_][\w.]*)|([A-Za-z_]\w*)|(\|\||&&|==|!=|<=|>=|[-+*/%^<>!(),]))""")
#: Name: least and greatest number of arguments.
FUNCTIONS = {"sqrt": (1, 1), "log": (1, 1), "log2": (1, 1), "abs": (1, 1), "ceil": (1, 1), "floor": (1, 1), "round": (1, 1), "lower": (1, 1), "upper": (1, 1), "strlen": (1, 1), "substr": (3, 3), "format": (1, 16), "if": (3, 3)}
_LEVELS = (("||",), ("&&",), ("==", "!=", "<=", ">=", "<", ">"), ("+", "-"), ("*", "/", "%"), ("^",))
_A, _Z = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parse_expr(text: str) -> Tree:
    """The tree: ('num', x), ('str', s), ('field', f), ('op', o, ..), ('call', f, ..)."""
    toks, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEXER.match(text, at)
        if not m:
            raise ExprError(f"cannot read {text[at:at + 12]!r}")
        k = m.lastindex
        v = m.group(k)
        toks.append(("num", "str", "str", "field", "name", "op")[k - 1 : k] + (re.sub(r"\\(.)", r"\1", v) if k in (2, 3) else v,))
        at = m.end()
    pos = 0

    def is_op(*ops: str) -> bool:
        return pos < len(toks) and toks[pos][0] == "op" and toks[pos][1] in ops

    def level(k: int) -> Tree:
        nonlocal pos
        if k == len(_LEVELS):
            return atom()
        left = level(k + 1)
        while is_op(*_LEVELS[k]):
            op = toks[pos][1]
            pos += 1
            left = ("op", op, left, level(k + 1))
        return left

    def atom() -> Tree:
        nonlocal pos
        if pos >= len(toks):
            raise ExprError("the expression ends too early")
        kind, v = toks[pos]
        pos += 1
        if kind == "op" and v in "!-":
            return ("op", "neg" if v == "-" else "!", atom())
        if kind == "op" and v == "(":
            inner = level(0)
            close()
            return inner
        if kind == "num":
            return ("num", float(v))
        if kind in ("str", "field"):
            return (kind, v)
        if kind == "name":
            low = v.lower()
            if not is_op("("):
                raise ExprError(f"unexpected name {v!r}")
            if low not in FUNCTIONS:
                raise ExprError(f"no function {v!r}")
            pos += 1
            args = []
            while not is_op(")"):
                args.append(level(0))
                if is_op(","):
                    pos += 1
                elif not is_op(")"):
                    raise ExprError("unclosed call")
            pos += 1
            least, most = FUNCTIONS[low]
            if not least <= len(args) <= most:
                raise ExprError(f"{low} takes {least} to {most} arguments")
            return ("call", low, *args)
        raise ExprError(f"unexpected {v!r}")

    def close() -> None:
        nonlocal pos
        if not is_op(")"):
            raise ExprError("unclosed (")
        pos += 1

    tree = level(0)
    if pos < len(toks):
        raise ExprError(f"unexpected {toks[pos][1]!r}")
    return tree


@dataclass(frozen=True)
class Value:
    """A column with its kind."""

    col: Column
    number: bool
    literal: object = None


def leading_number(c: Column) -> Column:
    """The number that a string begins with, else 0."""
    m = F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.coalesce(m.try_cast("double"), F.lit(0.0))


def to_number(v: Value) -> Column:
    return v.col if v.number else leading_number(v.col)


def to_text(v: Value) -> Column:
    """Whole numbers without a point, others with six decimals."""
    if not v.number:
        return v.col
    return F.when(v.col == F.floor(v.col), v.col.cast("bigint").cast("string")).otherwise(F.format_string("%.6f", v.col))


def truth(v: Value) -> Column:
    return F.coalesce(v.col != 0, F.lit(False)) if v.number else v.col != ""


def _flag(c: Column) -> Value:
    return Value(F.when(c, 1.0).otherwise(0.0), True)


def compile_expr(tree: Tree | str, schema: T.StructType | Mapping[str, T.DataType]) -> Value:
    """The column of a tree; fields that schema lacks are empty strings."""
    if isinstance(tree, str):
        tree = parse_expr(tree)
    types = {f.name: f.dataType for f in schema.fields} if isinstance(schema, T.StructType) else dict(schema)
    return _compile(tree, types)


def _compile(t: Tree, types: Mapping[str, T.DataType]) -> Value:
    if t[0] == "num":
        return Value(F.lit(t[1]), True, t[1])
    if t[0] == "str":
        return Value(F.lit(t[1]), False, t[1])
    if t[0] == "field":
        if t[1] not in types:
            return Value(F.lit(""), False)
        c = F.col(f"`{t[1]}`")
        if isinstance(types[t[1]], T.NumericType):
            return Value(F.coalesce(c.cast("double"), F.lit(0.0)), True)
        return Value(F.coalesce(c.cast("string"), F.lit("")), False)
    args = [_compile(x, types) for x in t[2:]]
    return _operate(t[1], args) if t[0] == "op" else _call(t[1], args)


def _operate(op: str, args: list[Value]) -> Value:
    if op == "!":
        return _flag(~truth(args[0]))
    if op == "neg":
        return Value(-to_number(args[0]), True)
    a, b = args
    if op == "&&":
        return _flag(truth(a) & truth(b))
    if op == "||":
        return _flag(truth(a) | truth(b))
    if op in ("==", "!="):
        same = to_number(a) == to_number(b) if a.number or b.number else a.col == b.col
        return _flag(same if op == "==" else ~same)
    x, y = to_number(a), to_number(b)
    if op in ("<", ">", "<=", ">="):
        return _flag({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op])
    if op in ("/", "%"):
        return Value(F.when(y == 0, 0.0).otherwise(x / y if op == "/" else x % y), True)
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[op](), True)


def _call(name: str, args: list[Value]) -> Value:
    if name in ("sqrt", "log", "log2", "abs", "ceil", "floor", "round"):
        x = to_number(args[0])
        if name in ("log", "log2"):
            f = F.ln if name == "log" else F.log2
            return Value(F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(f(x)), True)
        if name == "sqrt":
            return Value(F.sqrt(x), True)
        if name == "round":  # half away from zero
            return Value(F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double"), True)
        return Value({"abs": F.abs, "ceil": F.ceil, "floor": F.floor}[name](x).cast("double"), True)
    if name == "if":
        test, a, b = args
        if a.number and b.number:
            return Value(F.when(truth(test), a.col).otherwise(b.col), True)
        return Value(F.when(truth(test), to_text(a)).otherwise(to_text(b)), False)
    s = to_text(args[0])
    if name == "lower":
        return Value(F.translate(s, _Z, _A), False)
    if name == "upper":
        return Value(F.translate(s, _A, _Z), False)
    if name == "strlen":
        return Value(F.octet_length(s).cast("double"), True)
    if name == "substr":
        off, n = (F.greatest(to_number(v), F.lit(0.0)).cast("int") for v in args[1:])
        return Value(F.substring(s, off + 1, n), False)
    if args[0].literal is None or args[0].number:
        raise ExprError("format takes a literal")
    parts = str(args[0].literal).split("%s")
    rest = [to_text(v) for v in args[1:]]
    cols = [F.lit(parts[0])]
    for i, p in enumerate(parts[1:]):
        cols += [rest[i] if i < len(rest) else F.lit(""), F.lit(p)]
    return Value(F.concat(*cols), False)

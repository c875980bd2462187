"""JSON values and paths.

Values are Python's, with insertion order kept, integers and numbers apart, integers beyond
64 bits read as numbers, and whole numbers printed without a point. A path that starts with
``$`` gives all matches; any other is legacy and gives the first.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class JsonError(ValueError):
    """Text that is not JSON, a path that cannot be read, or an edit that does not fit."""


def _int(s: str) -> int | float:
    v = int(s)
    return v if -(2**63) <= v < 2**63 else float(s)


def _constant(s: str) -> float:
    raise JsonError(f"{s} is not JSON")


def _strict(s: str) -> str:
    return s


def loads(text: str) -> Any:
    """Strict parse; of repeated keys the last value stays, in the first one's place."""
    try:
        return json.loads(text, parse_int=_int, parse_constant=_constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise JsonError(str(e)) from None


def number_text(v: float) -> str:
    if not math.isfinite(v):
        return "null"
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return repr(v).replace("e+", "e+")


def dumps(v: Any, indent: str = "", newline: str = "", space: str = "", level: int = 0) -> str:
    """JSON text; newline and space count only with an indent."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if not v:
        return "{}" if isinstance(v, dict) else "[]"
    nl = (newline + indent * (level + 1), newline + indent * level) if indent else ("", "")
    gap = space if indent else ""
    if isinstance(v, dict):
        parts = [f"{json.dumps(k, ensure_ascii=False)}:{gap}{dumps(x, indent, newline, space, level + 1)}" for k, x in v.items()]
        return "{" + ",".join(nl[0] + p for p in parts) + nl[1] + "}"
    return "[" + ",".join(nl[0] + dumps(x, indent, newline, space, level + 1) for x in v) + nl[1] + "]"


def type_name(v: Any) -> str:
    if v is None:
        return "null"
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array")):
        if isinstance(v, kind):
            return name
    return "object"


def equal(a: Any, b: Any) -> bool:
    """Deep equality; 1 equals 1.0, true does not equal 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return a == b


@dataclass(frozen=True)
class Step:
    """kind: key, index, slice, all, filter, keys, indices; deep: also in all descendants."""

    kind: str
    arg: Any = None
    deep: bool = False


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]
    legacy: bool


_NAME = re.compile(r"[^.\[\]\s]+")
_QUOTED = re.compile(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\"""")
_TEST = re.compile(r"""^\?\(\s*@((?:\.[^.\[\]\s=!<>()]+|\[(?:'[^']*'|"[^"]*"|\d+)\])*)\s*(?:(==|!=|<=|>=|<|>)\s*(.+?))?\s*\)$""", re.S)


@lru_cache(1024)
def parse_path(text: str) -> Path:
    """The steps of a path."""
    legacy = not text.startswith("$")
    at, steps = (0 if legacy else 1), []
    if legacy and text in ("", "."):
        return Path((), True)
    if legacy and text[0] not in ".[":
        text = "." + text
    while at < len(text):
        deep = False
        if text.startswith("..", at):
            deep, at = True, at + 2
        elif text[at] == ".":
            at += 1
        elif text[at] != "[":
            raise JsonError(f"cannot read path {text!r}")
        if at < len(text) and text[at] == "[":
            end = _bracket_end(text, at)
            steps.append(_bracket(text[at + 1 : end].strip(), deep, text))
            at = end + 1
        elif text.startswith("*", at):
            steps.append(Step("all", deep=deep))
            at += 1
        else:
            m = _NAME.match(text, at)
            if not m:
                raise JsonError(f"cannot read path {text!r}")
            steps.append(Step("key", m.group(), deep))
            at = m.end()
    return Path(tuple(steps), legacy)


def _bracket_end(text: str, at: int) -> int:
    depth, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    raise JsonError(f"unclosed [ in path {text!r}")


def _bracket(body: str, deep: bool, text: str) -> Step:
    if body == "*":
        return Step("all", deep=deep)
    if body.startswith("?"):
        m = _TEST.match(body)
        if not m:
            raise JsonError(f"cannot read filter {body!r}")
        names = tuple(x or y or z for x, y, z in re.findall(r"""\.([^.\[\]\s]+)|\[['"]([^'"]*)['"]\]|\[(\d+)\]""", m[1]))
        if m[2] is None:
            return Step("filter", (names, None, None), deep)
        raw = m[3].strip()
        try:
            value = loads(raw) if not raw.startswith("'") else raw[1:-1]
        except JsonError:
            raise JsonError(f"cannot read value {raw!r}") from None
        return Step("filter", (names, m[2], value), deep)
    keys = [(a or b) for a, b in _QUOTED.findall(body)]
    if keys and re.fullmatch(r"""\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")(?:\s*,\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"))*\s*""", body):
        keys = [re.sub(r"\\(.)", r"\1", k) for k in keys]
        return Step("key", keys[0], deep) if len(keys) == 1 else Step("keys", tuple(keys), deep)
    if re.fullmatch(r"-?\d+", body):
        return Step("index", int(body), deep)
    if re.fullmatch(r"-?\d+(\s*,\s*-?\d+)+", body):
        return Step("indices", tuple(int(x) for x in body.split(",")), deep)
    if re.fullmatch(r"(-?\d*)\s*:\s*(-?\d*)\s*(:\s*(-?\d*))?", body):
        parts = [int(p) if p.strip() else None for p in body.split(":")]
        return Step("slice", tuple((parts + [None, None])[:3]), deep)
    raise JsonError(f"cannot read path {text!r}")


Place = tuple[Any, Any]  # container and key or index; (None, None) is the root


def _children(v: Any) -> Iterator[Any]:
    if isinstance(v, dict):
        yield from v
    elif isinstance(v, list):
        yield from range(len(v))


def _matches(v: Any, test: tuple) -> bool:
    names, op, want = test
    for n in names:
        if isinstance(v, dict) and n in v:
            v = v[n]
        elif isinstance(v, list) and n.isdigit() and int(n) < len(v):
            v = v[int(n)]
        else:
            return False
    if op is None:
        return True
    if op in ("==", "!="):
        return equal(v, want) == (op == "==")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not (number(v) and number(want) or isinstance(v, str) and isinstance(want, str)):
        return False
    return {"<": v < want, ">": v > want, "<=": v <= want, ">=": v >= want}[op]


def _pick(v: Any, s: Step) -> list[Any]:
    """Keys or indices of v's children that a step takes, in order."""
    if s.kind == "key":
        return [s.arg] if isinstance(v, dict) and s.arg in v else []
    if s.kind == "keys":
        return [k for k in s.arg if isinstance(v, dict) and k in v]
    if s.kind == "all":
        return list(_children(v))
    if s.kind == "filter":
        return [k for k in _children(v) if _matches(v[k], s.arg)]
    if not isinstance(v, list):
        return []
    if s.kind == "slice":
        a, b, step = s.arg
        return list(range(len(v))[slice(a, b, step or 1)])
    n = len(v)
    return [i + n if i < 0 else i for i in ([s.arg] if s.kind == "index" else s.arg) if -n <= i < n]


def _descend(v: Any) -> Iterator[Any]:
    stack = [v]
    while stack:
        x = stack.pop()
        yield x
        stack += [x[k] for k in reversed(list(_children(x)))]


def places(root: Any, path: Path) -> list[Place]:
    """Where the path leads: container and key of each match, in document order."""
    here: list[Place] = [(None, None)]
    for s in path.steps:
        nxt: list[Place] = []
        for box, k in here:
            v = root if box is None else box[k]
            for x in _descend(v) if s.deep else (v,):
                nxt += [(x, key) for key in _pick(x, s)]
        here = nxt
    return here[:1] if path.legacy else here


def values(root: Any, path: Path) -> list[Any]:
    return [root if box is None else box[k] for box, k in places(root, path)]


_PLAIN = re.compile(r"^\$(?:\.[A-Za-z_]\w*|\[\d+\])+$")


def json_get(col: Column, path: str) -> Column:
    """The first match as JSON text, strings as they are; plain paths stay in the engine."""
    if _PLAIN.match(path):
        return F.get_json_object(col, path)
    return json_map(col, lambda v, p=path: _first(values(v, parse_path(p))), "string")


def _first(found: list[Any]) -> str | None:
    if not found or found[0] is None:
        return None
    return found[0] if isinstance(found[0], str) else dumps(found[0])


def json_query(col: Column, path: str) -> Column:
    """All matches as an array of JSON texts."""
    return json_map(col, lambda v, p=path: [dumps(x) for x in values(v, parse_path(p))], "array<string>")


def json_map(col: Column, f: Callable[[Any], Any], kind: str) -> Column:
    """f over the parsed values of a text column, in Arrow batches; null where it is no JSON."""
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        def one(t: Any) -> Any:
            if not isinstance(t, str):
                return None
            try:
                v = loads(t)
            except JsonError:
                return None
            return f(v)

        return pd.Series([one(t) for t in s], dtype=object)

    return run(col)

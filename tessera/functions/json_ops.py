"""Reads and edits of JSON documents, as functions of values and as columns.

An edit takes a parsed document and returns (document, reply); a document that an edit
removes is None inside Gone. Edits of keys and places that are not there raise JsonError.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.json_path import JsonError, Path, Step, dumps, equal, json_map, loads, parse_path, places, type_name, values

MISSING = object()


class Gone:
    """What stands for a document that was deleted."""


GONE = Gone()


def _put(root: Any, place: tuple, v: Any) -> Any:
    box, k = place
    if box is None:
        return v
    box[k] = v
    return root


def _copy(v: Any) -> Any:
    return loads(dumps(v)) if isinstance(v, (dict, list)) else v


def set_value(root: Any, path: str, value: Any, mode: str = "") -> tuple[Any, bool]:
    """Replaces every match, or adds a last key to every parent; NX and XX forbid one of these.

    root is MISSING for a document that is not there; only the root can make it."""
    p = parse_path(path)
    if not p.steps:
        if (mode == "NX" and root is not MISSING) or (mode == "XX" and root is MISSING):
            return root, False
        return value, True
    if root is MISSING:
        raise JsonError("a new document must be set at the root")
    found = places(root, p)
    if found:
        if mode == "NX":
            return root, False
        for at in found:
            root = _put(root, at, _copy(value))
        return root, True
    last = p.steps[-1]
    if mode == "XX" or last.kind != "key" or last.deep:
        return root, False
    parents = [v for v in values(root, Path(p.steps[:-1], p.legacy)) if isinstance(v, dict)]
    for v in parents:
        v[last.arg] = _copy(value)
    return root, bool(parents)


def get_values(root: Any, paths: Sequence[str], indent: str = "", newline: str = "", space: str = "") -> str | None:
    """One path: all matches as an array ($) or the first; several: an object by path."""
    show = lambda v: dumps(v, indent, newline, space)
    parsed = [parse_path(p) for p in paths or ["."]]
    if len(parsed) == 1:
        found = values(root, parsed[0])
        if parsed[0].legacy:
            return show(found[0]) if found else None
        return show(found)
    if all(p.legacy for p in parsed):
        return show({t: found[0] for t, p in zip(paths, parsed) if (found := values(root, p))})
    return show({t: values(root, Path(p.steps, False)) for t, p in zip(paths, parsed)})


def delete(root: Any, path: str = "$") -> tuple[Any, int]:
    """Removes every match; the number removed. The root removes the document."""
    p = parse_path(path)
    if not p.steps:
        return GONE, 1
    found = places(root, p)
    n = 0
    for box, k in sorted(found, key=lambda x: x[1] if isinstance(x[1], int) else -1, reverse=True):
        if isinstance(box, dict):
            n += box.pop(k, MISSING) is not MISSING
        elif k < len(box):
            del box[k]
            n += 1
    return root, n


def clear(root: Any, path: str = "$") -> tuple[Any, int]:
    """Empties containers and zeroes numbers; how many changed their value's place."""
    n = 0
    for at in places(root, parse_path(path)):
        v = root if at[0] is None else at[0][at[1]]
        if isinstance(v, (dict, list)):
            v.clear()
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            root = _put(root, at, 0)
        else:
            continue
        n += 1
    return root, n


def toggle(root: Any, path: str) -> tuple[Any, list[bool | None]]:
    return _edit(root, path, lambda v: (not v, not v), bool)


def _edit(root: Any, path: str, f: Callable[[Any], tuple[Any, Any]], *kinds: type) -> tuple[Any, list[Any]]:
    """f at every match of one of the kinds: (new value, reply); None elsewhere."""
    replies = []
    for at in places(root, parse_path(path)):
        v = root if at[0] is None else at[0][at[1]]
        if not isinstance(v, kinds) or (isinstance(v, bool) and bool not in kinds):
            replies.append(None)
            continue
        new, reply = f(v)
        root = _put(root, at, new)
        replies.append(reply)
    return root, replies


def array_append(root: Any, path: str, *items: Any) -> tuple[Any, list[int | None]]:
    def f(v: list) -> tuple[list, int]:
        v.extend(map(_copy, items))
        return v, len(v)

    return _edit(root, path, f, list)


def array_insert(root: Any, path: str, at: int, *items: Any) -> tuple[Any, list[int | None]]:
    def f(v: list) -> tuple[list, int]:
        i = at + len(v) if at < 0 else at
        if not 0 <= i <= len(v):
            raise JsonError("index out of range")
        v[i:i] = map(_copy, items)
        return v, len(v)

    return _edit(root, path, f, list)


def array_pop(root: Any, path: str = "$", at: int = -1) -> tuple[Any, list[Any]]:
    def f(v: list) -> tuple[list, Any]:
        i = at + len(v) if at < 0 else at
        return (v, dumps(v.pop(i))) if 0 <= i < len(v) else (v, None)

    return _edit(root, path, f, list)


def array_trim(root: Any, path: str, start: int, stop: int) -> tuple[Any, list[int | None]]:
    """Keeps start to stop, both included."""

    def f(v: list) -> tuple[list, int]:
        n = len(v)
        a, b = max(0, start + n if start < 0 else start), stop + n if stop < 0 else min(stop, n - 1)
        v[:] = v[a : b + 1] if a <= b else []
        return v, len(v)

    return _edit(root, path, f, list)


def array_index(root: Any, path: str, value: Any, start: int = 0, stop: int | None = None) -> list[int | None]:
    """First place of an equal element in [start, stop), -1 if none; null elsewhere."""
    out: list[int | None] = []
    for v in values(root, parse_path(path)):
        if not isinstance(v, list):
            out.append(None)
            continue
        n = len(v)
        a = max(0, start + n) if start < 0 else start
        b = n if stop is None else max(0, stop + n) if stop < 0 else min(stop, n)
        out.append(next((i for i in range(a, b) if equal(v[i], value)), -1))
    return out


def string_append(root: Any, path: str, suffix: str) -> tuple[Any, list[int | None]]:
    return _edit(root, path, lambda v: (v + suffix, len((v + suffix).encode())), str)


def number_add(root: Any, path: str, by: int | float) -> tuple[Any, list[Any]]:
    def f(v: int | float) -> tuple[Any, Any]:
        s = v + by
        if isinstance(s, int) and not -(2**63) <= s < 2**63:
            s = float(s)
        return s, s

    return _edit(root, path, f, int, float)


def number_multiply(root: Any, path: str, by: int | float) -> tuple[Any, list[Any]]:
    return _edit(root, path, lambda v: (float(v) * by, float(v) * by), int, float)


def merge(root: Any, path: str, patch: Any) -> tuple[Any, bool]:
    """Merge patch of RFC 7396 at every match; a match it makes null goes."""

    def apply(old: Any, new: Any) -> Any:
        if not isinstance(new, dict):
            return new
        out = dict(old) if isinstance(old, dict) else {}
        for k, v in new.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = apply(out.get(k), v)
        return out

    p = parse_path(path)
    if not p.steps:
        return (GONE if patch is None else apply(None if root is MISSING else root, patch)), True
    if root is MISSING:
        raise JsonError("a new document must be merged at the root")
    found = places(root, p)
    if patch is None:
        return delete(root, path)[0], bool(found)
    if not found:
        return set_value(root, path, apply(None, patch))
    for box, k in found:
        box[k] = apply(box[k], patch)
    return root, True


def sizes(root: Any, path: str, kind: type) -> list[int | None]:
    """Lengths of the matches of a kind: elements, keys, or bytes of a string."""
    return [(len(v.encode()) if kind is str else len(v)) if isinstance(v, kind) else None for v in values(root, parse_path(path))]


def memory(v: Any) -> int:
    """Bytes that a value takes, about: 16 each, and its text or parts."""
    if isinstance(v, str):
        return 16 + len(v.encode())
    if isinstance(v, dict):
        return 16 + sum(16 + len(k.encode()) + memory(x) for k, x in v.items())
    if isinstance(v, list):
        return 16 + sum(map(memory, v))
    return 16


def flat(v: Any) -> list[str]:
    """Protocol view: containers open with a marker, then their parts follow."""
    if isinstance(v, dict):
        return ["{", *(x for k, item in v.items() for x in (k, *flat(item)))]
    if isinstance(v, list):
        return ["[", *(x for item in v for x in flat(item))]
    return [v if isinstance(v, str) else "" if v is None else dumps(v)]


# columns


def edit_column(col: Column, f: Callable[..., tuple[Any, Any]], *args: Any) -> Column:
    """struct<json, reply> of an edit over a JSON text column; json is null for a deleted one."""
    @F.pandas_udf("struct<json:string,reply:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            try:
                doc, reply = f(loads(t), *args) if isinstance(t, str) else (GONE, None)
                rows.append((None if doc is GONE else dumps(doc), dumps(reply) if reply is not None else None))
            except JsonError:
                rows.append((t, None))
        return pd.DataFrame(rows, columns=["json", "reply"])

    return run(col)


def type_column(col: Column, path: str = "$") -> Column:
    """Type names of the matches."""
    return json_map(col, lambda v, p=path: [type_name(x) for x in values(v, parse_path(p))], "array<string>")


def length_column(col: Column, path: str, kind: type) -> Column:
    return json_map(col, lambda v, p=path, k=kind: sizes(v, p, k), "array<int>")


def keys_column(col: Column, path: str = "$") -> Column:
    """Keys of the first match, in order; the root's stay in the engine."""
    if path in ("$", "."):
        return F.json_object_keys(col)
    return json_map(col, lambda v, p=path: next((list(x) for x in values(v, parse_path(p)) if isinstance(x, dict)), None), "array<string>")


def flat_column(col: Column, path: str = "$") -> Column:
    return json_map(col, lambda v, p=path: [y for x in values(v, parse_path(p)) for y in flat(x)], "array<string>")


def memory_column(col: Column) -> Column:
    return json_map(col, memory, "bigint")


def valid_column(col: Column) -> Column:
    """Whether the text is strict JSON."""
    return F.coalesce(json_map(col, lambda v: True, "boolean"), F.lit(False))


def multi_get(keys: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """(key, json) of one path over keys; no document and no match are null.

    Only the documents of the keys are looked into (and put together, if they are groups)."""
    own = docs.join(keys.select("key"), "key", "left_semi").select("key", json_query_text(F.col("json"), path).alias("json"))
    return keys.join(own, "key", "left")


def json_query_text(col: Column, path: str) -> Column:
    def f(v: Any, p: str = path) -> str | None:
        found = values(v, parse_path(p))
        return None if not found else dumps(found[0] if parse_path(p).legacy else found)

    return json_map(col, f, "string")


def multi_set(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (key, json) after edits (seq, key, path, value), each key's in order of seq.

    All values are read first; one that is not JSON, or an edit that cannot apply, leaves
    its own document as the edits before it made it."""
    both = docs.select("key", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("path"), F.col("json").alias("value")).unionByName(
        edits.select("key", F.col("seq").cast("bigint").alias("seq"), "path", "value")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc: Any = MISSING
        for path, value in zip(pdf.sort_values("seq", na_position="first")["path"], pdf.sort_values("seq", na_position="first")["value"]):
            try:
                doc = loads(value) if path is None or path != path else set_value(doc, path, loads(value))[0]
            except (JsonError, TypeError):
                continue
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "json": [None if doc is MISSING else dumps(doc)]})

    kind = docs.schema["key"].dataType.simpleString()
    return both.groupBy("key").applyInPandas(run, f"key {kind}, json string").where("json is not null")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Any", "Callable", "Sequence", "Step")]

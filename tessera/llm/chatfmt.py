"""Operator 4: chat formatting by a compiler for a sandboxed template language.

A template is text with ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``; a
dash inside a bracket strips white space on that side. Statements: for/else, if/elif/else,
set (names and namespace attributes), and generation, which marks what a model is to learn.
Expressions: literals, names, attributes and items of maps and lists, slices, arithmetic,
``~``, comparisons, ``in``, ``and or not``, ``a if c else b``, filters, tests, and calls of
a fixed list of functions and string methods. Nothing else can be reached: attributes are
looked up in maps only, and names that start with an underscore are refused.

Parsing gives a syntax tree of tuples; constants are folded (expressions, branches, runs of
text); the tree is then turned into Python closures, which render conversations and return
the text with the (start, stop) offsets of its generated parts.

The sandbox is bounded too: no string, list or output may be larger than ``MAX_CHARS`` plus
``MAX_GROWTH`` times the conversation, integers have 64 bits, and operations (the turns of
loops, and each 1,024 characters or elements that one reads) are ``MAX_STEPS`` plus
``MESSAGE_STEPS`` a message at most. A template that goes beyond is refused, as is any error
in it: the query fails, and no row is left out.

Defined results: one row for each conv_id (null is a conversation too); messages go by turn
(nulls first), then role and text, repeated rows stay; a null role or text renders empty.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _base as B

Node = tuple
MAX_RANGE = 100_000
MAX_CHARS, MAX_GROWTH = 1_000_000, 64
MAX_STEPS, MESSAGE_STEPS = 1_000_000, 10_000

CHATML = (
    "{%- for m in messages -%}{{ '<|im_start|>' ~ m.role ~ '\\n' }}"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text ~ '<|im_end|>' }}{% endgeneration %}"
    "{%- else -%}{{ m.text ~ '<|im_end|>' }}{%- endif -%}{{ '\\n' }}{%- endfor -%}"
)


class TemplateError(ValueError):
    """A template that cannot be compiled, or that refuses its input."""


class Budget(threading.local):
    """What the rendering in hand may still use."""

    chars, steps = MAX_CHARS, MAX_STEPS

    @contextmanager
    def of(self, chars: int, messages: int) -> Iterator[None]:
        held = self.chars, self.steps
        self.chars, self.steps = MAX_CHARS + MAX_GROWTH * chars, MAX_STEPS + MESSAGE_STEPS * messages
        try:
            yield
        finally:
            self.chars, self.steps = held

    def spend(self, *values: Any) -> None:
        n = 1
        for v in values:
            if isinstance(v, (str, list, dict)):
                n += len(v) >> 10
        self.steps -= n
        if self.steps < 0:
            raise TemplateError("the template takes too many steps")

    def fit(self, size: int) -> None:
        if size > self.chars:
            raise TemplateError("a value is too large")

    def check(self, v: Any) -> Any:
        """v, if it isn't too large."""
        if isinstance(v, (str, list, dict)):
            self.fit(len(v))
        elif isinstance(v, int) and not -(2**63) <= v < 2**63:
            raise TemplateError("a number is too large")
        return v

    def weigh(self, v: Any) -> Any:
        """v, if it isn't too large with all that it holds."""
        total, left = 0, [v]
        while left:
            x = left.pop()
            total += len(x) if isinstance(x, str) else 2 + 4 * len(x) if isinstance(x, (list, tuple, dict)) else 20
            self.fit(total)
            if isinstance(x, (list, tuple)):
                left += x
            elif isinstance(x, dict):
                left += [*x.keys(), *x.values()]
        return v


BUDGET = Budget()


class Missing:
    """The value of names and keys that are not there: empty, false."""

    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __iter__(self) -> Iterator[Any]:
        return iter(())

    def __len__(self) -> int:
        return 0


MISSING = Missing()


class Namespace(dict):
    """A map that templates may write to."""


def show(v: Any) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else v if isinstance(v, str) else str(BUDGET.weigh(v))


def join(v: Any, sep: str = "", key: str | None = None) -> str:
    parts, size = [], 0
    for x in v:
        parts.append(show(get(x, key) if key else x))
        size += len(parts[-1]) + len(sep)
        BUDGET.fit(size)
    return sep.join(parts)


def replaced(v: Any, a: str, b: str, *count: int) -> str:
    v = show(v)
    BUDGET.fit(len(v) + v.count(a) * len(b))
    return v.replace(a, b, *count)


def to_json(v: Any, indent: int | None = None) -> str:
    return json.dumps(BUDGET.weigh(v), ensure_ascii=False, indent=min(indent, 16) if isinstance(indent, int) else None)


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: show(v).strip(), "upper": lambda v: show(v).upper(), "lower": lambda v: show(v).lower(), "title": lambda v: show(v).title(), "capitalize": lambda v: show(v).capitalize(),
    "length": len, "count": len, "default": lambda v, d="", falsy=False: d if v is MISSING or v is None or (falsy and not v) else v, "join": join,
    "tojson": to_json, "replace": replaced, "first": lambda v: next(iter(v), MISSING),
    "last": lambda v: v[-1] if len(v) else MISSING, "list": list, "string": show, "int": lambda v, d=0: int(v) if re.fullmatch(r"\s*[+-]?\d+\s*", show(v)) else d, "reverse": lambda v: v[::-1], "sort": sorted, "unique": lambda v: list(dict.fromkeys(v)),
    "items": lambda v: list(v.items()), "selectattr": lambda v, key, test="eq", x=True: [e for e in v if TESTS[test](get(e, key), x)], "rejectattr": lambda v, key, test="eq", x=True: [e for e in v if not TESTS[test](get(e, key), x)], "map": lambda v, attribute: [get(e, attribute) for e in v],
}
TESTS: dict[str, Callable[..., bool]] = {
    "defined": lambda v: v is not MISSING, "undefined": lambda v: v is MISSING, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "sequence": lambda v: isinstance(v, (list, str)), "iterable": lambda v: isinstance(v, (list, str, dict)), "true": lambda v: v is True, "false": lambda v: v is False,
    "even": lambda v: v % 2 == 0, "odd": lambda v: v % 2 == 1, "eq": lambda v, x: v == x, "equalto": lambda v, x: v == x, "ne": lambda v, x: v != x, "in": lambda v, x: v in x,
}
METHODS = {"strip", "lstrip", "rstrip", "startswith", "endswith", "upper", "lower", "title", "capitalize", "replace", "split", "rsplit", "find", "count"}


def bounded(*a: int) -> list[int]:
    if len(r := range(*a)) > MAX_RANGE:
        raise TemplateError("range is too long")
    BUDGET.steps -= len(r)
    return list(r)


def refuse(message: Any = "") -> str:
    raise TemplateError(show(message))


FUNCTIONS: dict[str, Callable[..., Any]] = {"range": bounded, "namespace": lambda **kw: Namespace(kw), "dict": lambda **kw: dict(kw), "raise_exception": refuse}
IMPURE = {"namespace", "raise_exception", "dict"}


def get(v: Any, key: Any) -> Any:
    if isinstance(v, dict):
        return v.get(key, MISSING)
    if isinstance(v, (list, tuple, str)) and isinstance(key, int) and -len(v) <= key < len(v):
        return v[key]
    return MISSING


def multiply(a: Any, b: Any) -> Any:
    for x, n in ((a, b), (b, a)):
        if isinstance(x, (str, list)) and isinstance(n, int) and len(x) * n > MAX_CHARS:
            raise TemplateError("repetition is too long")
    return a * b


def added(a: Any, b: Any) -> Any:
    if isinstance(a, (str, list)) and isinstance(b, (str, list)):
        BUDGET.fit(len(a) + len(b))
    return a + b


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": added, "-": lambda a, b: a - b, "*": multiply, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b, "~": lambda a, b: added(show(a), show(b)),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}
TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>=().,:|\[\]{}]))""", re.S)
LEVELS = (("+", "-"), ("~",), ("*", "/", "//", "%"))
ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}


class Expr:
    """Parser of one expression or of the inside of a statement."""

    def __init__(self, source: str):
        self.toks: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)) or m.end() == at:
                raise TemplateError(f"cannot read: {source[at:at + 20]!r}")
            self.toks.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i = 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] != "str" and self.toks[self.i][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.i < len(self.toks) and self.toks[self.i][0] == "name":
            self.i += 1
            if (n := self.toks[self.i - 1][1]).startswith("_"):
                raise TemplateError(f"name {n!r} is not allowed")
            return n
        raise TemplateError("a name is expected")

    def whole(self) -> Node:
        node = self.cond()
        self.end()
        return node

    def end(self) -> None:
        if self.i < len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r}")

    def cond(self) -> Node:
        node = self.either()
        while self.take("if"):
            test = self.either()
            node = ("cond", test, node, self.cond() if self.take("else") else ("const", MISSING))
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.inverse()
        while self.take("and"):
            node = ("and", node, self.inverse())
        return node

    def inverse(self) -> Node:
        return ("not", self.inverse()) if self.take("not") else self.compare()

    def compare(self) -> Node:
        node = self.level(0)
        while True:
            op = next((o for o in ("==", "!=", "<=", ">=", "<", ">", "in") if self.take(o)), None)
            if op is None and self.peek("not") and self.i + 1 < len(self.toks) and self.toks[self.i + 1][1] == "in":
                self.i += 2
                op = "not in"
            if op is None:
                return node
            node = ("bin", op, node, self.level(0))

    def level(self, k: int) -> Node:
        if k == len(LEVELS):
            return self.unary()
        node = self.level(k + 1)
        while self.peek(*LEVELS[k]):
            self.i += 1
            node = ("bin", self.toks[self.i - 1][1], node, self.level(k + 1))
        return node

    def unary(self) -> Node:
        if self.take("-"):
            return ("bin", "-", ("const", 0), self.unary())
        return self.postfix(self.primary())

    def args(self) -> tuple[list[Node], dict[str, Node]]:
        pos: list[Node] = []
        named: dict[str, Node] = {}
        while not self.take(")"):
            if self.toks[self.i][0] == "name" and self.i + 1 < len(self.toks) and self.toks[self.i + 1] == ("op", "="):
                key = self.name()
                self.need("=")
                named[key] = self.cond()
            else:
                pos.append(self.cond())
            if not self.peek(")"):
                self.need(",")
        return pos, named

    def postfix(self, node: Node) -> Node:
        while True:
            if self.take("."):
                key = self.name()
                if self.take("("):
                    if key not in METHODS and key not in ("items", "keys", "values", "get"):
                        raise TemplateError(f"method {key!r} is not allowed")
                    node = ("method", key, node, *self.args())
                else:
                    node = ("item", node, ("const", key))
            elif self.take("["):
                parts: list[Node | None] = [None]
                while not self.take("]"):
                    if self.take(":"):
                        parts.append(None)
                    else:
                        parts[-1] = self.cond()
                node = ("item", node, parts[0]) if len(parts) == 1 else ("slice", node, *[p or ("const", None) for p in (parts + [None])[:3]])
            elif self.take("|"):
                key = self.name()
                if key not in FILTERS:
                    raise TemplateError(f"no filter {key!r}")
                node = ("filter", key, node, *(self.args() if self.take("(") else ([], {})))
            elif self.take("is"):
                inverse, key = self.take("not"), None
                key = self.name()
                if key not in TESTS:
                    raise TemplateError(f"no test {key!r}")
                node = ("test", key, node, *(self.args() if self.take("(") else ([], {})))
                node = ("not", node) if inverse else node
            else:
                return node

    def primary(self) -> Node:
        if self.i >= len(self.toks):
            raise TemplateError("the expression ends too early")
        kind, v = self.toks[self.i]
        if kind == "num":
            self.i += 1
            return ("const", float(v) if "." in v else int(v))
        if kind == "str":
            self.i += 1
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPE.get(m.group(1), m.group(1)), v[1:-1], flags=re.S))
        if self.take("("):
            node = self.cond()
            self.need(")")
            return node
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.cond())
                if not self.peek("]"):
                    self.need(",")
            return ("list", items)
        if self.take("{"):
            pairs = []
            while not self.take("}"):
                key = self.cond()
                self.need(":")
                pairs.append((key, self.cond()))
                if not self.peek("}"):
                    self.need(",")
            return ("dict", pairs)
        for word, value in (("true", True), ("True", True), ("false", False), ("False", False), ("none", None), ("None", None)):
            if self.take(word):
                return ("const", value)
        n = self.name()
        if self.take("("):
            if n not in FUNCTIONS:
                raise TemplateError(f"no function {n!r}")
            return ("call", n, *self.args())
        return ("name", n)


PIECE = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)


def parse(source: str) -> list[Node]:
    """The syntax tree of a template."""
    flat: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in PIECE.finditer(source):
        text = source[at : m.start()]
        k = next(i for i in (2, 5, 8) if m.group(i) is not None)
        text = text.lstrip() if strip else text
        flat.append(("text", text.rstrip() if m.group(k - 1) else text))
        strip, at = bool(m.group(k + 1)), m.end()
        if k != 8:
            flat.append(("out" if k == 2 else "tag", m.group(k).strip()))
    flat.append(("text", source[at:].lstrip() if strip else source[at:]))
    tree, rest, tag = _block(flat, 0, ())
    if tag:
        raise TemplateError(f"unexpected {tag!r}")
    return tree


def _block(flat: list[tuple[str, str]], i: int, ends: tuple[str, ...]) -> tuple[list[Node], int, str]:
    out: list[Node] = []
    while i < len(flat):
        kind, body = flat[i]
        i += 1
        if kind == "text":
            if body:
                out.append(("text", body))
            continue
        if kind == "out":
            out.append(("out", Expr(body).whole()))
            continue
        word, _, rest = body.partition(" ")
        if word in ends:
            return out, i, body
        if word == "for":
            e = Expr(rest)
            names = [e.name()]
            while e.take(","):
                names.append(e.name())
            e.need("in")
            over = e.either()
            test = e.either() if e.take("if") else None
            e.end()
            inner, i, end = _block(flat, i, ("endfor", "else"))
            other: list[Node] = []
            if end == "else":
                other, i, end = _block(flat, i, ("endfor",))
            out.append(("for", names, over, test, inner, other))
        elif word == "if":
            arms, test = [], Expr(rest).whole()
            while True:
                inner, i, end = _block(flat, i, ("elif", "else", "endif"))
                arms.append((test, inner))
                if end == "endif":
                    break
                test = ("const", True) if end == "else" else Expr(end[4:]).whole()
            out.append(("if", arms))
        elif word == "set":
            e = Expr(rest)
            target = [e.name()]
            while e.take("."):
                target.append(e.name())
            e.need("=")
            out.append(("set", target, e.whole()))
        elif word == "generation":
            inner, i, _ = _block(flat, i, ("endgeneration",))
            out.append(("generation", inner))
        else:
            raise TemplateError(f"no statement {word!r}")
    if ends:
        raise TemplateError(f"{ends[0]!r} is missing")
    return out, i, ""


def fold(node: Node) -> Node:
    """The same expression with its constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "list":
        return ("list", [fold(x) for x in node[1]])
    if kind == "dict":
        return ("dict", [(fold(k), fold(v)) for k, v in node[1]])
    if kind in ("filter", "test", "method"):
        node = (kind, node[1], fold(node[2]), [fold(x) for x in node[3]], {k: fold(v) for k, v in node[4].items()})
        still = [node[2], *node[3], *node[4].values()]
    elif kind == "call":
        node = ("call", node[1], [fold(x) for x in node[2]], {k: fold(v) for k, v in node[3].items()})
        still = [("name", "?")]
    elif kind == "bin":
        node = ("bin", node[1], fold(node[2]), fold(node[3]))
        still = list(node[2:])
    else:
        node = (kind, *[fold(x) for x in node[1:]])
        still = list(node[1:])
        if kind == "cond" and node[1][0] == "const":
            return node[2] if node[1][1] else node[3]
        if kind in ("and", "or") and node[1][0] == "const":
            return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
    if all(x[0] == "const" for x in still):
        try:
            return ("const", closure(node)({}))
        except TemplateError:
            raise
        except Exception:  # noqa: BLE001  it fails where it is rendered, if it is
            return node
    return node


def fold_block(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for n in nodes:
        if n[0] == "out":
            e = fold(n[1])
            made = [("text", show(e[1]))] if e[0] == "const" else [("out", e)]
        elif n[0] == "for":
            made = [("for", n[1], fold(n[2]), fold(n[3]) if n[3] else None, fold_block(n[4]), fold_block(n[5]))]
        elif n[0] == "if":
            arms, made = [], None
            for test, inner in n[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_block(inner)))
                if test[0] == "const":
                    break
            made = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        elif n[0] == "set":
            made = [("set", n[1], fold(n[2]))]
        elif n[0] == "generation":
            made = [("generation", fold_block(n[1]))]
        else:
            made = [n]
        for m in made:
            if m[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + m[1])
            elif m != ("text", ""):
                out.append(m)
    return out


Env = dict


def closure(node: Node) -> Callable[[Env], Any]:
    """A function from variables to the value of the expression."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n, MISSING)
    if kind == "list":
        items = [closure(x) for x in node[1]]
        return lambda env: [f(env) for f in items]
    if kind == "dict":
        pairs = [(closure(k), closure(v)) for k, v in node[1]]
        return lambda env: {k(env): v(env) for k, v in pairs}
    if kind == "bin":
        op, a, b = BINARY[node[1]], closure(node[2]), closure(node[3])

        def binary(env: Env) -> Any:
            x, y = a(env), b(env)
            BUDGET.spend(x, y)
            return BUDGET.check(op(x, y))

        return binary
    if kind in ("filter", "test", "call", "method"):
        at = 2 if kind == "call" else 3
        args, named = [closure(x) for x in node[at]], {k: closure(v) for k, v in node[at + 1].items()}
        if kind == "call":
            fn = FUNCTIONS[node[1]]

            def call(env: Env) -> Any:
                BUDGET.spend()
                return fn(*[f(env) for f in args], **{k: f(env) for k, f in named.items()})

            return call
        obj = closure(node[2])
        if kind == "method":
            name = node[1]

            def method(env: Env) -> Any:
                v = obj(env)
                BUDGET.spend(v)
                if isinstance(v, str) and name == "replace":
                    return replaced(v, *[f(env) for f in args])
                if isinstance(v, str) and name in METHODS:
                    return BUDGET.check(getattr(v, name)(*[f(env) for f in args]))
                if isinstance(v, dict) and name == "get":
                    return v.get(*[f(env) for f in args])
                if isinstance(v, dict) and name in ("items", "keys", "values"):
                    return [list(x) if name == "items" else x for x in getattr(v, name)()]
                raise TemplateError(f"no method {name!r} of this value")

            return method
        fn = (FILTERS if kind == "filter" else TESTS)[node[1]]

        def apply(env: Env) -> Any:
            v = obj(env)
            BUDGET.spend(v)
            return BUDGET.check(fn(v, *[f(env) for f in args], **{k: f(env) for k, f in named.items()}))

        return apply
    parts = [closure(x) for x in node[1:]]
    if kind == "item":
        return lambda env: get(parts[0](env), parts[1](env))
    if kind == "slice":
        return lambda env: parts[0](env)[parts[1](env) : parts[2](env) : parts[3](env)]
    if kind == "not":
        return lambda env: not parts[0](env)
    if kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    if kind == "cond":
        return lambda env: parts[1](env) if parts[0](env) else parts[2](env)
    raise TemplateError(f"unknown node {kind!r}")


class Sink:
    """What was rendered so far: pieces, their length and the generated spans."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)
        BUDGET.fit(self.size)


Step = Callable[[Env, Sink], None]


def steps(nodes: list[Node]) -> Step:
    fns = [step(n) for n in nodes]
    if len(fns) == 1:
        return fns[0]

    def run(env: Env, out: Sink) -> None:
        for f in fns:
            f(env, out)

    return run


def step(n: Node) -> Step:
    """A function that renders one statement."""
    if n[0] == "text":
        return lambda env, out, s=n[1]: out.put(s)
    if n[0] == "out":
        value = closure(n[1])
        return lambda env, out: out.put(show(value(env)))
    if n[0] == "if":
        arms = [(closure(t), steps(b)) for t, b in n[1]]

        def choose(env: Env, out: Sink) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, out)

        return choose
    if n[0] == "set":
        value, target = closure(n[2]), n[1]

        def put(env: Env, out: Sink) -> None:
            if len(target) == 1:
                env[target[0]] = value(env)
            elif isinstance(space := env.get(target[0]), Namespace) and len(target) == 2:
                space[target[1]] = value(env)
            else:
                raise TemplateError("only attributes of a namespace can be set")

        return put
    if n[0] == "generation":
        body = steps(n[1])

        def mark(env: Env, out: Sink) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return mark
    _, names, over, test, inner, other = n
    items, ok, body, empty = closure(over), closure(test) if test else None, steps(inner), steps(other)

    def loop(env: Env, out: Sink) -> None:
        seq = list(items(env))
        bind = (lambda e, x: e.__setitem__(names[0], x)) if len(names) == 1 else (lambda e, x: e.update(zip(names, x, strict=True)))
        if ok:
            kept = []
            for x in seq:
                BUDGET.spend()
                own = dict(env)
                bind(own, x)
                if ok(own):
                    kept.append(x)
            seq = kept
        for i, x in enumerate(seq):
            BUDGET.spend(env)
            own = dict(env)  # what a loop sets stays in it
            bind(own, x)
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(seq) - 1, "length": len(seq), "revindex": len(seq) - i, "previtem": seq[i - 1] if i else MISSING, "nextitem": seq[i + 1] if i + 1 < len(seq) else MISSING}
            body(own, out)
        if not seq:
            empty(env, out)

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        with BUDGET.of(len(source), 0):
            try:
                self.tree = fold_block(parse(source))
                self.run = steps(self.tree)
            except RecursionError:
                raise TemplateError("the template is nested too deeply") from None

    def render(self, messages: list[dict[str, Any]], **variables: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Sink()
        with BUDGET.of(sum(len(v) for m in messages for v in m.values() if isinstance(v, str)), len(messages)):
            self.run({**variables, "messages": messages}, out)
        return "".join(out.parts), out.spans


@lru_cache(64)
def compiled(source: str) -> Template:
    return Template(source)


def format_chats(turns: DataFrame, template: str = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **variables: Any) -> DataFrame:
    """(conv_id, text, spans) of every conversation of turns."""
    compiled(template)  # errors show before a job runs
    src = B.narrow(turns, id=id_col, turn=turn_col, role=role_col, text=text_col)
    convs = src.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    convs = convs.select("id", F.transform("m", lambda x: x["role"].cast("string")).alias("roles"), F.transform("m", lambda x: x["text"].cast("string")).alias("texts"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(template)
        for b in batches:
            made = [t.render([{"role": r or "", "text": x or ""} for r, x in zip(rs, xs)], **variables) for rs, xs in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            spans = pa.array([[{"start": s, "stop": e} for s, e in m[1]] for m in made], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), spans], names=["conv_id", "text", "spans"])

    return convs.mapInArrow(run, f"conv_id {src.schema['id'].dataType.simpleString()}, text string, spans array<struct<start:int,stop:int>>")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as rendered text; generated: spans as 'start-stop,..'."""
    done = format_chats(B.table(spark, sf_dir, "conversations"))
    marks = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")
    return done.select("conv_id", "text", marks.alias("generated"))


OP4_SQL = """
with m as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as k, '<|im_start|>' || role || chr(10) as head, text || '<|im_end|>' as body from conversations
), o as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint + length(head) as s from m
)
select conv_id, string_agg(head || body || chr(10), '' order by k) as text,
  coalesce(string_agg(case when role = 'assistant' then s || '-' || (s + length(body)) end, ',' order by k), '') as generated
from o group by conv_id
"""

"""The search query language: text to tree, tree to text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from tessera.functions.text import STOP_WORDS, words


class QueryError(ValueError):
    """A query that cannot be read or does not fit its index."""


@dataclass(frozen=True)
class Term:
    """A search word; edits: allowed edits of a fuzzy one."""

    text: str
    prefix: bool = False
    edits: int = 0
    optional: bool = False

    @property
    def plain(self) -> bool:
        return not self.prefix and not self.edits


@dataclass(frozen=True)
class Node:
    """kind: ALL, TAG, NUMERIC, TEXT, PHRASE, GEO, SHAPE, AND, OR, NOT, MAYBE."""

    kind: str
    field: str = ""
    children: tuple[Node, ...] = ()
    values: tuple[str, ...] = ()
    terms: tuple[Term, ...] = ()
    low: float = float("-inf")
    high: float = float("inf")
    open_low: bool = False
    open_high: bool = False
    circle: tuple[float, float, float, str] | None = None
    relation: str = ""
    param: str = ""


@dataclass(frozen=True)
class Knn:
    k: int
    field: str
    param: str


@dataclass(frozen=True)
class Query:
    root: Node
    knn: Knn | None = None
    stop: frozenset[str] = field(default=STOP_WORDS, compare=False)


RELATIONS = ("WITHIN", "CONTAINS", "INTERSECTS", "DISJOINT")
_EDGE = re.compile(r"^(\(?)([-+]?(?:inf|\d+\.?\d*(?:e[-+]?\d+)?|\.\d+(?:e[-+]?\d+)?))$", re.I)
_STOP_AT = frozenset(" \t)|=")


def parse_query(text: str, stop: frozenset[str] = STOP_WORDS) -> Query:
    """The tree of a query, and its nearest-neighbour clause if it has one."""
    body, arrow, tail = text.partition("=>")
    reader = _Reader(body, stop)
    root = reader.either()
    reader.blank()
    if reader.at < len(body):
        raise QueryError(f"unexpected {body[reader.at:]!r}")
    return Query(root, _parse_knn(tail) if arrow else None, stop)


def _parse_knn(text: str) -> Knn:
    m = re.fullmatch(r"\s*\[\s*(?:KNN|knn)\s+(\d+)\s+@(\S+)\s+\$(\S+?)\s*\]\s*", text)
    if not m or int(m[1]) <= 0:
        raise QueryError("expected [KNN k @field $param]")
    return Knn(int(m[1]), m[2], m[3])


class _Reader:
    def __init__(self, text: str, stop: frozenset[str]):
        self.text, self.at, self.stop = text, 0, stop

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def blank(self) -> None:
        while self.peek() in (" ", "\t"):
            self.at += 1

    def until(self, end: str, what: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise QueryError(f"unclosed {what}")
        got, self.at = self.text[self.at : stop], stop + 1
        return got

    def either(self) -> Node:
        arms = [self.both()]
        self.blank()
        while self.peek() == "|":
            self.at += 1
            arms.append(self.both())
            self.blank()
        return arms[0] if len(arms) == 1 else Node("OR", children=tuple(arms))

    def both(self) -> Node:
        parts = []
        self.blank()
        while self.peek() not in ("", ")", "|"):
            parts.append(self.signed())
            self.blank()
        if not parts:
            raise QueryError("a term is expected")
        return parts[0] if len(parts) == 1 else Node("AND", children=tuple(parts))

    def signed(self) -> Node:
        c = self.peek()
        if c == "-":
            self.at += 1
            return Node("NOT", children=(self.signed(),))
        if c == "~":
            self.at += 1
            return Node("MAYBE", children=(self.primary(),))
        return self.primary()

    def primary(self) -> Node:
        self.blank()
        c = self.peek()
        if c == "(":
            self.at += 1
            node = self.either()
            self.blank()
            if self.peek() != ")":
                raise QueryError("unclosed (")
            self.at += 1
            return node
        if c == "*":
            self.at += 1
            return Node("ALL")
        if c == "@":
            self.at += 1
            name = self.until(":", "field name")
            if not name:
                raise QueryError("an empty field name")
            return self.leaf(name)
        if c == '"':
            return self.phrase("")
        if c and (c == "%" or (c.isascii() and c.isalnum())):
            return Node("TEXT", terms=self.terms(self.run()))
        raise QueryError(f"unexpected {c!r}" if c else "the query ends too early")

    def run(self) -> str:
        start = self.at
        while self.peek() and self.peek() not in _STOP_AT:
            self.at += 1
        return self.text[start : self.at]

    def phrase(self, name: str) -> Node:
        self.at += 1
        got = words(self.until('"', "quote"))
        if not got:
            raise QueryError("an empty phrase")
        return Node("PHRASE", name, terms=tuple(map(Term, got)))

    def terms(self, body: str) -> tuple[Term, ...]:
        out: list[Term] = []
        for raw in body.replace("\t", " ").split(" "):
            optional = raw.startswith("~")
            raw, edits = raw[optional:], 0
            while edits < 3 and len(raw) >= 2 and raw[0] == raw[-1] == "%":
                raw, edits = raw[1:-1], edits + 1
            prefix = raw.endswith("*")
            base = (raw[:-1] if prefix else raw).lower()
            if not base:
                continue
            if prefix or edits or optional:
                out.append(Term(base, prefix, edits, optional))
            else:
                out.extend(map(Term, words(base, self.stop)))
        return tuple(out)

    def leaf(self, name: str) -> Node:
        c = self.peek()
        if c == "{":
            self.at += 1
            values = tuple(v.strip() for v in self.until("}", "{").split("|"))
            if not any(values):
                raise QueryError("an empty tag list")
            return Node("TAG", name, values=tuple(v for v in values if v))
        if c == "[":
            self.at += 1
            return self.bracket(name, self.until("]", "[").split())
        if c == '"':
            return self.phrase(name)
        if c == "(":
            depth, start = 1, self.at + 1
            for i in range(start, len(self.text)):
                depth += {"(": 1, ")": -1}.get(self.text[i], 0)
                if not depth:
                    self.at = i + 1
                    got = self.terms(self.text[start:i])
                    if not got:
                        raise QueryError("an empty text query")
                    return Node("TEXT", name, terms=got)
            raise QueryError("unclosed (")
        raw = self.run()
        if not raw:
            raise QueryError(f"nothing follows @{name}:")
        return Node("TEXT", name, terms=self.terms(raw))

    def bracket(self, name: str, parts: list[str]) -> Node:
        if len(parts) == 2 and parts[0].upper() in RELATIONS and parts[1].startswith("$"):
            return Node("SHAPE", name, relation=parts[0].upper(), param=parts[1][1:])
        if len(parts) == 4:
            try:
                lon, lat, radius = map(float, parts[:3])
            except ValueError:
                raise QueryError(f"cannot read [{' '.join(parts)}]") from None
            if parts[3].lower() not in ("m", "km", "mi", "ft"):
                raise QueryError(f"unknown unit {parts[3]!r}")
            return Node("GEO", name, circle=(lon, lat, radius, parts[3].lower()))
        edges = [_EDGE.match(p) for p in parts]
        if len(parts) != 2 or not all(edges):
            raise QueryError(f"cannot read [{' '.join(parts)}]")
        (a, b) = edges
        return Node("NUMERIC", name, low=float(a[2]), high=float(b[2]), open_low=bool(a[1]), open_high=bool(b[1]))


def plain_terms(node: Node) -> list[str]:
    """The words of all text leaves, those under NOT too."""
    out = [t.text for t in node.terms]
    for c in node.children:
        out += plain_terms(c)
    return out


def simplify(node: Node) -> Node:
    """An equal tree: nested AND and OR flattened, NOT pushed to the leaves, ranges of one
    field in one AND merged, cheap conjuncts first. Only for queries that keep no score."""
    kids = tuple(simplify(c) for c in node.children)
    if node.kind == "NOT":
        (c,) = kids
        if c.kind == "NOT":
            return c.children[0]
        if c.kind in ("AND", "OR"):
            return simplify(Node("OR" if c.kind == "AND" else "AND", children=tuple(Node("NOT", children=(x,)) for x in c.children)))
        return Node("NOT", children=(c,))
    if node.kind in ("AND", "OR"):
        flat: list[Node] = []
        for c in kids:
            flat += c.children if c.kind == node.kind else (c,)
        if node.kind == "AND":
            flat = sorted(_merge_ranges(flat), key=lambda c: _COST.get(c.kind, 5))
        return flat[0] if len(flat) == 1 else Node(node.kind, children=tuple(flat))
    return replace(node, children=kids)


_COST = {"NUMERIC": 0, "TAG": 1, "ALL": 0, "GEO": 2, "TEXT": 3, "PHRASE": 4, "SHAPE": 9}


def _merge_ranges(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    at: dict[str, int] = {}
    for n in nodes:
        if n.kind != "NUMERIC" or n.field not in at:
            if n.kind == "NUMERIC":
                at[n.field] = len(out)
            out.append(n)
            continue
        o = out[at[n.field]]
        low, open_low = max((o.low, o.open_low), (n.low, n.open_low))
        high, shut = min((o.high, not o.open_high), (n.high, not n.open_high))
        out[at[n.field]] = replace(o, low=low, open_low=open_low, high=high, open_high=not shut)
    return out


def explain(query: Query) -> str:
    """The tree as indented text, a node a line."""
    lines: list[str] = []

    def show(n: Node, depth: int) -> None:
        f = f" @{n.field}" if n.field else ""
        text = {
            "ALL": lambda: "*",
            "TAG": lambda: f"TAG{f}:{{{' | '.join(n.values)}}}",
            "NUMERIC": lambda: f"NUMERIC{f}:[{'(' * n.open_low}{n.low:.6f} {'(' * n.open_high}{n.high:.6f}]",
            "TEXT": lambda: f"TEXT{f}:" + "".join(f" {t.text}" for t in n.terms),
            "PHRASE": lambda: f"TEXT{f} PHRASE:" + "".join(f" {t.text}" for t in n.terms),
            "GEO": lambda: f"GEO{f}:[" + " ".join(f"{v:.6f}" for v in n.circle[:3]) + "]",
            "SHAPE": lambda: f"GEOSHAPE{f}:[{n.relation} ${n.param}]",
            "MAYBE": lambda: "OPTIONAL",
        }.get(n.kind, lambda: n.kind)()
        lines.append("  " * depth + text)
        for c in n.children:
            show(c, depth + 1)

    show(query.root, 0)
    if query.knn:
        lines.append(f"KNN k={query.knn.k} @{query.knn.field} ${query.knn.param}")
    return "\n".join(lines)

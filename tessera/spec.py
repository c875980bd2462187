"""Schemas, indexes and the catalogue that names them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lists import TextLists, write_lists

TYPES = ("TAG", "NUMERIC", "TEXT", "GEO", "GEOSHAPE", "VECTOR")
CONFIG_DEFAULTS = {"MAXEXPANSIONS": "200", "MINPREFIX": "2", "TIMEOUT": "500", "MAXSEARCHRESULTS": "1000000"}


class SchemaError(ValueError):
    """A definition or document that the catalogue refuses."""


@dataclass(frozen=True)
class Field:
    """A declared field. The flags after type are kept and reported; weight, phonetic and
    custom stop words only act where a search opts in."""

    name: str
    type: str
    sortable: bool = False
    noindex: bool = False
    nostem: bool = False
    weight: float = 1.0
    phonetic: str | None = None
    algorithm: str = "FLAT"
    dim: int = 0
    metric: str = "L2"
    m: int = 16
    ef_construction: int = 200
    path: str | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise SchemaError(f"unknown field type {self.type!r}")
        if self.type == "VECTOR" and (self.dim <= 0 or self.metric not in ("L2", "COSINE", "IP") or self.algorithm not in ("FLAT", "HNSW")):
            raise SchemaError(f"bad vector field {self.name!r}")


@dataclass(frozen=True)
class Spec:
    """An index definition."""

    name: str
    fields: tuple[Field, ...]
    on: str = "HASH"
    prefixes: tuple[str, ...] = ()
    language: str = "english"
    stopwords: tuple[str, ...] | None = None
    flags: tuple[str, ...] = ()
    temporary: int | None = None

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise SchemaError("duplicate field")
        if not names:
            raise SchemaError("no fields")

    def field(self, name: str, *types: str) -> Field:
        for f in self.fields:
            if f.name == name:
                if types and f.type not in types:
                    raise SchemaError(f"field {name!r} is {f.type}, not {' or '.join(types)}")
                return f
        raise SchemaError(f"no field {name!r}")

    def of(self, kind: str) -> list[Field]:
        return [f for f in self.fields if f.type == kind]

    @staticmethod
    def parse(args: Sequence[str]) -> Spec:
        """From the words of a definition: name, options, SCHEMA, fields with attributes."""
        words, i = list(map(str, args)), 1
        if not words:
            raise SchemaError("a name is expected")
        opts: dict[str, object] = {"name": words[0]}
        flags = []

        def take() -> str:
            nonlocal i
            if i >= len(words):
                raise SchemaError("the definition ends too early")
            i += 1
            return words[i - 1]

        def count() -> list[str]:
            n = take()
            if not n.isdigit():
                raise SchemaError(f"a count is expected, not {n!r}")
            return [take() for _ in range(int(n))]

        while (w := take().upper()) != "SCHEMA":
            if w == "ON":
                opts["on"] = take().upper()
                if opts["on"] not in ("HASH", "JSON"):
                    raise SchemaError("ON takes HASH or JSON")
            elif w == "PREFIX":
                opts["prefixes"] = tuple(count())
            elif w == "LANGUAGE":
                opts["language"] = take().lower()
            elif w == "STOPWORDS":
                opts["stopwords"] = tuple(count())
            elif w == "TEMPORARY":
                opts["temporary"] = int(take())
            elif w in ("NOFREQS", "NOOFFSETS", "NOHL", "MAXTEXTFIELDS"):
                flags.append(w)
            else:
                raise SchemaError(f"unknown option {w!r}")
        return Spec(fields=tuple(_fields(words[i:])), flags=tuple(flags), **opts)  # type: ignore[arg-type]


def _fields(words: list[str]) -> list[Field]:
    out, i = [], 0
    while i < len(words):
        name, path = words[i], None
        if i + 2 < len(words) and words[i + 1].upper() == "AS":
            path, name = name, words[i + 2]
            i += 2
        if i + 1 >= len(words):
            raise SchemaError(f"no type for field {name!r}")
        kind, i = words[i + 1].upper(), i + 2
        got: dict[str, object] = {}
        if kind == "VECTOR":
            if i + 1 >= len(words) or not words[i + 1].isdigit():
                raise SchemaError("a vector field takes an algorithm and a count of attributes")
            got["algorithm"] = words[i].upper()
            n, i = int(words[i + 1]), i + 2
            pairs = dict(zip((w.upper() for w in words[i : i + n : 2]), words[i + 1 : i + n : 2]))
            i += n
            got |= {own: int(pairs[k]) for k, own in (("DIM", "dim"), ("M", "m"), ("EF_CONSTRUCTION", "ef_construction")) if k in pairs}
            got["metric"] = pairs.get("DISTANCE_METRIC", "L2").upper()
        while i < len(words):
            w = words[i].upper()
            if w in ("SORTABLE", "NOINDEX", "NOSTEM"):
                got[w.lower()] = True
            elif w in ("WEIGHT", "PHONETIC") and i + 1 < len(words):
                i += 1
                got[w.lower()] = float(words[i]) if w == "WEIGHT" else words[i]
            else:
                break
            i += 1
        out.append(Field(name, kind, path=path, **got))  # type: ignore[arg-type]
    return out


def typed(df: DataFrame, spec: Spec, guard: bool = True) -> DataFrame:
    """doc_id and one typed column for each field; what cannot be read is null.

    Without guard, numbers that are no finite ones and vectors of another length stay: the
    columns are then those of the source, so that predicates on them reach its scan."""

    def col(f: Field) -> Column:
        c, kind = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        if f.type == "NUMERIC":
            d = c.try_cast("double") if isinstance(kind, T.StringType) else c.cast("double")
            return finite(d) if isinstance(kind, T.StringType) or guard and isinstance(kind, (T.FloatType, T.DoubleType)) else d
        if f.type == "VECTOR":
            v = c.cast("array<float>")
            return F.when(F.size(v) == f.dim, v) if guard else v
        if f.type == "TAG" and isinstance(kind, T.ArrayType):
            return c.cast("array<string>")
        return c.cast("string")

    have = set(df.columns)
    return df.select("doc_id", *[(col(f) if f.name in have else F.lit(None).cast("string")).alias(f.name) for f in spec.fields])


def whole_numbers(df: DataFrame, spec: Spec) -> frozenset[str]:
    """The NUMERIC fields whose type has finite numbers only."""
    have = set(df.columns)
    return frozenset(f.name for f in spec.of("NUMERIC") if f.name in have and isinstance(df.schema[f.name].dataType, (T.IntegralType, T.DecimalType)))


def finite(d: Column) -> Column:
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


@dataclass
class Index:
    """A definition with the frame that holds its documents, keyed by doc_id.

    scan has the same documents without the guards of ``typed``; whole names the numbers that
    need none; text has stored lists."""

    spec: Spec
    docs: DataFrame
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    stats: dict[object, object] = field(default_factory=dict)
    scan: DataFrame | None = None
    whole: frozenset[str] = frozenset()
    text: TextLists | None = None

    def with_docs(self, docs: DataFrame) -> Index:
        return Index(self.spec, docs, self.synonyms)

    def guarded(self, rows: DataFrame) -> DataFrame:
        """Rows of scan, with whatever other columns, as documents."""
        if self.scan is None:
            return rows
        numbers = {f.name: finite(F.col(f"`{f.name}`")) for f in self.spec.of("NUMERIC") if isinstance(self.scan.schema[f.name].dataType, T.DoubleType)}
        vectors = {f.name: F.when(F.size(F.col(f"`{f.name}`")) == f.dim, F.col(f"`{f.name}`")) for f in self.spec.of("VECTOR") if isinstance(self.scan.schema[f.name].dataType, T.ArrayType)}
        return rows.withColumns(numbers | vectors) if numbers or vectors else rows


class Catalog:
    """Indexes and aliases of a session; every index is a temporary view too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.indexes: dict[str, Index] = {}
        self.aliases: dict[str, str] = {}
        self.dictionaries: dict[str, set[str]] = {}
        self.config = dict(CONFIG_DEFAULTS)

    def resolve(self, name: str) -> Index:
        name = self.aliases.get(name, name)
        if name not in self.indexes:
            raise SchemaError(f"no index {name!r}")
        return self.indexes[name]

    def create(self, spec: Spec | Sequence[str], source: DataFrame | None = None, store: str | None = None) -> Index:
        """A new index over source, a frame with doc_id; only keys with one of the prefixes.

        With store, a path that all machines see, the inverted lists of its text fields are
        written there and searches read them; changed documents are searched without them."""
        spec = spec if isinstance(spec, Spec) else Spec.parse(spec)
        if spec.name in self.indexes:
            raise SchemaError(f"index {spec.name!r} exists")
        if source is None:
            kinds = {"NUMERIC": "double", "VECTOR": "array<float>"}
            source = self.spark.createDataFrame([], ", ".join(["doc_id string", *(f"`{f.name}` {kinds.get(f.type, 'string')}" for f in spec.fields)]))
        elif spec.prefixes:
            source = source.where(has_prefix(F.col("doc_id").cast("string"), spec.prefixes))
        index = self.indexes[spec.name] = Index(spec, typed(source, spec), scan=typed(source, spec, False), whole=whole_numbers(source, spec))
        if store:
            index.text = write_lists(index.docs, [f.name for f in spec.of("TEXT")], store)
        index.docs.createOrReplaceTempView(f"`{spec.name}`")
        return index

    def drop(self, name: str) -> None:
        own = self.resolve(name).spec.name
        del self.indexes[own]
        self.aliases = {a: t for a, t in self.aliases.items() if t != own}
        self.spark.catalog.dropTempView(own)

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names()], "name string")

    def info(self, name: str) -> DataFrame:
        """One row: name, number of documents, language, prefixes, fields."""
        index = self.resolve(name)
        s = index.spec
        fields = [{k: v for k, v in asdict(f).items() if v not in (None, False)} for f in s.fields]
        return index.docs.agg(F.count(F.lit(1)).alias("num_docs")).select(
            F.lit(s.name).alias("index_name"), "num_docs", F.lit(s.language).alias("language"), F.lit(",".join(s.prefixes)).alias("prefixes"), F.lit(json.dumps(fields)).alias("fields")
        )

    def put(self, name: str, docs: DataFrame) -> Index:
        """Replaces whole documents by id; the last of equal ids by column seq, if there is one."""
        index = self.indexes.get(name)
        if index is None:
            raise SchemaError(f"no index {name!r}")
        known = {f.name for f in index.spec.fields} | {"doc_id", "seq"}
        if extra := [c for c in docs.columns if c not in known]:
            raise SchemaError(f"no field {extra[0]!r}")
        from tessera.sources.store import upsert

        latest = upsert(None, docs) if "seq" in docs.columns else docs
        return self._swap(index, upsert(index.docs, typed(latest, index.spec)))

    def delete(self, name: str, ids: DataFrame | Sequence[object]) -> Index:
        index = self.resolve(name)
        if not isinstance(ids, DataFrame):
            kind = index.docs.schema["doc_id"].dataType
            ids = self.spark.createDataFrame([(x,) for x in ids], T.StructType([T.StructField("doc_id", kind)]))
        return self._swap(index, index.docs.join(ids, "doc_id", "left_anti"))

    def _swap(self, index: Index, docs: DataFrame) -> Index:
        new = self.indexes[index.spec.name] = index.with_docs(docs)
        docs.createOrReplaceTempView(f"`{index.spec.name}`")
        return new

    def alter(self, name: str, fields: Sequence[str | Field], source: DataFrame | None = None) -> Index:
        """Adds fields; with a source, its documents are read again."""
        index = self.resolve(name)
        new = [f for f in fields if isinstance(f, Field)] or _fields([str(w) for w in fields])
        if bad := [f for f in new if f.type not in ("TAG", "NUMERIC", "TEXT", "GEO")]:
            raise SchemaError(f"cannot add a {bad[0].type} field")
        spec = replace(index.spec, fields=(*index.spec.fields, *new))
        base = index.docs
        if source is not None:
            base = source.where(has_prefix(F.col("doc_id").cast("string"), spec.prefixes)) if spec.prefixes else source
        self.indexes[spec.name] = Index(spec, typed(base, spec), index.synonyms, scan=typed(base, spec, False), whole=whole_numbers(base, spec))
        return self.indexes[spec.name]

    def alias(self, alias: str, name: str, update: bool = False) -> None:
        if not update and alias in self.aliases:
            raise SchemaError(f"alias {alias!r} exists")
        own = self.resolve(name).spec.name
        self.aliases[alias] = own
        self.indexes[own].docs.createOrReplaceTempView(f"`{alias}`")

    def unalias(self, alias: str) -> None:
        if self.aliases.pop(alias, None) is None:
            raise SchemaError(f"no alias {alias!r}")
        self.spark.catalog.dropTempView(alias)

    def tag_values(self, name: str, field_name: str) -> DataFrame:
        index = self.resolve(name)
        index.spec.field(field_name, "TAG")
        c = F.col(f"`{field_name}`")
        if isinstance(index.docs.schema[field_name].dataType, T.ArrayType):
            c = F.explode(c)
        return index.docs.select(c.alias("value")).where("value is not null").distinct().orderBy("value")

    def get_config(self, key: str = "*") -> Mapping[str, str]:
        return dict(self.config) if key == "*" else {key: self.config[key]}

    def set_config(self, key: str, value: str) -> None:
        if key.upper() not in self.config:
            raise SchemaError(f"no setting {key!r}")
        self.config[key.upper()] = str(value)

    def ping(self) -> DataFrame:
        return self.spark.createDataFrame([("OK",)], "status string")


def has_prefix(key: Column, prefixes: Sequence[str]) -> Column:
    """Whether the key begins with any of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | key.startswith(p)
    return found

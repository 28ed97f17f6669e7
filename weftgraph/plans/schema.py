"""Schemas: property types by label, validation modes, inference, and the statements that change them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import values as V
from weftgraph.plans.gql_parser import GqlError, Parser

TYPES = {"ANY", "BOOL", "INT", "FLOAT", "STRING", "LIST", "MAP"}
_KINDS = {"BOOL": "b", "INT": "i", "FLOAT": "d", "STRING": "s", "LIST": "l", "MAP": "m"}


class SchemaError(ValueError):
    """Rows or a statement break the schema."""


class Mode(Enum):
    NONE = "none"
    WARN = "warn"
    STRICT = "strict"
    CLOSED = "closed"


@dataclass(frozen=True)
class PropertyDef:
    name: str
    type: str = "ANY"
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class ElementType:
    label: str
    properties: dict = field(default_factory=dict)
    sources: tuple = ()  # of edges: labels that they may leave and enter
    targets: tuple = ()


@dataclass(frozen=True)
class Schema:
    nodes: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)
    mode: Mode = Mode.NONE

    def node(self, label: str, *properties: PropertyDef) -> Schema:
        return replace(self, nodes={**self.nodes, label: ElementType(label, {p.name: p for p in properties})})

    def edge(self, label: str, sources=(), targets=(), *properties: PropertyDef) -> Schema:
        return replace(self, edges={**self.edges, label: ElementType(label, {p.name: p for p in properties}, tuple(sources), tuple(targets))})

    def with_mode(self, mode: Mode) -> Schema:
        return replace(self, mode=mode)


def fits(c: Column, dtype, wanted: str) -> Column:
    """Whether a non-null value has the type; ANY takes all but null."""
    base = wanted.split("<")[0]
    if base == "ANY":
        return c.isNotNull()
    k = V.kind(dtype)
    if k == "t":
        return F.coalesce(c["t"] == {"INT": 0, "FLOAT": 1, "STRING": 2, "BOOL": 3}.get(base, -1), F.lit(False))
    return F.lit(k == _KINDS[base]) & c.isNotNull()


def problems(graph, schema: Schema) -> DataFrame:
    """(element, label, id, problem) for every broken rule, as one plan."""
    parts = []
    for element, tables, types in (("v", graph.vertices, schema.nodes), ("e", graph.edges, schema.edges)):
        for label, df in tables.items():
            if label not in types:
                if schema.mode is Mode.CLOSED:
                    parts.append(df.select(F.lit(element).alias("element"), F.lit(label).alias("label"), F.col("id"), F.lit("unknown label").alias("problem")))
                continue
            t = types[label]
            own = {f.name: f.dataType for f in df.schema.fields}
            tests = []
            for p in t.properties.values():
                if p.name not in own:
                    if p.required:
                        tests.append((F.lit(True), f"{p.name} is missing"))
                    continue
                c = F.col(f"`{p.name}`")
                if p.required:
                    tests.append((c.isNull(), f"{p.name} is missing"))
                tests.append((c.isNotNull() & ~fits(c, own[p.name], p.type), f"{p.name} isn't {p.type}"))
            if schema.mode is Mode.CLOSED:
                tests += [(F.col(f"`{k}`").isNotNull(), f"{k} isn't in the schema") for k in own if k not in t.properties and k not in ("id", "src", "dst", "__keys")]
            rows = df
            if element == "e" and (t.sources or t.targets):
                v = graph.view("v").select("id", "label")
                rows = rows.join(v.select(F.col("id").alias("src"), F.col("label").alias("__from")), "src", "left").join(v.select(F.col("id").alias("dst"), F.col("label").alias("__to")), "dst", "left")
                if t.sources:
                    tests.append((~F.coalesce(F.col("__from").isin(*t.sources), F.lit(False)), "it leaves a vertex of a wrong label"))
                if t.targets:
                    tests.append((~F.coalesce(F.col("__to").isin(*t.targets), F.lit(False)), "it enters a vertex of a wrong label"))
            if tests:
                found = F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in tests)), lambda x: x.isNotNull())
                parts.append(rows.select(F.lit(element).alias("element"), F.lit(label).alias("label"), F.col("id"), F.explode(found).alias("problem")))
    if not parts:
        return graph.spark.createDataFrame([], "element string, label string, id long, problem string")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def enforce(graph) -> DataFrame | None:
    """Problems in WARN mode; an error in STRICT and CLOSED; nothing in NONE. Unique indexes hold in all modes."""
    for spec in graph.indexes.values():
        if spec.kind == "unique":
            check_unique(graph, spec)
    if graph.schema is None or graph.schema.mode is Mode.NONE:
        return None
    found = problems(graph, graph.schema)
    if graph.schema.mode is Mode.WARN:
        return found
    first = found.limit(5).collect()
    if first:
        raise SchemaError("; ".join(f"{r.label} {r.id}: {r.problem}" for r in first))
    return None


def infer(graph) -> Schema:
    """The schema that the tables have; a property without a null is required."""
    out = Schema()
    for element, tables in (("v", graph.vertices), ("e", graph.edges)):
        for label, df in tables.items():
            keys = [f for f in df.schema.fields if f.name not in ("id", "src", "dst", "__keys")]
            row = df.agg(F.count("*").alias("__n"), *(F.count(f"`{f.name}`").alias(f.name) for f in keys)).first()
            names = {"i": "INT", "d": "FLOAT", "s": "STRING", "b": "BOOL", "l": "LIST", "m": "MAP"}
            defs = [PropertyDef(f.name, names.get(V.kind(f.dataType), "ANY"), row[f.name] == row["__n"] and row["__n"] > 0) for f in keys]
            out = out.node(label, *defs) if element == "v" else out.edge(label, (), (), *defs)
    return out


@dataclass(frozen=True)
class IndexSpec:
    """A layout of the stored graph (sorted by the key, so that equality and range filters read few files) and,
    if unique, a constraint that every change is held to; results never depend on it."""

    name: str
    kind: str  # btree, unique, rtree
    label: str | None
    key: str


def check_unique(graph, spec: IndexSpec) -> None:
    view = graph.view("v", frozenset([spec.label]) if spec.label else None)
    if spec.key not in view.columns:
        return
    twice = view.filter(F.col(f"`{spec.key}`").isNotNull()).groupBy(f"`{spec.key}`").count().filter("count > 1").limit(1).collect()
    if twice:
        raise SchemaError(f"{spec.key} isn't unique: {twice[0][0]}")


# -- statements --------------------------------------------------------------------------------


def run_ddl(graph, text: str):
    """Apply one statement; a new graph."""
    p = Parser(text)
    schema = graph.schema or Schema()
    if p.take("SET"):
        for w in ("SCHEMA", "VALIDATION"):
            p.need(w)
        return replace(graph, schema=schema.with_mode(Mode(p.name().lower())))
    verb = p.need("CREATE", "ALTER", "DROP").upper()
    kind = "btree"
    if p.word("UNIQUE", "RTREE"):
        kind = p.name().lower()
    if p.take("INDEX"):
        return _index(graph, p, verb, kind)
    element = p.need("NODE", "EDGE").upper()
    p.need("TYPE")
    label = p.name()
    table = dict(schema.nodes if element == "NODE" else schema.edges)
    if verb == "DROP":
        if label not in table:
            raise SchemaError(f"no type {label}")
        del table[label]
    elif verb == "CREATE":
        if label in table:
            raise SchemaError(f"type {label} exists")
        t = ElementType(label, {d.name: d for d in _definitions(p)})
        sources = targets = ()
        if element == "EDGE" and p.take("FROM"):
            sources = tuple(p.names())
            p.need("TO")
            targets = tuple(p.names())
        table[label] = replace(t, sources=sources, targets=targets)
    else:
        if label not in table:
            raise SchemaError(f"no type {label}")
        t = table[label]
        if p.take("ALLOW"):
            p.need("ADDITIONAL")
            p.need("PROPERTIES")
        elif p.take("ADD"):
            d = _definition(p)
            t = replace(t, properties={**t.properties, d.name: d})
        else:
            p.need("DROP")
            name = p.name()
            t = replace(t, properties={k: v for k, v in t.properties.items() if k != name})
        table[label] = t
    if not p.done():
        raise GqlError(f"unexpected {p.peek()[1]!r}")
    return replace(graph, schema=replace(schema, nodes=table) if element == "NODE" else replace(schema, edges=table))


def _index(graph, p: Parser, verb: str, kind: str):
    name = p.name()
    if verb == "DROP":
        return replace(graph, indexes={k: v for k, v in graph.indexes.items() if k != name})
    p.need("ON")
    p.take(":")
    label = None
    if not p.sign("("):
        label = p.name()
    p.need("(")
    key = p.name()
    p.need(")")
    spec = IndexSpec(name, kind, label, key)
    if kind == "unique":
        check_unique(graph, spec)
    return replace(graph, indexes={**graph.indexes, name: spec})


def _definitions(p: Parser) -> list[PropertyDef]:
    out = []
    if p.take("("):
        while not p.sign(")"):
            out.append(_definition(p))
            p.take(",")
        p.need(")")
    return out


def _definition(p: Parser) -> PropertyDef:
    name, kind = p.name(), p.name().upper()
    if kind not in TYPES:
        raise GqlError(f"unknown type {kind}")
    if p.take("<"):
        inner = p.name().upper()
        p.need(">")
        kind = f"{kind}<{inner}>"
    required, default = False, None
    while True:
        if p.take("NOT"):
            p.need("NULL")
            required = True
        elif p.take("REQUIRED"):
            required = True
        elif p.take("DEFAULT"):
            e = p.expression()
            default = -e[1][1] if e[0] == "minus" else e[1]
        else:
            return PropertyDef(name, kind, required, default)


def defaults(schema: Schema | None, label: str, given: dict, element: str = "v") -> dict:
    """The properties with the schema's defaults filled in."""
    t = (schema.nodes if element == "v" else schema.edges).get(label) if schema else None
    return {**{k: d.default for k, d in t.properties.items() if d.default is not None}, **given} if t else given


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]{0,63}")

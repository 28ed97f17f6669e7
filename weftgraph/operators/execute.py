"""Lowering of traversals to DataFrames.

A state is a frame with one row for each traverser. Its current element or value is in fixed columns;
everything else that later steps may want (order, bound labels, path, origin of a nested traversal) is
carried beside it. Navigation is an equi-join with an edge view, property access a join with a vertex
view; both are unions of typed tables, of which Catalyst reads the columns and labels that are used.

Nested traversals never run row by row: they run once over the distinct origins (the current element and
the labels they refer to) and come back by semi-join, anti-join or aggregate on the origin. Barriers inside them
are windows or groupings by origin.

Order columns exist only if some later step can observe the encounter order. Where it can't, and neither
paths nor labels are asked for, traversers at the same vertex are merged into one with a bulk
between hops, so counts of many hops don't expand to all walks.
"""

from __future__ import annotations

import itertools
import random
import time
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V
from weftgraph.functions.mathexpr import compile_math, names
from weftgraph.functions.predicates import P
from weftgraph.plans.traversal import Step, Traversal

ORDER_SENSITIVE = {"limit", "skip", "range", "tail", "dedup", "fold", "index", "order", "store", "aggregate", "group", "path"}
BULK_SAFE = {"out", "in", "both", "hasLabel", "has", "hasNot", "hasId", "dedup", "count", "groupCount"}
HOPS = {"out", "in", "both"}
_fresh = itertools.count()


def fresh(stem: str) -> str:
    return f"_{stem}{next(_fresh)}"


@dataclass
class State:
    graph: object
    df: DataFrame
    kind: str  # v, e or x
    vtype: T.DataType | None = None  # of _val
    labels: frozenset | None = None  # of the current element, where known
    loaded: bool = False  # properties of the current element are columns p:<key>
    origin: list = field(default_factory=list)
    keys: DataFrame | None = None  # all origins, for results of empty groups
    order: list = field(default_factory=list)  # (column, descending)
    binds: dict = field(default_factory=dict)  # label: [(column, kind, type)]
    path: bool = False
    bulk: bool = False
    need_order: bool = False
    seed: int | None = None
    effects: dict = field(default_factory=dict)
    names: list | None = None  # of a map in _val that is a struct
    bound: dict = field(default_factory=dict)  # a bound label's column: (labels of its element, {key: (column, type)})
    ahead: dict = field(default_factory=dict)  # label: the keys that later steps read of it

    # -- columns ----------------------------------------------------------------------------
    def carried(self) -> list[str]:
        out = [*self.origin, *(c for c, _ in self.order)]
        out += [c for bs in self.binds.values() for c, _, _ in bs]
        if self.bound:
            out += [c for _, kept in self.bound.values() for c, _ in kept.values() if c in self.df.columns]
        out += [c for c in ("_path", "_loops", "_sack", "_bulk", "_rep") if c in self.df.columns]
        return list(dict.fromkeys(out))

    def current(self) -> list[str]:
        if self.kind == "x":
            return ["_val"]
        own = ["_id"] if self.kind == "v" else ["_id", "_src", "_dst", "_prev"]
        return [c for c in [*own, "_label", "__keys"] if c in self.df.columns] + [c for c in self.df.columns if c.startswith("p:")]

    def key(self) -> list[str]:
        """Columns that identify the current element or value."""
        return ["_val"] if self.kind == "x" else ["_id"]

    def types(self) -> dict[str, T.DataType]:
        return self.graph.properties(self.kind, self.labels)

    def load(self) -> State:
        """With the current element's label and properties as columns."""
        if self.loaded or self.kind == "x":
            return self
        view = self.graph.view(self.kind, self.labels)
        renamed = view.select(F.col("id").alias("_vid"), F.col("label").alias("_label"), "__keys", *(F.col(f"`{k}`").alias(f"p:{k}") for k in self.types()))
        keep = [c for c in self.df.columns if c not in ("_label", "__keys")]
        return replace(self, df=self.df.select(*map(_q, keep)).join(renamed, F.col("_id") == F.col("_vid")).drop("_vid"), loaded=True)

    def prop(self, key: str) -> tuple[Column, T.DataType] | None:
        """The property's column, after ``load``."""
        types = self.types()
        return (F.col(f"`p:{key}`"), types[key]) if key in types else None

    def present(self, key: str) -> Column:
        found = self.prop(key)
        if found is None:
            return F.lit(False)
        return F.when(F.col("__keys").isNotNull(), F.array_contains("__keys", key)).otherwise(found[0].isNotNull())

    def value(self) -> tuple[Column, T.DataType]:
        return (F.col("_val"), self.vtype) if self.kind == "x" else (F.col("_id"), T.LongType())

    def now(self, val: Column, vtype: T.DataType, extra: list | None = None, **more) -> State:
        """A state whose current is the given value."""
        df = self.df.select(*map(_q, self.carried()), *(extra or []), val.alias("_val"))
        return replace(self, df=df, kind="x", vtype=vtype, labels=None, loaded=False, names=None, **more)

    def filtered(self, test: Column) -> State:
        return replace(self, df=self.df.filter(test))

    def window_order(self) -> list[Column]:
        return [F.col(_q(c)).desc() if d else F.col(_q(c)).asc() for c, d in self.order] or [F.lit(1)]

    def with_order(self, c: str) -> list:
        return [*self.order, (c, False)]

    # -- results ----------------------------------------------------------------------------
    def frame(self, *columns: str) -> DataFrame:
        """A flat result: asked properties or keys; else id and label, struct fields, or value."""
        s = self
        if s.kind != "x":
            s = s.load()
            wanted = columns or ("id", "label", *s.types())
            out = []
            for c in wanted:
                col = F.col("_id") if c == "id" else F.col("_label") if c == "label" else F.col("_src") if c == "src" else F.col("_dst") if c == "dst" else F.col(f"`p:{c}`")
                out.append(col.alias(c))
            df = s._sorted().select(*out)
        elif s.names is not None:
            df = s._sorted().select(*(F.col("_val")[n].alias(n) for n in columns or s.names))
        else:
            df = s._sorted().select(F.col("_val").alias(columns[0] if columns else "value"))
        return df

    def _sorted(self) -> DataFrame:
        df = self.df
        if self.bulk:
            df = df.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_bulk")))).drop("_one")
        return df.orderBy(*self.window_order()) if self.order and self.need_order else df

    def collect(self) -> list:
        if self.kind != "x":
            return [r[0] for r in self._sorted().select("_id").collect()]
        return [plain(r[0]) for r in self._sorted().select("_val").collect()]

    def stream(self):
        for r in self._sorted().select(*self.key()).toLocalIterator():
            yield plain(r[0])

    def distinct(self) -> State:
        return replace(self, df=self.df.select(*self.key()).distinct(), order=[], bulk=False)


def _q(c: str) -> str:
    return f"`{c}`"


def plain(value):
    """Rows as dicts, tagged structs as their value."""
    if hasattr(value, "asDict"):
        d = value.asDict()
        if set(d) == {"t", "i", "d", "s", "b"}:
            return next((d[k] for k in "idsb" if d[k] is not None), None)
        return {k: plain(v) for k, v in d.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


# -- analysis ----------------------------------------------------------------------------------


def nested(step: Step):
    for a in (*step.args, *(x for _, args in step.mods for x in args)):
        if isinstance(a, Traversal):
            yield a


def uses(steps, wanted: set) -> bool:
    return any(s.name in wanted or any(uses(t.steps, wanted) for t in nested(s)) for s in steps)


def labels_used(steps) -> set:
    out = set()
    for s in steps:
        if s.name == "select":
            out |= set(s.args)
        if s.name == "math":
            out |= {n for n in names(s.args[0]) if n != "_"}
        for a in s.args:
            if isinstance(a, P) and a.name in ("eq_label", "neq_label"):
                out.add(a.args[0])
        for t in nested(s):
            out |= labels_used(t.steps)
    return out


# -- running -----------------------------------------------------------------------------------


WHOLE = {"valueMap", "elementMap", "propertyMap", "properties", "map", "flatMap", "filter", "searchTextV", "searchTextE"}


def keys_read(steps) -> set | None:
    """Properties that the steps may read: every name among their arguments; None for all."""
    out: set = set()
    for s in steps:
        if s.name in WHOLE or (s.name == "values" and not s.args):
            return None
        for a in (*s.args, *(x for _, args in s.mods for x in args)):
            for x in a if isinstance(a, (list, tuple)) else (a,):
                if isinstance(x, str):
                    out.add(x)
        for t in nested(s):
            inner = keys_read(t.steps)
            if inner is None:
                return None
            out |= inner
    return out


def run(t: Traversal, asked: tuple | None = None) -> State:
    """``asked``: the properties of a resulting element that will be shown; None for all."""
    if t.graph is None:
        raise ValueError("an anonymous traversal can't run on its own")
    keys = keys_read(t.steps)
    keys = None if keys is None or asked is None else keys | set(asked)
    return walk(start(t.graph.focused(keys), t.steps), t.steps[1:])


def start(graph, steps) -> State:
    first = steps[0]
    sensitive = uses(steps[1:], ORDER_SENSITIVE)
    path = uses(steps, {"path", "simplePath", "cyclicPath"})
    base = State(graph, None, "v", need_order=sensitive, path=path)
    if first.name == "inject":
        rows = [(i, a) for i, a in enumerate(first.args)]
        from weftgraph.model import _fit, _infer

        vtype = _infer([a for a in first.args if a is not None])
        df = graph.spark.createDataFrame([(i, _fit(a, vtype)) for i, a in rows], T.StructType([T.StructField("_o", T.LongType()), T.StructField("_val", vtype)]))
        s = replace(base, df=df, kind="x", vtype=vtype, order=[("_o", False)] if sensitive else [])
    elif first.name in ("V", "E"):
        kind = first.name.lower()
        ids = [a for x in first.args for a in (x if isinstance(x, (list, tuple)) else [x])]
        wanted = frozenset(steps[1].args) if len(steps) > 1 and steps[1].name == "hasLabel" else None
        if kind == "v" and ids and (owned := graph.labels_of(ids)) is not None:
            wanted = owned if wanted is None else wanted & owned
        view = graph.view(kind, wanted)
        if ids:
            view = view.filter(F.col("id").isin(*ids))
        s = scan(base, view, kind, wanted)
    elif first.name in ("searchTextV", "searchTextE"):
        from weftgraph.operators.textsearch import hits

        kind = first.name[-1].lower()
        found = hits(graph, kind, *first.args).select(F.col("id").alias("_h"), F.col("score").alias("_sack"))
        s = scan(base, graph.view(kind), kind)
        s = replace(s, df=s.df.join(F.broadcast(found), F.col("_id") == F.col("_h")).drop("_h"))  # k rows at most
        s = replace(s, order=[("_sack", True), ("_id", False)])
    else:
        raise ValueError(f"a traversal can't start with {first.name}()")
    return tracked(s) if path else s


def scan(base: State, view: DataFrame, kind: str, labels: frozenset | None = None) -> State:
    fixed = [F.col("id").alias("_id"), F.col("label").alias("_label"), F.col("__keys")]
    if kind == "e":
        fixed += [F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.lit(None).cast("long").alias("_prev")]
    types = base.graph.properties(kind, labels)
    df = view.select(*fixed, *(F.col(f"`{k}`").alias(f"p:{k}") for k in types))
    order = []
    if base.need_order:
        df = df.withColumn("_o", F.col("_id"))
        order = [("_o", False)]
    return replace(base, df=df, kind=kind, labels=labels, loaded=True, order=order)


PATH_ITEM = "struct<k:string,id:bigint,v:string>"


def item(s: State) -> Column:
    if s.kind == "x":
        parts = (F.lit("x"), F.lit(None).cast("long"), V.text(F.col("_val"), s.vtype))
    else:
        parts = (F.lit(s.kind), F.col("_id"), F.lit(None).cast("string"))
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("k", "id", "v"), strict=True)))


def tracked(s: State) -> State:
    """With the current object appended to the path."""
    before = F.col("_path") if "_path" in s.df.columns else F.array().cast(f"array<{PATH_ITEM}>")
    return replace(s, df=s.df.withColumn("_path", F.concat(before, F.array(item(s)))))


PATH_STEPS = HOPS | {"outE", "inE", "bothE", "outV", "inV", "bothV", "otherV", "values", "id", "label", "constant", "unfold"}


def walk(s: State, steps) -> State:
    steps = list(steps)
    mergeable = not s.path and not s.need_order and not s.origin and not s.binds
    for n, step in enumerate(steps):
        rest = steps[n:]
        if mergeable and step.name in HOPS and s.kind == "v" and (n > 0 or s.bulk) and all(x.name in BULK_SAFE and not list(nested(x)) for x in rest) and rest[-1].name in ("count", "groupCount") and "_sack" not in s.df.columns and any(x.name in HOPS for x in steps[:n]):
            s = merge(s)
        if step.name == "as":
            s = replace(s, ahead=read_of(step.args, rest[1:]))
        s = STEP[step.name](s, step)
        if s.path and step.name in PATH_STEPS:
            s = tracked(s)
    return s


def read_of(labels, steps) -> dict:
    """Keys that select().by() and math().by() read of bound labels."""
    out: dict = {}
    for x in steps:
        bys = [args[0] if args else None for m, args in x.mods if m == "by"]
        if x.name == "select" and bys:
            pairs = [(a, bys[n % len(bys)]) for n, a in enumerate(x.args)]
        else:
            pairs = [args for m, args in x.mods if m == "by" and len(args) == 2] if x.name == "math" else []
        for label, key in pairs:
            if label in labels and isinstance(key, str):
                out.setdefault(label, set()).add(key)
        for t in nested(x):
            for label, keys in read_of(labels, t.steps).items():
                out.setdefault(label, set()).update(keys)
    return out


def merge(s: State) -> State:
    """Traversers at one vertex become one with their number as bulk."""
    times = F.sum("_bulk") if s.bulk else F.count("*")
    return replace(s, df=s.df.groupBy("_id").agg(times.cast("long").alias("_bulk")), loaded=False, bulk=True)


# -- nested traversals -------------------------------------------------------------------------


def as_traversal(a) -> Traversal:
    return a if isinstance(a, Traversal) else Traversal(None, (Step("values", (a,)),))


def sub(s: State, t: Traversal) -> tuple[State, list[tuple[Column, str]]]:
    """The nested traversal over all distinct origins; and how a row of ``s`` finds its origin."""
    bound = [c for label in labels_used(t.steps) if label in s.binds for c, _, _ in s.binds[label]]
    wanted = list(dict.fromkeys([*s.key(), *bound, *(["_loops"] if "_loops" in s.df.columns and uses(t.steps, {"loops"}) else []), *(["_prev"] if "_prev" in s.df.columns and uses(t.steps, {"otherV"}) else []), *(["_path"] if s.path and uses(t.steps, {"path", "simplePath", "cyclicPath"}) else [])]))
    if s.kind == "e":
        wanted = list(dict.fromkeys([*wanted, "_src", "_dst"]))
    origin = [fresh("o") for _ in wanted]
    keys = s.df.select(*(F.col(_q(w)).alias(o) for w, o in zip(wanted, origin, strict=True))).distinct()
    df = keys.select(*origin, *(F.col(o).alias(w) for w, o in zip(wanted, origin, strict=True)))
    if s.kind == "e" and "_prev" not in df.columns:
        df = df.withColumn("_prev", F.lit(None).cast("long"))
    sensitive = uses(t.steps, ORDER_SENSITIVE) or s.need_order
    inner = State(s.graph, df, s.kind, s.vtype, s.labels, origin=origin, keys=keys, order=[], need_order=sensitive, binds={k: [b for b in bs if b[0] in bound] for k, bs in s.binds.items() if any(b[0] in bound for b in bs)}, path=s.path and "_path" in wanted, effects=s.effects, names=s.names)
    return walk(inner, t.steps), list(zip(wanted, origin, strict=True))


def matches(pairs) -> Column:
    return reduce(lambda a, b: a & b, (F.col(_q(w)).eqNullSafe(F.col(o)) for w, o in pairs))


def keep(s: State, t: Traversal, anti: bool = False) -> State:
    """Rows whose nested traversal has a result (or none)."""
    test = pure(s, t)
    if test is not None:
        loaded, column = test
        return loaded.filtered(~column if anti else column)
    found, pairs = sub(s, t)
    origins = found.df.select(*found.origin).distinct()
    return replace(s, df=s.df.join(origins, matches(pairs), "left_anti" if anti else "left_semi"))


def pure(s: State, t: Traversal) -> tuple[State, Column] | None:
    """A traversal of filters alone, as one test of the row."""
    if not t.steps or any(x.name not in ("hasLabel", "has", "hasNot", "hasId", "is", "and", "or", "not", "where") for x in t.steps):
        return None
    out = F.lit(True)
    for x in t.steps:
        if x.name in ("and", "or", "not") or (x.name == "where" and isinstance(x.args[0], Traversal)):
            tests = []
            for a in x.args:
                found = pure(s, a)
                if found is None:
                    return None
                s, c = found
                tests.append(c)
            joined = reduce(lambda a, b: (a | b) if x.name == "or" else (a & b), tests)
            out = out & (~joined if x.name == "not" else joined)
        else:
            if x.name in ("hasLabel", "has", "hasNot") and s.kind != "x":
                s = s.load()
            out = out & condition(s, x)
    return s, out


def first_value(s: State, t: Traversal) -> tuple[State, str, T.DataType]:
    """The nested traversal's first result beside each row (null if none)."""
    found, pairs = sub(s, t)
    name = fresh("f")
    v, vtype = found.value()
    best = found.df.select(*found.origin, F.struct(*(F.col(c) for c, _ in found.order), v.alias("_v")).alias("_b")).groupBy(*found.origin).agg(F.min("_b").alias("_b"))
    joined = s.df.join(best, matches(pairs), "left").withColumn(name, F.col("_b")["_v"]).drop("_b", *found.origin)
    return replace(s, df=joined), name, vtype


def all_values(s: State, t: Traversal) -> tuple[State, str, T.DataType]:
    """The nested traversal's results as a list beside each row."""
    found, pairs = sub(s, t)
    name = fresh("l")
    v, vtype = found.value()
    order = [F.col(c) for c, _ in found.order]
    lists = found.df.groupBy(*found.origin).agg(F.sort_array(F.collect_list(F.struct(*order, v.alias("_v")))).alias("_b"))
    joined = s.df.join(lists, matches(pairs), "left").withColumn(name, F.transform("_b", lambda b: b["_v"])).drop("_b", *found.origin)
    return replace(s, df=joined), name, vtype


def selector(s: State, by, default: str = "value") -> tuple[State, Column, T.DataType]:
    """A by() argument as a column: nothing, a key, T.id or T.label, or a traversal."""
    if by is None:
        if s.kind != "x" and default == "label":
            s = s.load()
            return s, F.col("_label"), T.StringType()
        return (s, *s.value())
    if isinstance(by, Traversal):
        if len(by.steps) == 1 and by.steps[0].name == "values" and len(by.steps[0].args) == 1:
            by = by.steps[0].args[0]
        elif len(by.steps) == 1 and by.steps[0].name in ("id", "label"):
            by = f"T.{by.steps[0].name}"
        else:
            s, name, vtype = first_value(s, by)
            return s, F.col(name), vtype
    if by in ("T.id", "T.label"):
        s = s.load() if by == "T.label" else s
        return s, F.col("_id" if by == "T.id" else "_label"), T.LongType() if by == "T.id" else T.StringType()
    if s.kind == "x":
        c, vtype = field_of(s, by)
        return s, c, vtype
    s = s.load()
    found = s.prop(by)
    return (s, *found) if found else (s, F.lit(None).cast("string"), T.StringType())


def field_of(s: State, key: str) -> tuple[Column, T.DataType]:
    """An entry of a current map."""
    if isinstance(s.vtype, T.StructType) and key in s.vtype.names:
        return F.col("_val")[key], s.vtype[key].dataType
    if isinstance(s.vtype, T.MapType):
        return F.try_element_at("_val", F.lit(key)), s.vtype.valueType
    return F.lit(None).cast("string"), T.StringType()


# -- navigation --------------------------------------------------------------------------------


def hop(s: State, step: Step) -> State:
    if s.kind != "v":
        return s.filtered(F.lit(False)) if s.kind == "e" else _nothing(s)
    asked = frozenset(step.args) if step.args else None
    name = step.name.rstrip("E")
    sides = {"out": [("src", "dst", 0)], "in": [("dst", "src", 0)], "both": [("src", "dst", 0), ("dst", "src", 1)]}[name]
    to_edge = step.name.endswith("E")
    ways = {a: s.graph.leaving(asked, n, s.labels) for n, a in enumerate(("src", "dst"))}
    wanted = [ways[a] for a, _, _ in sides]
    edge_labels = None if any(w is None for w in wanted) else frozenset().union(*wanted)
    there = [s.graph.reached(ways[a], 1 if a == "src" else 0) for a, _, _ in sides]
    found = None if any(x is None for x in there) else frozenset().union(*there)
    over = asked if asked is not None else edge_labels
    types = s.graph.properties("e", over)
    parts = []
    for a, b, d in sides:
        e, own = s.graph.view("e", ways[a]), s.graph.properties("e", ways[a])
        props = [(V.as_common(F.col(f"`{k}`"), own[k], t) if k in own else F.lit(None).cast(t)).alias(f"p:{k}") for k, t in types.items()] if to_edge else []
        cols = [F.col(a).alias("_a"), F.col(b).alias("_b"), F.lit(d).alias("_d"), F.col("id").alias("_eid")]
        if to_edge:
            cols += [F.col("src").alias("_s"), F.col("dst").alias("_t"), F.col("label").alias("_l"), F.col("__keys").alias("_k")]
        parts.append(e.select(*cols, *props))
    side = reduce(DataFrame.union, parts)
    mine = s.df.select(*map(_q, s.carried()), F.col("_id"))
    met = mine.join(side, F.col("_id") == F.col("_a"))
    order, extra = s.order, []
    if s.need_order:
        h = fresh("h")
        order, extra = s.with_order(h), [F.struct("_d", "_eid").alias(h)]
    carry = [F.col(_q(c)) for c in s.carried()]
    if to_edge:
        df = met.select(*carry, *extra, F.col("_eid").alias("_n"), F.col("_s").alias("_src"), F.col("_t").alias("_dst"), F.col("_id").alias("_prev"), F.col("_l").alias("_label"), F.col("_k").alias("__keys"), *(F.col(f"`p:{k}`") for k in types)).withColumnRenamed("_n", "_id")
        return replace(s, df=df, kind="e", labels=over, loaded=True, order=order)
    df = met.select(*carry, *extra, F.col("_b").alias("_n")).withColumnRenamed("_n", "_id")
    return replace(s, df=df, labels=found, loaded=False, order=order)


def endpoint(s: State, step: Step) -> State:
    if s.kind != "e":
        return _nothing(s)
    carry = [F.col(_q(c)) for c in s.carried()]
    order, extra = s.order, []
    if step.name == "bothV":
        df = s.df.select(*carry, F.posexplode(F.array("_src", "_dst")).alias("_pos", "_n"))
        if s.need_order:
            h = fresh("h")
            order, df = s.with_order(h), df.withColumnRenamed("_pos", h)
        else:
            df = df.drop("_pos")
    else:
        other = F.when(F.col("_prev").isNull(), F.col("_dst")).when(F.col("_prev") == F.col("_src"), F.col("_dst")).when(F.col("_prev") == F.col("_dst"), F.col("_src"))
        end = {"outV": F.col("_src"), "inV": F.col("_dst"), "otherV": other}[step.name]
        df = s.df.select(*carry, *extra, end.alias("_n")).filter("_n IS NOT NULL")
    known = [s.graph.reached(s.labels, side) for side in {"outV": (0,), "inV": (1,)}.get(step.name, (0, 1))]
    found = None if any(x is None for x in known) else frozenset().union(*known)
    return replace(s, df=df.withColumnRenamed("_n", "_id"), kind="v", labels=found, loaded=False, order=order)


def _nothing(s: State) -> State:
    df = s.df.select(*map(_q, s.carried())).withColumn("_id", F.lit(None).cast("long")).filter(F.lit(False))
    return replace(s, df=df, kind="v", labels=None, loaded=False)


# -- filters -----------------------------------------------------------------------------------


def condition(s: State, step: Step) -> Column:
    """A simple filter's test; the state is loaded where it needs to be."""
    a, name = step.args, step.name
    if name == "hasLabel":
        return F.col("_label").isin(*a) if s.kind != "x" else F.lit(False)
    if name == "hasId":
        ids = [i for x in a for i in (x if isinstance(x, (list, tuple)) else [x])]
        return F.col("_id").isin(*ids) if s.kind != "x" else F.lit(False)
    if name in ("is", "where"):
        v, vtype = s.value()
        if isinstance(a[0], P) and a[0].name in ("eq_label", "neq_label"):
            return label_test(s, a[0])
        p = a[0] if isinstance(a[0], P) else P.eq(a[0])
        return p.column(v, vtype) if s.kind == "x" else F.lit(False)
    if name == "hasNot":
        return ~s.present(a[0]) if s.kind != "x" else F.lit(True)
    if name == "has":
        if s.kind == "x":
            return F.lit(False)
        if len(a) == 1:
            return s.present(a[0])
        *label, key, want = a
        p = want if isinstance(want, P) else P.eq(want)
        if key in ("T.id", "id") and s.prop("id") is None:
            test = p.column(F.col("_id"), T.LongType())
        elif key == "T.label":
            test = p.column(F.col("_label"), T.StringType())
        else:
            found = s.prop(key)
            test = s.present(key) & p.column(*found) if found else F.lit(False)
        return test & (F.col("_label") == label[0]) if label else test
    raise ValueError(name)


def label_test(s: State, p: P) -> Column:
    label = p.args[0]
    if label not in s.binds:
        return F.lit(True)
    col, kind, vtype = s.binds[label][0]
    v, mine = s.value()
    same = V.same(v, mine, F.col(_q(col)), vtype or T.LongType()) if kind == s.kind else F.lit(False)
    return same if p.name == "eq_label" else ~same


def has(s: State, step: Step) -> State:
    if s.kind != "x" and step.name != "hasId":
        narrowed = None
        if step.name == "hasLabel" or (step.name == "has" and len(step.args) == 3):
            wanted = set(step.args if step.name == "hasLabel" else step.args[:1])
            narrowed = frozenset(wanted if s.labels is None else wanted & s.labels)
        if narrowed is not None and not s.loaded:
            s = replace(s, labels=narrowed).load()
            return s.filtered(condition(s, step)) if step.name == "has" else s
        s = s.load()
        test = condition(s, step)
        return replace(s.filtered(test), labels=narrowed if narrowed is not None else s.labels) if narrowed is not None else s.filtered(test)
    return s.filtered(condition(s, step))


def where(s: State, step: Step) -> State:
    a = step.args[0]
    if isinstance(a, Traversal):
        return keep(s, a)
    if isinstance(a, P) and a.name in ("eq", "neq") and isinstance(a.args[0], str) and a.args[0] in s.binds:
        a = P(f"{a.name}_label", a.args[0])
    return s.filtered(condition(s, Step("where", (a,))))


def logical(s: State, step: Step) -> State:
    if step.name == "and":
        return reduce(keep, step.args, s)
    if step.name == "not":
        return keep(s, step.args[0], anti=True)
    simple = pure(s, Traversal(None, (step,)))
    if simple is not None:
        return simple[0].filtered(simple[1])
    origins, pairs = None, None
    for t in step.args:
        found, ps = sub(s, Traversal(None, t.steps))
        ws, os = zip(*ps, strict=True)
        got = found.df.select(*os).distinct().toDF(*(f"_or_{w}" for w in ws))
        pairs = pairs or {}
        pairs |= {w: f"_or_{w}" for w in ws}
        origins = got if origins is None else origins.unionByName(got, allowMissingColumns=True)
    return replace(s, df=s.df.join(origins.distinct(), matches(list(pairs.items())), "left_semi"))


def dedup(s: State, step: Step) -> State:
    by = step.mods[0][1][0] if step.mods else step.args[0] if step.args else None
    if by is None:
        c, vtype = s.value()
    else:
        s, c, vtype = selector(s, by)
    if not s.order:
        name = fresh("d")
        df = s.df.withColumn(name, c).dropDuplicates([*s.origin, name]).drop(name)
        if s.bulk:
            df = df.withColumn("_bulk", F.lit(1).cast("long"))
        return replace(s, df=df)
    w = Window.partitionBy(*s.origin, c).orderBy(*s.window_order())
    return replace(s, df=s.df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"))


def cut(s: State, step: Step) -> State:
    a, n = step.args, step.name
    low, high = {"limit": lambda: (0, a[0]), "skip": lambda: (a[0], None), "range": lambda: (a[0], max(a[0], a[1])), "tail": lambda: (0, a[0] if a else 1)}[n]()
    if n in ("limit", "range", "tail") and high is not None and high <= low:
        return s.filtered(F.lit(False))
    flip = n == "tail"
    order = [F.col(_q(c)).asc() if d else F.col(_q(c)).desc() for c, d in s.order] if flip else s.window_order()
    if s.origin:
        rn = F.row_number().over(Window.partitionBy(*s.origin).orderBy(*order))
        df = s.df.withColumn("_rn", rn).filter(F.col("_rn") > low)
        df = df.filter(F.col("_rn") <= high) if high is not None else df
        return replace(s, df=df.drop("_rn"))
    df = s.df.orderBy(*order) if s.order else s.df
    if high is not None:
        df = df.limit(high)
    return replace(s, df=df.offset(low) if low else df)


def coin(s: State, step: Step) -> State:
    p = min(1.0, max(0.0, float(step.args[0])))
    if p in (0.0, 1.0):
        return s.filtered(F.lit(p == 1.0))
    return s.filtered(F.rand(s.seed if s.seed is not None else random.randrange(2**31)) < p)


def sample(s: State, step: Step) -> State:
    r = F.rand(s.seed if s.seed is not None else random.randrange(2**31))
    if s.origin:
        w = Window.partitionBy(*s.origin).orderBy("_r")
        return replace(s, df=s.df.withColumn("_r", r).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= step.args[0]).drop("_r", "_rn"))
    return replace(s, df=s.df.withColumn("_r", r).orderBy("_r").limit(step.args[0]).drop("_r"))


def paths(s: State, step: Step) -> State:
    distinct = F.size("_path") == F.size(F.array_distinct("_path"))
    return s.filtered(distinct if step.name == "simplePath" else ~distinct)


def host_filter(s: State, step: Step) -> State:
    s = s.load() if s.kind != "x" else s
    return s.filtered(F.coalesce(step.args[0](F.col("_val") if s.kind == "x" else _element(s)), F.lit(False)))


def _element(s: State) -> Column:
    return F.struct(F.col("_id").alias("id"), F.col("_label").alias("label"), *(F.col(f"`p:{k}`").alias(k) for k in s.types()))


def property_filter(s: State, step: Step) -> State:
    if not (isinstance(s.vtype, T.StructType) and "key" in s.vtype.names):
        return _empty(s)
    if step.name == "hasKey":
        return s.filtered(F.col("_val")["key"].isin(*step.args))
    v, vtype = F.col("_val")["value"], s.vtype["value"].dataType
    return s.filtered(reduce(lambda a, b: a | b, (V.equals(v, vtype, x) for x in step.args)))


def _empty(s: State) -> State:
    return s.filtered(F.lit(False))


# -- transforms --------------------------------------------------------------------------------


def spread(s: State, entries: Column, vtype: T.DataType) -> State:
    """One row for each entry of an array column, in its order."""
    pos = fresh("h")
    df = s.df.select(*map(_q, s.carried()), F.posexplode(entries).alias(pos, "_val"))
    order = s.with_order(pos) if s.need_order else s.order
    if not s.need_order:
        df = df.drop(pos)
    return replace(s, df=df, kind="x", vtype=vtype, labels=None, loaded=False, order=order, names=None)


def values(s: State, step: Step) -> State:
    if s.kind == "x":
        if s.names or V.kind(s.vtype) == "m":
            if len(step.args) == 1:
                c, vtype = field_of(s, step.args[0])
                return s.now(c, vtype).filtered(F.col("_val").isNotNull())
        return _empty(s)
    s = s.load()
    keys = [k for k in (step.args or s.types()) if k in s.types()]
    if not keys:
        return _empty(s.now(F.lit(None).cast("string"), T.StringType()))
    if len(keys) == 1:
        c, vtype = s.prop(keys[0])
        return replace(s.filtered(s.present(keys[0])), labels=s.labels).now(c, vtype)
    target = V.common([s.types()[k] for k in keys])
    cells = F.array(*(F.when(s.present(k), F.struct(V.as_common(*s.prop(k), target).alias("v"))) for k in keys))
    out = spread(s, F.filter(cells, lambda c: c.isNotNull()), target)
    return replace(out, df=out.df.withColumn("_val", F.col("_val")["v"]))


def pairs_of(s: State, keys) -> tuple[list[str], T.DataType]:
    wanted = [k for k in (keys or s.types()) if k in s.types()]
    return wanted, V.common([s.types()[k] for k in wanted])


def properties(s: State, step: Step) -> State:
    s = s.load()
    keys, target = pairs_of(s, step.args)
    cells = F.array(*(F.when(s.present(k), F.struct(F.lit(k).alias("key"), V.as_common(*s.prop(k), target).alias("value"))) for k in keys))
    vtype = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", target)])
    out = spread(s, F.filter(cells, lambda c: c.isNotNull()), vtype)
    return replace(out, names=["key", "value"])


def value_map(s: State, step: Step) -> State:
    """Maps as structs of the keys; absent keys are null. Lists, entries or plain values by step."""
    tokens = bool(step.args and step.args[0] is True)
    asked = [a for a in step.args if isinstance(a, str)]
    s = s.load()
    keys = [k for k in (asked or s.types()) if k in s.types()]
    cols, fields = [], []
    if tokens or step.name == "elementMap":
        cols += [F.col("_id").alias("id"), F.col("_label").alias("label")]
        fields += [T.StructField("id", T.LongType()), T.StructField("label", T.StringType())]
    if step.name == "elementMap" and s.kind == "e":
        ends = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType())])
        for side, at in (("IN", "_dst"), ("OUT", "_src")):
            look = s.graph.view("v").select(F.col("id").alias(f"_{side}i"), F.col("label").alias(f"_{side}l"))
            s = replace(s, df=s.df.join(look, F.col(at) == F.col(f"_{side}i"), "left"))
            cols.append(F.struct(F.col(at).alias("id"), F.col(f"_{side}l").alias("label")).alias(side))
            fields.append(T.StructField(side, ends))
    for k in keys:
        c, vtype = s.prop(k)
        if step.name == "valueMap":
            c, vtype = F.when(s.present(k), F.array(c)), T.ArrayType(vtype)
        elif step.name == "propertyMap":
            entry = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", vtype)])
            c, vtype = F.when(s.present(k), F.array(F.struct(F.lit(k).alias("key"), c.alias("value")))), T.ArrayType(entry)
        cols.append(c.alias(k))
        fields.append(T.StructField(k, vtype))
    return replace(s.now(F.struct(*cols), T.StructType(fields)), names=[f.name for f in fields])


def metadata(s: State, step: Step) -> State:
    if step.name == "loops":
        return s.now(F.col("_loops") if "_loops" in s.df.columns else F.lit(0).cast("long"), T.LongType())
    if step.name in ("key", "value"):
        c, vtype = field_of(s, step.name)
        return s.now(c, vtype)
    if s.kind == "x":
        return _empty(s)
    if step.name == "id":
        return s.now(F.col("_id"), T.LongType())
    s = s.load()
    return s.now(F.col("_label"), T.StringType())


def index(s: State, step: Step) -> State:
    c, vtype = s.value()
    rn = F.row_number().over(Window.partitionBy(*s.origin).orderBy(*s.window_order())).cast("long") - 1
    fields = T.StructType([T.StructField("value", vtype), T.StructField("index", T.LongType())])
    return replace(s.now(F.struct(c.alias("value"), rn.alias("index")), fields), names=["value", "index"])


def path(s: State, step: Step) -> State:
    t = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("id", T.LongType()), T.StructField("v", T.StringType())]))
    return s.now(F.col("_path"), t)


def bind(s: State, step: Step) -> State:
    name, (c, vtype) = fresh("b"), s.value()
    binds, kept = dict(s.binds), {}
    for label in step.args:
        binds[label] = [*binds.get(label, []), (name, s.kind, vtype)]
        if s.kind != "x" and s.loaded:  # what is read here needn't be joined again later
            kept |= {k: (fresh("k"), s.types()[k]) for k in s.ahead.get(label, ()) if k in s.types()}
    df = s.df.withColumns({name: c} | {own: F.col(f"`p:{k}`") for k, (own, _) in kept.items()})
    return replace(s, df=df, binds=binds, bound={**s.bound, name: (s.labels, kept)} if s.kind != "x" else s.bound)


def select(s: State, step: Step) -> State:
    a = step.args
    if a in (("keys",), ("values",)) and a[0] not in s.binds:
        if s.names == ["key", "value"]:  # an entry of a group
            return s.now(*field_of(s, "key" if a[0] == "keys" else "value"))
        if isinstance(s.vtype, T.StructType):
            ns = s.vtype.names
            if a[0] == "keys":
                return s.now(F.lit(ns[0]) if len(ns) == 1 else F.array(*map(F.lit, ns)), T.StringType() if len(ns) == 1 else T.ArrayType(T.StringType()))
            target = V.common([f.dataType for f in s.vtype.fields])
            vals = [V.as_common(F.col("_val")[f.name], f.dataType, target) for f in s.vtype.fields]
            return s.now(vals[0] if len(ns) == 1 else F.array(*vals), target if len(ns) == 1 else T.ArrayType(target))
        if isinstance(s.vtype, T.MapType):
            c = F.map_keys("_val") if a[0] == "keys" else F.map_values("_val")
            return s.now(c, T.ArrayType(s.vtype.keyType if a[0] == "keys" else s.vtype.valueType))
        return _empty(s)
    bys = [m[1][0] if m[1] else None for m in step.mods if m[0] == "by"]
    if any(x not in s.binds for x in a):
        if s.kind == "x" and V.kind(s.vtype) == "m" and len(a) == 1:
            c, vtype = field_of(s, a[0])
            return s.now(c, vtype).filtered(F.col("_val").isNotNull())
        return _empty(s)
    if len(a) == 1 and not bys:
        col, kind, vtype = s.binds[a[0]][-1]
        if kind == "x":
            return s.now(F.col(col), vtype)
        df = s.df.select(*map(_q, s.carried()), F.col(col).alias("_id"))
        out = replace(s, df=df, kind=kind, labels=s.bound.get(col, (None,))[0], loaded=False, vtype=None, names=None)
        return ends(out) if kind == "e" else out
    cols, fields = [], []
    for n, x in enumerate(a):
        col, kind, vtype = s.binds[x][-1]
        by = bys[n % len(bys)] if bys else None
        if by is None or kind == "x":
            cols.append(F.col(col).alias(x))
            fields.append(T.StructField(x, vtype if kind == "x" else T.LongType()))
            continue
        known, kept = s.bound.get(col, (None, {}))
        if isinstance(by, str) and by in kept and kept[by][0] in s.df.columns:
            cols.append(F.col(kept[by][0]).alias(x))
            fields.append(T.StructField(x, kept[by][1]))
            continue
        side = replace(s, df=s.df.select(*map(_q, s.df.columns)).withColumn("_id", F.col(col)), kind=kind, labels=known, loaded=False)
        if kind == "e":
            side = ends(side)
        clean = replace(side, df=side.df.drop(*(c for c in side.df.columns if c.startswith("p:") or c in ("_label", "__keys"))))
        got, c, t = selector(clean, by)
        name = fresh("s")
        s = replace(s, df=got.df.withColumn(name, c).drop(*(x for x in got.df.columns if x.startswith("p:") or x in ("_label", "__keys"))), kind=kind, labels=known, loaded=False)
        cols.append(F.col(name).alias(x))
        fields.append(T.StructField(x, t))
    if len(a) == 1:
        return s.now(cols[0], fields[0].dataType)
    return replace(s.now(F.struct(*cols), T.StructType(fields)), names=list(a))


def ends(s: State) -> State:
    """An edge state that knows only ids, with its endpoints."""
    e = s.graph.view("e", s.labels).select(F.col("id").alias("_ei"), F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    df = s.df.drop("_src", "_dst", "_prev").join(e, F.col("_id") == F.col("_ei")).drop("_ei")
    return replace(s, df=df.withColumn("_prev", F.lit(None).cast("long")))


def host_map(s: State, step: Step) -> State:
    s = s.load() if s.kind != "x" else s
    c = step.args[0](F.col("_val") if s.kind == "x" else _element(s))
    if step.name == "flatMap":
        t = s.df.select(c.alias("c")).schema["c"].dataType
        return spread(s, c, t.elementType)
    out = s.now(c, T.StringType())
    return replace(out, vtype=out.df.schema["_val"].dataType)


def project(s: State, step: Step) -> State:
    bys = [m[1][0] if m[1] else None for m in step.mods if m[0] == "by"]
    cols, fields = [], []
    for n, key in enumerate(step.args):
        by = bys[n % len(bys)] if bys else None
        scalar = not isinstance(by, Traversal) or by.steps[-1].name in ("count", "sum", "mean", "min", "max", "fold", "id", "label") or (len(by.steps) == 1 and by.steps[0].name == "values")
        if scalar:
            s, c, vtype = selector(s, by)
            name = fresh("j")
            s = replace(s, df=s.df.withColumn(name, c))
        else:
            s, name, vtype = all_values(s, by)
            single = F.size(name) == 1
            if _at_most_one(by):
                s = replace(s, df=s.df.withColumn(name, F.when(single, F.col(name)[0])))
            else:
                vtype = T.ArrayType(vtype)
        cols.append(F.col(name).alias(key))
        fields.append(T.StructField(key, vtype))
    return replace(s.now(F.struct(*cols), T.StructType(fields)), names=list(step.args))


def _at_most_one(t: Traversal) -> bool:
    return t.steps[-1].name == "limit" and t.steps[-1].args == (1,) or all(x.name in ("values", "id", "label", "constant", "select", "math", "is", "has", "hasLabel") for x in t.steps)


def math(s: State, step: Step) -> State:
    bys = {m[1][0]: m[1][1] for m in step.mods if m[0] == "by" and len(m[1]) == 2}
    singles = [m[1][0] for m in step.mods if m[0] == "by" and len(m[1]) == 1]
    variables = {}
    for n, name in enumerate(names(step.args[0])):
        key = bys.get(name) or (singles[n % len(singles)] if singles else None)
        if name == "_" or (name not in s.binds and name in bys):
            s, c, vtype = selector(s, key) if key else (s, *s.value())
        elif name in s.binds:
            col, kind, vtype = s.binds[name][0]
            c = F.col(col)
            if kind != "x":
                if key is None:
                    return _empty(s.now(F.lit(None).cast("double"), T.DoubleType()))
                known, kept = s.bound.get(col, (None, {}))
                if key in kept and kept[key][0] in s.df.columns:
                    c, vtype = F.col(kept[key][0]), kept[key][1]
                elif key in s.graph.properties(kind, known):
                    v = fresh("m")
                    look = s.graph.view(kind, known).select(F.col("id").alias(f"{v}i"), F.col(f"`{key}`").alias(v))
                    s = replace(s, df=s.df.join(look, F.col(col) == F.col(f"{v}i"), "left").drop(f"{v}i"))
                    c, vtype = F.col(v), s.graph.properties(kind, known)[key]
                else:
                    c, vtype = F.lit(None).cast("double"), T.DoubleType()
        else:
            return _empty(s.now(F.lit(None).cast("double"), T.DoubleType()))
        number = V.number(c, vtype)
        variables[name] = number if number is not None else F.lit(None).cast("double")
    out = s.now(compile_math(step.args[0], variables), T.DoubleType())
    return out.filtered(F.col("_val").isNotNull())


def constant(s: State, step: Step) -> State:
    from weftgraph.model import _infer

    return s.now(F.lit(step.args[0]), _infer([step.args[0]]))


def order(s: State, step: Step) -> State:
    mods = [m[1] for m in step.mods if m[0] == "by"] or [()]
    keys = []
    for args in mods:
        direction = next((str(a).lower() for a in args if str(a).lower() in ("asc", "desc", "shuffle", "incr", "decr")), "asc")
        by = next((a for a in args if str(a).lower() not in ("asc", "desc", "shuffle", "incr", "decr")), None)
        if direction == "shuffle":
            c = F.rand()
        else:
            s, c, vtype = selector(s, by)
            c = V.tagged(c, vtype) if V.kind(vtype) == "t" else c
        down = direction in ("desc", "decr")
        missing, name = fresh("n"), fresh("k")
        s = replace(s, df=s.df.withColumn(missing, c.isNull()).withColumn(name, c))  # missing last going up, first going down
        keys += [(missing, down), (name, down)]
    return replace(s, order=[*keys, *s.order], need_order=True)


def unfold(s: State, step: Step) -> State:
    if s.kind == "x" and isinstance(s.vtype, T.ArrayType):
        return spread(s, F.col("_val"), s.vtype.elementType)
    if s.kind == "x" and isinstance(s.vtype, T.MapType):
        entry = T.StructType([T.StructField("key", s.vtype.keyType), T.StructField("value", s.vtype.valueType)])
        return replace(spread(s, F.map_entries("_val"), entry), names=["key", "value"])
    if s.kind == "x" and s.names and s.vtype != V.TAG:
        target = V.common([f.dataType for f in s.vtype.fields])
        entry = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", target)])
        cells = F.array(*(F.struct(F.lit(f.name).alias("key"), V.as_common(F.col("_val")[f.name], f.dataType, target).alias("value")) for f in s.vtype.fields))
        return replace(spread(s, cells, entry), names=["key", "value"])
    return s


def text_score(s: State, step: Step) -> State:
    return s.now(F.col("_sack") if "_sack" in s.df.columns else F.lit(None).cast("double"), T.DoubleType()).filtered(F.col("_val").isNotNull())


# -- aggregates --------------------------------------------------------------------------------


def reduced(s: State, agg: Column, vtype: T.DataType, empty: Column | None) -> State:
    """One value for each origin, or one in all; ``empty`` for origins without rows."""
    if s.origin:
        df = s.df.groupBy(*s.origin).agg(agg.alias("_val"))
        if empty is not None:
            keys = s.keys.select(*(F.col(o).alias(f"{o}_k") for o in s.origin))
            met = reduce(lambda a, b: a & b, (F.col(f"{o}_k").eqNullSafe(F.col(o)) for o in s.origin))
            df = keys.join(df, met, "left").select(*(F.col(f"{o}_k").alias(o) for o in s.origin), F.coalesce("_val", empty).alias("_val"))
    else:
        df = s.df.agg(agg.alias("_val"))
        if empty is not None:
            df = df.select(F.coalesce("_val", empty).alias("_val"))
    return replace(s, df=df, kind="x", vtype=vtype, labels=None, loaded=False, order=[], binds={}, bulk=False, names=None, path=False)


def count(s: State, step: Step) -> State:
    if step.args == ("local",):
        c, vtype = s.value()
        k = V.kind(vtype)
        n = F.size(c) if k == "l" or isinstance(vtype, T.MapType) else F.octet_length(c) if k == "s" else F.lit(len(s.names)) if s.names else F.lit(1)
        return s.now(n.cast("long"), T.LongType())
    return reduced(s, F.sum("_bulk") if s.bulk else F.count("*"), T.LongType(), F.lit(0).cast("long"))


def total(s: State, step: Step) -> State:
    c, vtype = s.value()
    if step.args == ("local",):
        if not isinstance(vtype, T.ArrayType):
            return s.now(F.lit(0).cast("long"), T.LongType())
        t = V.widen(F.lit(0), vtype.elementType)[1]
        return s.now(F.aggregate(F.transform(c, lambda x: F.coalesce(x.cast(t), F.lit(0).cast(t))), F.lit(0).cast(t), lambda a, b: a + b), t)
    k = V.kind(vtype)
    if s.kind != "x" or k not in "idt":
        return reduced(s, F.lit(0).cast("long") + F.count(F.lit(None)), T.LongType(), F.lit(0).cast("long"))
    if k == "t":  # integers until a float appears
        whole, part = F.sum(F.col("_val")["i"]), F.sum(F.col("_val")["d"])
        out = F.when(F.count(F.col("_val")["d"]) > 0, F.coalesce(whole.cast("double"), F.lit(0.0)) + part)
        value = F.struct(F.when(out.isNotNull(), 1).otherwise(0).alias("t"), F.when(out.isNull(), F.coalesce(whole, F.lit(0))).alias("i"), out.alias("d"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("boolean").alias("b"))
        return reduced(s, value, V.TAG, None)
    c, vtype = V.widen(c, vtype)
    zero = T.LongType() if k == "i" else T.DoubleType()
    return reduced(s, F.sum(c).cast(vtype), vtype, F.lit(0).cast(zero))


def mean(s: State, step: Step) -> State:
    c = V.number(*s.value()) if s.kind == "x" else None
    out = reduced(s, F.avg(c if c is not None else F.lit(None).cast("double")), T.DoubleType(), None)
    return out.filtered(F.col("_val").isNotNull())


def extreme(s: State, step: Step) -> State:
    c, vtype = s.value()
    f = F.min if step.name == "min" else F.max
    if s.kind != "x" or V.kind(vtype) not in "idst x":
        return reduced(s, f(F.lit(None).cast("string")), T.StringType(), None)
    if V.kind(vtype) == "t":
        comparable = F.when(c["t"] <= 2, F.struct((c["t"] == 2).alias("a"), V.number(c, vtype).alias("n"), c["s"].alias("s"), c.alias("v")))
        return reduced(s, f(comparable)["v"], vtype, None)
    return reduced(s, f(c), vtype, None)


def fold(s: State, step: Step) -> State:
    c, vtype = s.value()
    rows = F.sort_array(F.collect_list(F.struct(*(F.col(_q(k)) for k, _ in s.order), c.alias("_v"))))
    if any(d for _, d in s.order):
        rn = fresh("h")
        s = replace(s, df=s.df.withColumn(rn, F.row_number().over(Window.partitionBy(*s.origin).orderBy(*s.window_order()))))
        rows = F.sort_array(F.collect_list(F.struct(F.col(rn), c.alias("_v"))))
    return reduced(s, F.transform(rows, lambda r: r["_v"]), T.ArrayType(vtype), F.array().cast(T.ArrayType(vtype)))


REDUCERS = {"count", "sum", "mean", "min", "max", "fold"}


def group(s: State, step: Step) -> State:
    """One row for each group as struct (key, value); ``frame`` shows both as columns."""
    bys = [m[1][0] if m[1] else None for m in step.mods if m[0] == "by"]
    s, key, ktype = selector(s, bys[0] if bys else None, "label")
    name = fresh("g")
    s = replace(s, df=s.df.withColumn(name, key).filter(F.col(name).isNotNull()))
    value = bys[1] if len(bys) > 1 else None
    if step.name == "groupCount":
        out, vtype = F.sum("_bulk") if s.bulk else F.count("*"), T.LongType()
        df = s.df.groupBy(*s.origin, name).agg(out.alias("_v"))
    elif isinstance(value, Traversal) and value.steps[-1].name in REDUCERS:
        inner = Traversal(None, value.steps[:-1])
        if inner.steps:
            t, pairs = sub(s, inner)
            joined = s.df.select(*s.origin, name, *(F.col(_q(w)).alias(f"{o}_w") for w, o in pairs)).join(t.df, reduce(lambda a, b: a & b, (F.col(f"{o}_w").eqNullSafe(F.col(o)) for _, o in pairs)))
            base = replace(t, df=joined, origin=[*s.origin, name], keys=s.df.select(*s.origin, name).distinct(), binds={})
        else:
            base = replace(s, origin=[*s.origin, name], keys=s.df.select(*s.origin, name).distinct(), binds={}, labels=s.labels)
        got = STEP[value.steps[-1].name](base, value.steps[-1])
        df, vtype = got.df.withColumnRenamed("_val", "_v"), got.vtype
    else:
        if isinstance(value, Traversal) and not (len(value.steps) == 1 and value.steps[0].name == "values"):
            s, lists, vtype = all_values(s, value)
            df = s.df.groupBy(*s.origin, name).agg(F.flatten(F.collect_list(lists)).alias("_v"))
        else:
            s, c, vtype = selector(s, value)
            entry = F.struct(*(F.col(_q(k)) for k, _ in s.order), c.alias("_x"))
            df = s.df.withColumn("_e", F.when(c.isNotNull() | F.lit(value is None), entry)).groupBy(*s.origin, name).agg(F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["_x"]).alias("_v"))
        vtype = T.ArrayType(vtype)
    fields = T.StructType([T.StructField("key", ktype), T.StructField("value", vtype)])
    df = df.select(*s.origin, F.struct(F.col(name).alias("key"), F.col("_v").alias("value")).alias("_val"))
    return replace(s, df=df, kind="x", vtype=fields, labels=None, loaded=False, order=[], binds={}, bulk=False, names=["key", "value"], path=False)


# -- branches ----------------------------------------------------------------------------------


def branch_of(s: State, t: Traversal) -> State:
    return walk(s, t.steps)


def together(states: list[State]) -> State:
    """Branch results in branch order, with what all of them carry."""
    states = [x for x in states if x is not None]
    base = states[0]
    kinds = {x.kind for x in states}
    if kinds != {"x"} and len(kinds) > 1:
        states = [x if x.kind == "x" else x.now(F.col("_id"), T.LongType()) for x in states]
    keep = [c for c in states[0].carried() if all(c in x.df.columns for x in states)]
    keep = [c for c in keep if c not in {o for x in states for o, _ in x.order} - set(base.origin)]
    vtype = V.common([x.vtype for x in states]) if states[0].kind == "x" else None
    branch, rank = fresh("h"), fresh("h")
    frames = []
    for n, x in enumerate(states):
        cols = [F.col(_q(c)) for c in keep]
        if base.need_order:
            cols.append(F.lit(n).alias(branch))
        if x.kind == "x":
            cols.append(V.as_common(F.col("_val"), x.vtype, vtype).alias("_val"))
        else:
            cols.append(F.col("_id"))
            if x.kind == "e":
                cols += [F.col("_src"), F.col("_dst"), F.col("_prev")]
        frames.append((x, cols))
    if base.need_order:  # by the input's order, then the branch, then the branch's own order
        common = [c for c, _ in base.order if all(c in x.df.columns for x, _ in frames)]
        most = max(len([o for o, _ in x.order if o not in common]) for x, _ in frames)
        outs = []
        for x, cols in frames:
            own = [o for o, _ in x.order if o not in common]
            w = Window.partitionBy(*x.origin, *common).orderBy(*(F.col(_q(o)) for o in own)) if own else None
            outs.append(x.df.select(*(F.col(c) for c in common if c not in keep), *cols, (F.row_number().over(w) if w is not None and most else F.lit(0)).alias(rank)))
        order = [*((c, d) for c, d in base.order if c in common), (branch, False), (rank, False)]
        df = reduce(DataFrame.unionByName, outs)
    else:
        order, df = [], reduce(DataFrame.unionByName, (x.df.select(*cols) for x, cols in frames))
    binds = {k: bs for k, bs in base.binds.items() if all(c in df.columns for c, _, _ in bs)}
    known = None if states[0].kind == "x" or any(x.labels is None for x in states) else frozenset().union(*(x.labels for x in states))
    return replace(base, df=df, kind=states[0].kind, vtype=vtype, labels=known, loaded=False, order=order, binds=binds, names=base.names if all(x.names == base.names for x in states) else None)


def union(s: State, step: Step) -> State:
    return together([branch_of(s, t) for t in step.args])


def coalesce(s: State, step: Step) -> State:
    out, rest = [], s
    for n, t in enumerate(step.args):
        out.append(branch_of(rest, t))
        if n < len(step.args) - 1:
            rest = keep(rest, t, anti=True)
    return together(out)


def optional(s: State, step: Step) -> State:
    return together([branch_of(s, step.args[0]), keep(s, step.args[0], anti=True)])


def choose(s: State, step: Step) -> State:
    options = [m[1] for m in step.mods if m[0] == "option"]
    if options:
        return branch(s, Step("branch", step.args, step.mods))
    test, yes = step.args[0], step.args[1]
    no = step.args[2] if len(step.args) > 2 else Traversal(None, ())
    t = test if isinstance(test, Traversal) else Traversal(None, (Step("is", (test,)),))
    return together([branch_of(keep(s, t), yes), branch_of(keep(s, t, anti=True), no)])


def branch(s: State, step: Step) -> State:
    s, key, vtype = selector(s, step.args[0])
    name = fresh("q")
    s = replace(s, df=s.df.withColumn(name, key))
    out, taken = [], F.lit(False)
    other = None
    for args in (m[1] for m in step.mods if m[0] == "option"):
        if len(args) == 1 or args[0] in (None, "none", "Pick.none"):
            other = args[-1]
            continue
        test = args[0].column(F.col(name), vtype) if isinstance(args[0], P) else V.equals(F.col(name), vtype, args[0])
        out.append(branch_of(s.filtered(test), args[1]))
        taken = taken | test
    if other is not None:
        out.append(branch_of(s.filtered(~taken), other))
    return together(out)


def local(s: State, step: Step) -> State:
    found, pairs = sub(s, step.args[0])
    inner = [c for c, _ in found.order]
    mine = s.df.select(*map(_q, s.carried()), *(F.col(_q(w)).alias(f"{o}_w") for w, o in pairs))
    met = reduce(lambda a, b: a & b, (F.col(f"{o}_w").eqNullSafe(F.col(o)) for _, o in pairs))
    got = found.df.select(*found.origin, *(c for c in inner if c not in found.origin), *(_q(c) for c in found.current()))
    df = mine.join(got, met).drop(*(f"{o}_w" for _, o in pairs), *found.origin)
    return replace(found, df=df, origin=s.origin, keys=s.keys, order=[*s.order, *found.order], binds=s.binds, need_order=s.need_order, path=False)


def repeat(s: State, step: Step) -> State:
    """Breadth-first rounds of joins; times and until are checked before each round."""
    from weftgraph.operators.rounds import repeated

    return repeated(s, step)


# -- side effects ------------------------------------------------------------------------------


def store(s: State, step: Step) -> State:
    """store() and aggregate() are one: whether a list fills early or late can't be seen before cap()."""
    s.effects[step.args[0]] = s
    return s


def cap(s: State, step: Step) -> State:
    kept = [(k, fold(replace(s.effects[k], origin=[]), Step("fold"))) for k in step.args]
    if len(kept) == 1:
        return replace(kept[0][1], effects=s.effects)
    df = reduce(lambda a, b: a.crossJoin(b), (x.df.withColumnRenamed("_val", f"_{k}") for k, x in kept))  # one row each
    fields = T.StructType([T.StructField(k, x.vtype) for k, x in kept])
    return replace(kept[0][1], df=df.select(F.struct(*(F.col(f"_{k}").alias(k) for k, _ in kept)).alias("_val")), vtype=fields, names=list(step.args), effects=s.effects)


def side_effect(s: State, step: Step) -> State:
    walk(s, step.args[0].steps)
    return s


def profile(s: State, step: Step) -> State:
    """Counts rows as they pass; the observation fills when the query has run."""
    from pyspark.sql import Observation

    watch = Observation()
    s.effects[step.args[0] if step.args else "profile"] = {"observation": watch, "started": time.time()}
    return replace(s, df=s.df.observe(watch, F.count(F.lit(1)).alias("count")))


def algorithm(s: State, step: Step) -> State:
    from weftgraph.operators.algorithms import step_result

    return step_result(s, step)


def mutation(s: State, step: Step) -> State:
    raise ValueError(f"{step.name}() changes the graph: end the traversal with mutate()")


STEP = {
    **dict.fromkeys(("out", "in", "both", "outE", "inE", "bothE"), hop),
    **dict.fromkeys(("outV", "inV", "bothV", "otherV"), endpoint),
    **dict.fromkeys(("hasLabel", "has", "hasNot", "hasId"), has),
    "is": lambda s, x: s.filtered(condition(s, x)),
    "where": where, "and": logical, "or": logical, "not": logical, "dedup": dedup,
    **dict.fromkeys(("limit", "skip", "range", "tail"), cut),
    "coin": coin, "sample": sample, "simplePath": paths, "cyclicPath": paths, "filter": host_filter, "hasKey": property_filter, "hasValue": property_filter,
    "values": values, "properties": properties, "valueMap": value_map, "elementMap": value_map, "propertyMap": value_map,
    **dict.fromkeys(("id", "label", "key", "value", "loops"), metadata),
    "index": index, "path": path, "as": bind, "select": select, "map": host_map, "flatMap": host_map, "project": project, "math": math,
    "constant": constant, "identity": lambda s, x: s, "order": order, "unfold": unfold, "textScore": text_score,
    "count": count, "sum": total, "mean": mean, "min": extreme, "max": extreme, "fold": fold, "group": group, "groupCount": group,
    "union": union, "coalesce": coalesce, "optional": optional, "choose": choose, "branch": branch, "local": local, "repeat": repeat,
    "store": store, "aggregate": store, "cap": cap, "sideEffect": side_effect, "profile": profile,
    **dict.fromkeys(("shortestPath", "kShortestPaths", "bfs", "dfs", "bidirectionalBfs", "iddfs"), algorithm),
    **dict.fromkeys(("addV", "addE", "property", "drop"), mutation),
}

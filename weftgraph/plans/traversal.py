"""Fluent traversals: a list of step records that ``operators.execute`` lowers to one DataFrame plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from weftgraph.functions.predicates import P, TextP


@dataclass
class Step:
    name: str
    args: tuple = ()
    mods: list = field(default_factory=list)  # (modulator, args) as by, option, times, until, emit, with

    def __repr__(self):
        return f"{self.name}({', '.join(map(repr, self.args))})" + "".join(f".{m}({', '.join(map(repr, a))})" for m, a in self.mods)


#: Steps, with the names of the traversal language; Python's keywords take a trailing underscore.
STEPS = """V E inject searchTextV searchTextE
out in both outE inE bothE outV inV bothV otherV
hasLabel has hasNot hasId hasKey hasValue filter is where not and or dedup limit skip range tail coin sample simplePath cyclicPath
values properties valueMap elementMap propertyMap id label key value loops index path as select map flatMap project math constant identity order unfold textScore
count sum mean min max fold group groupCount
union coalesce choose optional local branch repeat
store aggregate cap sideEffect profile
addV addE property drop
shortestPath kShortestPaths bfs dfs bidirectionalBfs iddfs""".split()
MODULATORS = ["by", "option", "times", "until", "emit", "emit_first", "from", "to", "with"]
RENAMED = {"in": "in_", "is": "is_", "not": "not_", "and": "and_", "or": "or_", "as": "as_", "from": "from_", "with": "with_", "filter": "filter_", "sum": "sum_", "min": "min_", "max": "max_", "range": "range_", "id": "id_", "map": "map_", "property": "property_"}
BARRIERS = {"order", "dedup", "limit", "skip", "range", "tail", "sample", "count", "sum", "mean", "min", "max", "fold", "group", "groupCount", "aggregate", "cap", "profile", "index"}
CATEGORIES = {
    "source": {"V", "E", "inject", "searchTextV", "searchTextE"},
    "navigation": {"out", "in", "both", "outE", "inE", "bothE", "outV", "inV", "bothV", "otherV"},
    "filter": {"hasLabel", "has", "hasNot", "hasId", "hasKey", "hasValue", "filter", "is", "where", "not", "and", "or", "dedup", "limit", "skip", "range", "tail", "coin", "sample", "simplePath", "cyclicPath"},
    "reduce": {"count", "sum", "mean", "min", "max", "fold", "group", "groupCount"},
    "branch": {"union", "coalesce", "choose", "optional", "local", "branch", "repeat"},
    "side effect": {"store", "aggregate", "cap", "sideEffect", "profile"},
    "mutation": {"addV", "addE", "property", "drop"},
    "algorithm": {"shortestPath", "kShortestPaths", "bfs", "dfs", "bidirectionalBfs", "iddfs"},
}


class Traversal:
    """An immutable chain of steps; anonymous if it has no graph."""

    def __init__(self, graph=None, steps: tuple = ()):
        self.graph, self.steps = graph, steps

    def __repr__(self):
        return "".join(f".{s!r}" for s in self.steps) or ".identity()"

    def _with(self, step: Step) -> Traversal:
        return type(self)(self.graph, (*self.steps, step))

    def _mod(self, name: str, args: tuple) -> Traversal:
        if not self.steps:
            raise ValueError(f"{name}() needs a step before it")
        last = self.steps[-1]
        return type(self)(self.graph, (*self.steps[:-1], Step(last.name, last.args, [*last.mods, (name, args)])))

    # -- conveniences over plain steps ---------------------------------------------------------
    def where_eq(self, label: str):
        return self._with(Step("where", (P("eq_label", label),)))

    def where_neq(self, label: str):
        return self._with(Step("where", (P("neq_label", label),)))

    def choose_by(self, t):
        return self._with(Step("branch", (t,)))

    def count_local(self):
        return self._with(Step("count", ("local",)))

    def sum_local(self):
        return self._with(Step("sum", ("local",)))

    def dijkstra_to(self, target, weight: str):
        return self._with(Step("shortestPath", (target,), [("by", (weight,))]))

    # -- terminals -----------------------------------------------------------------------------
    def _run(self, asked=None):
        from weftgraph.operators.execute import run

        return run(self, asked)

    def df(self, *columns: str):
        """The result as a DataFrame: properties of elements, keys of maps, or ``value``."""
        return self._run(columns or None).frame(*columns)

    def to_list(self) -> list:
        return self._run(()).collect()

    toList = to_list

    def to_set(self) -> set:
        return set(self._run(()).distinct().collect())

    toSet = to_set

    def next(self, n: int | None = None):
        if n is not None:
            return self._with(Step("limit", (n,))).to_list()
        found = self._with(Step("limit", (1,))).to_list()
        if not found:
            raise StopIteration("the traversal is empty")
        return found[0]

    def one(self):
        found = self._with(Step("limit", (2,))).to_list()
        if len(found) != 1:
            raise ValueError("not one" if found else "none")
        return found[0]

    def has_next(self) -> bool:
        return not self._run(()).df.isEmpty()

    hasNext = has_next

    def iterate(self) -> None:
        self._run(()).df.write.format("noop").mode("overwrite").save()

    def iter(self):
        """Values one partition at a time."""
        return self._run(()).stream()

    def traversers(self):
        return self._run().df.toLocalIterator()

    def explain(self) -> str:
        """Steps with their category, barrier flag and a hint where an index covers a filter; doesn't run."""
        lines = []
        for n, s in enumerate(self.steps):
            category = next((c for c, names in CATEGORIES.items() if s.name in names), "transform")
            keys = {k for spec in (self.graph.indexes.values() if self.graph else ()) for k in [spec.key]}
            hint = f" index on {s.args[0]}" if s.name == "has" and s.args and s.args[0] in keys else ""
            lines.append(f"{n} {s!r} [{category}]{' barrier' if s.name in BARRIERS else ''}{hint}")
        return "\n".join(lines)

    def plan(self, mode: str = "formatted") -> None:
        self._run().df.explain(mode)

    def mutate(self):
        """Apply pending additions, properties and drops; (new graph, counters)."""
        from weftgraph.operators.mutation import apply_traversal

        return apply_traversal(self)

    def subscribe(self, changes, sink, **options):
        """Keep this query's result up to date over a stream of changes; see ``streaming``."""
        from weftgraph.streaming.subscribe import subscribe

        return subscribe(self, changes, sink, **options)


def _method(name: str):
    def method(self, *args):
        return self._with(Step(name, args))

    return method


def _modulator(name: str):
    def method(self, *args):
        return self._mod(name, args)

    return method


for _name in STEPS:
    setattr(Traversal, RENAMED.get(_name, _name), _method(_name))
    if _name not in ("V", "E", "id", "min", "max", "sum", "range", "map", "filter", "property"):
        setattr(Traversal, re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), RENAMED.get(_name, _name)), _method(_name))
for _name in ("id", "min", "max", "sum", "range", "map", "filter", "property"):
    setattr(Traversal, _name, _method(_name))
for _name in MODULATORS:
    setattr(Traversal, RENAMED.get(_name, _name), _modulator(_name))
Traversal.dedup_by = lambda self, t: self.dedup().by(t)
Traversal.dedup_by_key = lambda self, k: self.dedup(k)
Traversal.dedup_by_label = lambda self: self.dedup().by("T.label")


class GraphTraversalSource:
    """Where a bound traversal starts."""

    def __init__(self, graph):
        self.graph = graph

    def V(self, *ids):
        return Traversal(self.graph, (Step("V", ids),))

    def E(self, *ids):
        return Traversal(self.graph, (Step("E", ids),))

    v, e = V, E

    def inject(self, *values):
        return Traversal(self.graph, (Step("inject", values),))

    def addV(self, label):
        return Traversal(self.graph, (Step("addV", (label,)),))

    def addE(self, label):
        return Traversal(self.graph, (Step("addE", (label,)),))

    def searchTextV(self, key, query, k):
        return Traversal(self.graph, (Step("searchTextV", (key, query, k)),))

    def searchTextE(self, key, query, k):
        return Traversal(self.graph, (Step("searchTextE", (key, query, k)),))

    def v_by_property(self, label, key, value):
        t = self.V() if label is None else self.V().hasLabel(label)
        return t.has(key, value)

    def v_by_property_range(self, label, key, low=None, high=None, low_inclusive=True, high_inclusive=False):
        t = self.V() if label is None else self.V().hasLabel(label)
        if low is not None:
            t = t.has(key, P.gte(low) if low_inclusive else P.gt(low))
        if high is not None:
            t = t.has(key, P.lte(high) if high_inclusive else P.lt(high))
        return t

    def e_by_property(self, label, key, value):
        t = self.E() if label is None else self.E().hasLabel(label)
        return t.has(key, value)


class _Anonymous:
    """``__``: starts a traversal without a graph."""

    def __getattr__(self, name):
        return getattr(Traversal(), name)


__ = _Anonymous()
__all__ = ["GraphTraversalSource", "P", "Step", "TextP", "Traversal", "__"]

"""Changes to a graph as deltas over its tables; every change is a new graph, the old one stays valid.

A query's matches are a DataFrame, and each clause is one set-based delta over all of them: additions are
unions with ids above the highest, updates are joins on the id, removals are anti-joins. Nothing is
collected but counters.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V
from weftgraph.model import SYSTEM, PropertyGraph
from weftgraph.plans import schema as S
from weftgraph.plans.gql_parser import GqlError, Query
from weftgraph.runtime import settle

COUNTERS = ("vertices_added", "vertices_removed", "edges_added", "edges_removed", "properties_set")


class MutationError(ValueError):
    """The change isn't allowed."""


# -- deltas ------------------------------------------------------------------------------------


def next_id(graph: PropertyGraph, kind: str) -> int:
    found = graph.view(kind).agg(F.max("id")).first()[0]
    return 0 if found is None else found + 1


def append(graph: PropertyGraph, kind: str, label: str, rows: DataFrame) -> PropertyGraph:
    """Rows (id, (src, dst,) properties) under a label; columns are merged by name and common type."""
    tables = dict(graph.vertices if kind == "v" else graph.edges)
    if label in tables:
        old = tables[label]
        a, b = ({f.name: f.dataType for f in x.schema.fields} for x in (old, rows))
        cols = list(dict.fromkeys([*a, *b]))
        target = {c: V.common([t[c] for t in (a, b) if c in t]) if c not in SYSTEM else (a.get(c) or b.get(c)) for c in cols}

        def fit(df, own):
            return df.select(*((V.as_common(F.col(f"`{c}`"), own[c], target[c]) if c in own else F.lit(None).cast(target[c])).alias(c) for c in cols))

        rows = fit(old, a).union(fit(rows, b))
    tables[label] = rows
    return graph.changed(tables, graph.edges) if kind == "v" else graph.changed(graph.vertices, tables)


def update(graph: PropertyGraph, kind: str, key: str, changes: DataFrame, dtype: T.DataType, remove: bool = False) -> PropertyGraph:
    """Set a property from (id, value[, turn]); an id's value of the last turn wins. ``remove`` makes the key absent."""
    tables = dict(graph.vertices if kind == "v" else graph.edges)
    last = F.max_by("value", "turn") if "turn" in changes.columns else F.max("value")
    changes = changes.groupBy("id").agg(last.alias("__new"))
    for label, df in tables.items():
        own = {f.name: f.dataType for f in df.schema.fields}
        if remove and key not in own:
            continue
        hit = df.select("id").join(changes, "id", "left_semi")
        if key not in own and hit.isEmpty():
            continue
        target = own[key] if remove else V.common([t for t in (own.get(key), dtype) if t is not None])
        joined = df.join(changes.withColumn("__hit", F.lit(True)), "id", "left")
        old = V.as_common(F.col(f"`{key}`"), own[key], target) if key in own else F.lit(None).cast(target)
        new = F.lit(None).cast(target) if remove else V.as_common(F.col("__new"), dtype, target)
        out = joined.withColumn(key, F.when(F.col("__hit"), new).otherwise(old))
        if "__keys" in own:
            names = F.array_remove("__keys", key) if remove else F.array_union("__keys", F.array(F.lit(key)))
            out = out.withColumn("__keys", F.when(F.col("__hit"), names).otherwise(F.col("__keys")))
        tables[label] = out.drop("__new", "__hit")
    return graph.changed(tables, graph.edges) if kind == "v" else graph.changed(graph.vertices, tables)


def remove(graph: PropertyGraph, kind: str, ids: DataFrame, cascade: bool = True) -> tuple[PropertyGraph, dict]:
    """Without the elements of (id); vertices take their edges with them, or refuse if they have any."""
    ids = settle(ids.select("id").distinct())
    counts = dict.fromkeys(COUNTERS, 0)
    vertices, edges = dict(graph.vertices), dict(graph.edges)
    if kind == "e":
        counts["edges_removed"] = graph.view("e").join(ids, "id", "left_semi").count()
        edges = {k: df.join(ids, "id", "left_anti") for k, df in edges.items()}
    else:
        touched = graph.view("e").select("id", "src", "dst")
        gone = touched.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("id").union(touched.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id")).distinct()
        counts["edges_removed"] = gone.count()
        if counts["edges_removed"] and not cascade:
            raise MutationError("a vertex with edges can't be deleted: use DETACH DELETE")
        counts["vertices_removed"] = graph.view("v").join(ids, "id", "left_semi").count()
        vertices = {k: df.join(ids, "id", "left_anti") for k, df in vertices.items()}
        edges = {k: df.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti") for k, df in edges.items()}
    return graph.changed(vertices, edges), counts


def add_vertex(graph, label: str, **properties) -> tuple[PropertyGraph, int]:
    i = next_id(graph, "v")
    given = S.defaults(graph.schema, label, properties)
    made = PropertyGraph.from_rows(graph.spark, [{"id": i, "label": label, **given}], [])
    return append(graph, "v", label, made.vertices[label]), i


def add_edge(graph, src: int, dst: int, label: str, **properties) -> tuple[PropertyGraph, int | None]:
    """None, and the same graph, if an endpoint is missing."""
    if graph.view("v").filter(F.col("id").isin(src, dst)).count() != len({src, dst}):
        return graph, None
    i = next_id(graph, "e")
    given = S.defaults(graph.schema, label, properties, "e")
    made = PropertyGraph.from_rows(graph.spark, [], [{"id": i, "label": label, "src": src, "dst": dst, **given}])
    return append(graph, "e", label, made.edges[label]), i


# -- traversal steps ---------------------------------------------------------------------------


def apply_traversal(t):
    """addV, addE, property and drop at the end of a traversal; (new graph, counters)."""
    from weftgraph.operators.execute import start, walk

    graph, steps = t.graph, list(t.steps)
    counts = dict.fromkeys(COUNTERS, 0)
    cut = next((n for n, s in enumerate(steps) if s.name in ("addV", "addE", "property", "drop")), None)
    if cut is None:
        raise MutationError("the traversal changes nothing")
    state = walk(start(graph, steps), steps[1:cut]) if cut else None
    current, kind = (state.df.select(F.col("_id").alias("id")) if state else None), (state.kind if state else None)
    n = cut
    while n < len(steps):
        s = steps[n]
        props = []
        while n + 1 < len(steps) and steps[n + 1].name == "property" and s.name in ("addV", "addE"):
            n += 1
            props.append(steps[n].args[-2:])
        if s.name == "addV":
            times = 1 if current is None else current.count()
            first = next_id(graph, "v")
            given = S.defaults(graph.schema, s.args[0], dict(props))
            made = PropertyGraph.from_rows(graph.spark, [{"id": 0, "label": s.args[0], **given}], []).vertices[s.args[0]]
            rows = graph.spark.range(first, first + times).join(made.drop("id"))
            graph = append(graph, "v", s.args[0], rows)
            current, kind = rows.select("id"), "v"
            counts["vertices_added"] += times
            counts["properties_set"] += times * len(props)
        elif s.name == "addE":
            ends = {m: a[0] for m, a in s.mods if m in ("from", "to")}
            src, dst = (_endpoint(graph, state, ends.get(m), current) for m in ("from", "to"))
            pairs = src.crossJoin(dst.withColumnRenamed("id", "dst")).withColumnRenamed("id", "src") if "from" in ends or "to" in ends and current is None else src.withColumnRenamed("id", "src").crossJoin(dst.withColumnRenamed("id", "dst"))
            known = graph.view("v").select("id")
            pairs = pairs.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
            rows = numbered(pairs.select("src", "dst"), "id", next_id(graph, "e")).select("id", "src", "dst")
            if props:
                made = PropertyGraph.from_rows(graph.spark, [], [{"id": 0, "label": s.args[0], "src": 0, "dst": 0, **dict(props)}]).edges[s.args[0]]
                rows = rows.join(made.drop("id", "src", "dst"))
            counts["edges_added"] += rows.count()
            counts["properties_set"] += rows.count() * len(props)
            graph = append(graph, "e", s.args[0], rows)
            current, kind = rows.select("id"), "e"
        elif s.name == "property":
            key, val = s.args[-2:]
            from weftgraph.model import _infer

            dtype = _infer([val])
            graph = update(graph, kind, key, current.withColumn("value", F.lit(val).cast(dtype)), dtype)
            counts["properties_set"] += current.distinct().count()
        elif s.name == "drop":
            graph, gone = remove(graph, kind, current)
            counts = {k: counts[k] + gone[k] for k in counts}
            current = current.limit(0)
        else:
            raise MutationError(f"{s.name}() can't follow a change")
        n += 1
    S.enforce(graph)
    return graph, counts


def _endpoint(graph, state, what, current) -> DataFrame:
    """Ids of an edge's end: an id, a bound label, a traversal, or the current vertex."""
    from weftgraph.operators.algorithms import replace_graph
    from weftgraph.plans.traversal import Traversal

    if what is None:
        if current is None:
            raise MutationError("addE needs from and to")
        return current
    if isinstance(what, Traversal):
        return replace_graph(what, graph)._run().df.select(F.col("_id").alias("id"))
    if isinstance(what, str):
        col, _, _ = state.binds[what][-1]
        return state.df.select(F.col(col).alias("id"))
    return graph.view("v").filter(F.col("id") == what).select("id")


# -- pattern language --------------------------------------------------------------------------


def run_mutation(graph, query: Query, params: dict):
    """Match once, then apply the changing clauses in order; (new graph, counters)."""
    from weftgraph.plans.gql_compile import CLAUSE, Rows, one_row

    rows = Rows(graph, None, params=params, turns=())
    counts = dict.fromkeys(COUNTERS, 0)
    for n, clause in enumerate(query.clauses):
        if clause[0] in CHANGE:
            rows = one_row(rows)
            rows, counts = CHANGE[clause[0]](rows, clause, counts)
        elif clause[0] == "return":
            continue
        else:
            rows = CLAUSE[clause[0]](rows, clause, query.clauses[n:])
    S.enforce(rows.graph)
    return rows.graph, counts


def create(rows, clause, counts):
    from weftgraph.plans.gql_compile import fresh

    for pattern in clause[1]:
        spots = []
        for node in pattern.nodes:
            if node.var in rows.vars:
                spots.append(node.var)
                continue
            if not node.labels:
                raise GqlError("CREATE needs a label")
            given = S.defaults(rows.graph.schema, node.labels[0], {}, "v")
            props = {k: ("literal", v) for k, v in given.items()} | node.props
            rows, name = number(rows, node.var or fresh("n"), "v")
            rows = make(rows, "v", node.labels[0], name, props, [])
            counts["vertices_added"] += rows.df.count()
            counts["properties_set"] += len(props) * rows.df.count()
            spots.append(name)
        for edge, a, b in zip(pattern.edges, spots, spots[1:], strict=False):
            if not edge.labels:
                raise GqlError("CREATE needs a label")
            src, dst = (b, a) if edge.direction == "in" else (a, b)
            rows, name = number(rows, edge.var or fresh("e"), "e")
            rows = make(rows, "e", edge.labels[0], name, edge.props, [(src, "src"), (dst, "dst")])
            counts["edges_added"] += rows.df.count()
            counts["properties_set"] += len(edge.props) * rows.df.count()
    return rows, counts


def number(rows, name: str, kind: str):
    """New ids, one for each row; settled, as they must not change afterwards."""
    df = numbered(rows.df, name, next_id(rows.graph, kind))
    return replace(rows, df=df).bind(name, kind, ()), name


def numbered(df: DataFrame, name: str, first: int) -> DataFrame:
    """Rows with ids from ``first`` on without gaps: each task counts its own, and begins where the ones before it end."""
    held = settle(df.select("*", F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().alias("__row")))
    sizes = held.groupBy("__task").agg(F.count("*").alias("n"), F.min("__row").alias("low")).orderBy("__task").collect()  # a row for each task
    starts, at = [], first
    for r in sizes:
        starts.append((r["__task"], at - r.low))
        at += r.n
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "__task int, __start long"))
    return held.join(known, "__task").withColumn(name, F.col("__row") + F.col("__start")).drop("__task", "__row", "__start")


def make(rows, kind: str, label: str, name: str, props: dict, ends: list):
    from weftgraph.plans.gql_compile import value

    cols = [F.col(f"`{name}`").alias("id"), *(F.col(f"`{v}`").alias(c) for v, c in ends)]
    for k, e in props.items():
        rows, (c, t) = value(rows, e)
        cols.append((c.cast("string") if isinstance(t, T.NullType) else c).alias(k))
    return replace(rows, graph=append(rows.graph, kind, label, rows.df.select(*cols)))


def set_(rows, clause, counts):
    from weftgraph.plans.gql_compile import value

    for var, key, e in clause[1]:
        if var not in rows.vars:
            raise GqlError(f"unknown variable {var}")
        kind = rows.vars[var][0]
        rows, (c, t) = value(rows, e)
        t = T.StringType() if isinstance(t, T.NullType) else t
        turn = F.struct(*(F.col(x) for x in rows.turns or () if x in rows.df.columns), *(F.col(f"`{v}`") for v, (k, _) in rows.vars.items() if k != "x"))
        changes = settle(rows.df.select(F.col(f"`{var}`").alias("id"), c.cast(t).alias("value"), turn.alias("turn")))
        hit = changes.select("id").distinct().count()
        if reads(e, var, key) and changes.count() > hit:
            raise MutationError(f"{var}.{key} is set from itself by several rows of one element")
        counts["properties_set"] += hit
        df = settle(rows.df)
        rows = replace(rows, graph=update(rows.graph, kind, key, changes, t), df=df.drop(f"{var}${key}") if f"{var}${key}" in df.columns else df)
        rows = replace(rows, df=rows.df.drop(*(x for x in rows.df.columns if x.startswith(f"{var}$"))))
    return rows, counts


def reads(e, var: str, key: str) -> bool:
    """Whether an expression reads a property."""
    if isinstance(e, (list, tuple)):
        return (len(e) == 3 and e[0] == "prop" and e[1] == ("var", var) and e[2] == key) or any(reads(x, var, key) for x in e)
    return False


def remove_keys(rows, clause, counts):
    for var, key in clause[1]:
        ids = settle(rows.df.select(F.col(f"`{var}`").alias("id"), F.lit(None).cast("string").alias("value")))
        rows = replace(rows, df=settle(rows.df), graph=update(rows.graph, rows.vars[var][0], key, ids, T.StringType(), remove=True))
        counts["properties_set"] += ids.select("id").distinct().count()
    return rows, counts


def delete(rows, clause, counts):
    rows = replace(rows, df=settle(rows.df))
    kinds = sorted(clause[1], key=lambda v: rows.vars[v][0])  # edges before vertices
    for var in kinds:
        graph, gone = remove(rows.graph, rows.vars[var][0], rows.df.select(F.col(f"`{var}`").alias("id")).filter("id IS NOT NULL"), clause[2])
        rows = replace(rows, graph=graph)
        counts = {k: counts[k] + gone[k] for k in counts}
    return rows, counts


def merge(rows, clause, counts):
    """Match or create; ON MATCH changes the first match alone."""
    from weftgraph.plans.gql_compile import match, shared_rows, used

    _, pattern, created, matched = clause
    inner, keys = shared_rows(rows, used(pattern))
    got = match(inner, ("match", [pattern]), [("set", [e for *_, e in matched]), ("all", [("prop", ("var", v), k) for v, k, _ in matched])])
    first = got
    if got.vars:
        order = [F.col(f"`{v}`") for v in got.vars]
        w = Window.partitionBy(*(f"`{k}`" for k in keys)).orderBy(*order)
        first = replace(got, df=settle(got.df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")))
    if keys:
        left = replace(rows, df=settle(rows.df.join(first.df.select(*(f"`{k}`" for k in keys)), keys, "left_anti")))
    else:
        left = replace(rows, df=rows.df.limit(0) if not first.df.isEmpty() else rows.df)
    graph = rows.graph
    if matched:
        first, counts = set_(first, ("set", matched), counts)
        graph = first.graph
    missing = replace(left, graph=graph)
    if not missing.df.isEmpty():
        missing, counts = create(missing, ("create", [pattern]), counts)
        if created:
            missing, counts = set_(missing, ("set", created), counts)
    return replace(rows, graph=missing.graph), counts


def foreach(rows, clause, counts):
    from weftgraph.plans.gql_compile import unwind

    _, var, e, inner = clause
    each = unwind(rows, ("unwind", e, var), [])
    for c in inner:
        each, counts = CHANGE[c[0]](each, c, counts)
    return replace(rows, graph=each.graph), counts


CHANGE = {"create": create, "set": set_, "remove": remove_keys, "delete": delete, "merge": merge, "foreach": foreach}


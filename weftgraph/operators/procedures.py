"""Procedures of the pattern language: CALL name(args) YIELD fields, joined to the rows by their arguments."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators import algorithms, textsearch
from weftgraph.plans.gql_parser import GqlError

LIST, LONG, DOUBLE = T.ArrayType(T.LongType()), T.LongType(), T.DoubleType()
PATH = [("path", LIST), ("distance", DOUBLE)]
SEARCHES = {f"searchText{mode}{kind}": (mode or "Any", kind.lower()) for mode in ("", "All", "Phrase", "Prefix") for kind in "VE"}
MOST_CALLS = 1_000


def call_procedure(rows, name: str, args: list, fields):
    """Evaluated once for each distinct list of arguments; no rows in, no call."""
    from weftgraph.plans.gql_compile import value

    typed = []
    for a in args:
        rows, p = value(rows, a)
        typed.append(p[0])
    marks = [f"__p{n}" for n in range(len(typed))]
    df = rows.df.withColumns(dict(zip(marks, typed, strict=True))) if marks else rows.df
    calls = df.select(*marks).distinct().limit(MOST_CALLS + 1).collect() if marks else [()]
    if len(calls) > MOST_CALLS:
        raise GqlError(f"a procedure is called with at most {MOST_CALLS} lists of arguments")
    found, kinds = None, None
    for call in calls:
        part, kinds = run(rows.graph, name, list(call))
        part = part.select(*(F.lit(v).alias(f"{m}k") for m, v in zip(marks, call, strict=True)), "*")
        found = part if found is None else found.union(part)
    if found is None:
        kinds = run(rows.graph, name, [0] * len(args))[1] if name not in SEARCHES else SEARCH_FIELDS
        out = replace(rows, df=rows.df.select("*", *(F.lit(None).cast(t).alias(f) for f, t in kinds)).filter(F.lit(False)))
    else:
        on = [df[m].eqNullSafe(found[f"{m}k"]) for m in marks]
        joined = df.join(found, on) if on else df.crossJoin(found)
        out = replace(rows, df=joined.drop(*marks, *(f"{m}k" for m in marks)))
    wanted = fields if fields is not None else [(f, f) for f, _ in kinds]
    known = dict(kinds)
    for f, alias in wanted:
        if f not in known:
            raise GqlError(f"{name} has no field {f}")
        if f != alias:
            out = replace(out, df=out.df.withColumnRenamed(f, alias))
        out = out.bind(alias, *(("v", ()) if f in ("node", "elem") and name not in EDGE_SEARCHES else ("e", ()) if f == "elem" else ("x", known[f])))
    return replace(out, df=out.df.drop(*(f for f, _ in kinds if f not in [x for x, _ in wanted])))


SEARCH_FIELDS = [("elem", LONG), ("elemId", LONG), ("score", DOUBLE)]
EDGE_SEARCHES = {k for k, v in SEARCHES.items() if v[1] == "e"}


def run(graph, name: str, a: list) -> tuple[DataFrame, list]:
    spark = graph.spark
    if name in SEARCHES:
        mode, kind = SEARCHES[name]
        key, query, k = a
        if not key or k <= 0:
            raise GqlError("a search needs a property and k > 0")
        found = textsearch.hits(graph, kind, key, textsearch.of_mode(mode, query), k)
        return found.select(F.col("id").alias("elem"), F.col("id").alias("elemId"), "score"), SEARCH_FIELDS
    short = name[0].lower() + name[1:]
    if short == "shortestPath":
        return algorithms.shortest_paths(graph, a[0], a[1]).select("path", "distance"), PATH
    if short == "astar" and len(a) > 3:
        found = algorithms.astar(graph, a[0], a[1], a[2], a[3])
        return spark.createDataFrame([(found[1], float(found[0]))] if found else [], "path array<long>, distance double"), PATH
    if short in ("dijkstra", "astar"):
        return algorithms.dijkstra_all(graph, a[0], a[2], target=a[1]).filter(F.col("vertex") == a[1]).select("path", "distance"), PATH
    if short == "kShortestPaths":
        found = algorithms.k_shortest_paths(graph, a[0], a[1], a[2], a[3] if len(a) > 3 else None)
        return spark.createDataFrame([(p, float(c), n) for n, (c, p) in enumerate(found)], "path array<long>, distance double, `index` long"), [*PATH, ("index", LONG)]
    if short == "bfs":
        return algorithms.bfs(graph, a[0], a[1] if len(a) > 1 else None).select(F.col("vertex").alias("node"), "depth"), [("node", LONG), ("depth", LONG)]
    if short == "dfs":
        return spark.createDataFrame(algorithms.dfs(graph, a[0], a[1] if len(a) > 1 else None), "node long, depth long"), [("node", LONG), ("depth", LONG)]
    if short == "bidirectionalBfs":
        found = algorithms.bidirectional_paths(graph, a[0], a[1])
        return spark.createDataFrame([(found, float(len(found) - 1))] if found else [], "path array<long>, distance double"), PATH
    if short == "iddfs":
        found = algorithms.iddfs(graph, a[0], a[1], a[2])
        return spark.createDataFrame([(found, float(len(found) - 1))] if found else [], "path array<long>, distance double"), PATH
    raise GqlError(f"unknown procedure {name}")

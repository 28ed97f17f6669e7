"""Pattern-language queries lowered to one DataFrame plan.

A row is one match: every variable is a column (an element's id, or a value), and the properties that the
query reads of an element stand beside it. Clauses are applied strictly in their order. Patterns are
equi-joins of vertex and edge views; variable-length edges are unrolled; OPTIONAL MATCH, EXISTS, pattern
lists and correlated subqueries are decorrelated: they run over the distinct rows of the variables that they
share with the outer query, and come back by outer join, semi-join flag or aggregate.

Logic is two-valued: comparisons are never null, NOT is plain negation.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import geo, scalars
from weftgraph.functions import values as V
from weftgraph.functions.mathexpr import compile_math, names
from weftgraph.plans.gql_parser import GqlError, Pattern, Query, aggregates, parse

#: Hops of an unbounded variable-length edge, and limits of a query's size.
MAX_HOPS = 10
MOST_PATTERNS, MOST_OPTIONAL, MOST_UNIONS, MOST_DEPTH = 100, 50, 50, 10
_fresh = itertools.count()


def fresh(stem: str) -> str:
    return f"__{stem}{next(_fresh)}"


@dataclass
class Rows:
    """Matches so far: a frame, and what its columns mean."""

    graph: object
    df: DataFrame | None
    vars: dict = field(default_factory=dict)  # name: ("v" | "e" | "x", labels or type)
    params: dict = field(default_factory=dict)
    paths: dict = field(default_factory=dict)  # path name: column of vertex ids
    track: str | None = None
    group: list | None = None  # correlated subquery: columns that stand for the outer row
    depth: int = 0
    turns: tuple | None = None  # of a changing query: columns that tell the order of its rows, outermost first

    def bind(self, name: str, kind: str, what) -> Rows:
        return replace(self, vars={**self.vars, name: (kind, what)})


def run_gql(graph, text: str, params: dict | None = None):
    """The result's DataFrame; for a query that changes the graph, (new graph, counters)."""
    query = parse(text)
    kinds = {c[0] for q in [query, *(b for _, b in query.branches)] for c in q.clauses}
    if kinds & {"create", "set", "remove", "delete", "merge", "foreach"}:
        from weftgraph.operators.mutation import run_mutation

        return run_mutation(graph, query, params or {})
    return compile_query(graph.focused(keys_read(query)), query, params or {})


def keys_read(query: Query) -> set | None:
    """Property names that the query may read; None for all."""
    out: set = set()
    stack: list = [query]
    while stack:
        x = stack.pop()
        if isinstance(x, Query):
            stack += [*x.clauses, *(b for _, b in x.branches)]
        elif isinstance(x, Pattern):
            for item in (*x.nodes, *x.edges):
                out |= item.props.keys()
                stack += [*item.props.values(), *([item.where] if item.where is not None else [])]
        elif isinstance(x, dict):
            stack += list(x.values())
        elif isinstance(x, (tuple, list)):
            if len(x) == 3 and x[0] == "prop" and isinstance(x[2], str):
                out.add(x[2])
            if x and (x[0] == "procedure" or (x[0] == "call" and x[1] == "PROPERTIES")):
                return None
            stack += list(x)
    return out


def compile_query(graph, query: Query, params: dict, outer: Rows | None = None) -> DataFrame:
    check(query, outer.depth if outer else 0)
    first = single(graph, query, params, outer)
    for every, branch in query.branches:
        other = single(graph, branch, params, outer)
        if len(first.columns) != len(other.columns):
            raise GqlError("branches of UNION have different numbers of columns")
        first = first.union(other.toDF(*first.columns))
        if not every:
            first = first.distinct()
    return first


def check(query: Query, depth: int) -> None:
    patterns = sum(len(c[1]) for c in query.clauses if c[0] == "match")
    optional = sum(c[0] == "optional" for c in query.clauses)
    if patterns > MOST_PATTERNS or optional > MOST_OPTIONAL or len(query.branches) > MOST_UNIONS or depth > MOST_DEPTH:
        raise GqlError("the query is too complex")


def single(graph, query: Query, params: dict, outer: Rows | None) -> DataFrame:
    rows = replace(outer, depth=outer.depth + 1) if outer else Rows(graph, None, params=params)
    result = None
    for n, clause in enumerate(query.clauses):
        if result is not None:
            raise GqlError("RETURN must be the last clause")
        if clause[0] == "return":
            result = project(rows, *clause[1:])
            continue
        rest = query.clauses[n:]
        rows = CLAUSE[clause[0]](rows, clause, rest)
    if result is None:
        raise GqlError("the query has no RETURN")
    keep = [*(rows.group or []), *result.names]
    return result.df.select(*(f"`{c}`" for c in keep))


# -- patterns ----------------------------------------------------------------------------------


def one_row(rows: Rows) -> Rows:
    return rows if rows.df is not None else replace(rows, df=rows.graph.spark.range(1).select())


def props_of(graph, kind: str, labels) -> dict:
    return graph.properties(kind, frozenset(labels) if labels else None)


def column(var: str, key: str) -> str:
    return f"{var}${key}"


def view(graph, kind: str, labels, var: str) -> DataFrame:
    df = graph.view(kind, frozenset(labels) if labels else None)
    ends = [] if kind == "v" else [F.col("src").alias(column(var, "__src")), F.col("dst").alias(column(var, "__dst"))]
    return df.select(F.col("id").alias(var), F.col("label").alias(column(var, "__label")), *ends, *(F.col(f"`{k}`").alias(column(var, k)) for k in props_of(graph, kind, labels)))


def conditions(rows: Rows, var: str, kind: str, item) -> Rows:
    """Property map and inline WHERE of a node or edge."""
    for k, e in item.props.items():
        rows, a = value(rows, ("prop", ("var", var), k))
        rows, b = value(rows, e)
        rows = replace(rows, df=rows.df.filter(scalars.equal(a, b)))
    if item.where is not None:
        rows = where(rows, ("where", item.where), [])
    return rows


def match_pattern(rows: Rows, pattern: Pattern, wanted: set | None) -> Rows:
    """Join one pattern to the rows; ``wanted`` are variables whose properties are read (None: any)."""
    single_var = len({n.var for n in pattern.nodes if n.var} | {e.var for e in pattern.edges if e.var}) == 1 and not rows.vars
    start = pattern.nodes[0]
    var = start.var or fresh("n")
    if var in rows.vars and rows.df is not None:
        if start.labels:
            rows = replace(rows, df=rows.df.filter(F.col(f"`{column(var, '__label')}`").isin(*start.labels)))
        rows = conditions(rows, var, "v", start)
    else:
        found = view(rows.graph, "v", start.labels, var)
        df = found if rows.df is None or not rows.df.columns else rows.df.crossJoin(found)
        rows = conditions(replace(rows, df=df).bind(var, "v", start.labels), var, "v", start)
    path = None
    if pattern.name or rows.track:
        path = fresh("path")
        rows = replace(rows, df=rows.df.withColumn(path, F.array(F.col(f"`{var}`"))))
    here = var
    for edge, node in zip(pattern.edges, pattern.nodes[1:], strict=True):
        there = node.var or fresh("n")
        rows = hop(rows, here, edge, there, node, path, wanted)
        here = there
    if path:
        rows = replace(rows, paths={**rows.paths, pattern.name or rows.track: path})
    if single_var and any(e.hops for e in pattern.edges):
        name = next(iter({n.var for n in pattern.nodes if n.var}))
        rows = replace(rows, df=rows.df.dropDuplicates([name]))
    return rows


def ways(graph, edge, evar: str | None) -> DataFrame:
    """(__a, __b) for each way along the edges, with the edge's columns if it has a name."""
    e = graph.view("e", frozenset(edge.labels) if edge.labels else None)
    extra = []
    if evar:
        extra = [F.col("id").alias(evar), F.col("label").alias(column(evar, "__label")), F.col("src").alias(column(evar, "__src")), F.col("dst").alias(column(evar, "__dst"))]
        extra += [F.col(f"`{k}`").alias(column(evar, k)) for k in props_of(graph, "e", edge.labels)]
    out = e.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), *extra)
    back = e.select(F.col("dst").alias("__a"), F.col("src").alias("__b"), *extra)
    return {"out": out, "in": back, "both": out.union(back)}[edge.direction]


def hop(rows: Rows, here: str, edge, there: str, node, path: str | None, wanted: set | None) -> Rows:
    graph = rows.graph
    evar = edge.var or (fresh("e") if edge.props or edge.where is not None else None)
    if edge.hops is None:
        side = ways(graph, edge, evar)
        df = rows.df.join(side, F.col(f"`{here}`") == F.col("__a")).drop("__a")
        rows = replace(rows, df=df)
        if evar:
            rows = conditions(rows.bind(evar, "e", edge.labels), evar, "e", edge)
        if path:
            rows = replace(rows, df=rows.df.withColumn(path, F.concat(F.col(path), F.array("__b"))))
    else:
        least, most = edge.hops[0], edge.hops[1] if edge.hops[1] is not None else MAX_HOPS
        now = rows.df.withColumn("__b", F.col(f"`{here}`"))
        depths = [now] if least == 0 else []
        for depth in range(1, most + 1):
            mark = fresh("s")
            step = edge_step(rows, edge).select(F.col("__a").alias(mark), F.col("__b").alias(f"{mark}b"))
            now = now.join(step, F.col("__b") == F.col(mark)).drop("__b", mark).withColumnRenamed(f"{mark}b", "__b")
            if path:
                now = now.withColumn(path, F.concat(F.col(path), F.array("__b")))
            if depth % 4 == 0 and depth < most:
                from weftgraph.runtime import settle

                now = settle(now)
                if now.isEmpty():
                    break
            if depth >= least:
                depths.append(now)
        rows = replace(rows, df=reduce(DataFrame.unionByName, depths))
    if there in rows.vars:
        rows = replace(rows, df=rows.df.filter(F.col("__b") == F.col(f"`{there}`")).drop("__b"))
        if node.labels:
            rows = replace(rows, df=rows.df.filter(F.col(f"`{column(there, '__label')}`").isin(*node.labels)))
    elif wanted is None or there in wanted or node.labels or node.props or node.where is not None:
        side = view(graph, "v", node.labels, there)
        rows = replace(rows, df=rows.df.join(side, F.col("__b") == F.col(f"`{there}`")).drop("__b")).bind(there, "v", node.labels)
    else:
        rows = replace(rows, df=rows.df.withColumnRenamed("__b", there)).bind(there, "v", ())
    return conditions(rows, there, "v", node) if node.props or node.where is not None else rows


def edge_step(rows: Rows, edge) -> DataFrame:
    """Ways of one hop of a variable-length edge, filtered by its property map."""
    if not edge.props and edge.where is None:
        return ways(rows.graph, edge, None)
    evar = edge.var or fresh("e")
    inner = Rows(rows.graph, ways(rows.graph, edge, evar), params=rows.params).bind(evar, "e", edge.labels)
    return conditions(inner, evar, "e", edge).df


def read_vars(clauses) -> set | None:
    """Variables whose properties or labels later clauses may read."""
    out: set = set()
    stack = list(clauses)
    while stack:
        x = stack.pop()
        if isinstance(x, Query):
            stack += [*x.clauses, *(b for _, b in x.branches)]
        elif isinstance(x, Pattern):
            for item in (*x.nodes, *x.edges):
                stack += [*item.props.values(), *([item.where] if item.where is not None else [])]
                if item.var and (item.labels or item.props):
                    out.add(item.var)
        elif isinstance(x, dict):
            stack += [v for v in x.values()]
        elif isinstance(x, (tuple, list)):
            if len(x) == 3 and x[0] == "prop" and x[1][0] == "var":
                out.add(x[1][1])
            if len(x) == 3 and x[0] == "call" and x[1] in ("PROPERTIES", "LABELS", "TYPE"):
                out |= {e[1] for e in x[2] if isinstance(e, tuple) and e[0] == "var"}
            if x and x[0] in ("star", "procedure"):
                return None
            stack += list(x)
    return out


def match(rows: Rows, clause, rest) -> Rows:
    wanted = read_vars(rest)
    waiting = list(clause[1])
    while waiting:  # patterns that share a variable with what is there go first: joins, not products
        pick = next((p for p in waiting if {n.var for n in p.nodes if n.var} & rows.vars.keys()), waiting[0])
        waiting.remove(pick)
        shared = [n for n, node in enumerate(pick.nodes) if node.var in rows.vars and rows.df is not None]
        if shared and shared[0] != 0 and not pick.name and not rows.track:
            cut = shared[0]  # walk outwards from the shared node, both ways
            left = Pattern(pick.nodes[cut::-1], [flipped(e) for e in pick.edges[cut - 1 :: -1]])
            right = Pattern(pick.nodes[cut:], pick.edges[cut:])
            rows = match_pattern(match_pattern(rows, left, wanted), right, wanted)
        elif shared or rows.df is None or not rows.df.columns:
            rows = match_pattern(rows, pick, wanted)
        else:
            apart = match_pattern(replace(rows, df=None, vars={}, paths={}), pick, wanted)
            rows = replace(rows, df=rows.df.crossJoin(apart.df), vars={**rows.vars, **apart.vars}, paths={**rows.paths, **apart.paths})
    return rows


def flipped(edge):
    return replace(edge, direction={"out": "in", "in": "out", "both": "both"}[edge.direction])


# -- decorrelation -----------------------------------------------------------------------------


def shared_rows(rows: Rows, names_used: set) -> tuple[Rows, list[str]]:
    """The distinct outer rows of some variables, with their property columns."""
    mine = [v for v in rows.vars if v in names_used]
    cols = [c for v in mine for c in rows.df.columns if c == v or c.startswith(f"{v}$")]
    keys = [*mine]
    df = rows.df.select(*(f"`{c}`" for c in cols)).dropDuplicates(keys) if mine else rows.graph.spark.range(1).select()
    return replace(rows, df=df, vars={v: rows.vars[v] for v in mine}, paths={}, track=None, group=None), keys


def used(*things) -> set:
    out: set = set()
    stack = list(things)
    while stack:
        x = stack.pop()
        if isinstance(x, Pattern):
            for item in (*x.nodes, *x.edges):
                out |= {item.var} if item.var else set()
                stack += [*item.props.values(), *([item.where] if item.where is not None else [])]
        elif isinstance(x, Query):
            stack += [*x.clauses, *(b for _, b in x.branches)]
        elif isinstance(x, dict):
            stack += list(x.values())
        elif isinstance(x, (tuple, list)):
            if len(x) == 2 and x[0] == "var":
                out.add(x[1])
            stack += list(x)
    return out


def back(rows: Rows, found: DataFrame, keys: list[str], how: str, taken: set | None = None) -> DataFrame:
    """Join by null-safe equality of keys, which ``found`` carries under their names."""
    if not keys:
        return rows.df.join(found, how=how) if how == "left" else rows.df.crossJoin(found)
    renamed = found.select(*(F.col(f"`{k}`").alias(f"__k_{k}") for k in keys), *(f"`{c}`" for c in found.columns if c not in keys and c not in (taken or ())))
    on = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"`__k_{k}`")) for k in keys))
    return rows.df.join(renamed, on, how).drop(*(f"__k_{k}" for k in keys))


def optional(rows: Rows, clause, rest) -> Rows:
    _, patterns, test = clause
    rows = one_row(rows)
    inner, keys = shared_rows(rows, used(patterns))
    got = match(inner, ("match", patterns), rest)
    extra = set(rows.df.columns) & set(got.df.columns) - set(keys)
    df = back(rows, got.df, keys, "left", extra)
    out = replace(rows, df=df, vars={**rows.vars, **{k: v for k, v in got.vars.items() if k not in rows.vars}})
    return where(out, ("where", test), rest) if test is not None else out


def exists(rows: Rows, pattern: Pattern, test) -> tuple[Rows, Column]:
    inner, keys = shared_rows(rows, used(pattern, test))
    got = match(inner, ("match", [pattern]), [("where", test)] if test is not None else [])
    if test is not None:
        got = where(got, ("where", test), [])
    flag = fresh("x")
    found = got.df.select(*(f"`{k}`" for k in keys)).distinct() if keys else got.df.limit(1).select()
    df = back(rows, found.withColumn(flag, F.lit(True)), keys, "left")
    return replace(rows, df=df), F.coalesce(F.col(flag), F.lit(False))


def pattern_list(rows: Rows, pattern: Pattern, test, body) -> tuple[Rows, scalars.Typed]:
    inner, keys = shared_rows(rows, used(pattern, test, body))
    got = match(inner, ("match", [pattern]), [("where", test), ("return", body)])
    if test is not None:
        got = where(got, ("where", test), [])
    got, (c, t) = value(got, body)
    name = fresh("l")
    lists = got.df.withColumn("__v", c).groupBy(*(f"`{k}`" for k in keys)).agg(F.sort_array(F.collect_list("__v")).alias(name))
    df = back(rows, lists, keys, "left")
    return replace(rows, df=df), (F.coalesce(F.col(name), F.array().cast(T.ArrayType(t))), T.ArrayType(t))


def call(rows: Rows, clause, rest) -> Rows:
    _, imports, query = clause
    if imports is None:
        sub = compile_query(rows.graph, query, rows.params)
        out = replace(rows, df=sub if rows.df is None else rows.df.crossJoin(sub))
    else:
        unknown = [i for i in imports if i not in rows.vars]
        if unknown:
            raise GqlError(f"unknown variables {unknown}")
        inner, keys = shared_rows(rows, set(imports))
        named = [fresh("o") for _ in keys]
        df = inner.df
        for k, n in zip(keys, named, strict=True):
            df = df.withColumn(n, F.col(f"`{k}`"))
        sub = compile_query(rows.graph, query, rows.params, replace(inner, df=df, group=named, depth=rows.depth))
        renamed = sub.withColumnsRenamed(dict(zip(named, keys, strict=True)))
        whole = all(global_aggregate(q) for q in [query, *(b for _, b in query.branches)])
        out = replace(rows, df=back(rows, renamed, keys, "left" if whole else "inner"))
        if whole:  # a global aggregate has a row for every outer row
            returned = next(c for c in query.clauses if c[0] == "return")
            for e, name in returned[2]:
                if e[0] == "aggregate" and e[1] in ("COUNT", "SUM"):
                    out = replace(out, df=out.df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(0).cast(out.df.schema[name].dataType))))
        sub = renamed.drop(*keys)
    for f in sub.schema.fields:
        out = out.bind(f.name, "x", f.dataType)
    return out


def global_aggregate(query: Query) -> bool:
    returned = next((c for c in query.clauses if c[0] == "return"), None)
    return bool(returned) and returned[3]["group"] is None and all(aggregates(e) for e, _ in returned[2])


# -- other clauses -----------------------------------------------------------------------------


def where(rows: Rows, clause, rest) -> Rows:
    rows, test = truth(one_row(rows), clause[1])
    return replace(rows, df=rows.df.filter(test))


def unwind(rows: Rows, clause, rest) -> Rows:
    _, e, name = clause
    rows, (c, t) = value(one_row(rows), e)
    if not isinstance(t, T.ArrayType):
        c, t = F.when(c.isNotNull(), F.array(c)), T.ArrayType(t)
    if rows.turns is None:
        return replace(rows, df=rows.df.select("*", F.explode(c).alias(name))).bind(name, "x", t.elementType)
    turn = fresh("turn")
    return replace(rows, df=rows.df.select("*", F.posexplode(c).alias(turn, name)), turns=(*rows.turns, turn)).bind(name, "x", t.elementType)


def let(rows: Rows, clause, rest) -> Rows:
    rows = one_row(rows)
    for name, e in clause[1]:
        if aggregates(e):
            rows, (c, t) = value(rows, e)
            whole = rows.df.groupBy(*(rows.group or [])).agg(c.alias(name))
            rows = replace(rows, df=rows.df.join(whole, rows.group) if rows.group else rows.df.crossJoin(whole)).bind(name, "x", t)
        else:
            rows, (c, t) = value(rows, e)
            rows = replace(rows, df=rows.df.withColumn(name, c)).bind(name, "x", t)
    return rows


def with_(rows: Rows, clause, rest) -> Rows:
    return project(rows, *clause[1:], keep=True).rows


def path_clause(rows: Rows, clause, rest) -> Rows:
    return replace(rows, track=clause[1])


def procedure(rows: Rows, clause, rest) -> Rows:
    from weftgraph.operators.procedures import call_procedure

    return call_procedure(one_row(rows), *clause[1:])


CLAUSE = {"path": path_clause, "match": match, "optional": optional, "where": where, "unwind": unwind, "let": let, "with": with_, "call": call, "procedure": procedure}


# -- projection --------------------------------------------------------------------------------


@dataclass
class Projected:
    df: DataFrame
    names: list
    rows: Rows


def project(rows: Rows, distinct: bool, items: list, extra: dict, keep: bool = False) -> Projected:
    """RETURN or WITH: aggregate, DISTINCT, WHERE, ORDER, SKIP and LIMIT, in that order."""
    rows = one_row(rows)
    if items and items[0][0] == ("star",):
        items = [(("var", v), v) for v in rows.vars if not v.startswith("__")] + items[1:]
    group = rows.group or []
    grouped = extra["group"] is not None or any(aggregates(e) for e, _ in items)
    names_out = [n for _, n in items]
    if len(set(names_out)) != len(names_out):
        raise GqlError(f"two items have one name: {names_out}")
    plain = [(e, n) for e, n in items if not aggregates(e)]
    if extra["group"] is not None:
        allowed = [*extra["group"]]
        by_name = {n: e for e, n in items}
        allowed += [by_name[e[1]] for e in extra["group"] if e[0] == "var" and e[1] in by_name]
        wrong = [n for e, n in plain if e not in allowed]
        if wrong:
            raise GqlError(f"{wrong} must be in GROUP BY or aggregated")
    carried: dict[str, list[str]] = {}
    kinds: dict[str, tuple] = {}
    cols: dict[str, Column] = {}
    for e, n in items:
        if e[0] == "var" and e[1] in rows.vars and rows.vars[e[1]][0] in "ve":
            kinds[n] = rows.vars[e[1]]
            carried[n] = [c for c in rows.df.columns if c.startswith(f"{e[1]}$")]
        rows, (c, t) = value(rows, e)
        cols[n] = c
        kinds.setdefault(n, ("x", t))
    hidden: list[tuple[str, bool]] = []
    having = None
    if grouped:
        keys: dict = {n: cols[n] for e, n in plain}
        df = rows.df
        more_keys = []
        for e in extra["group"] or []:
            if e not in [x for x, _ in plain] and not (e[0] == "var" and e[1] in keys):
                rows, (c, _) = value(rows, e)
                more_keys.append((e, c.alias(fresh("g"))))
        df = rows.df
        sums = [cols[n].alias(n) for e, n in items if aggregates(e)]
        order_items = []
        for e, down in extra["order"]:
            if aggregates(e) and e not in [x for x, _ in items]:
                rows, (c, _) = value(rows, e)
                name = fresh("s")
                sums.append(c.alias(name))
                order_items.append((("hidden", name), down))
            else:
                order_items.append((e, down))
        if extra["having"] is not None:
            replaced, more = pull_aggregates(extra["having"], items)
            for name, e in more:
                rows, (c, _) = value(rows, e)
                sums.append(c.alias(name))
            having = replaced
            having_types = {name: value(rows, e)[1][1] for name, e in more}
        side = [F.first(f"`{c}`", ignorenulls=True).alias(f"{n}${c.split('$', 1)[1]}") for n, cs in carried.items() if keep for c in cs]
        key_cols = [c.alias(n) for n, c in keys.items()]
        df = rows.df.groupBy(*group, *key_cols, *(c for _, c in more_keys)).agg(*(sums or [F.count("*").alias(fresh("c"))]), *side)
        after = replace(rows, df=df, vars={n: kinds[n] for n in names_out}, paths={})
        if having is not None:
            scope = after
            for name, t in having_types.items():
                scope = scope.bind(name, "x", t)
            scope, test = truth(scope, substitute(having, items))
            after = replace(after, df=scope.df.filter(test))
        texts = {repr(e): n for e, n in items}
        for e, down in order_items:
            if e[0] == "hidden":
                hidden.append((e[1], down))
            elif repr(e) in texts:
                hidden.append((texts[repr(e)], down))
            else:
                after, (c, _) = value(after, e)
                name = fresh("s")
                after = replace(after, df=after.df.withColumn(name, c))
                hidden.append((name, down))
        df = after.df
    else:
        texts = {repr(e): n for e, n in items}
        df = rows.df
        out_cols = [F.col(c) for c in group] + [cols[n].alias(n) for n in names_out]
        side = [F.col(f"`{c}`").alias(f"{n}${c.split('$', 1)[1]}") for n, cs in carried.items() if keep for c in cs]
        if keep and not distinct:
            side += [F.col(c) for c in rows.paths.values()]
        extra_cols = []
        for e, down in extra["order"]:
            if repr(e) in texts:
                hidden.append((texts[repr(e)], down))
                continue
            if e[0] == "var" and e[1] in names_out:
                hidden.append((e[1], down))
                continue
            scope = rows
            if distinct:
                raise GqlError("ORDER BY after DISTINCT needs a returned item")
            aliased = {n: cols[n] for n in names_out if n not in rows.vars}
            for n, c in aliased.items():
                scope = replace(scope, df=scope.df.withColumn(n, c)).bind(n, *kinds[n])
            scope, (c, _) = value(scope, e)
            rows = replace(rows, df=scope.df)
            name = fresh("s")
            extra_cols.append(c.alias(name))
            hidden.append((name, down))
        df = rows.df.select(*out_cols, *side, *extra_cols)
    after = replace(rows, df=df, vars={n: kinds[n] for n in names_out}, paths=rows.paths if keep and not grouped and not distinct else {})
    if distinct:
        after = replace(after, df=after.df.dropDuplicates([*group, *names_out]))
    if extra["where"] is not None:
        scope, test = truth(after, extra["where"])
        after = replace(after, df=scope.df.filter(test))
    df = after.df
    if hidden:
        df = df.orderBy(*(F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_first() for c, down in hidden))
    if group and (extra["limit"] is not None or extra["skip"]):
        from pyspark.sql import Window

        order = [F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_first() for c, down in hidden] or [F.lit(1)]
        df = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__rn") > extra["skip"])
        if extra["limit"] is not None:
            df = df.filter(F.col("__rn") <= extra["skip"] + extra["limit"])
        df = df.drop("__rn")
    else:
        if extra["skip"]:
            df = df.offset(extra["skip"])
        if extra["limit"] is not None:
            df = df.limit(extra["limit"])
    after = replace(after, df=df.drop(*(c for c, _ in hidden if c.startswith("__s"))))
    return Projected(after.df, names_out, after)


def pull_aggregates(e, items):
    """An expression with its aggregates as names; and those that no item has."""
    more: list = []
    texts = {repr(x): n for x, n in items}

    def go(x):
        if isinstance(x, tuple) and x and x[0] == "aggregate":
            if repr(x) in texts:
                return ("var", texts[repr(x)])
            name = fresh("h")
            more.append((name, x))
            return ("var", name)
        if isinstance(x, tuple):
            return tuple(go(y) for y in x)
        if isinstance(x, list):
            return [go(y) for y in x]
        return x

    return go(e), more


def substitute(e, items):
    """Returned expressions by their names."""
    plain = {repr(x): n for x, n in items}

    def go(x):
        if isinstance(x, tuple) and repr(x) in plain:
            return ("var", plain[repr(x)])
        if isinstance(x, tuple):
            return tuple(go(y) for y in x)
        return [go(y) for y in x] if isinstance(x, list) else x

    return go(e)


# -- expressions -------------------------------------------------------------------------------


def truth(rows: Rows, e) -> tuple[Rows, Column]:
    """An expression as a two-valued test."""
    if e[0] in ("and", "or"):
        rows, a = truth(rows, e[1])
        rows, b = truth(rows, e[2])
        return rows, a & b if e[0] == "and" else a | b
    if e[0] == "not":
        rows, a = truth(rows, e[1])
        return rows, ~a
    rows, (c, t) = value(rows, e)
    return rows, V.truthy(c, t)


def literal(x) -> scalars.Typed:
    if isinstance(x, (geo.Point, geo.Polygon)):
        return x.column(), scalars.POINT if isinstance(x, geo.Point) else T.ArrayType(scalars.POINT)
    if isinstance(x, (list, tuple)):
        parts = [literal(y) for y in x]
        t = V.common([p[1] for p in parts])
        return F.array(*(V.as_common(c, k, t) for c, k in parts)).cast(T.ArrayType(t)), T.ArrayType(t)
    if isinstance(x, dict):
        parts = {k: literal(v) for k, v in x.items()}
        return F.struct(*(c.alias(k) for k, (c, _) in parts.items())), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
    if x is None:
        return F.lit(None).cast("string"), T.NullType()
    t = {"b": T.BooleanType(), "i": T.LongType(), "d": T.DoubleType(), "s": T.StringType()}.get(V.kind_of(x))
    return (F.lit(x).cast(t), t) if t else (F.lit(x), T.TimestampType())


def value(rows: Rows, e, local: dict | None = None) -> tuple[Rows, scalars.Typed]:
    """An expression as (Column, type); rows may gain columns on the way. ``local``: lambda variables."""
    kind = e[0]
    go = lambda x: value(rows, x, local)
    if kind == "literal":
        return rows, literal(e[1])
    if kind == "param":
        return rows, literal(rows.params.get(e[1]))
    if kind == "distance":
        return rows, literal(geo.distance_metres(e[1], e[2]))
    if kind == "var":
        if local and e[1] in local:
            return rows, local[e[1]]
        if e[1] in rows.paths:
            return rows, (F.col(rows.paths[e[1]]), T.ArrayType(T.LongType()))
        if e[1] not in rows.vars:
            raise GqlError(f"unknown variable {e[1]}")
        k, what = rows.vars[e[1]]
        return rows, (F.col(f"`{e[1]}`"), what if k == "x" else T.LongType())
    if kind == "prop":
        if e[1][0] == "var" and e[1][1] in rows.vars and not (local and e[1][1] in local):
            var = e[1][1]
            k, labels = rows.vars[var]
            if k in "ve":
                types = props_of(rows.graph, k, labels)
                if e[2] not in types:
                    return rows, scalars.null()
                name = column(var, e[2])
                if name not in rows.df.columns:
                    rows = attach(rows, var)
                return rows, (F.col(f"`{name}`"), types[e[2]])
        rows, (c, t) = go(e[1])
        if isinstance(t, T.StructType) and e[2] in t.names:
            return rows, (c[e[2]], t[e[2]].dataType)
        if isinstance(t, T.MapType):
            return rows, (F.try_element_at(c, F.lit(e[2])), t.valueType)
        return rows, scalars.null()
    if kind in ("and", "or", "not"):
        parts = []
        for x in e[1:]:
            rows, (c, t) = value(rows, x, local)
            parts.append((c, t))
        if kind == "not":
            c, t = parts[0]
            return rows, (~F.coalesce(c, F.lit(False)) if V.kind(t) == "b" else F.lit(None).cast("boolean"), T.BooleanType())
        a, b = (V.truthy(*p) for p in parts)
        return rows, (a & b if kind == "and" else a | b, T.BooleanType())
    if kind == "compare":
        rows, a = go(e[2])
        rows, b = value(rows, e[3], local)
        return rows, (comparison(e[1], a, b), T.BooleanType())
    if kind == "in":
        rows, a = go(e[1])
        if e[2][0] == "list":
            tests = []
            for x in e[2][1]:
                rows, b = value(rows, x, local)
                tests.append(scalars.equal(a, b))
            return rows, (reduce(lambda p, q: p | q, tests, F.lit(False)), T.BooleanType())
        rows, (c, t) = value(rows, e[2], local)
        if not isinstance(t, T.ArrayType):
            return rows, (F.lit(False), T.BooleanType())
        return rows, (scalars.two_valued(F.exists(c, lambda x: scalars.equal(a, (x, t.elementType)))), T.BooleanType())
    if kind == "null?":
        rows, (c, _) = go(e[1])
        return rows, (c.isNull(), T.BooleanType())
    if kind == "math":
        rows, a = go(e[2])
        rows, b = value(rows, e[3], local)
        return rows, scalars.arithmetic(e[1], a, b)
    if kind == "minus":
        rows, (c, t) = go(e[1])
        return rows, (-c, t) if V.kind(t) in "id" else scalars.null(T.DoubleType())
    if kind == "join":
        rows, a = go(e[1])
        rows, b = value(rows, e[2], local)
        return rows, scalars.join_text(a, b)
    if kind == "list":
        parts = []
        for x in e[1]:
            rows, p = value(rows, x, local)
            parts.append(p)
        t = V.common([p[1] for p in parts])
        return rows, (F.array(*(V.as_common(c, k, t) for c, k in parts)).cast(T.ArrayType(t)), T.ArrayType(t))
    if kind == "map":
        parts = {}
        for k, x in e[1].items():
            rows, parts[k] = value(rows, x, local)
        return rows, (F.struct(*(c.alias(k) for k, (c, _) in parts.items())), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()]))
    if kind == "case":
        arms = []
        for test, x in e[1]:
            rows, (c, t) = value(rows, test, local)
            rows, arm = value(rows, x, local)
            arms.append((V.truthy(c, t), arm))
        rows, other = value(rows, e[2], local)
        t = V.common([a[1] for _, a in arms] + [other[1]])
        out = F.when(arms[0][0], V.as_common(*arms[0][1], t))
        for test, a in arms[1:]:
            out = out.when(test, V.as_common(*a, t))
        return rows, (out.otherwise(V.as_common(*other, t)), t)
    if kind == "exists":
        rows, c = exists(rows, e[1], e[2])
        return rows, (c, T.BooleanType())
    if kind == "pattern list":
        return pattern_list(rows, e[1], e[2], e[3])
    if kind == "item":
        rows, (c, t) = go(e[1])
        rows, (i, _) = value(rows, e[2], local)
        if isinstance(t, T.StructType) and e[2][0] == "literal" and e[2][1] in t.names:
            return rows, (c[e[2][1]], t[e[2][1]].dataType)
        if not isinstance(t, T.ArrayType):
            return rows, scalars.null()
        return rows, (F.get(c, F.when(i < 0, F.size(c) + i).otherwise(i).cast("int")), t.elementType)
    if kind == "slice":
        rows, (c, t) = go(e[1])
        if not isinstance(t, T.ArrayType):
            return rows, scalars.null()
        bounds = []
        for x, default in ((e[2], F.lit(0)), (e[3], F.size(c))):
            if x is None:
                bounds.append(default)
            else:
                rows, (b, _) = value(rows, x, local)
                bounds.append(F.when(b < 0, F.greatest(F.size(c) + b, F.lit(0))).otherwise(F.least(b, F.size(c))).cast("int"))
        a, b = bounds
        return rows, (F.slice(c, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), t)
    if kind in ("comprehension", "quantifier", "reduce"):
        return folded(rows, e, local)
    if kind == "aggregate":
        return aggregate(rows, e, local)
    if kind == "call":
        return function(rows, e, local)
    raise GqlError(f"can't evaluate {kind}")


def attach(rows: Rows, var: str) -> Rows:
    """Properties of an element that is known by its id alone."""
    k, labels = rows.vars[var]
    side = view(rows.graph, k, labels, fresh("a"))
    own = side.columns[0]
    side = side.select(F.col(own).alias("__at"), *(F.col(f"`{c}`").alias(f"{var}${c.split('$', 1)[1]}") for c in side.columns[1:]))
    return replace(rows, df=rows.df.join(side, F.col(f"`{var}`") == F.col("__at"), "left").drop("__at"))


def comparison(op: str, a: scalars.Typed, b: scalars.Typed) -> Column:
    if op == "=":
        return scalars.equal(a, b)
    if op == "<>":
        return ~scalars.equal(a, b)
    if op in ("<", "<=", ">", ">="):
        return scalars.less(op, a, b)
    x, y = V.string(*a), V.string(*b)
    if x is None or y is None:
        return F.lit(False)
    return scalars.two_valued({"contains": x.contains, "starts": x.startswith, "ends": x.endswith}[op](y) if op != "=~" else F.regexp_like(x, y))


def folded(rows: Rows, e, local) -> tuple[Rows, scalars.Typed]:
    """List comprehension, ALL / ANY / NONE / SINGLE and REDUCE as higher-order functions."""
    local = local or {}
    source = e[2] if e[0] == "comprehension" else e[3] if e[0] == "quantifier" else e[4]
    rows, (c, t) = value(rows, source, local)
    if not isinstance(t, T.ArrayType):
        return rows, scalars.null(T.BooleanType() if e[0] == "quantifier" else T.StringType())
    item = t.elementType
    if e[0] == "comprehension":
        _, v, _, test, body = e
        if test is not None:
            c0 = c
            c = F.filter(c0, lambda x: V.truthy(*value(rows, test, {**local, v: (x, item)})[1]))
        kinds = {}

        def each(x):
            out, kinds["t"] = value(rows, body, {**local, v: (x, item)})[1]
            return out

        mapped = F.transform(c, each)
        return rows, (mapped, T.ArrayType(kinds["t"]))
    if e[0] == "quantifier":
        _, which, v, _, test = e
        hit = lambda x: V.truthy(*value(rows, test, {**local, v: (x, item)})[1])
        out = {"ALL": lambda: F.forall(c, hit), "ANY": lambda: F.exists(c, hit), "NONE": lambda: ~F.exists(c, hit), "SINGLE": lambda: F.when(c.isNotNull(), F.size(F.filter(c, hit)) == 1)}[which]()
        return rows, (out, T.BooleanType())
    _, acc, init, v, _, body = e
    rows, (start, st) = value(rows, init, local)
    _, (_, bt) = value(rows, body, {**local, acc: (start, st), v: (F.lit(None).cast(item), item)})
    target = V.common([st, bt])
    out = F.aggregate(c, V.as_common(start, st, target), lambda a, x: V.as_common(*value(rows, body, {**local, acc: (a, target), v: (x, item)})[1], target))
    return rows, (out, target)


def aggregate(rows: Rows, e, local) -> tuple[Rows, scalars.Typed]:
    _, name, distinct, args = e
    if args and args[0] == ("star",):
        return rows, (F.count(F.lit(1)), T.LongType())
    rows, (c, t) = value(rows, args[0], local)
    if name == "COUNT":
        return rows, (F.count_distinct(c) if distinct else F.count(c), T.LongType())
    if name == "COLLECT":
        return rows, (F.sort_array(F.collect_set(c) if distinct else F.collect_list(c)), T.ArrayType(t))
    if name in ("MIN", "MAX"):
        return rows, ((F.min if name == "MIN" else F.max)(c), t)
    n = V.number(c, t)
    if n is None:
        return rows, (F.lit(0).cast("long") + F.count(F.lit(None)), T.LongType()) if name == "SUM" else (F.avg(F.lit(None).cast("double")), T.DoubleType())
    if name == "AVG":
        return rows, (avg_distinct(n) if distinct else F.avg(n), T.DoubleType())
    whole = V.kind(t) == "i"
    col = c.cast("long") if whole else n
    total = F.sum_distinct(col) if distinct else F.sum(col)
    return rows, (F.coalesce(total, F.lit(0).cast("long" if whole else "double")), T.LongType() if whole else T.DoubleType())


def avg_distinct(n: Column) -> Column:
    return F.try_divide(F.sum_distinct(n), F.count_distinct(n))


def function(rows: Rows, e, local) -> tuple[Rows, scalars.Typed]:
    _, name, args = e
    if name in ("ID", "LABELS", "TYPE", "PROPERTIES") and args and args[0][0] == "var" and args[0][1] in rows.vars and rows.vars[args[0][1]][0] in "ve":
        var = args[0][1]
        k, labels = rows.vars[var]
        if name == "ID":
            return rows, (F.col(f"`{var}`"), T.LongType())
        if column(var, "__label") not in rows.df.columns:
            rows = attach(rows, var)
        if name == "LABELS":
            label = F.col(f"`{column(var, '__label')}`")
            return rows, (F.when(label.isNotNull(), F.array(label)), T.ArrayType(T.StringType()))
        if name == "TYPE":
            return rows, (F.col(f"`{column(var, '__label')}`"), T.StringType()) if k == "e" else scalars.null()
        types = props_of(rows.graph, k, labels)
        cols = [F.col(f"`{column(var, p)}`").alias(p) for p in types]
        return rows, (F.struct(*cols), T.StructType([T.StructField(p, t) for p, t in types.items()]))
    if name == "PATH":
        if not rows.paths:
            return rows, scalars.null()
        return rows, (F.col(next(iter(rows.paths.values()))), T.ArrayType(T.LongType()))
    typed = []
    for a in args:
        rows, p = value(rows, a, local)
        typed.append(p)
    if name == "MATH":
        if args[0][0] != "literal":
            raise GqlError("MATH needs a literal expression")
        free = names(args[0][1])
        order = [n for n in free if n == "_"] or []
        slots = order if order and len(typed) == 2 else [c for c in "abcdefgh"][: len(typed) - 1]
        numbers = {n: V.number(*p) if V.number(*p) is not None else F.lit(None).cast("double") for n, p in zip(slots, typed[1:], strict=False)}
        return rows, (compile_math(args[0][1], numbers), T.DoubleType())
    if name in scalars.ONE and len(typed) == 1:
        return rows, scalars.ONE[name](typed[0])
    if name in scalars.MANY:
        return rows, scalars.MANY[name](*typed)
    raise GqlError(f"unknown function {name}")


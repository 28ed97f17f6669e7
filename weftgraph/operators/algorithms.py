"""Graph algorithms as rounds of joins.

All kernels take many sources at once: their state is keyed by (source, vertex). Breadth-first search
keeps one shortest path for each reached vertex (the smallest of its level); weighted search relaxes
edges until nothing improves. Rounds go to the shared folder. Depth-first order and Yen's algorithm are
sequential by nature: they run over the reached subgraph, whose size is checked before it leaves Spark.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V
from weftgraph.runtime import Rounds, settle

#: Edges of a subgraph that a sequential algorithm may hold.
MAX_LOCAL_EDGES = 2_000_000
MAX_ROUNDS = 1_000


class PathError(ValueError):
    """A vertex is missing, a weight is missing or negative, or no path exists."""


@dataclass
class Walks:
    """How a search follows edges."""

    direction: str = "out"
    labels: tuple | None = None
    weight: str | None = None
    on_missing: str = "skip"  # or error

    def steps(self, graph) -> DataFrame:
        """(a, b, w) for every way along an edge."""
        e = graph.view("e", frozenset(self.labels) if self.labels else None)
        w = F.lit(1.0)
        if self.weight is not None:
            types = graph.properties("e", frozenset(self.labels) if self.labels else None)
            w = V.number(F.col(f"`{self.weight}`"), types[self.weight]) if self.weight in types else None
            w = F.lit(None).cast("double") if w is None else w
            if self.on_missing == "error" and not e.filter(w.isNull()).isEmpty():
                raise PathError(f"edges without a numeric {self.weight}")
            e = e.filter(w.isNotNull())
            if not e.filter(w < 0).isEmpty():
                raise PathError("negative weights")
        out, back = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"), w.alias("w"))
        return {"out": out, "in": back, "both": out.union(back)}[self.direction]


def _sources(graph, sources) -> DataFrame:
    if isinstance(sources, DataFrame):
        return sources.toDF("source").distinct()
    ids = sources if isinstance(sources, (list, tuple, set)) else [sources]
    return graph.view("v").filter(F.col("id").isin(*ids)).select(F.col("id").alias("source"))


def bfs(graph, sources, max_depth: int | None = None, labels=None, direction: str = "out", target=None, paths: bool = False, prune=None) -> DataFrame:
    """(source, vertex, depth[, path]) for every vertex within ``max_depth``; each once for a source.

    ``prune`` is a test of (vertex, depth) columns: the search reaches vertices that pass it, but goes no further.
    """
    steps = settle(Walks(direction, labels).steps(graph).select("a", "b"))  # views aren't built anew in each round
    now, _ = Rounds().settle(_sources(graph, sources).select("source", F.col("source").alias("vertex"), F.lit(0).cast("long").alias("depth"), *([F.array("source").alias("path")] if paths else [])))
    seen, rounds = now, Rounds()
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        ahead = now if prune is None else now.filter(~F.coalesce(prune(F.col("vertex"), F.col("depth")), F.lit(False)))
        if target is not None:
            found = seen.filter(F.col("vertex") == target).select("source").distinct()
            ahead = now.join(found, "source", "left_anti")
        reached = ahead.join(steps, F.col("vertex") == F.col("a"))
        if paths:
            reached = reached.groupBy("source", F.col("b").alias("vertex")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        else:
            reached = reached.select("source", F.col("b").alias("vertex")).distinct()
        fresh = reached.join(seen.select("source", "vertex"), ["source", "vertex"], "left_anti")
        now, some = rounds.settle(fresh.select("source", "vertex", F.lit(depth).cast("long").alias("depth"), *(["path"] if paths else [])))
        if not some:
            break
        seen = rounds.settle(seen.union(now))[0] if depth % 8 == 0 else seen.union(now)
    return seen


def dijkstra_all(graph, sources, weight: str, labels=None, direction: str = "out", on_missing: str = "skip", banned_vertices=(), banned_edges=(), target: int | None = None) -> DataFrame:
    """(source, vertex, distance, path) of a cheapest path to every reachable vertex.

    With a ``target``, paths that are no cheaper than the best one to it so far aren't followed; then only
    the target's row is sure to be there and to be the cheapest.
    """
    steps = Walks(direction, labels, weight, on_missing).steps(graph).groupBy("a", "b").agg(F.min("w").alias("w"))
    if banned_vertices:
        steps = steps.filter(~F.col("a").isin(*banned_vertices) & ~F.col("b").isin(*banned_vertices))
    for a, b in banned_edges:
        steps = steps.filter(~((F.col("a") == a) & (F.col("b") == b)))
    steps = settle(steps)
    best = settle(_sources(graph, sources).select("source", F.col("source").alias("vertex"), F.lit(0.0).alias("distance"), F.array("source").alias("path")))
    now, rounds = best, Rounds()
    for _ in range(MAX_ROUNDS):
        tried = now.join(steps, F.col("vertex") == F.col("a")).groupBy("source", F.col("b").alias("vertex")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.concat("path", F.array("b")).alias("p"))).alias("t"))
        known = best.select(F.col("source").alias("s2"), F.col("vertex").alias("v2"), F.col("distance").alias("d2"))
        if target is not None:
            goal = F.broadcast(best.filter(F.col("vertex") == target).select(F.col("source").alias("s3"), F.col("distance").alias("d3")))  # a row for each source
            tried = tried.join(goal, F.col("source") == F.col("s3"), "left").filter("d3 IS NULL OR t.d < d3").drop("s3", "d3")
        better = tried.join(known, (F.col("source") == F.col("s2")) & (F.col("vertex") == F.col("v2")), "left").filter("d2 IS NULL OR t.d < d2")
        now, some = rounds.settle(better.select("source", "vertex", F.col("t.d").alias("distance"), F.col("t.p").alias("path")))
        if not some:
            return best
        best = rounds.settle(best.join(now.select("source", "vertex"), ["source", "vertex"], "left_anti").union(now))[0]
    raise PathError(f"no fixpoint in {MAX_ROUNDS} rounds")


def shortest_paths(graph, sources, target: int, labels=None, direction: str = "out", max_depth: int | None = None) -> DataFrame:
    """(source, path, distance) of a path with the fewest edges; sources that don't reach it have no row."""
    found = bfs(graph, sources, max_depth, labels, direction, target, paths=True)
    return found.filter(F.col("vertex") == target).select("source", "path", F.col("depth").cast("double").alias("distance"))


def bidirectional_paths(graph, source: int, target: int, labels=None, max_depth: int | None = None) -> list[int] | None:
    """A shortest path by two frontiers: forward from the source, backward from the target."""
    sides = [bfs(graph, source, 0, labels, "out", paths=True), bfs(graph, target, 0, labels, "in", paths=True)]
    forth = settle(Walks("out", labels).steps(graph).select("a", "b"))
    steps = [forth, forth.select(F.col("b").alias("a"), F.col("a").alias("b"))]
    fronts, rounds = list(sides), Rounds()
    for depth in count() if max_depth is None else range(max_depth + 1):
        met = sides[0].select("vertex", F.col("path").alias("p"), F.col("depth").alias("x")).join(sides[1].select("vertex", F.col("path").alias("q"), F.col("depth").alias("y")), "vertex")
        hit = met.orderBy(F.col("x") + F.col("y"), "p", "q").limit(1).collect()
        if hit:
            return hit[0].p + hit[0].q[::-1][1:]
        i = depth % 2
        reached = fronts[i].join(steps[i], F.col("vertex") == F.col("a")).groupBy("source", F.col("b").alias("vertex")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        fresh = reached.join(sides[i].select("source", "vertex"), ["source", "vertex"], "left_anti")
        fronts[i], some = rounds.settle(fresh.select("source", "vertex", F.lit(depth // 2 + 1).cast("long").alias("depth"), "path"))
        if not some:
            return None
        sides[i] = sides[i].union(fronts[i])
        if depth % 8 > 5:  # plans don't grow
            sides[i] = rounds.settle(sides[i])[0]
    return None


def _local(steps: DataFrame) -> list:
    """A checked subgraph as rows."""
    if steps.count() > MAX_LOCAL_EDGES:
        raise PathError(f"more than {MAX_LOCAL_EDGES} edges are reachable: bound the depth or the labels")
    return steps.orderBy("a", "b").collect()


def dfs(graph, source: int, max_depth: int | None = None, labels=None, direction: str = "out") -> list[tuple[int, int]]:
    """(vertex, depth) in pre-order, smaller ids first, each vertex once."""
    reached = bfs(graph, source, max_depth, labels, direction)
    steps = Walks(direction, labels).steps(graph).select("a", "b").distinct()
    inside = steps.join(reached.select(F.col("vertex").alias("a")), "a", "left_semi")
    after: dict[int, list[int]] = {}
    for r in _local(inside):
        after.setdefault(r.a, []).append(r.b)
    if reached.isEmpty():
        return []
    out, seen, stack = [], set(), [(source, 0)]
    while stack:
        v, depth = stack.pop()
        if v in seen:
            continue
        seen.add(v)
        out.append((v, depth))
        if max_depth is None or depth < max_depth:
            stack.extend((w, depth + 1) for w in reversed(after.get(v, [])) if w not in seen)
    return out


def iddfs(graph, source: int, target: int, max_depth: int, labels=None, direction: str = "out") -> list[int] | None:
    """A path of the least depth, none beyond ``max_depth``."""
    found = shortest_paths(graph, source, target, labels, direction, max_depth).collect()
    return found[0].path if found else None


def _cheapest(after: dict, source: int, target: int, no_vertices: set, no_edges: set, guess=None):
    """Dijkstra or, with a guess of the remaining cost, A*, over an adjacency map.

    A* opens a vertex again that it reaches more cheaply, and ends when nothing left can be cheaper, so the
    result is right for every guess; a good guess finds a bound early.
    """
    h = guess or (lambda v: 0.0)
    queue, best, answer = [(h(source), 0.0, [source])], {source: 0.0}, None
    while queue:
        _, cost, path = heapq.heappop(queue)
        v = path[-1]
        if cost > best[v] or (answer and cost >= answer[0]):
            continue
        if v == target:
            answer = (cost, path)
            if guess is None:  # a guess may be too high somewhere: then what is left may still be cheaper
                return answer
            continue
        for w, b in after.get(v, ()):
            if b not in no_vertices and (v, b) not in no_edges and cost + w < best.get(b, float("inf")):
                best[b] = cost + w
                heapq.heappush(queue, (cost + w + h(b), cost + w, [*path, b]))
    return answer


def _adjacency(graph, walks: Walks, source: int) -> dict:
    steps = walks.steps(graph).groupBy("a", "b").agg(F.min("w").alias("w"))
    reached = bfs(graph, source, None, walks.labels, walks.direction).select(F.col("vertex").alias("a"))
    after: dict[int, list] = {}
    for r in _local(steps.join(reached, "a", "left_semi")):
        after.setdefault(r.a, []).append((r.w, r.b))
    return after


def k_shortest_paths(graph, source: int, target: int, k: int, weight: str | None = None, labels=None, direction: str = "out", on_missing: str = "skip") -> list[tuple[float, list[int]]]:
    """Up to k loopless paths in ascending cost (Yen's algorithm)."""
    if k <= 0:
        return []
    after = _adjacency(graph, Walks(direction, labels, weight, on_missing), source)
    first = _cheapest(after, source, target, set(), set())
    found, waiting = [first] if first else [], []
    cost_of = {(a, b): w for a, bs in after.items() for w, b in bs}
    while found and len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            gone = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == root and len(p) > i + 1}
            spur = _cheapest(after, last[i], target, set(root[:-1]), gone)
            if spur:
                path = root[:-1] + spur[1]
                entry = (sum(cost_of[e] for e in zip(path, path[1:], strict=False)), path)
                if entry not in waiting and entry not in found:
                    heapq.heappush(waiting, entry)
        if not waiting:
            break
        found.append(heapq.heappop(waiting))
    return found


def astar(graph, source: int, target: int, weight: str, heuristic, labels=None, direction: str = "out") -> tuple[float, list[int]] | None:
    """A cheapest path; ``heuristic`` is a vertex property or a function of the id."""
    guess = heuristic
    after = _adjacency(graph, Walks(direction, labels, weight), source)
    if isinstance(heuristic, str):
        reached = {source, *after, *(b for near in after.values() for _, b in near)}  # as many as the checked edges and one
        ids = graph.spark.createDataFrame([(v,) for v in reached], "id long")
        known = {r[0]: r[1] for r in graph.view("v").select("id", F.col(f"`{heuristic}`").cast("double")).filter(F.col(heuristic).isNotNull()).join(ids, "id", "left_semi").collect()}
        guess = lambda v: known.get(v, 0.0)
    return _cheapest(after, source, target, set(), set(), guess)


def step_result(s, step):
    """The traversal steps: a list or map for each current vertex."""
    from weftgraph.plans.traversal import Traversal

    by = next((a[0] for m, a in step.mods if m == "by"), None)
    weight = by.steps[0].args[0] if isinstance(by, Traversal) else by
    options = {a[0]: a[1] for m, a in step.mods if m == "with"}
    labels, direction = options.get("edgeLabels"), options.get("direction", "out")
    labels = (labels,) if isinstance(labels, str) else tuple(labels) if labels else None
    sources = s.df.select("_id").distinct()
    target = step.args[0] if step.args else None
    if isinstance(target, Traversal):
        target = replace_graph(target, s.graph).next()
    longs = T.ArrayType(T.LongType())
    pair = T.StructType([T.StructField("vertex", T.LongType()), T.StructField("depth", T.LongType())])
    name = step.name
    if name == "bfs":
        found = bfs(s.graph, sources, options.get("maxDepth"), labels, direction)
        df, vtype = found.select("source", F.struct("vertex", "depth").alias("_val"), F.struct("depth", "vertex").alias("_rank")), pair
    elif name == "dfs":
        rows = [(src, (v, d), (n, v)) for (src,) in _few(sources) for n, (v, d) in enumerate(dfs(s.graph, src, options.get("maxDepth"), labels, direction))]
        df, vtype = s.graph.spark.createDataFrame(rows, "source long, _val struct<vertex:long,depth:long>, _rank struct<depth:long,vertex:long>"), pair
    elif name == "shortestPath" and weight:
        guess = options.get("heuristic")
        if guess is None:
            found = dijkstra_all(s.graph, sources, weight, labels, direction, target=target).filter(F.col("vertex") == target)
        else:
            rows = [(src, target, float(f[0]), f[1]) for (src,) in _few(sources) for f in [astar(s.graph, src, target, weight, guess, labels, direction)] if f]
            found = s.graph.spark.createDataFrame(rows, "source long, vertex long, distance double, path array<long>")
        vtype = T.StructType([T.StructField("path", longs), T.StructField("weight", T.DoubleType())])
        df = found.select("source", F.struct("path", F.col("distance").alias("weight")).alias("_val"), F.lit(0).alias("_rank"))
    elif name == "kShortestPaths":
        rows = [(src, list(p), (n, 0)) for (src,) in _few(sources) for n, (_, p) in enumerate(k_shortest_paths(s.graph, src, target, step.args[1], weight, labels, direction))]
        df, vtype = s.graph.spark.createDataFrame(rows, "source long, _val array<long>, _rank struct<depth:long,vertex:long>"), longs
    elif name == "bidirectionalBfs":
        rows = [(src, p, (0, 0)) for (src,) in _few(sources) for p in [bidirectional_paths(s.graph, src, target, labels)] if p]
        df, vtype = s.graph.spark.createDataFrame(rows, "source long, _val array<long>, _rank struct<depth:long,vertex:long>"), longs
    else:
        depth = step.args[1] if name == "iddfs" and len(step.args) > 1 else options.get("maxDepth")
        found = shortest_paths(s.graph, sources, target, labels, direction, depth)
        df, vtype = found.select("source", F.col("path").alias("_val"), F.lit(0).alias("_rank")), longs
    ranked = s.need_order or name in ("kShortestPaths", "dfs")  # their results have an order of their own
    joined = s.df.select(*(f"`{c}`" for c in s.carried()), "_id").join(df, F.col("_id") == F.col("source")).drop("_id", "source")
    names = vtype.names if isinstance(vtype, T.StructType) else None
    return replace(s, df=joined, kind="x", vtype=vtype, labels=None, loaded=False, names=names, order=[*s.order, ("_rank", False)] if ranked else s.order, need_order=ranked)


def _few(sources: DataFrame, most: int = 100):
    rows = sources.limit(most + 1).collect()
    if len(rows) > most:
        raise PathError(f"a sequential search takes at most {most} sources at once")
    return [tuple(r) for r in rows]


def replace_graph(t, graph):
    return type(t)(graph, t.steps)

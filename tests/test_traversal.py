"""Every traversal step over a small graph, with results derived by hand."""

import inspect
import json

import pytest

from weftgraph.model import PropertyGraph
from weftgraph.plans.traversal import P, __
from weftgraph.operators import algorithms, rounds
from weftgraph.sources import graphson, saved, store, tables
from weftgraph.plans.traversal_text import run_script

#: Mills along rivers: a diamond of channels from Aldwark to Dorney, and what the mills grind or store.
VERTICES = [
    dict(id=10, label="mill", name="Aldwark", built=1790, river="Ure"),
    dict(id=11, label="mill", name="Bexley", built=1812, river="Cray"),
    dict(id=12, label="mill", name="Cobham", built=1755, river="Mole"),
    dict(id=13, label="mill", name="Dorney", built=1803, river="Cray"),
    dict(id=20, label="grain", name="barley", price=1.5),
    dict(id=21, label="grain", name="oats", price=0.75),
    dict(id=22, label="grain", name="rye", price=2.0),
]
EDGES = [
    dict(id=100, label="feeds", src=10, dst=11, metres=40),
    dict(id=101, label="feeds", src=10, dst=12, metres=90),
    dict(id=102, label="feeds", src=12, dst=13, metres=15),
    dict(id=103, label="feeds", src=11, dst=13, metres=60),
    dict(id=104, label="grinds", src=11, dst=20),
    dict(id=105, label="grinds", src=13, dst=20),
    dict(id=106, label="grinds", src=13, dst=21),
    dict(id=107, label="stores", src=12, dst=22),
]


@pytest.fixture(scope="module")
def graph(spark):
    return PropertyGraph.from_rows(spark, VERTICES, EDGES)


# Steps over tables are held to SQL in test_entry; these are cases of small graphs, with rows derived by hand.
# fmt: off
CASES = [
    ("a step over all labels", lambda g: g.V(13).out().values("name").to_set(), {"barley", "oats"}),
    ("two ways to one vertex", lambda g: g.V(10).out("feeds").out("feeds").values("name").to_list(), ["Dorney", "Dorney"]),
    ("merged by dedup", lambda g: g.V(10).out("feeds").out("feeds").dedup().out("grinds").count().next(), 2),
    ("both directions", lambda g: g.V(13).both("feeds").id().to_set(), {11, 12}),
    ("the other end", lambda g: g.V(12).bothE("feeds").otherV().id().to_set(), {10, 13}),
    ("an edge's property", lambda g: g.V(10).outE("feeds").has("metres", P.gt(50)).inV().values("name").to_list(), ["Cobham"]),
    ("integers aren't floats", lambda g: g.V().has("built", 1790.0).count().next(), 0),
    ("labels of a path", lambda g: [[p["id"] for p in r] for r in g.V(10).out("feeds").out("stores").path().to_list()], [[10, 12, 22]]),
    ("no vertex twice", lambda g: g.V(10).out("feeds").both("feeds").simplePath().count().next(), 2),
    ("kept values of bound elements", lambda g: sorted((r["m"], r["e"], r["g"]) for r in g.V().hasLabel("mill").as_("m").outE("feeds").as_("e").inV().as_("g").select("m", "e", "g").by("name").by("metres").by("river").to_list()), [("Aldwark", 40, "Cray"), ("Aldwark", 90, "Mole"), ("Bexley", 60, "Cray"), ("Cobham", 15, "Cray")]),
    ("maths of two bound elements", lambda g: sorted(g.V().hasLabel("mill").as_("a").out("feeds").as_("b").math("b - a").by("a", "built").by("b", "built").to_list()), [-35.0, -9.0, 22.0, 48.0]),
    ("encounter order of fold", lambda g: g.V().hasLabel("grain").values("name").fold().to_list(), [["barley", "oats", "rye"]]),
    ("the first of each origin", lambda g: g.V().hasLabel("mill").local(__.out("grinds").order().by("price").limit(1)).values("name").to_list(), ["barley", "oats"]),
    ("a dead end leaves as it is", lambda g: g.V(12).repeat(__.out("feeds")).until(__.has("river", "Ure")).values("name").to_list(), ["Dorney"]),
    ("emitted rounds", lambda g: sorted(g.V(10).repeat(__.out("feeds")).times(2).emit().values("name").to_list()), ["Bexley", "Cobham", "Dorney", "Dorney"]),
    ("an empty sum", lambda g: g.V().hasLabel("river").values("length").sum().next(), 0),
    ("the shortest way", lambda g: g.V(10).shortestPath(13).to_list(), [[10, 11, 13]]),
    ("the cheapest way", lambda g: g.V(10).shortestPath(13).by("metres").to_list(), [{"path": [10, 11, 13], "weight": 100.0}]),
    ("all ways by length", lambda g: g.V(10).kShortestPaths(13, 5).to_list(), [[10, 11, 13], [10, 12, 13]]),
    ("from both ends", lambda g: len(g.V(10).bidirectionalBfs(13).one()), 3),
    ("depth first", lambda g: [(r["vertex"], r["depth"]) for r in g.V(10).dfs().to_list()], [(10, 0), (11, 1), (13, 2), (20, 3), (21, 3), (12, 1), (22, 2)]),
    ("an edge's map", lambda g: g.E(102).elementMap("metres").to_list(), [{"id": 102, "label": "feeds", "IN": {"id": 13, "label": "mill"}, "OUT": {"id": 12, "label": "mill"}, "metres": 15}]),
]
# fmt: on


@pytest.mark.parametrize(("run", "want"), [c[1:] for c in CASES], ids=[c[0].replace(" ", "-") for c in CASES])
def test_step(graph, run, want):
    got = run(graph.traversal())
    assert (sorted(got) if isinstance(want, list) and all(isinstance(x, str) for x in want) else got) == want


def test_bfs_and_hops(graph):
    g = graph.traversal()
    depth, now = {10: 0}, {10}
    while now:
        now = {e["dst"] for e in EDGES if e["src"] in now} - depth.keys()
        depth |= dict.fromkeys(now, max(depth.values()) + 1)
    assert {r["vertex"]: r["depth"] for r in g.V(10).bfs().to_list()} == depth
    assert g.V().out().out().out().count().next() == sum(1 for a in EDGES for b in EDGES for c in EDGES if a["dst"] == b["src"] and b["dst"] == c["src"])


def test_terminals(graph):
    g = graph.traversal()
    assert g.V().has("name", "Cobham").values("built").one() == 1755 and g.V().has_next() and not g.V(99).has_next()
    assert g.V().values("river").to_set() == {"Ure", "Cray", "Mole"}
    assert len(list(g.V().iter())) == len(VERTICES)
    with pytest.raises(ValueError):
        g.V().one()
    with pytest.raises(StopIteration):
        g.V(99).next()
    assert "barrier" in g.V().dedup().explain()


def test_null_is_not_absent(spark):
    g = PropertyGraph.from_rows(spark, [dict(id=0, label="a", x=None), dict(id=1, label="a"), dict(id=2, label="a", x=1)], []).traversal()
    assert sorted(g.V().has("x").to_list()) == [0, 2] and g.V().hasNot("x").to_list() == [1]


def test_mixed_types(spark):
    g = PropertyGraph.from_rows(spark, [dict(id=0, label="a", x=1), dict(id=1, label="a", x=1.0), dict(id=2, label="b", x="1"), dict(id=3, label="b", x=True)], []).traversal()
    assert g.V().has("x", 1).to_list() == [0] and g.V().has("x", 1.0).to_list() == [1] and g.V().has("x", "1").to_list() == [2]
    assert sorted(g.V().has("x", P.lt(2)).to_list()) == [0, 1]
    assert g.V().order().by("x").to_list() == [0, 1, 2, 3]
    assert g.V().values("x").sum().next() == 2.0


def test_graphson_round_trip(spark, graph):
    text = graphson.dumps(graph)
    again = graphson.loads(spark, text)
    assert graphson.dumps(again) == text
    assert graphson.lines(graph, "v").count() == len(VERTICES)


def test_graphson_lines(spark, graph, tmp_path):
    graphson.write(graph, f"file://{tmp_path}/lines")
    again = graphson.read(spark, f"file://{tmp_path}/lines")
    assert json.loads(graphson.dumps(again)) == json.loads(graphson.dumps(graph))


def test_graphson_files_are_small(spark, tmp_path, monkeypatch):
    """Lines take a fifth of their text's bytes at most, and a task's lines are cut into files."""
    monkeypatch.setattr(graphson, "LINES_A_FILE", 400)
    rows = spark.range(1000, numPartitions=1).selectExpr("id", "concat('name ', id) AS name", "id * 3 AS amount")
    written = PropertyGraph(spark, {"thing": rows}, {})
    graphson.write(written, f"file://{tmp_path}/lines")
    files = list((tmp_path / "lines" / "vertices").glob("part-*"))
    text = sum(len(r.value) + 1 for r in graphson.lines(written, "v").collect())
    assert len(files) == 3 and sum(f.stat().st_size for f in files) * 5 < text
    again = graphson.read(spark, f"file://{tmp_path}/lines").traversal().V().hasLabel("thing").df("id", "name", "amount")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_store_and_saved(spark, graph, tmp_path):
    path = f"file://{tmp_path}/g"
    assert store.save(graph, path, by_target=True) == 0 and store.save(graph, path) == 1
    assert store.versions(spark, path) == [0, 1]
    assert store.load(spark, path, 0).traversal().V(12).out("feeds").values("name").to_list() == ["Dorney"]
    with pytest.raises(ValueError):
        store.load(spark, path, 7)
    library = saved.QueryLibrary(spark, f"file://{tmp_path}/q")
    library.save("young", "MATCH (m:mill) WHERE m.built > $n RETURN m.name AS n")
    assert [r.n for r in library.run(graph, "young", n=1810).collect()] == ["Bexley"] and [q.name for q in library.list()] == ["young"]
    library.delete("young")
    assert library.list() == []
    with pytest.raises(ValueError):
        library.save("1x", "MATCH (p) RETURN p")


def test_script(graph):
    after, n = run_script(graph, "x = g.addV('mill').property('name', 'Esher').next(); g.addE('feeds').from(__.V(13)).to(__.V(23)); g.V(13).out('feeds').values('name').next()")
    assert n == "Esher"
    assert graph.traversal().V().count().next() == len(VERTICES)


def test_line_items_have_ids_of_their_own(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    line.union(line.limit(50)).write.parquet(str(tmp_path / "lineitem.parquet"))
    ids = tables.graph_of(spark, str(tmp_path)).view("e").select("id")
    assert ids.count() == ids.distinct().count()


def test_astar_reads_the_heuristic_of_all_reached_vertices(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "MAX_LOCAL_EDGES", 4)
    guesses = {0: 7.0, 2: 6.0, 10: 1.0, 11: 1.0, 12: 1.0, 13: 1.0, 1: 5.0, 3: 0.0}
    edges = [(0, 1, 4.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 5.0)]
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="n", h=h) for i, h in guesses.items()], [dict(id=n, label="e", src=a, dst=b, w=w) for n, (a, b, w) in enumerate(edges)])
    assert algorithms.astar(g, 0, 3, "w", "h") == (7.0, [0, 2, 1, 3])


def test_astar_with_a_guess_that_is_too_high(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (2, 3, 3.0)]
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="n", h=h) for i, h in enumerate([0.0, 9.0, 0.0, 0.0])], [dict(id=n, label="e", src=a, dst=b, w=w) for n, (a, b, w) in enumerate(edges)])
    assert algorithms.astar(g, 0, 3, "w", "h") == (5.0, [0, 1, 2, 3])


def test_rounds_of_many_rows_go_to_the_folder(spark, monkeypatch):
    from weftgraph import runtime

    monkeypatch.setattr(runtime.Rounds, "FEW", 2)
    n = 40
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="n", at=i) for i in range(n)], [dict(id=i, label="e", src=(i - 1) // 3, dst=i) for i in range(1, n)])
    depth = lambda i: 0 if i == 0 else 1 + depth((i - 1) // 3)
    assert {r.vertex: r.depth for r in algorithms.bfs(g, 0).collect()} == {i: depth(i) for i in range(n)}
    assert sorted(g.traversal().V(0).repeat(__.out("e")).times(3).emit().id().to_list()) == list(range(1, n))


def test_hops_read_no_other_tables(spark):
    g = tables.graph_of(spark, "/root/testdata/sf0.001").traversal()
    scans = lambda t: t._run().df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    whole = lambda t, *c: t.df(*c)._jdf.queryExecution().optimizedPlan().toString()
    kept = whole(g.V().hasLabel("order").outE("contains").has("l_quantity", P.gt(49)).as_("e").inV().as_("p").select("e", "p").by("l_quantity").by("p_partkey"))
    assert kept.count("Relation [") <= 3 and "Window" not in kept
    assert scans(g.V(tables.STRIDE * 5 + 10).inE("contains").outV()) <= 2 and whole(g.V(tables.STRIDE * 5 + 10).inE("contains").outV(), "o_orderkey").count("Relation [") <= 3
    assert whole(g.V().hasLabel("customer").out("placed").values("o_orderkey")).count("Relation [") <= 3


def test_rounds_have_no_silent_cap(spark, monkeypatch):
    n = 9
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="n", at=i) for i in range(n)], [dict(id=i, label="e", src=i, dst=i + 1) for i in range(n - 1)])
    monkeypatch.setattr(algorithms, "MAX_ROUNDS", 3)
    monkeypatch.setattr(rounds, "MAX_LOOPS", 3, raising=False)
    assert algorithms.bfs(g, 2).count() == 7
    assert g.traversal().V(0).repeat(__.out("e")).until(__.has("at", n - 1)).id().to_list() == [n - 1]
    assert inspect.signature(algorithms.bidirectional_paths).parameters["max_depth"].default is None
    assert algorithms.bidirectional_paths(g, 0, n - 1) == list(range(n))

"""The pattern language, changes and traversal text over the same small graph."""

import pyarrow as pa
import pytest

from tests.test_traversal import EDGES, VERTICES
from weftgraph.functions import stemming
from weftgraph.functions.stemming import stem
from weftgraph.model import PropertyGraph
from weftgraph.operators import algorithms, mutation, textsearch
from weftgraph.plans import schema
from weftgraph.plans.gql_parser import GqlError
from weftgraph.plans.traversal import P
from weftgraph.streaming import subscribe as live


@pytest.fixture(scope="module")
def G(spark):  # noqa: N802
    return PropertyGraph.from_rows(spark, VERTICES, EDGES)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


# Clauses over tables are held to SQL in test_entry; these are cases of small graphs, with rows derived by hand.
# fmt: off
CASES = [
    ("both ways", lambda G, q, spark: q("MATCH (m:mill {name: 'Cobham'})-[:feeds]-(x) RETURN x.name AS x"), [("Aldwark",), ("Dorney",)]),
    ("joined patterns", lambda G, q, spark: q("MATCH (a:mill)-[:feeds]->(b), (b)-[:grinds]->(g) RETURN a.name AS a, g.name AS g"), [("Aldwark", "barley"), ("Bexley", "barley"), ("Bexley", "oats"), ("Cobham", "barley"), ("Cobham", "oats")]),
    ("product", lambda G, q, spark: q("MATCH (m:mill), (g:grain) RETURN count(*) AS n"), [(12,)]),
    ("no hop at all", lambda G, q, spark: q("MATCH (m:mill {name: 'Bexley'})-[:feeds*0..1]->(x) RETURN m.name AS m, x.name AS x"), [("Bexley", "Bexley"), ("Bexley", "Dorney")]),
    ("optional", lambda G, q, spark: q("MATCH (m:mill) OPTIONAL MATCH (m)-[:stores]->(g) RETURN m.name AS m, g.name AS g"), [("Aldwark", None), ("Bexley", None), ("Cobham", "rye"), ("Dorney", None)]),
    ("implicit groups", lambda G, q, spark: q("MATCH (m:mill) RETURN m.river AS r, count(*) AS n, max(m.built) AS b, collect(m.name) AS l"), [("Cray", 2, 1812, ["Bexley", "Dorney"]), ("Mole", 1, 1755, ["Cobham"]), ("Ure", 1, 1790, ["Aldwark"])]),
    ("a limit within", lambda G, q, spark: q("MATCH (m:mill) WITH m ORDER BY m.built DESC LIMIT 2 MATCH (m)-[:grinds]->(g) RETURN m.name AS m, g.name AS g"), [("Bexley", "barley"), ("Dorney", "barley"), ("Dorney", "oats")]),
    ("order of an expression", lambda G, q, spark: [r.n for r in G.gql("MATCH (g:grain) RETURN g.name AS n ORDER BY size(g.name), g.name").collect()], ["rye", "oats", "barley"]),
    ("procedure", lambda G, q, spark: q("MATCH (a:mill {name: 'Aldwark'}), (g:grain {name: 'rye'}) CALL lib.shortestPath(id(a), id(g)) YIELD path, distance RETURN path, distance"), [([10, 12, 22], 2.0)]),
    ("path", lambda G, q, spark: q("WITH PATH AS p MATCH (a:mill)-[:feeds]->(b)-[:stores]->(g) RETURN path() AS p"), [([10, 12, 22],)]),
    ("types", lambda G, q, spark: q("MATCH (a)-[r]->(g:grain) RETURN labels(g) AS l, type(r) AS t, id(a) AS i"), [(["grain"], "grinds", 11), (["grain"], "grinds", 13), (["grain"], "grinds", 13), (["grain"], "stores", 12)]),
    ("unwind",lambda G, q, spark: q("UNWIND [1,2,3] AS x RETURN x, x*2 AS y"),[(1,2),(2,4),(3,6)]),
    ("fns",lambda G, q, spark: q("UNWIND [1] AS x RETURN toUpper('ab') AS a, substring('hello',1,3) AS b, 7/2 AS c, -7/2 AS d, 7 % 3 AS e, 2^10 AS f, 2^-1 AS g, 1.5+1 AS h, 'a' || 1 AS i, toInteger('12') AS j, round(2.5) AS k, sign(-3) AS l, 1/0 AS m, coalesce(null, 5) AS n, size('é') AS o, toString(1.0) AS p"),[('AB','ell',3,-3,1,1024,None,2.5,'a1',12,3.0,-1,None,5,2,'1')]),
    ("lists",lambda G, q, spark: q("UNWIND [1] AS z RETURN [x IN [1,2,3] WHERE x > 1 | x*10] AS a, reduce(s=0, x IN [1,2,3] | s+x) AS b, all(x IN [1,2] WHERE x > 0) AS c, single(x IN [1,2] WHERE x > 1) AS d, [1,2,3][-1] AS e, [1,2,3,4][1..3] AS f, 2 IN [1,2] AS g"),[([20,30],6,True,True,3,[2,3],True)]),
    ("create", lambda G, q, spark: rows(G.gql("MATCH (m:mill {name: 'Dorney'}) CREATE (m)-[:owned_by {since: 1901}]->(o:owner {name: 'Pym'})")[0].gql("MATCH (m)-[e:owned_by]->(o:owner) RETURN m.name AS m, e.since AS s, o.name AS o")), [("Dorney", 1901, "Pym")]),
    ("set", lambda G, q, spark: rows(G.gql("MATCH (m:mill) WHERE m.built > 1800 SET m.built = m.built + 1, m.late = true")[0].gql("MATCH (m:mill) WHERE m.late RETURN m.name AS m, m.built AS b")), [("Bexley", 1813), ("Dorney", 1804)]),
    ("set by rows", lambda G, q, spark: rows(G.gql("UNWIND [3, 8, 1] AS v MATCH (g:grain) SET g.rank = v")[0].gql("MATCH (g:grain) RETURN DISTINCT g.rank AS r")), [(1,)]),
    ("remove", lambda G, q, spark: G.gql("MATCH (m:mill {name: 'Cobham'}) REMOVE m.river")[0].traversal().V().hasLabel("mill").hasNot("river").values("name").to_list(), ["Cobham"]),
    ("detach", lambda G, q, spark: (lambda r: (r[1]["vertices_removed"], r[1]["edges_removed"], r[0].view("v").count()))(G.gql("MATCH (m:mill {name: 'Dorney'}) DETACH DELETE m")), (1, 4, 6)),
    ("merge makes", lambda G, q, spark: rows(G.gql("MERGE (m:mill {name: 'Esher'}) ON CREATE SET m.built = 1 ON MATCH SET m.built = 2")[0].gql("MATCH (m:mill {name: 'Esher'}) RETURN m.built AS b")), [(1,)]),
    ("merge finds", lambda G, q, spark: rows(G.gql("MERGE (m:mill {name: 'Bexley'}) ON CREATE SET m.built = 1 ON MATCH SET m.built = 2")[0].gql("MATCH (m:mill {name: 'Bexley'}) RETURN m.built AS b")), [(2,)]),
    ("foreach", lambda G, q, spark: G.gql("MATCH (g:grain {name: 'oats'}) FOREACH (x IN [4, 5, 6] | CREATE (:sack {kilos: x}))")[1]["vertices_added"], 3),
    ("text", lambda G, q, spark: G.query("g.V(10).repeat(__.out('feeds')).times(2).dedup().values('name').next()"), "Dorney"),
    ("text with a test", lambda G, q, spark: sorted(G.query("g.V().where(__.out('grinds').has('price', lt(1.0))).values('name').toList()")), ["Dorney"]),
    ("addE in text", lambda G, q, spark: G.query("g.V(13).addE('feeds').to(__.V(10)).property('metres', 7)")[0].traversal().V(13).out("feeds").values("name").to_list(), ["Aldwark"]),
    ("search", lambda G, q, spark: [r[0] for r in textsearch.hits(textsearch.create_index(G, "v", "name"), "v", "name", "rye", 5).collect()], [22]),
]
# fmt: on


@pytest.mark.parametrize(("run", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_query(spark, G, run, want):  # noqa: N803
    assert run(G, lambda text, **p: rows(G.gql(text, **p)), spark) == want


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "MATCH (a) RETURN b", "MATCH (a) RETURN nope(a)", "MATCH (a)", "MATCH (a) RETURN a.x AS x, a.y AS x", "MATCH (a) RETURN a.x, count(*) GROUP BY a.y"])
def test_errors(G, text):  # noqa: N803
    with pytest.raises(GqlError):
        G.gql(text)


def test_delete_refuses(G):  # noqa: N803
    with pytest.raises(mutation.MutationError):
        G.gql("MATCH (m:mill {name: 'Aldwark'}) DELETE m")


def test_set_refuses_what_it_cannot_order(G):  # noqa: N803
    with pytest.raises(mutation.MutationError):
        G.gql("UNWIND [1, 2] AS v MATCH (g:grain) SET g.price = g.price + v")


def test_schema(G):  # noqa: N803
    g = G.ddl("CREATE NODE TYPE mill (name STRING NOT NULL, built INT, wheels INT DEFAULT 2, river STRING)").ddl("CREATE EDGE TYPE feeds (metres INT) FROM mill TO mill").ddl("SET SCHEMA VALIDATION strict")
    after, _ = g.gql("CREATE (:mill {name: 'Esher'})")
    assert rows(after.gql("MATCH (m:mill {name: 'Esher'}) RETURN m.wheels AS w")) == [(2,)]
    with pytest.raises(schema.SchemaError):
        g.gql("CREATE (:mill {built: 1700})")
    with pytest.raises(schema.SchemaError):
        g.gql("MATCH (m:mill {name: 'Bexley'}), (g:grain {name: 'rye'}) CREATE (m)-[:feeds {metres: 1}]->(g)")
    assert g.ddl("ALTER NODE TYPE mill DROP built").schema.nodes["mill"].properties.keys() == {"name", "wheels", "river"}
    assert schema.infer(G).nodes["mill"].properties["built"].type == "INT"
    with pytest.raises(schema.SchemaError):
        G.ddl("CREATE UNIQUE INDEX c ON mill(river)")


def test_text_queries(spark):
    docs = ["the quick brown fox", "quick foxes jump over brown dogs", "slow green turtles", "brown bears and quick brown foxes"]
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="d", body=t) for i, t in enumerate(docs)], [])
    g = textsearch.create_index(g, "v", "body")
    q = textsearch.TextQ
    ids = lambda x: sorted(r.id for r in textsearch.hits(g, "v", "body", x, 10).collect())
    assert ids(q.match("fox turtle")) == [0, 1, 2, 3] and ids(q.match_all("quick dog")) == [1]
    assert ids(q.phrase("quick brown")) == [0, 3] and ids(q.phrase("quick jump", 1)) == [1] and ids(q.prefix("turt")) == [2]
    assert ids(q.and_(q.match("brown"), q.not_(q.match("bear")))) == [0, 1] and ids(q.not_(q.match("brown"))) == [2] and ids(q.match("")) == []
    with pytest.raises(textsearch.TextError):
        ids(q.or_(q.match("a"), q.not_(q.match("b"))))
    best = textsearch.hits(g, "v", "body", "brown", 1).first()
    assert best.id in (0, 3) and best.score > 0


def test_algorithm_library(spark):
    edges = [(0, 1, 1), (1, 2, 2), (0, 2, 4), (2, 3, 1), (1, 3, 6)]
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="n", h=0.0) for i in range(5)], [dict(id=n, label="e", src=a, dst=b, w=w) for n, (a, b, w) in enumerate(edges)])
    assert algorithms.k_shortest_paths(g, 0, 3, 9, "w") == [(4.0, [0, 1, 2, 3]), (5.0, [0, 2, 3]), (7.0, [0, 1, 3])]
    assert algorithms.k_shortest_paths(g, 0, 3, 0) == [] and algorithms.astar(g, 0, 3, "w", "h") == (4.0, [0, 1, 2, 3])
    assert {r.vertex: r.distance for r in algorithms.dijkstra_all(g, 0, "w").collect()} == {0: 0.0, 1: 1.0, 2: 3.0, 3: 4.0}
    assert algorithms.bidirectional_paths(g, 0, 3) in ([0, 1, 3], [0, 2, 3]) and algorithms.bidirectional_paths(g, 0, 4) is None
    assert algorithms.iddfs(g, 0, 3, 1) is None and len(algorithms.iddfs(g, 0, 3, 2)) == 3
    assert algorithms.dfs(g, 0) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    with pytest.raises(algorithms.PathError):
        algorithms.dijkstra_all(g, 0, "nope", on_missing="error")


def test_live_query(spark, G, tmp_path):  # noqa: N803
    schema_ = live.CHANGE_SCHEMA
    batches = [
        [(1, "vertex_added", 30, "mill", None, None, None, None), (2, "vertex_property", 30, "mill", None, None, "built", "1850"), (3, "vertex_property", 12, "mill", None, None, "built", "1899")],
        [(4, "vertex_removed", 11, "mill", None, None, None, None), (5, "edge_added", 190, "feeds", 12, 13, None, None)],
        [(6, "vertex_property", 12, "mill", None, None, "built", "1901")],
    ]
    t = G.traversal().V().hasLabel("mill").has("built", P.gt(1800))
    got = []
    sub = live.subscribe(t, spark.createDataFrame([], schema_), lambda df, n: got.append(sorted((r.id, r.event) for r in df.collect())), include_initial=True)
    for n, b in enumerate(batches):
        sub.on_batch(spark.createDataFrame(b, schema_), n)
    assert got == [[(11, "Added"), (13, "Added")], [(12, "Added"), (30, "Added")], [(11, "Removed")], [(12, "Updated")]]
    source = f"{tmp_path}/changes"
    for b in batches:
        spark.createDataFrame(b, schema_).coalesce(1).write.mode("append").parquet(source)
    seen = []
    stream = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 10).parquet(source)
    again = live.subscribe(t, stream, lambda df, n: seen.extend((r.id, r.event) for r in df.collect()), available_now=True)
    again.query.awaitTermination(120)
    assert sorted(seen) == [(11, "Removed"), (12, "Added"), (30, "Added")]
    again.cancel()


def test_changes_in_their_order(spark, G):  # noqa: N803
    ops = [("vertex_removed", 12, None, None), ("vertex_added", 12, None, None), ("edge_added", 200, 12, 13), ("edge_added", 201, 10, 13), ("vertex_removed", 13, None, None), ("vertex_added", 13, None, None), ("edge_added", 202, 10, 13), ("vertex_added", 40, None, None), ("vertex_removed", 40, None, None)]
    batch = spark.createDataFrame([(n, op, i, "mill" if op[0] == "v" else "feeds", a, b, None, None) for n, (op, i, a, b) in enumerate(ops)], live.CHANGE_SCHEMA)
    after = live.apply_changes(G, batch)
    assert sorted(r.id for r in after.view("v").select("id").collect()) == [10, 11, 12, 13, 20, 21, 22]
    assert sorted(r.id for r in after.view("e").select("id").collect()) == [100, 104, 202]  # edges went with their ends
    assert after.traversal().V(12).values("river").to_list() == []


def test_values_that_are_there_twice(spark, G):  # noqa: N803
    got = []
    change = spark.createDataFrame([(1, "vertex_property", 10, "mill", None, None, "river", "Cray")], live.CHANGE_SCHEMA)
    live.subscribe(G.traversal().V().hasLabel("mill").values("river"), change, lambda df, n: got.extend((r.event, r.before or r.after, r.times) for r in df.collect()))
    assert sorted(x[0] for x in got) == ["Added", "Removed"] and {t for *_, t in got} == {1}


def test_stored_index(spark, tmp_path):
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="d", body=t) for i, t in enumerate(["red mill", "green mills", "milling of oats", None])], [])
    g = textsearch.store_index(textsearch.create_index(g, "v", "body"), "v", "body", f"file://{tmp_path}/i")
    ids = lambda x, q: sorted(r.id for r in textsearch.hits(x, "v", "body", q, 10).collect())
    assert ids(g, "mill") == [0, 1, 2] and ids(g, textsearch.TextQ.phrase("red mill")) == [0]
    later = textsearch.upsert(g, "v", "body", spark.createDataFrame([(1, "rye"), (3, "a mill")], "id long, text string"))
    later = textsearch.delete(later, "v", "body", spark.createDataFrame([(0,)], "id long"))
    assert ids(later, "mill") == [2, 3] and ids(later, "rye") == [1] and ids(g, "mill") == [0, 1, 2]  # the old index is a snapshot
    whole = textsearch.merge(later, "v", "body")
    assert ids(whole, "mill") == [2, 3] and len(whole.text["v", "body"].segments) == 1
    assert ids(textsearch.open_index(g, "v", "body", f"file://{tmp_path}/i"), "mill") == [2, 3]


LONG = " ".join(f"w{i}" for i in range(textsearch.PIECE - 1)) + " green mill " + "oats " * textsearch.PIECE


@pytest.fixture
def bodies(spark):
    texts = ["a red mill", LONG, "green and mill", "", None, "Millstones, oats: oats"]
    g = PropertyGraph.from_rows(spark, [dict(id=i, label="d", body=t) for i, t in enumerate(texts)], [])
    return textsearch.create_index(g, "v", "body", analyzer=textsearch.Analyzer("standard"))


def found(g, q):
    return sorted((r.id, round(r.score, 9)) for r in textsearch.scores(g, g.text["v", "body"], q).collect())


def test_storing_an_index_moves_no_postings(spark, bodies, tmp_path):
    """Each job of it has one stage, and a row holds a term's postings in many texts."""
    spark.sparkContext.setJobGroup("store", "store")
    stored = textsearch.store_index(bodies, "v", "body", f"file://{tmp_path}/i")
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    assert {len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("store")} == {1}
    assert [r.n for r in textsearch._unpacked(textsearch._segment(spark, stored.text["v", "body"], stored.text["v", "body"].segments[0]).filter("term = 'oats'"), "id", "tf").groupBy("id").agg({"tf": "sum"}).toDF("id", "n").orderBy("id").collect()] == [textsearch.PIECE, 2]


def test_merge_after_changes_is_the_index_of_what_is_left(spark, bodies, tmp_path):
    stored = textsearch.store_index(bodies, "v", "body", f"file://{tmp_path}/i")
    stored = textsearch.upsert(stored, "v", "body", spark.createDataFrame([(0, "oats"), (2, None)], "id long, text string"))
    stored = textsearch.delete(stored, "v", "body", spark.createDataFrame([(5,)], "id long"))
    left = PropertyGraph.from_rows(spark, [dict(id=i, label="d", body=t) for i, t in ((0, "oats"), (1, LONG), (3, ""))], [])
    left = textsearch.create_index(left, "v", "body", analyzer=textsearch.Analyzer("standard"))
    merged = textsearch.merge(stored, "v", "body")
    for q in (textsearch.TextQ.match("oats mill"), textsearch.TextQ.phrase("green mill"), textsearch.TextQ.not_(textsearch.TextQ.match("w1"))):
        assert found(merged, q) == found(stored, q) == found(left, q) != []


@pytest.mark.parametrize("q", [textsearch.TextQ.phrase("green mill"), textsearch.TextQ.prefix("mill"), textsearch.TextQ.match_all("oats green"), textsearch.TextQ.match("red oats")], ids=lambda q: q.op)
def test_stored_search_without_shuffled_postings(spark, bodies, tmp_path, q):
    """The stored index gives what the texts give; a block's row holds a term's postings, so there are fewer rows than postings."""
    stored = textsearch.store_index(bodies, "v", "body", f"file://{tmp_path}/i")
    assert found(stored, q) == found(bodies, q) != []
    index = stored.text["v", "body"]
    kept = spark.read.parquet(f"{index.path}/{index.segments[0]}/postings").filter("term = 'mill'")
    assert "ids" in kept.columns and sum(len(r.ids) for r in kept.collect()) == 3


def test_blocks_end_with_a_text(monkeypatch):
    """Texts cut into pieces over several batches are whole in one block each."""
    monkeypatch.setattr(textsearch, "BLOCK_TOKENS", 4)
    schema = pa.schema([("id", pa.int64()), ("len", pa.int32()), ("at", pa.int32()), ("tokens", pa.list_(pa.string()))])
    batches = [[(7, 3, 0, ["b", "a"])], [(7, 3, 2, ["b"]), (8, 0, 0, []), (9, 2, 0, ["a", "c"])], [(5, 1, 0, ["b"])]]
    rows = [r for b in textsearch._packed(pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema=schema) for rows in batches) for r in b.to_pylist()]
    assert [(r["term"], r["ids"], r["lens"], r["ends"], r["positions"]) for r in rows] == [
        (None, [7, 8, 9], [3, 0, 2], [0, 0, 0], []),
        ("b", [7], [3], [2], [0, 2]),
        ("a", [7, 9], [3, 2], [1, 2], [1, 0]),
        ("c", [9], [2], [1], [1]),
        (None, [5], [1], [0], []),
        ("b", [5], [1], [1], [0]),
    ]
    assert len({r["block"] for r in rows}) == 2


def test_stemmer():
    pairs = "consigned consign consistency consist consolation consol conspicuously conspicu knightly knight knotty knotti hopping hop hoping hope agreed agre relational relat rationalize ration dying die happily happili".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_stemming_takes_few_arrays_at_a_time(spark, monkeypatch):
    """Nulls and empty arrays stay; no slice of a batch is larger than it may be."""
    arrays = [["mills", "red"], None, [], ["milling", "mills"]]
    seen = []
    monkeypatch.setattr(stemming, "ROWS", 3)
    monkeypatch.setattr(stemming, "stem", lambda w: (seen.append(w), stem(w))[1])
    whole = pa.array(arrays, pa.list_(pa.string()))
    assert [stemming._stems(whole.slice(i, 3)).to_pylist() for i in (0, 3)] == [[["mill", "red"], None, []], [["mill", "mill"]]]
    assert seen == ["mills", "red", "milling", "mills"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays * 900)], "id int, a array<string>").repartition(1)
    got = dict(df.select("id", stemming.stemmed(df.a)).collect())
    assert [got[i] for i in range(len(got))] == [["mill", "red"], None, [], ["mill", "mill"]] * 900


def test_long_texts_reach_python_in_pieces(spark):
    rows = textsearch._pieces(textsearch.Analyzer(), spark.createDataFrame([(1, "mills " * (2 * textsearch.PIECE + 1)), (2, "the")], "id long, text string")).collect()
    assert sorted((r.id, r.len, r["at"], len(r.tokens)) for r in rows) == [(1, 2 * textsearch.PIECE + 1, i * textsearch.PIECE, n) for i, n in enumerate([textsearch.PIECE, textsearch.PIECE, 1])] + [(2, 0, 0, 0)]

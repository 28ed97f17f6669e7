"""Further registered graph queries: one or more for each step, function, procedure, statement and source that
``queries`` doesn't show, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph.functions import geo
from weftgraph.operators import algorithms, textsearch
from weftgraph.plans.gql_parser import GqlError
from weftgraph.plans.traversal import P, TextP, __
from weftgraph.queries import _REACH, ORACLES, PA, QUERIES, C, N, R, _PLACE, gql, query, traversal, with_places, with_weights
from weftgraph.runtime import shared_dir
from weftgraph.sources import graphson, store
from weftgraph.sources.tables import STRIDE
from weftgraph.streaming.subscribe import CHANGE_SCHEMA, apply_changes, subscribe

TextQ = textsearch.TextQ
WAYS = ("in_region", "in_nation", "supplied_by")


def scratch(graph, what: str) -> str:
    return f"{shared_dir(graph.spark)}/weft-{what}-{uuid.uuid4().hex}"


def part_of(g, vertices, edges):
    """The graph with some labels alone."""
    return g.changed({k: g.vertices[k] for k in vertices}, {k: g.edges[k] for k in edges})


def places(g):
    return part_of(g, ("region", "nation"), ("in_region",))


def rows(g, data, schema: str):
    return g.spark.createDataFrame(data, schema)


# -- sources -----------------------------------------------------------------------------------
traversal("inject_step", "SELECT unnest([2, 3])::BIGINT AS value", lambda g: g.inject(1, 2, 3).is_(P.gt(1)))
traversal("v_by_property", "SELECT n_name AS value FROM nation WHERE n_regionkey = 1", lambda g: g.v_by_property("nation", "n_regionkey", 1).values("n_name"))
traversal("v_by_property_range", "SELECT c_custkey AS value FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 1000", lambda g: g.v_by_property_range("customer", "c_acctbal", 0.0, 1000.0, False, True).values("c_custkey"))
traversal("e_by_property", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'", lambda g: g.e_by_property("contains", "l_returnflag", "R").count(), "n")
query("edge_ids_distinct", "SELECT 0::BIGINT AS repeated")(lambda g: g.view("e").groupBy("id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated")))
_IN = "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey"
query("graphson_text", _IN)(lambda g: graphson.loads(g.spark, graphson.dumps(places(g))).gql("MATCH (n:nation)-[:in_region]->(r:region) RETURN n.n_name AS a, r.r_name AS b"))


@query("graphson_files", "SELECT o_orderkey AS o, o_custkey AS c, o_totalprice AS p, c_name AS n FROM orders JOIN customer ON c_custkey = o_custkey")
def _graphson_files(g):
    path = scratch(g, "graphson")
    graphson.write(part_of(g, ("customer", "order"), ("placed",)), path)
    return graphson.read(g.spark, path).gql("MATCH (c:customer)-[e:placed]->(o:order) RETURN o.o_orderkey AS o, o.o_custkey AS c, e.o_totalprice AS p, c.c_name AS n")


@query("store_versions", "SELECT r_name AS key, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _store_versions(g):
    path, kept = scratch(g, "store"), part_of(g, ("customer", "nation", "region"), ("in_nation", "in_region"))
    first = store.save(kept, path)
    store.save(kept.gql("MATCH (r:region) DETACH DELETE r")[0], path)
    return store.load(g.spark, path, first).traversal().V().hasLabel("customer").out("in_nation").out("in_region").groupCount().by("r_name").df()


@query("sink_csv", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def _sink_csv(g):
    path = scratch(g, "csv")
    store.to_csv(g.traversal().V().hasLabel("customer").has("c_acctbal", P.gt(5000)).df("c_custkey", "c_acctbal"), path)
    return g.spark.read.option("header", True).schema("c_custkey long, c_acctbal double").csv(path)


@query("sink_json", "SELECT r_name AS r, list(n_name ORDER BY n_nationkey) AS ns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _sink_json(g):
    path = scratch(g, "json")
    store.to_json(g.traversal().V().hasLabel("region").project("r", "ns").by("r_name").by(__.in_("in_region").order().by("n_nationkey").values("n_name").fold()).df(), path)
    return g.spark.read.schema("r string, ns array<string>").json(path)


# -- filters -----------------------------------------------------------------------------------
query("has_key_property", "SELECT r_name AS value FROM region")(lambda g: g.traversal().V().hasLabel("region").properties().hasKey("r_name").df().select(F.col("value.s").alias("value")))
query("has_value_property", "SELECT 'r_name' AS key FROM region WHERE r_name = 'ASIA'")(lambda g: g.traversal().V().hasLabel("region").properties().hasValue("ASIA").df().select("key"))
traversal("where_predicate", "SELECT c_acctbal AS value FROM customer WHERE c_acctbal > 9500", lambda g: g.V().hasLabel("customer").values("c_acctbal").where(P.gt(9500)))
traversal("dedup_by_label", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'order', 'document', 'user']) AS value", lambda g: g.V().dedup_by_label().label())


@query("coin_half", "SELECT true AS about_half, 0::BIGINT AS strangers")
def _coin(g):
    """What coin(0.5) lets pass is about half of all orders, and nothing else."""
    known = g.vertices["order"].select(F.col("o_orderkey").alias("k"))
    tossed = g.traversal().V().hasLabel("order").coin(0.5).df("o_orderkey").join(known, F.col("o_orderkey") == F.col("k"), "left")
    facts = tossed.agg(F.count("*").alias("n"), F.count(F.when(F.col("k").isNull(), 1)).alias("strangers"))
    return facts.crossJoin(known.agg(F.count("*").alias("all"))).select((F.col("n") / F.col("all")).between(0.3, 0.7).alias("about_half"), "strangers")  # one row each


query("sample_step", "SELECT least(7, count(*)) AS n, least(7, count(*)) AS known FROM nation")(lambda g: g.traversal().V().hasLabel("nation").sample(7).df("n_nationkey").agg(F.countDistinct("n_nationkey").alias("n"), F.count(F.when(F.col("n_nationkey").between(0, 24), 1)).alias("known")))
traversal("has_gte", "SELECT c_custkey FROM customer WHERE c_acctbal >= 9000", lambda g: g.V().hasLabel("customer").has("c_acctbal", P.gte(9000)), "c_custkey")
traversal("textp_ending", "SELECT p_partkey FROM part WHERE ends_with(p_name, 'ring') AND NOT starts_with(p_name, 'small')", lambda g: g.V().hasLabel("part").has("p_name", TextP.endingWith("ring")).has("p_name", TextP.notStartingWith("small")), "p_partkey")
query("geo_intersects", f"SELECT c_custkey FROM ({_PLACE}) WHERE lon BETWEEN 10 AND 50 AND lat BETWEEN 10 AND 50")(lambda g: with_places(g).traversal().V().hasLabel("customer").has("place", P.geo_intersects(geo.Polygon([(10, 10), (50, 10), (50, 50), (10, 50)]))).df("c_custkey"))

# -- transforms --------------------------------------------------------------------------------
query("property_map", "SELECT 'n_name' AS key, n_name AS value FROM nation")(lambda g: g.traversal().V().hasLabel("nation").propertyMap("n_name").df().select(F.explode("n_name").alias("x")).select("x.key", "x.value"))
traversal("property_key_step", "SELECT 'r_name' AS value FROM region UNION ALL SELECT 'r_regionkey' FROM region", lambda g: g.V().hasLabel("region").properties().key())
traversal("property_value_step", "SELECT r_name AS value FROM region", lambda g: g.V().hasLabel("region").properties("r_name").value())
traversal("loops_until", "SELECT 1000000000000 + n_regionkey AS value FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda g: g.V().hasLabel("customer").repeat(__.out("in_nation", "in_region")).until(__.loops().is_(P.gte(2))).id())
traversal("select_keys", "SELECT DISTINCT c_mktsegment AS value FROM customer", lambda g: g.V().hasLabel("customer").groupCount().by("c_mktsegment").select("keys"))
traversal("select_values", "SELECT count(*) AS value FROM customer GROUP BY c_mktsegment", lambda g: g.V().hasLabel("customer").groupCount().by("c_mktsegment").select("values"))
query("terminal_sum", "SELECT sum(n_nationkey)::BIGINT AS total, count(*) AS n FROM nation")(lambda g: rows(g, [(g.traversal().V().hasLabel("nation").values("n_nationkey").sum().next(), g.traversal().V().hasLabel("nation").count().next())], "total long, n long"))
_ORDER = "(SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation)"


@query("terminals", f"SELECT list(n_name ORDER BY n_name) AS all_names, 5::BIGINT AS regions, min(n_name) AS one, list(n_name ORDER BY k) FILTER (k <= 3) AS three, true AS some, false AS other, count(*) AS streamed FROM {_ORDER}")
def _terminals(g):
    names = g.traversal().V().hasLabel("nation").order().by("n_name").values("n_name")
    g.traversal().V().hasLabel("region").iterate()
    none = g.traversal().V().hasLabel("nation").has("n_nationkey", -1)
    found = (names.to_list(), len(g.traversal().V().hasLabel("nation").values("n_regionkey").to_set()), names.limit(1).one(), names.next(3), names.has_next(), none.has_next(), sum(1 for _ in names.iter()))
    return rows(g, [found], "all_names array<string>, regions long, one string, three array<string>, some boolean, other boolean, streamed long")


query("explain_step", "SELECT '0 V() [source]' AS line UNION ALL SELECT '1 hasLabel(''nation'') [filter]' UNION ALL SELECT '2 out(''in_region'') [navigation]' UNION ALL SELECT '3 count() [reduce] barrier'")(lambda g: rows(g, [(x,) for x in g.traversal().V().hasLabel("nation").out("in_region").count().explain().split("\n")], "line string"))



@query("map_host_functions", "SELECT reverse(n_name) AS value FROM nation WHERE length(n_name) = 8 UNION ALL SELECT upper(n_name) FROM nation WHERE length(n_name) = 8")
def _host(g):
    """Python functions as closures: Arrow batches of values in, values, lists or tests out."""
    short = F.pandas_udf(lambda names: names.str.len() == 8, "boolean")
    twice = F.pandas_udf(lambda names: names.map(lambda x: [x, x.upper()[::-1]]), "array<string>")
    back = F.pandas_udf(lambda names: names.str[::-1], "string")
    return g.traversal().V().hasLabel("nation").values("n_name").filter(short).flatMap(twice).map(back).df()


# -- branches and side effects -------------------------------------------------------------------
traversal("choose_by_option", "SELECT CASE n_regionkey WHEN 1 THEN 'one' ELSE n_name END AS value FROM nation", lambda g: g.V().hasLabel("nation").choose_by(__.values("n_regionkey")).option(1, __.constant("one")).option("none", __.values("n_name")))
_UP = "SELECT {first} c_nationkey + 2000000000000 AS value FROM customer UNION ALL SELECT n_regionkey + 1000000000000 FROM customer JOIN nation ON c_nationkey = n_nationkey"
traversal("repeat_emit_first", _UP.format(first="c_custkey + 3000000000000 AS value FROM customer UNION ALL SELECT"), lambda g: g.V().hasLabel("customer").repeat(__.out("in_nation", "in_region")).times(2).emit_first().id())
traversal("repeat_emit_if", "SELECT n_regionkey + 1000000000000 AS value FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda g: g.V().hasLabel("customer").repeat(__.out("in_nation", "in_region")).times(2).emit(__.hasLabel("region")).id())


@query("repeat_long_chain", "SELECT 105::BIGINT AS value")
def _chain(g):
    """A chain of 106 vertices is walked to its end: repeat() has no limit of its own."""
    own = g.spark.range(106)
    chain = type(g)(g.spark, {"link": own.select("id", F.col("id").alias("n"))}, {"next": own.filter("id < 105").select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))})
    return chain.traversal().V(0).repeat(__.out("next")).until(__.has("n", 105)).values("n").df()


traversal("store_side_effect", "SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation", lambda g: g.V().hasLabel("nation").values("n_name").store("x").cap("x"), "names")
traversal("side_effect_step", "SELECT count(*) AS n FROM nation", lambda g: g.V().hasLabel("nation").sideEffect(__.values("n_name").store("x")).count(), "n")
traversal("profile_step", "SELECT n_name AS value FROM nation", lambda g: g.V().hasLabel("nation").values("n_name").profile("p"))

# -- changes -----------------------------------------------------------------------------------
@query("add_v_add_e_property", "SELECT n_name AS a, 'hub' AS b, 7::BIGINT AS w FROM nation UNION ALL SELECT 'x', 'hub', 8")
def _add(g):
    made, _ = g.traversal().addV("place").property("name", "hub").mutate()
    hub = made.traversal().V().hasLabel("place").id().next()
    made, _ = made.traversal().V().hasLabel("nation").addE("near").to(hub).property("w", 7).mutate()
    made, _ = made.traversal().addV("nation").property("n_name", "x").mutate()
    made, _ = made.traversal().V().has("nation", "n_name", "x").addE("near").to(hub).property("w", 8).mutate()
    return made.gql("MATCH (n:nation)-[e:near]->(p:place) RETURN n.n_name AS a, p.name AS b, e.w AS w")


query("property_step", "SELECT n_name AS name, n_regionkey = 2 AS marked FROM nation")(lambda g: g.traversal().V().hasLabel("nation").has("n_regionkey", 2).property("mark", "m").mutate()[0].gql("MATCH (n:nation) RETURN n.n_name AS name, n.mark IS NOT NULL AS marked"))
query("remove_property", "SELECT count(*) AS n, count(*) FILTER (n_regionkey <> 3) AS named FROM nation")(lambda g: g.gql("MATCH (n:nation) WHERE n.n_regionkey = 3 REMOVE n.n_name")[0].gql("MATCH (n:nation) RETURN count(*) AS n, count(n.n_name) AS named"))
query("delete_edges", "SELECT count(*) FILTER (n_regionkey <> 1) AS n FROM nation")(lambda g: g.gql("MATCH (n:nation)-[e:in_region]->(r:region) WHERE r.r_regionkey = 1 DELETE e")[0].gql("MATCH (n:nation)-[e:in_region]->(r:region) RETURN count(*) AS n"))
query("foreach_create", "SELECT n_name AS n, x FROM nation, (VALUES (1::BIGINT), (2)) t(x) WHERE n_regionkey = 0")(lambda g: g.gql("MATCH (n:nation) WHERE n.n_regionkey = 0 FOREACH (x IN [1, 2] | CREATE (n)-[:marks {x: x}]->(n))")[0].gql("MATCH (n:nation)-[e:marks]->(n) RETURN n.n_name AS n, e.x AS x"))
query("set_last_row_wins", "SELECT n_name AS n, 2::BIGINT AS x FROM nation")(lambda g: g.gql("UNWIND [5, 9, 2] AS v MATCH (n:nation) SET n.x = v")[0].gql("MATCH (n:nation) RETURN n.n_name AS n, n.x AS x"))
query("create_many", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, sum(o_orderkey)::BIGINT AS total FROM orders")(lambda g: g.gql("MATCH (o:order) CREATE (b:bill {k: o.o_orderkey})")[0].gql("MATCH (b:bill) RETURN count(*) AS n, count(DISTINCT id(b)) AS ids, sum(b.k) AS total"))
query("match_create_edges", "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 200000")(lambda g: g.gql("MATCH (c:customer)-[:placed]->(o:order) WHERE o.o_totalprice > 200000 CREATE (o)-[:big_for]->(c)")[0].gql("MATCH (o:order)-[:big_for]->(c:customer) RETURN count(*) AS n"))


def refused(f) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@query("schema_statements", "SELECT true AS closed, true AS wrong_type, true AS missing, 'none' AS preset, true AS dropped")
def _schema(g):
    own = places(g).ddl("CREATE NODE TYPE town (name STRING NOT NULL, size INT, note STRING DEFAULT 'none')").ddl("ALTER NODE TYPE town ADD mayor STRING").ddl("CREATE EDGE TYPE lies_in (since INT) FROM town TO nation")
    own = own.ddl("CREATE NODE TYPE nation (n_nationkey INT, n_name STRING, n_regionkey INT)").ddl("CREATE NODE TYPE region (r_regionkey INT, r_name STRING)").ddl("CREATE EDGE TYPE in_region FROM nation TO region").ddl("SET SCHEMA VALIDATION CLOSED")
    made, _ = own.gql("CREATE (t:town {name: 'a', size: 3})")
    facts = (refused(lambda: own.gql("CREATE (t:village {name: 'b'})")), refused(lambda: own.gql("CREATE (t:town {name: 'b', size: 'big'})")), refused(lambda: own.gql("CREATE (t:town {size: 4})")), made.gql("MATCH (t:town) RETURN t.note AS note").first().note, "town" not in own.ddl("DROP NODE TYPE town").schema.nodes)
    return rows(g, [facts], "closed boolean, wrong_type boolean, missing boolean, preset string, dropped boolean")


@query("index_statements", "SELECT n_name AS name, true AS unique_kept, true AS refused FROM nation WHERE n_nationkey = 7")
def _indexes(g):
    own = g.ddl("CREATE INDEX by_region ON :nation(n_regionkey)").ddl("CREATE UNIQUE INDEX one_key ON :nation(n_nationkey)").ddl("DROP INDEX by_region")
    no = refused(lambda: g.ddl("CREATE UNIQUE INDEX no_key ON :nation(n_regionkey)"))
    found = own.traversal().v_by_property("nation", "n_nationkey", 7).df("n_name")
    return found.select(F.col("n_name").alias("name"), F.lit("one_key" in own.indexes and "by_region" not in own.indexes).alias("unique_kept"), F.lit(no).alias("refused"))


@query("store_sorted_by_index", "SELECT c_custkey AS value FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 1000")
def _sorted(g):
    """A stored graph whose customers are sorted by an indexed property."""
    path = scratch(g, "sorted")
    store.save(part_of(g, ("customer",), ()).ddl("CREATE INDEX by_balance ON :customer(c_acctbal)"), path)
    return store.load(g.spark, path).traversal().v_by_property_range("customer", "c_acctbal", 0.0, 1000.0, False, True).values("c_custkey").df()


@query("store_sorted_by_place", f"SELECT c_custkey FROM ({_PLACE}) WHERE lon BETWEEN -10 AND 40 AND lat BETWEEN 30 AND 60")
def _placed(g):
    """A stored graph whose customers are sorted along a curve over their indexed places."""
    path = scratch(g, "placed")
    store.save(part_of(with_places(g), ("customer",), ()).ddl("CREATE RTREE INDEX by_place ON :customer(place)"), path)
    return store.load(g.spark, path).traversal().V().hasLabel("customer").has("place", P.geo_bbox(-10, 30, 40, 60)).df("c_custkey")


@query("unique_index_holds", "SELECT true AS refused, count(*) AS n FROM nation")
def _unique(g):
    own = places(g).ddl("CREATE UNIQUE INDEX one_key ON :nation(n_nationkey)")
    no = refused(lambda: own.gql("CREATE (n:nation {n_nationkey: 7})"))
    return own.gql("MATCH (n:nation) RETURN count(*) AS n").select(F.lit(no).alias("refused"), "n")


# -- algorithms --------------------------------------------------------------------------------
_FAR = f"SELECT min(depth) AS n FROM ({_REACH}) WHERE vertex = 1000000000000 + (SELECT n_regionkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_partkey = 1 ORDER BY n_regionkey LIMIT 1)"


def goal(g):
    """The first region that part 1 leads to."""
    return algorithms.bfs(g, PA + 1, 3, WAYS).filter(F.col("vertex").between(R, R + STRIDE - 1)).agg(F.min("vertex")).first()[0]


traversal("sp_step", _FAR, lambda g: g.V(PA + 1).shortestPath(goal(g.graph)).with_("edgeLabels", list(WAYS)).count_local().map(lambda n: n - 1), "n")
traversal("iddfs_step", _FAR, lambda g: g.V(PA + 1).iddfs(goal(g.graph), 4).with_("edgeLabels", list(WAYS)).count_local().map(lambda n: n - 1), "n")
traversal("bidirectional_step", _FAR, lambda g: g.V(PA + 1).bidirectionalBfs(goal(g.graph)).with_("edgeLabels", list(WAYS)).count_local().map(lambda n: n - 1), "n")
query("iddfs_library", _FAR)(lambda g: rows(g, [(len(algorithms.iddfs(g, PA + 1, goal(g), 4, WAYS)) - 1,)], "n long"))
query("bidirectional_library", _FAR)(lambda g: rows(g, [(len(algorithms.bidirectional_paths(g, PA + 1, goal(g), WAYS)) - 1,)], "n long"))
_LEVELS = f"SELECT vertex, depth FROM ({_REACH}) WHERE depth <= 3"
query("bfs_step", _LEVELS)(lambda g: g.traversal().V(PA + 1).bfs().with_("edgeLabels", list(WAYS)).with_("maxDepth", 3).df("vertex", "depth"))
query("dfs_step", _LEVELS)(lambda g: g.traversal().V(PA + 1).dfs().with_("edgeLabels", list(WAYS)).with_("maxDepth", 3).df("vertex", "depth"))
ORACLES["algo_dfs"] = _LEVELS
_TO = "FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 1) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"
_K = f"SELECT row_number() OVER (ORDER BY v) - 1 AS n, 3.0::DOUBLE AS cost FROM (SELECT 4000000000000 + s_suppkey AS v, n_regionkey AS r {_TO}) WHERE r = (SELECT min(n_regionkey) {_TO}) ORDER BY v LIMIT 4"
query("k_shortest_library", _K)(lambda g: rows(g, [(n, float(c)) for n, (c, _) in enumerate(algorithms.k_shortest_paths(g, PA + 1, goal(g), 4, None, WAYS))], "n long, cost double"))
query("k_shortest_step", _K)(lambda g: g.traversal().V(PA + 1).kShortestPaths(goal(g), 4).with_("edgeLabels", list(WAYS)).index().df().select(F.col("index").alias("n"), (F.size("value") - 1).cast("double").alias("cost")))
ORACLES["algo_k_shortest"] = f"""SELECT row_number() OVER (ORDER BY v) - 1 AS n, 3.0::DOUBLE AS cost, [5000000000001, v, 2000000000000 + k, 1000000000001] AS path
FROM (SELECT 4000000000000 + s_suppkey AS v, n_nationkey AS k {_TO} WHERE n_regionkey = 1) ORDER BY v LIMIT 4"""
_BUY = "SELECT 5000000000000 + l_partkey AS v, min(o_totalprice + l_extendedprice) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY 1"


def weighted(g):
    own = with_weights(g)
    return part_of(own, ("customer", "order", "part"), ("placed", "contains"))


def bought(g):
    return algorithms.bfs(g, C + 7, 2, ("placed", "contains")).filter(F.col("vertex") >= PA).filter(F.col("vertex") < PA + STRIDE).agg(F.max("vertex")).first()[0]


query("dijkstra_step", f"SELECT d AS weight FROM ({_BUY}) ORDER BY v DESC LIMIT 1")(lambda g: (lambda own: own.traversal().V(C + 7).shortestPath(bought(own)).by("w").df("weight"))(weighted(g)))
query("astar_library", f"SELECT d AS cost FROM ({_BUY}) ORDER BY v DESC LIMIT 1")(lambda g: (lambda own: rows(g, [(float(algorithms.astar(own, C + 7, bought(own), "w", "o_totalprice")[0]),)], "cost double"))(weighted(g)))

query("astar_step", f"SELECT d AS weight FROM ({_BUY}) ORDER BY v DESC LIMIT 1")(lambda g: (lambda own: own.traversal().V(C + 7).shortestPath(bought(own)).by("w").with_("heuristic", "o_totalprice").df("weight"))(weighted(g)))
query("bfs_prune", f"SELECT vertex, depth FROM ({_REACH}) WHERE depth <= 2")(lambda g: algorithms.bfs(g, PA + 1, None, WAYS, prune=lambda vertex, depth: depth >= 2).select("vertex", "depth"))

# -- procedures --------------------------------------------------------------------------------


def small(g):
    """Part 1's way to its regions, so that procedures, which follow all edges, stay in it."""
    return part_of(g, ("region", "nation", "supplier", "part"), WAYS)


def call(name: str, text: str, sql: str, build=small):
    query(name, sql)(lambda g: (lambda own: own.gql(text, goal=goal(own)))(build(g)))


call("call_shortest_path", f"CALL shortestPath({PA + 1}, $goal) YIELD path, distance RETURN size(path) - 1 AS n, distance AS d", f"SELECT n, n::DOUBLE AS d FROM ({_FAR})")
call("call_bidirectional", f"CALL bidirectionalBfs({PA + 1}, $goal) YIELD path AS p RETURN size(p) - 1 AS n", _FAR)
call("call_iddfs", f"CALL iddfs({PA + 1}, $goal, 5) YIELD path RETURN size(path) - 1 AS n", _FAR)
call("call_bfs", f"CALL bfs({PA + 1}, 3) YIELD node, depth RETURN id(node) AS vertex, depth", _LEVELS)
call("call_dfs", f"CALL dfs({PA + 1}, 3) YIELD node AS v, depth AS d RETURN id(v) AS vertex, d AS depth", _LEVELS)
call("call_k_shortest", f"CALL kShortestPaths({PA + 1}, $goal, 4) YIELD distance, index RETURN index AS n, distance AS cost", _K)
for _name, _args in (("dijkstra", "'w'"), ("astar", "'w', 'o_totalprice'")):
    query(f"call_{_name}", f"SELECT d AS distance FROM ({_BUY}) ORDER BY v DESC LIMIT 1")(lambda g, name=_name, args=_args: (lambda own: own.gql(f"CALL {name}({C + 7}, $goal, {args}) YIELD distance RETURN distance", goal=bought(own)))(weighted(g)))

# -- expressions -------------------------------------------------------------------------------
gql("gql_string_tests", "MATCH (p:part) RETURN p.p_partkey AS p, p.p_name =~ '^s.*g$' AS a, p.p_name CONTAINS 'red' AS b, p.p_name STARTS WITH 'small' AS c, p.p_name ENDS WITH 'ring' AS d", "SELECT p_partkey AS p, regexp_matches(p_name, '^s.*g$') AS a, contains(p_name, 'red') AS b, starts_with(p_name, 'small') AS c, ends_with(p_name, 'ring') AS d FROM part")
gql("gql_fn_trims", "MATCH (n:nation) RETURN n.n_name AS n, ltrim('  a ') || '|' AS a, rtrim('  a ') || '|' AS b, length(n.n_name) AS c", "SELECT n_name AS n, 'a |' AS a, '  a|' AS b, strlen(n_name)::BIGINT AS c FROM nation")
gql("gql_fn_powers", "MATCH (n:nation) RETURN n.n_nationkey AS k, power(n.n_nationkey + 1, 3) AS a, round(log10(n.n_nationkey + 1) * 1000000) AS b, round(atan(n.n_nationkey) * 1000000) AS c, round(pi() * 1000000) AS d, round(e() * 1000000) AS f, round(cos(n.n_nationkey) * 1000000) AS g, round(degrees(n.n_nationkey) * 1000) AS h", "SELECT n_nationkey::BIGINT AS k, pow(n_nationkey + 1, 3)::BIGINT AS a, round(log10(n_nationkey + 1) * 1000000) AS b, round(atan(n_nationkey) * 1000000) AS c, 3141593.0::DOUBLE AS d, 2718282.0::DOUBLE AS f, round(cos(n_nationkey) * 1000000) AS g, round(degrees(n_nationkey) * 1000) AS h FROM nation")
query("gql_properties", "SELECT r_regionkey::BIGINT AS r, r_name AS name FROM region")(lambda g: g.gql("MATCH (r:region) RETURN r.r_regionkey AS r, properties(r) AS p").select("r", F.col("p.r_name").alias("name")))
gql("gql_detached_paths", "MATCH (n:nation)-[:in_region]->(r:region)<-[:in_region]-(m:nation) WHERE n.n_nationkey < m.n_nationkey RETURN n.n_name AS a, m.n_name AS b", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")


@query("gql_refusals", "SELECT true AS unknown_function, true AS unknown_procedure, true AS too_many, true AS bad_syntax")
def _refusals(g):
    own = places(g)

    def no(text):
        try:
            own.gql(text).collect()
        except GqlError:
            return True
        return False

    facts = (no("MATCH (n:nation) RETURN nonsense(n.n_name) AS x"), no("CALL nonsense(1) YIELD x RETURN x"), no("MATCH " + ", ".join(f"(a{i}:region)" for i in range(101)) + " RETURN count(*) AS n"), no("MATCH (n:nation RETURN n"))
    return rows(g, [facts], "unknown_function boolean, unknown_procedure boolean, too_many boolean, bad_syntax boolean")


# -- text search -------------------------------------------------------------------------------


def indexed(g):
    return textsearch.create_index(g, "v", "text", "document", textsearch.Analyzer("standard"))


def stored(g):
    return textsearch.store_index(indexed(g), "v", "text", scratch(g, "text-index"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND length(w) <= 255)"
_DOCS = f"SELECT doc_id, {_WORDS} AS t FROM documents"


def bm25(words: str, having: str = "true", docs: str = _DOCS, top: str = "ORDER BY sc.score DESC, doc_id LIMIT 10") -> str:
    listed = ", ".join(f"('{w}')" for w in words.split())
    return f"""WITH d AS ({docs}), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
f AS (SELECT doc_id, len(t) AS len, w, len(list_filter(t, lambda x: x = w)) AS tf FROM d, (VALUES {listed}) q(w)),
g AS (SELECT w, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1),
sc AS (SELECT doc_id, count(*) AS hits, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM f JOIN g USING (w), s WHERE tf > 0 GROUP BY 1 HAVING {having})
SELECT doc_id, round(score, 6) AS score FROM sc {top}"""


def best(g, q, k: int = 10):
    return textsearch.hits(g, "v", "text", q, k).select((F.col("id") - 8 * STRIDE).alias("doc_id"), F.round("score", 6).alias("score"))


query("text_stored_any", bm25("idiot there"))(lambda g: best(stored(g), "idiot there"))
query("text_stored_all", bm25("the idiot", "count(*) = 2"))(lambda g: best(stored(g), TextQ.match_all("the idiot")))
query("text_all", bm25("the idiot", "count(*) = 2"))(lambda g: best(indexed(g), TextQ.match_all("the idiot")))
_PHRASE = f"""WITH d AS ({_DOCS}), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
i AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT w, count(*) AS df FROM d, (VALUES ('of'), ('the')) q(w) WHERE list_contains(t, w) GROUP BY 1), s),
f AS (SELECT doc_id, len(t) AS len, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM d)
SELECT doc_id, round(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)), 6) AS score FROM f, s, i WHERE tf > 0 ORDER BY score DESC, doc_id LIMIT 10"""
query("text_phrase", _PHRASE)(lambda g: best(indexed(g), TextQ.phrase("of the")).orderBy(F.col("score").desc(), "doc_id"))
query("text_stored_phrase", _PHRASE)(lambda g: best(stored(g), TextQ.phrase("of the")))
_PREFIX = f"SELECT doc_id, 1.0::DOUBLE AS score FROM ({_DOCS}) WHERE len(list_filter(t, lambda w: starts_with(w, 'idio'))) > 0 ORDER BY doc_id LIMIT 10"
query("text_prefix", _PREFIX)(lambda g: best(indexed(g), TextQ.prefix("idio")))
query("text_stored_prefix", _PREFIX)(lambda g: best(stored(g), TextQ.prefix("idio")))
_BOOL = f"SELECT doc_id FROM ({_DOCS}) WHERE (list_contains(t, 'idiot') OR list_contains(t, 'trash')) AND list_contains(t, 'the') AND NOT list_contains(t, 'you')"
query("text_boolean", _BOOL)(lambda g: textsearch.scores(indexed(g), indexed(g).text[("v", "text")], TextQ.and_(TextQ.or_(TextQ.match("idiot"), TextQ.match("trash")), TextQ.match("the"), TextQ.not_(TextQ.match("you")))).select((F.col("id") - 8 * STRIDE).alias("doc_id")))


def matching(g, kind: str, key: str, label: str, analyzer, q):
    own = textsearch.create_index(g, kind, key, label, analyzer)
    return textsearch.scores(own, own.text[(kind, key)], q).agg(F.count("*").alias("n"))


query("text_english_stems", f"SELECT count(*) AS n FROM ({_DOCS}) WHERE list_contains(t, 'idiot') OR list_contains(t, 'idiots')")(lambda g: matching(g, "v", "text", "document", textsearch.Analyzer("standard_english"), TextQ.match("Idiots and the")))
query("text_raw", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda g: matching(g, "v", "c_mktsegment", "customer", textsearch.Analyzer("raw"), TextQ.match("BUILDING")))
query("text_ngrams", "SELECT count(*) AS n FROM part WHERE contains(lower(p_name), 'rin') AND contains(lower(p_name), 'ing')")(lambda g: matching(g, "v", "p_name", "part", textsearch.Analyzer("ngram", 3, 3), TextQ.match_all("Ring")))


@query("text_refusals", "SELECT true AS negated_alone, true AS negated_or, true AS no_index, true AS two_prefixes")
def _text_refusals(g):
    own = indexed(g)
    no = lambda q: refused(lambda: textsearch.hits(own, "v", "text", q, 3).collect())
    facts = (no(TextQ.and_(TextQ.not_(TextQ.match("a")))), no(TextQ("or", TextQ.match("a"), TextQ.not_(TextQ.match("b")))), refused(lambda: textsearch.hits(own, "v", "lang", "a", 3)), no(TextQ.prefix("a b")))
    return rows(g, [facts], "negated_alone boolean, negated_or boolean, no_index boolean, two_prefixes boolean")


@query("text_upsert_delete", bm25("idiot there", docs=f"SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN ['idiot'] ELSE {_WORDS} END AS t FROM documents WHERE doc_id % 3 <> 2"))
def _text_changes(g):
    """A third of the documents gets another text, a third goes; a merge and a reopening keep that."""
    own = stored(g)
    docs, key = g.vertices["document"], F.col("doc_id") % 3
    own = textsearch.upsert(own, "v", "text", docs.filter(key == 1).select("id", F.lit("Idiot!").alias("text")))
    own = textsearch.merge(textsearch.delete(own, "v", "text", docs.filter(key == 2).select("id")), "v", "text")
    return best(textsearch.open_index(g, "v", "text", own.text[("v", "text")].path), "idiot there")


traversal("search_text_v_step", f"SELECT 8000000000000 + doc_id AS value FROM ({bm25('idiot there')})", lambda g: type(g)(indexed(g.graph)).searchTextV("text", "idiot there", 10).id())
query("text_score_step", f"SELECT score AS value FROM ({bm25('idiot there')})")(lambda g: indexed(g).traversal().searchTextV("text", "idiot there", 10).textScore().df().select(F.round("value", 6).alias("value")))


def noted(g):
    """placed edges with a note of some words."""
    note = F.concat_ws(" ", F.lit("order"), F.expr("repeat('urgent ', cast(o_orderkey % 4 as int))"), F.expr("repeat('small ', cast(o_orderkey % 3 as int))"))
    own = g.changed(g.vertices, {**g.edges, "placed": g.edges["placed"].withColumn("o_orderkey", F.col("dst") - 6 * STRIDE).withColumn("note", note)})
    return textsearch.create_index(own, "e", "note", "placed", textsearch.Analyzer("whitespace"))


_NOTES = "SELECT o_orderkey AS doc_id, list_filter(string_split('order ' || repeat('urgent ', (o_orderkey % 4)::INT) || repeat('small ', (o_orderkey % 3)::INT), ' '), lambda w: w <> '') AS t FROM orders"
query("search_text_e_step", f"SELECT doc_id AS value FROM ({bm25('urgent small', docs=_NOTES)})")(lambda g: noted(g).traversal().searchTextE("note", "urgent small", 10).values("o_orderkey").df())
for _mode, _text, _sql in (("", "idiot there", bm25("idiot there")), ("All", "the idiot", bm25("the idiot", "count(*) = 2")), ("Phrase", "of the", _PHRASE), ("Prefix", "idio", _PREFIX)):
    query(f"call_search_{(_mode or 'any').lower()}_v", _sql)(lambda g, mode=_mode, text=_text: indexed(g).gql(f"CALL searchText{mode}V('text', '{text}', 10) YIELD elemId, score RETURN elemId - {8 * STRIDE} AS doc_id, round(score * 1000000) / 1000000.0 AS score"))
for _mode, _text, _sql in (("", "urgent small", bm25("urgent small", docs=_NOTES)), ("All", "urgent small", bm25("urgent small", "count(*) = 2", docs=_NOTES))):
    query(f"call_search_{(_mode or 'any').lower()}_e", _sql.replace("SELECT doc_id, round(score, 6) AS score FROM sc", "SELECT 4000000000000 + doc_id AS id, round(score, 6) AS score FROM sc"))(lambda g, mode=_mode, text=_text: noted(g).gql(f"CALL searchText{mode}E('note', '{text}', 10) YIELD elemId, score RETURN elemId AS id, round(score * 1000000) / 1000000.0 AS score"))
query("text_query_language", f"SELECT 8000000000000 + doc_id AS value FROM ({bm25('idiot there')})")(lambda g: indexed(g).query("g.searchTextV('text', 'idiot there', 10).id()"))

# -- change feeds ------------------------------------------------------------------------------


@query("live_query_events", "SELECT 'Added' AS event, 1::BIGINT AS n UNION ALL SELECT 'Removed', 1 UNION ALL SELECT 'Updated', 1")
def _live(g):
    """One vertex comes, one goes, one changes its name."""
    changes = rows(g, [(1, "vertex_added", 9 * STRIDE, "nation", None, None, None, None), (2, "vertex_removed", N + 3, None, None, None, None, None), (3, "vertex_property", N + 4, None, None, None, "n_name", "new")], CHANGE_SCHEMA)
    out = []
    subscribe(places(g).traversal().V().hasLabel("nation"), changes, lambda events, epoch: out.append(events))
    return out[0].groupBy("event").agg(F.count("*").alias("n"))


@query("live_query_initial", "SELECT 'Added' AS event, n_name AS name FROM nation WHERE n_regionkey = 1")
def _initial(g):
    """The events before any change are the query's result."""
    out = []
    sub = subscribe(places(g).traversal().V().hasLabel("nation").has("n_regionkey", 1), rows(g, [], CHANGE_SCHEMA), lambda events, epoch: out.append(events), include_initial=True)
    sub.cancel()
    return out[0].select("event", F.get_json_object("after", "$.n_name").alias("name"))


@query("live_query_passes_over", "SELECT 1::BIGINT AS skipped, 1::BIGINT AS told, count(*) AS n FROM region")
def _passes(g):
    """A batch that can't concern the query isn't evaluated, but is applied."""
    told = []
    sub = subscribe(places(g).traversal().V().hasLabel("nation"), rows(g, [], CHANGE_SCHEMA), lambda events, epoch: told.append(events))
    sub.on_batch(rows(g, [(1, "vertex_added", 9 * STRIDE, "region", None, None, None, None), (2, "edge_added", 9 * STRIDE, "in_region", N + 1, 9 * STRIDE, None, None)], CHANGE_SCHEMA), 0)
    sub.on_batch(rows(g, [(3, "vertex_removed", 9 * STRIDE, None, None, None, None, None), (4, "vertex_property", N + 1, None, None, None, "n_name", "x")], CHANGE_SCHEMA), 1)
    n = sub.graph.traversal().V().hasLabel("region").count().next()
    return rows(g, [(sub.skipped, len(told), n)], "skipped long, told long, n long")


@query("change_order", "SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (3, 5) UNION ALL SELECT 'back'")
def _order(g):
    """Removed, added again and named stays; added and removed doesn't; the later of two names counts."""
    known = {"label": "nation"}
    ops = [("vertex_removed", N + 3, None, None), ("vertex_added", N + 3, None, None), ("vertex_property", N + 3, "n_name", "first"), ("vertex_property", N + 3, "n_name", "back"), ("vertex_added", 9 * STRIDE, None, None), ("vertex_property", 9 * STRIDE, "n_name", "gone"), ("vertex_removed", 9 * STRIDE, None, None), ("vertex_property", N + 5, "n_name", "late"), ("vertex_removed", N + 5, None, None)]
    batch = rows(g, [(i, op, at, known["label"], None, None, key, value) for i, (op, at, key, value) in enumerate(ops)], CHANGE_SCHEMA)
    return apply_changes(places(g), batch).traversal().V().hasLabel("nation").df("n_name").withColumnRenamed("n_name", "name")

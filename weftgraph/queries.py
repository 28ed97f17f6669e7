"""The registered graph queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import geo
from weftgraph.operators import algorithms, mutation, textsearch
from weftgraph.plans.traversal import P, TextP, __
from weftgraph.sources.tables import STRIDE, graph_of
from weftgraph.streaming.subscribe import difference, windowed_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the graph that gives a DataFrame."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(graph_of(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def gql(name: str, text: str, sql: str, **params):
    query(name, sql)(lambda graph: graph.gql(text, **params))


def traversal(name: str, sql: str | None, build, *columns: str):
    query(name, sql)(lambda graph: build(graph.traversal()).df(*columns))


N, C, PA, O, S, R = (code * STRIDE for code in (2, 3, 5, 6, 4, 1))

# -- sources and filters -----------------------------------------------------------------------
query("v_count_by_label", "SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'document', count(*) FROM documents UNION ALL SELECT 'user', count(DISTINCT user_id) FROM events")(
    lambda g: g.traversal().V().groupCount().by("T.label").df().select(F.col("key").alias("label"), F.col("value").alias("n"))
)
traversal("v_count", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents) + (SELECT count(DISTINCT user_id) FROM events) AS n", lambda g: g.V().count(), "n")
traversal("e_count", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS n", lambda g: g.E().count(), "n")
traversal("v_by_ids", "SELECT n_name AS value FROM nation WHERE n_nationkey IN (1, 3, 5)", lambda g: g.V(N + 1, N + 3, N + 5, N + 999).values("n_name"))
traversal("has_label_values", "SELECT n_name AS value FROM nation", lambda g: g.V().hasLabel("nation").values("n_name"))
traversal("has_pred_between", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 1000", lambda g: g.V().hasLabel("customer").has("c_acctbal", P.between(0.0, 1000.0)), "c_custkey", "c_acctbal")
traversal("has_inside_outside", "SELECT c_custkey FROM customer WHERE (c_acctbal > 100 AND c_acctbal < 500) OR c_acctbal < -500 OR c_acctbal > 9000", lambda g: g.V().hasLabel("customer").has("c_acctbal", P.inside(100.0, 500.0).or_(P.outside(-500.0, 9000.0))), "c_custkey")
traversal("has_within", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", lambda g: g.V().hasLabel("customer").has("c_mktsegment", P.within("BUILDING", "MACHINERY")), "c_custkey")
traversal("has_without", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", lambda g: g.V().hasLabel("customer").has("c_mktsegment", P.without("BUILDING", "MACHINERY")), "c_custkey")
traversal("has_label_key_value", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey = 7", lambda g: g.V().has("nation", "n_nationkey", 7), "n_nationkey")
traversal("has_strict_type", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE false", lambda g: g.V().has("n_nationkey", 7.0), "n_nationkey")
traversal("has_neq_not", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey <> 3 AND NOT n_nationkey > 20", lambda g: g.V().hasLabel("nation").has("n_nationkey", P.neq(3).and_(P.gt(20).negate())), "n_nationkey")
traversal("has_key", "SELECT c_custkey AS id FROM customer WHERE false UNION ALL SELECT 3000000000000 + c_custkey FROM customer", lambda g: g.V().has("c_mktsegment"), "id")
traversal("has_not_key", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents) + (SELECT count(DISTINCT user_id) FROM events) AS n", lambda g: g.V().hasNot("c_mktsegment").count(), "n")
traversal("has_id", "SELECT r_name AS value FROM region WHERE r_regionkey IN (0, 2)", lambda g: g.V().hasId(R, R + 2).values("r_name"))
traversal("textp_starting", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'small')", lambda g: g.V().hasLabel("part").has("p_name", TextP.startingWith("small")), "p_partkey")
traversal("textp_containing", "SELECT p_partkey FROM part WHERE contains(p_type, 'A') AND NOT contains(p_name, '7') AND NOT ends_with(p_name, '3')", lambda g: g.V().hasLabel("part").has("p_type", TextP.containing("A")).has("p_name", TextP.notContaining("7")).has("p_name", TextP.notEndingWith("3")), "p_partkey")
traversal("textp_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'ed .*g$')", lambda g: g.V().hasLabel("part").has("p_name", TextP.regex("ed .*g$")), "p_partkey")
traversal("is_predicate", "SELECT c_acctbal AS value FROM customer WHERE c_acctbal > 9500", lambda g: g.V().hasLabel("customer").values("c_acctbal").is_(P.gt(9500)))

# -- navigation --------------------------------------------------------------------------------
traversal("out_hop", "SELECT n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda g: g.V().hasLabel("customer").out("in_nation").values("n_name"))
traversal("in_hop", "SELECT c_name AS value FROM customer WHERE c_nationkey = 4 UNION ALL SELECT s_name FROM supplier WHERE s_nationkey = 4", lambda g: g.V(N + 4).in_("in_nation").values("c_name", "s_name").is_(P.neq("")))
traversal("both_hop", "SELECT 'region' AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier", lambda g: g.V().hasLabel("nation").both().groupCount().by("T.label").project("label", "n").by("key").by("value"))
traversal("out_e_in_v", "SELECT p_partkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49", lambda g: g.V().hasLabel("order").outE("contains").has("l_quantity", P.gt(49)).as_("e").inV().as_("p").select("e", "p").by("l_quantity").by("p_partkey").project("l_quantity", "p_partkey").by("e").by("p"))
traversal("in_e_out_v", "SELECT o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 10", lambda g: g.V(PA + 10).inE("contains").outV(), "o_orderkey")
traversal("other_v", "SELECT c_custkey AS value FROM orders JOIN customer ON o_custkey = c_custkey", lambda g: g.V().hasLabel("order").bothE("placed").otherV().values("c_custkey"))
traversal("both_v", "SELECT n_nationkey + 2000000000000 AS value FROM nation UNION ALL SELECT n_regionkey + 1000000000000 FROM nation", lambda g: g.E().hasLabel("in_region").bothV().id())
traversal("two_hop_dedup_count", "SELECT count(DISTINCT n_regionkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda g: g.V().hasLabel("customer").out("in_nation").out("in_region").dedup().count(), "n")
traversal("three_hop_count", "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) s ON s.l_partkey = lineitem.l_partkey", lambda g: g.V().hasLabel("customer").out("placed").out("contains").out("supplied_by").count(), "n")
traversal("customers_per_region", "SELECT r_name AS key, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", lambda g: g.V().hasLabel("customer").out("in_nation").out("in_region").groupCount().by("r_name"))

# -- nested traversals -------------------------------------------------------------------------
traversal("where_sub", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", lambda g: g.V().hasLabel("customer").where(__.out("placed").has("o_totalprice", P.gt(400000))), "c_custkey")
traversal("not_sub", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", lambda g: g.V().hasLabel("customer").not_(__.out("placed").has("o_totalprice", P.gt(400000))), "c_custkey")
traversal("and_or_sub", "SELECT c_custkey FROM customer WHERE (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) OR c_acctbal < -900) AND c_mktsegment <> 'BUILDING'", lambda g: g.V().hasLabel("customer").and_(__.or_(__.out("placed").has("o_totalprice", P.gt(450000)), __.has("c_acctbal", P.lt(-900))), __.has("c_mktsegment", P.neq("BUILDING"))), "c_custkey")
traversal("where_neq_label", "SELECT coalesce(sum(k * (k - 1)), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)", lambda g: g.V().hasLabel("order").as_("a").in_("placed").out("placed").where_neq("a").count(), "n")
traversal("where_eq_label", "SELECT count(*) AS n FROM orders", lambda g: g.V().hasLabel("order").as_("a").in_("placed").out("placed").where_eq("a").count(), "n")
traversal("dedup_by_key", "SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1", lambda g: g.V().hasLabel("customer").order().by("c_custkey").dedup("c_mktsegment"), "c_mktsegment", "c_custkey")
traversal("dedup_by_sub", "SELECT c_nationkey::BIGINT AS c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1", lambda g: g.V().hasLabel("customer").order().by("c_custkey").dedup().by(__.out("in_nation").id()), "c_nationkey", "c_custkey")
traversal("order_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", lambda g: g.V().hasLabel("customer").order().by("c_acctbal", "desc").by("c_custkey").limit(10), "c_custkey", "c_acctbal")
traversal("order_skip", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation ORDER BY n_name OFFSET 20", lambda g: g.V().hasLabel("nation").order().by("n_name").skip(20), "n_nationkey")
traversal("order_range", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation ORDER BY n_name LIMIT 5 OFFSET 5", lambda g: g.V().hasLabel("nation").order().by("n_name").range(5, 10), "n_nationkey")
traversal("order_tail", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation ORDER BY n_name DESC LIMIT 4", lambda g: g.V().hasLabel("nation").order().by("n_name").tail(4), "n_nationkey")
traversal("order_by_sub", "SELECT n_nationkey::BIGINT AS n_nationkey FROM (SELECT n_nationkey, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY k DESC, n_nationkey LIMIT 5", lambda g: g.V().hasLabel("nation").order().by(__.in_("in_nation").hasLabel("customer").count(), "desc").by("n_nationkey").limit(5), "n_nationkey")
query("index_step", "SELECT n_name AS value, row_number() OVER (ORDER BY n_name) - 1 AS index FROM nation")(lambda g: g.traversal().V().hasLabel("nation").order().by("n_name").values("n_name").index().df())

# -- transforms --------------------------------------------------------------------------------
query("value_map", "SELECT [n_nationkey::BIGINT] AS n_nationkey, [n_name] AS n_name FROM nation")(lambda g: g.traversal().V().hasLabel("nation").valueMap("n_nationkey", "n_name").df())
traversal("element_map", "SELECT 1000000000000 + r_regionkey AS id, 'region' AS label, r_name FROM region", lambda g: g.V().hasLabel("region").elementMap("r_name"), "id", "label", "r_name")
query("properties_step", "SELECT 'r_name' AS key, r_name AS value FROM region UNION ALL SELECT 'r_regionkey', r_regionkey::VARCHAR FROM region")(lambda g: g.traversal().V().hasLabel("region").properties().df().select("key", F.coalesce(F.col("value.s"), F.col("value.i").cast("string")).alias("value")))
traversal("project_by", "SELECT c_name AS name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", lambda g: g.V().hasLabel("customer").project("name", "n_orders").by("c_name").by(__.out("placed").count()))
query("math_step", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem WHERE l_quantity > 45")(lambda g: g.traversal().E().hasLabel("contains").has("l_quantity", P.gt(45)).as_("a").as_("b").math("a * (1 - b)").by("a", "l_extendedprice").by("b", "l_discount").sum().df("total").select(F.round("total", 2).alias("total")))
traversal("path_select_as", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey", lambda g: g.V().hasLabel("nation").as_("a").out("in_region").as_("b").select("a", "b").by("n_name").by("r_name"))
query("path_step", "SELECT 2000000000000 + n_nationkey AS a, 1000000000000 + n_regionkey AS b FROM nation")(lambda g: g.traversal().V().hasLabel("nation").out("in_region").path().df("p").select(F.col("p")[0]["id"].alias("a"), F.col("p")[1]["id"].alias("b")))
traversal("constant_identity", "SELECT 'x' AS value FROM region", lambda g: g.V().hasLabel("region").identity().constant("x"))
traversal("label_id_steps", "SELECT 'nation' AS value, count(*) AS n FROM nation", lambda g: g.V().hasLabel("nation").label().groupCount().project("value", "n").by("key").by("value"))
traversal("map_closure", "SELECT (n_nationkey * 2 + 1)::BIGINT AS value FROM nation", lambda g: g.V().hasLabel("nation").values("n_nationkey").map(lambda c: c * 2 + 1))
traversal("flat_map_closure", "SELECT unnest([n_nationkey, -n_nationkey])::BIGINT AS value FROM nation", lambda g: g.V().hasLabel("nation").values("n_nationkey").flatMap(lambda c: F.array(c, -c)))
traversal("filter_closure", "SELECT n_nationkey::BIGINT AS value FROM nation WHERE n_nationkey % 3 = 0", lambda g: g.V().hasLabel("nation").values("n_nationkey").filter(lambda c: c % 3 == 0))
traversal("unfold_fold", "SELECT n_name AS value FROM nation", lambda g: g.V().hasLabel("nation").values("n_name").fold().unfold())

# -- aggregates --------------------------------------------------------------------------------
traversal("group_count", "SELECT c_mktsegment AS key, count(*) AS value FROM customer GROUP BY 1", lambda g: g.V().hasLabel("customer").groupCount().by("c_mktsegment"))
query("group_fold_sum", "SELECT c_mktsegment AS key, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1")(lambda g: g.traversal().V().hasLabel("customer").group().by("c_mktsegment").by(__.values("c_acctbal").sum()).df().select("key", F.round("value", 2).alias("value")))
traversal("group_collect", "SELECT n_regionkey::BIGINT AS key, list(n_name ORDER BY n_nationkey) AS value FROM nation GROUP BY 1", lambda g: g.V().hasLabel("nation").group().by("n_regionkey").by("n_name"))
traversal("group_sub_count", "SELECT n_name AS key, count(c_custkey) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", lambda g: g.V().hasLabel("nation").group().by("n_name").by(__.in_("in_nation").hasLabel("customer").count()))
query("sum_step", "SELECT round(sum(c_acctbal), 2) AS total FROM customer")(lambda g: g.traversal().V().hasLabel("customer").values("c_acctbal").sum().df("total").select(F.round("total", 2).alias("total")))
query("mean_step", "SELECT round(avg(c_acctbal), 6) AS mean FROM customer")(lambda g: g.traversal().V().hasLabel("customer").values("c_acctbal").mean().df("mean").select(F.round("mean", 6).alias("mean")))
traversal("min_step", "SELECT min(c_acctbal) AS least FROM customer", lambda g: g.V().hasLabel("customer").values("c_acctbal").min(), "least")
traversal("max_step", "SELECT max(n_name) AS most FROM nation", lambda g: g.V().hasLabel("nation").values("n_name").max(), "most")
traversal("fold_step", "SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation", lambda g: g.V().hasLabel("nation").values("n_name").fold(), "names")
traversal("count_local", "SELECT count(*) AS n FROM nation", lambda g: g.V().hasLabel("nation").values("n_name").fold().count_local(), "n")
traversal("sum_local", "SELECT sum(n_nationkey)::BIGINT AS n FROM nation", lambda g: g.V().hasLabel("nation").values("n_nationkey").fold().sum_local(), "n")

# -- branches ----------------------------------------------------------------------------------
traversal("union_step", "SELECT n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_name FROM customer", lambda g: g.V().hasLabel("customer").union(__.out("in_nation").values("n_name"), __.values("c_name")))
traversal("coalesce_step", "SELECT coalesce(o_orderstatus, 'none') AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", lambda g: g.V().hasLabel("customer").coalesce(__.out("placed").has("o_totalprice", P.gt(400000)).values("o_orderstatus"), __.constant("none")))
traversal("choose_step", "SELECT CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE c_mktsegment END AS value FROM customer", lambda g: g.V().hasLabel("customer").choose(__.has("c_acctbal", P.gt(5000)), __.constant("rich"), __.values("c_mktsegment")))
traversal("optional_step", "SELECT CASE WHEN o_orderkey IS NULL THEN 3000000000000 + c_custkey ELSE 6000000000000 + o_orderkey END AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", lambda g: g.V().hasLabel("customer").optional(__.out("placed").has("o_totalprice", P.gt(400000))).id())
traversal("branch_option", "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS value FROM customer", lambda g: g.V().hasLabel("customer").branch(__.values("c_mktsegment")).option("BUILDING", __.constant("b")).option("MACHINERY", __.constant("m")).option("none", __.constant("other")))
traversal("local_limit", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2", lambda g: g.V().hasLabel("customer").local(__.out("placed").order().by("o_totalprice", "desc").by("o_orderkey").limit(2)), "o_orderkey")
traversal("repeat_times", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN supplier ON a.l_suppkey = s_suppkey", lambda g: g.V().hasLabel("part").repeat(__.out("supplied_by", "in_nation")).times(2).hasLabel("nation").count(), "n")
traversal("repeat_until", "SELECT r_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey", lambda g: g.V().hasLabel("customer").repeat(__.out("in_nation", "in_region")).until(__.hasLabel("region")).values("r_name"))
traversal("repeat_emit", "SELECT c_nationkey + 2000000000000 AS value FROM customer UNION ALL SELECT n_regionkey + 1000000000000 FROM customer JOIN nation ON c_nationkey = n_nationkey", lambda g: g.V().hasLabel("customer").repeat(__.out("in_nation", "in_region")).times(2).emit().id())
traversal("simple_path", "SELECT coalesce(sum(k * (k - 1)), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)", lambda g: g.V().hasLabel("order").in_("placed").out("placed").simplePath().count(), "n")
traversal("cyclic_path", "SELECT count(*) AS n FROM orders", lambda g: g.V().hasLabel("order").in_("placed").out("placed").cyclicPath().count(), "n")
traversal("store_cap", "SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation", lambda g: g.V().hasLabel("nation").values("n_name").aggregate("x").cap("x"), "names")
traversal("coin_all", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation", lambda g: g.V().hasLabel("nation").coin(1.0), "n_nationkey")

# -- pattern language --------------------------------------------------------------------------
gql("gql_match_where_return", "MATCH (c:customer)-[:in_nation]->(n:nation) WHERE c.c_acctbal > 9000 AND n.n_name <> 'NATION_3' RETURN c.c_custkey AS c, n.n_name AS n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 AND n_name <> 'NATION_3'")
gql("gql_edge_props", "MATCH (o:order)-[l:contains WHERE l.l_quantity > 48]->(p:part) RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_quantity > 48")
gql("gql_multi_pattern", "MATCH (c:customer)-[:placed]->(o:order), (o)-[:contains]->(p:part) RETURN c.c_custkey AS c, count(*) AS n, sum(p.p_size) AS s", "SELECT o_custkey AS c, count(*) AS n, sum(p_size)::BIGINT AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
gql("gql_cartesian", "MATCH (r:region), (n:nation) WHERE r.r_regionkey < n.n_nationkey RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation WHERE r_regionkey < n_nationkey")
gql("gql_optional", "MATCH (c:customer) OPTIONAL MATCH (c)-[p:placed WHERE p.o_totalprice > 450000]->(o:order) RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000")
gql("gql_exists", "MATCH (c:customer) WHERE EXISTS { (c)-[:placed]->(o:order) WHERE o.o_totalprice > 450000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
gql("gql_not_exists", "MATCH (c:customer) WHERE NOT EXISTS { (c)-[:placed]->(o:order) WHERE o.o_totalprice > 300000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
gql("gql_varlen", "MATCH (c:customer)-[:in_nation|in_region*1..2]->(x) RETURN c.c_custkey AS c, id(x) AS x", "SELECT c_custkey AS c, 2000000000000 + c_nationkey AS x FROM customer UNION ALL SELECT c_custkey, 1000000000000 + n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
gql("gql_with_agg", "MATCH (c:customer)-[:placed]->(o:order) WITH c, count(*) AS n, max(o.o_totalprice) AS m WHERE n >= 15 RETURN c.c_name AS c, n, m", "SELECT c_name AS c, count(*) AS n, max(o_totalprice) AS m FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) >= 15")
gql("gql_unwind", "UNWIND [1, 2, 3] AS x MATCH (n:nation) WHERE n.n_regionkey = x RETURN x, n.n_name AS n", "SELECT n_regionkey::BIGINT AS x, n_name AS n FROM nation WHERE n_regionkey IN (1, 2, 3)")
gql("gql_let_agg", "MATCH (n:nation) LET m = max(n.n_nationkey) RETURN n.n_name AS n, m - n.n_nationkey AS d", "SELECT n_name AS n, ((SELECT max(n_nationkey) FROM nation) - n_nationkey)::BIGINT AS d FROM nation")
gql("gql_call_corr", "MATCH (n:nation) CALL { WITH n MATCH (c:customer)-[:in_nation]->(n) WHERE c.c_acctbal > 5000 RETURN count(*) AS k, max(c.c_acctbal) AS m } RETURN n.n_name AS n, k, m", "SELECT n_name AS n, count(c_custkey) AS k, max(c_acctbal) AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1")
gql("gql_call_uncorr", "MATCH (r:region) CALL { MATCH (n:nation) RETURN count(*) AS k } RETURN r.r_name AS r, k", "SELECT r_name AS r, (SELECT count(*) FROM nation) AS k FROM region")
gql("gql_union", "MATCH (c:customer) RETURN c.c_nationkey AS k UNION MATCH (s:supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
gql("gql_union_all", "MATCH (c:customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
gql("gql_group_having", "MATCH (c:customer) RETURN c.c_nationkey AS k, count(*) AS n GROUP BY c.c_nationkey HAVING count(*) > 60", "SELECT c_nationkey::BIGINT AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60")
gql("gql_order_skip_limit", "MATCH (c:customer) RETURN c.c_custkey AS c ORDER BY c.c_acctbal DESC, c.c_custkey SKIP 5 LIMIT 10", "SELECT c_custkey AS c FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
gql("gql_distinct", "MATCH (o:order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
gql("gql_param", "MATCH (c:customer) WHERE c.c_mktsegment = $seg AND c.c_acctbal > $min RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100", seg="BUILDING", min=100)
gql("gql_fn_string", "MATCH (n:nation) RETURN toUpper(n.n_name) AS a, toLower(n.n_name) AS b, size(n.n_name) AS c, substring(n.n_name, 2, 3) AS d, replace(n.n_name, 'A', '-') AS e, trim('  x ') AS f, n.n_name || '!' AS g", "SELECT upper(n_name) AS a, lower(n_name) AS b, strlen(n_name)::BIGINT AS c, substr(n_name, 3, 3) AS d, replace(n_name, 'A', '-') AS e, 'x' AS f, n_name || '!' AS g FROM nation")
gql("gql_fn_numeric", "MATCH (n:nation) RETURN n.n_nationkey / 3 AS a, n.n_nationkey % 4 AS b, n.n_nationkey ^ 2 AS c, abs(n.n_nationkey - 10) AS d, sign(n.n_nationkey - 10) AS e, ceil(n.n_nationkey * 0.5) AS f, floor(n.n_nationkey * 0.5) AS g, round(n.n_nationkey * 0.5) AS h, -n.n_nationkey AS i", "SELECT n_nationkey::BIGINT // 3 AS a, n_nationkey::BIGINT % 4 AS b, (n_nationkey * n_nationkey)::BIGINT AS c, abs(n_nationkey - 10)::BIGINT AS d, sign(n_nationkey - 10)::BIGINT AS e, ceil(n_nationkey * 0.5::DOUBLE) AS f, floor(n_nationkey * 0.5::DOUBLE) AS g, round(n_nationkey * 0.5::DOUBLE) AS h, -n_nationkey::BIGINT AS i FROM nation")
gql("gql_fn_trig", "MATCH (n:nation) RETURN n.n_nationkey AS k, round(sqrt(n.n_nationkey) * 1000000) AS a, round(sin(n.n_nationkey) * 1000000) AS b, round(atan2(n.n_nationkey, 3) * 1000000) AS c, round(log(n.n_nationkey) * 1000000) AS d, round(exp(n.n_nationkey / 10.0) * 1000) AS e, round(radians(n.n_nationkey) * 1000000) AS f, asin(n.n_nationkey + 2) AS g", "SELECT n_nationkey::BIGINT AS k, round(sqrt(n_nationkey) * 1000000) AS a, round(sin(n_nationkey) * 1000000) AS b, round(atan2(n_nationkey, 3) * 1000000) AS c, CASE WHEN n_nationkey > 0 THEN round(ln(n_nationkey) * 1000000) END AS d, round(exp(n_nationkey / 10.0::DOUBLE) * 1000) AS e, round(radians(n_nationkey) * 1000000) AS f, NULL::DOUBLE AS g FROM nation")
gql("gql_fn_convert", "MATCH (n:nation) RETURN toString(n.n_nationkey) AS a, toInteger('7') + n.n_nationkey AS b, toFloat(n.n_nationkey) AS c, toBoolean('yes') AS d, toInteger(2.9) AS e, coalesce(n.missing, n.n_name) AS f", "SELECT n_nationkey::VARCHAR AS a, 7 + n_nationkey::BIGINT AS b, n_nationkey::DOUBLE AS c, true AS d, 2::BIGINT AS e, n_name AS f FROM nation")
gql("gql_fn_math", "MATCH (c:customer) RETURN c.c_custkey AS c, round(math('a * 2 + b', c.c_acctbal, c.c_custkey) * 100) AS m", "SELECT c_custkey AS c, round((c_acctbal * 2 + c_custkey) * 100) AS m FROM customer")
gql("gql_case", "MATCH (c:customer) RETURN c.c_custkey AS c, CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal < 5000 THEN 'some' ELSE 'much' END AS k", "SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS k FROM customer")
gql("gql_list_comp", "MATCH (n:nation) RETURN n.n_name AS n, [x IN [1, 2, 3, 4] WHERE x > n.n_regionkey | x * 10] AS l", "SELECT n_name AS n, [x * 10 FOR x IN [1::BIGINT, 2, 3, 4] IF x > n_regionkey] AS l FROM nation")
gql("gql_reduce", "MATCH (n:nation) RETURN n.n_name AS n, reduce(s = 0, x IN [1, 2, 3] | s + x * n.n_nationkey) AS r", "SELECT n_name AS n, 6 * n_nationkey::BIGINT AS r FROM nation")
gql("gql_list_preds", "MATCH (n:nation) RETURN n.n_name AS n, all(x IN [1, 2] WHERE x > n.n_regionkey) AS a, any(x IN [1, 2] WHERE x > n.n_regionkey) AS b, none(x IN [1, 2] WHERE x > n.n_regionkey) AS c, single(x IN [1, 2] WHERE x > n.n_regionkey) AS d", "SELECT n_name AS n, n_regionkey < 1 AS a, n_regionkey < 2 AS b, n_regionkey >= 2 AS c, n_regionkey = 1 AS d FROM nation")
gql("gql_pattern_comp", "MATCH (r:region) RETURN r.r_name AS r, [(n:nation)-[:in_region]->(r) | n.n_name] AS l", "SELECT r_name AS r, coalesce(list(n_name ORDER BY n_name) FILTER (n_name IS NOT NULL), []) AS l FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
gql("gql_slice", "UNWIND [0, 1, 2] AS i RETURN i, [10, 20, 30, 40][i] AS a, [10, 20, 30, 40][-1] AS b, [10, 20, 30, 40][i..3] AS c, [10, 20][5] AS d", "SELECT i, a, 40::BIGINT AS b, c, NULL::BIGINT AS d FROM (VALUES (0::BIGINT, 10::BIGINT, [10::BIGINT, 20, 30]), (1, 20, [20, 30]), (2, 30, [30])) t(i, a, c)")
gql("gql_collect", "MATCH (n:nation) RETURN n.n_regionkey AS r, collect(n.n_name) AS l, count(DISTINCT n.n_name) AS d", "SELECT n_regionkey::BIGINT AS r, list(n_name ORDER BY n_name) AS l, count(DISTINCT n_name) AS d FROM nation GROUP BY 1")
gql("gql_labels_type_id", "MATCH (n:nation)-[e]->(r:region) RETURN id(n) AS i, type(e) AS t, labels(r) AS l", "SELECT 2000000000000 + n_nationkey AS i, 'in_region' AS t, ['region'] AS l FROM nation")
gql("gql_path", "WITH PATH AS p MATCH (n:nation)-[:in_region]->(r) RETURN path() AS p", "SELECT [2000000000000 + n_nationkey, 1000000000000 + n_regionkey] AS p FROM nation")
gql("gql_in_null", "MATCH (n:nation) WHERE n.n_nationkey IN [1, 5, 9] AND n.missing IS NULL AND NOT n.n_name IS NULL RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (1, 5, 9)")
query("traversal_text", "SELECT n_name AS value FROM nation WHERE n_regionkey = 1")(lambda g: g.query("g.V().hasLabel('nation').has('n_regionkey', P.eq(1)).values('n_name')"))

# -- algorithms --------------------------------------------------------------------------------
_REACH = """WITH RECURSIVE e AS (SELECT 2000000000000 + n_nationkey AS a, 1000000000000 + n_regionkey AS b FROM nation UNION ALL SELECT 3000000000000 + c_custkey, 2000000000000 + c_nationkey FROM customer UNION ALL SELECT 4000000000000 + s_suppkey, 2000000000000 + s_nationkey FROM supplier UNION ALL SELECT 5000000000000 + l_partkey, 4000000000000 + l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)),
r(v, d) AS (SELECT 5000000000000 + 1, 0 UNION SELECT b, d + 1 FROM r JOIN e ON a = v WHERE d < 5) SELECT v AS vertex, min(d)::BIGINT AS depth FROM r GROUP BY 1"""
query("algo_bfs_depth", _REACH)(lambda g: algorithms.bfs(g, PA + 1, 5, ("in_region", "in_nation", "supplied_by")).select("vertex", "depth"))
query("algo_shortest_len", f"SELECT depth::DOUBLE AS distance FROM ({_REACH}) WHERE vertex = (SELECT min(vertex) FROM ({_REACH}) WHERE vertex < 2000000000000)")(
    lambda g: algorithms.shortest_paths(g, PA + 1, algorithms.bfs(g, PA + 1, 5, ("in_region", "in_nation", "supplied_by")).agg(F.min("vertex")).first()[0], ("in_region", "in_nation", "supplied_by")).select("distance")
)
query("algo_dijkstra_cost", "SELECT 5000000000000 + l_partkey AS vertex, min(o_totalprice + l_extendedprice) AS distance FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY 1")(
    lambda g: algorithms.dijkstra_all(with_weights(g), C + 7, "w", ("placed", "contains")).filter(F.col("vertex").between(PA, PA + STRIDE - 1)).select("vertex", "distance")
)
query("algo_k_shortest")(lambda g: g.spark.createDataFrame([(n, float(c), p) for n, (c, p) in enumerate(algorithms.k_shortest_paths(g, PA + 1, R + 1, 4, None, ("in_region", "in_nation", "supplied_by")))], "n long, cost double, path array<long>"))
query("algo_dfs")(lambda g: g.spark.createDataFrame(algorithms.dfs(g, PA + 1, 3, ("in_region", "in_nation", "supplied_by")), "vertex long, depth long"))


def with_weights(g):
    """placed and contains with one weight property."""
    edges = dict(g.edges)
    edges["placed"] = edges["placed"].withColumn("w", F.col("o_totalprice"))
    edges["contains"] = edges["contains"].withColumn("w", F.col("l_extendedprice"))
    return g.changed(g.vertices, edges)


# -- text and geometry -------------------------------------------------------------------------
query(
    "text_bm25_topk",
    """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND length(w) <= 255) AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
f AS (SELECT doc_id, len(t) AS len, w, len(list_filter(t, lambda x: x = w)) AS tf FROM d, (VALUES ('idiot'), ('there')) q(w)),
g AS (SELECT w, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1),
sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM f JOIN g USING (w), s WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT 10""",
)(lambda g: textsearch.hits(textsearch.create_index(g, "v", "text", "document", textsearch.Analyzer("standard")), "v", "text", "idiot there", 10).select((F.col("id") - 8 * STRIDE).alias("doc_id"), F.round("score", 6).alias("score")))


def with_places(g):
    """Customers with a place made from their key."""
    vertices = dict(g.vertices)
    k = F.col("c_custkey").cast("double")
    vertices["customer"] = vertices["customer"].withColumn("place", F.struct((F.pmod(k * 7.3, F.lit(360.0)) - 180).alias("lon"), (F.pmod(k * 3.1, F.lit(180.0)) - 90).alias("lat")))
    return g.changed(vertices, g.edges)


_PLACE = "SELECT c_custkey, (c_custkey::DOUBLE * 7.3::DOUBLE) % 360 - 180 AS lon, (c_custkey::DOUBLE * 3.1::DOUBLE) % 180 - 90 AS lat FROM customer"
query("geo_within_distance", f"SELECT c_custkey FROM ({_PLACE}) WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(48.0)) / 2), 2) + cos(radians(48.0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(11.0)) / 2), 2)))) <= 3000000")(lambda g: with_places(g).traversal().V().hasLabel("customer").has("place", P.geo_within_distance(geo.Point(11.0, 48.0), geo.distance_metres(3000, "km"))).df("c_custkey"))
query("geo_bbox", f"SELECT c_custkey FROM ({_PLACE}) WHERE lon BETWEEN -10 AND 40 AND lat BETWEEN 30 AND 60")(lambda g: with_places(g).traversal().V().hasLabel("customer").has("place", P.geo_bbox(-10, 30, 40, 60)).df("c_custkey"))
query("geo_polygon", f"SELECT c_custkey FROM ({_PLACE}) WHERE lat > 0 AND lat < 60 AND lon > 0 AND lon < 60 AND lon + lat < 60")(lambda g: with_places(g).traversal().V().hasLabel("customer").has("place", P.geo_contained_by(geo.Polygon([(0, 0), (60, 0), (0, 60)]))).df("c_custkey"))
query("gql_geo", f"SELECT c_custkey AS c, round(2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(48.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin((radians(11.0) - radians(lon)) / 2), 2)))) / 1000) AS km FROM ({_PLACE})")(lambda g: with_places(g).gql("MATCH (c:customer) RETURN c.c_custkey AS c, round(point.distance(c.place, point(11.0, 48.0)) / 1000) AS km"))

# -- changes -----------------------------------------------------------------------------------
query("mutate_set_delete", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 2")(
    lambda g: g.gql("MATCH (n:nation) WHERE n.n_regionkey = 1 SET n.n_name = n.n_name || '!'")[0].gql("MATCH (n:nation) WHERE n.n_regionkey = 2 DETACH DELETE n")[0].gql("MATCH (n:nation) RETURN n.n_nationkey AS k, n.n_name AS name")
)
query("merge_upsert", "SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'matched' END AS note FROM nation UNION ALL SELECT 'nowhere', 'created'")(
    lambda g: g.gql("MERGE (n:nation {n_name: 'nowhere'}) ON CREATE SET n.note = 'created' ON MATCH SET n.note = 'matched'")[0].gql("MERGE (n:nation {n_nationkey: 3}) ON CREATE SET n.note = 'created' ON MATCH SET n.note = 'matched'")[0].gql("MATCH (n:nation) RETURN n.n_name AS name, n.note AS note")
)
query("create_edge", "SELECT r_name AS a, n_name AS b FROM region JOIN nation ON n_regionkey = r_regionkey")(
    lambda g: g.gql("MATCH (n:nation)-[:in_region]->(r:region) CREATE (r)-[:holds]->(n)")[0].gql("MATCH (r:region)-[:holds]->(n:nation) RETURN r.r_name AS a, n.n_name AS b")
)
query("traversal_drop", "SELECT count(*) AS n FROM customer WHERE c_acctbal >= 0")(lambda g: mutation.apply_traversal(g.traversal().V().hasLabel("customer").has("c_acctbal", P.lt(0)).drop())[0].traversal().V().hasLabel("customer").count().df("n"))


def _events_diff(spark, sf_dir):
    """The users' last value as a live result: what changed between the first half of the events and all."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = events.agg(F.max("event_id")).first()[0] // 2
    state = lambda df: df.groupBy("user_id").agg(F.max_by("value", "event_id").alias("v")).select(F.col("user_id").alias("id"), F.col("v").cast("string").alias("row"))
    return difference(state(events.filter(F.col("event_id") <= half)), state(events)).groupBy("event").agg(F.count("*").alias("n"))


QUERIES["events_subscription_diff"] = _events_diff
ORACLES["events_subscription_diff"] = """WITH h AS (SELECT max(event_id) // 2 AS half FROM events), a AS (SELECT user_id, arg_max(value, event_id) AS v FROM events, h WHERE event_id <= half GROUP BY 1), b AS (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1)
SELECT CASE WHEN a.user_id IS NULL THEN 'Added' WHEN b.user_id IS NULL THEN 'Removed' ELSE 'Updated' END AS event, count(*) AS n FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.v <> b.v GROUP BY 1"""
QUERIES["events_windowed"] = lambda spark, sf_dir: windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 day").select("event_type", "n", F.round("total", 4).alias("total"), F.date_format("start", "yyyy-MM-dd").alias("day"))
ORACLES["events_windowed"] = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events GROUP BY 1, 4"

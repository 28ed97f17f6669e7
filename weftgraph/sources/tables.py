"""The driver's tables as a property graph; nothing is copied, every label is a projection of a scan."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.model import PropertyGraph

#: Vertex ids are label code * STRIDE + natural key.
STRIDE = 10**12
#: Where the ids of line items begin; each order has room for 2^20 of them.
LINES = 1 << 62
CODES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "user": 7, "document": 8}

ENDS = {e: (frozenset(a.split()), frozenset(b.split())) for e, a, b in (("in_region", "nation", "region"), ("in_nation", "customer supplier", "nation"), ("placed", "customer", "order"), ("contains", "order", "part"), ("supplied_by", "part", "supplier"))}
#: Room for supplier keys beside a part's key: pairs are numbered below line items while part keys are under 2^30.
SUPPLIERS = 1 << 31


def vid(label: str, key):
    return F.lit(CODES[label] * STRIDE) + F.col(key).cast("long")


def _vertices(df: DataFrame, label: str, key: str) -> DataFrame:
    return df.select(vid(label, key).alias("id"), *(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _line_id(line: DataFrame):
    """Ids of line items, above all other edges' ids: the order's key and a row number over all columns within the order.

    Exactly repeated line items get numbers of their own; queries that don't read the id don't sort.
    """
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*line.columns))
    return F.lit(LINES) + F.coalesce(F.col("l_orderkey").cast("long"), F.lit(-1)) * (1 << 20) + number


@lru_cache(maxsize=4)
def _graph(application: str, sf_dir: str) -> PropertyGraph:
    return _build(SparkSession.active(), sf_dir)


def graph_of(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Vertices and edges over region, nation, customer, supplier, part, orders, lineitem, events and documents.

    Plans alone are kept for a session and folder, so that footers are read once; data are read by every query.
    """
    return _graph(spark.sparkContext.applicationId, sf_dir)


def _build(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")}
    vertices = {label: _vertices(t[name], label, key) for label, name, key in (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey"), ("order", "orders", "o_orderkey"), ("document", "documents", "doc_id"))}
    vertices["user"] = _vertices(t["events"].select("user_id").distinct(), "user", "user_id")
    line = t["lineitem"]
    edge = lambda n, key, src, dst, *cols: (lambda df: df.select((F.lit(n * STRIDE) + key).alias("id"), src.alias("src"), dst.alias("dst"), *cols))
    natural = lambda c: F.col(c).cast("long")
    edges = {
        "in_region": edge(1, natural("n_nationkey"), vid("nation", "n_nationkey"), vid("region", "n_regionkey"))(t["nation"]),
        "in_nation": edge(2, natural("c_custkey"), vid("customer", "c_custkey"), vid("nation", "c_nationkey"))(t["customer"]).union(edge(3, natural("s_suppkey"), vid("supplier", "s_suppkey"), vid("nation", "s_nationkey"))(t["supplier"])),
        "placed": edge(4, natural("o_orderkey"), vid("customer", "o_custkey"), vid("order", "o_orderkey"), "o_orderdate", "o_totalprice")(t["orders"]),
        "contains": edge(0, _line_id(line), vid("order", "l_orderkey"), vid("part", "l_partkey"), *(F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in line.dtypes))(line),
    }
    pairs = line.select("l_partkey", "l_suppkey").distinct()
    edges["supplied_by"] = edge(6, F.col("l_partkey") * SUPPLIERS + F.col("l_suppkey"), vid("part", "l_partkey"), vid("supplier", "l_suppkey"))(pairs)
    return PropertyGraph(spark, vertices, edges, ends=ENDS, owners=(STRIDE, {code: label for label, code in CODES.items()}))

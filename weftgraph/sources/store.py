"""Durable graphs: one Parquet directory for each version, a manifest written last.

A version is visible once its manifest is; readers take the highest. Edges are stored twice if asked:
as they are, and dealt and sorted by their target, so that incoming hops prune files. Vertices with an
indexed property are dealt by ranges of it and sorted, those with an indexed point along a curve over
its cells; filters then read the files and row groups whose ranges they meet.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.model import PropertyGraph


def save(graph: PropertyGraph, path: str, by_target: bool = False) -> int:
    """Write the graph as the next version; its number."""
    spark = graph.spark
    number = max(versions(spark, path), default=-1) + 1
    base = f"{path}/v{number}"
    for label, df in graph.vertices.items():
        laid_out(df, label, graph.indexes).write.parquet(f"{base}/vertices/{label}")
    for label, df in graph.edges.items():
        df.write.parquet(f"{base}/edges/{label}")
        if by_target:
            df.repartitionByRange("dst").sortWithinPartitions("dst").write.parquet(f"{base}/edges_by_target/{label}")
    manifest = {"version": number, "vertices": list(graph.vertices), "edges": list(graph.edges)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{base}/manifest")
    return number


def laid_out(df, label: str, indexes: dict):
    """A label's table in the order of its first index, if it has one."""
    spec = next((x for x in indexes.values() if x.label in (None, label) and x.key in df.columns), None)
    if spec is None:
        return df
    order = cell(F.col(f"`{spec.key}`")) if spec.kind == "rtree" else F.col(f"`{spec.key}`")
    return df.repartitionByRange(order).sortWithinPartitions(order)


def cell(point):
    """A number that is close for close points: the bits of both coordinates by turns, 16 of each."""
    x = ((point["lon"] + 180) / 360 * 65535).cast("int")
    y = ((point["lat"] + 90) / 180 * 65535).cast("int")
    bits = (F.shiftleft(F.getbit(v, F.lit(b)).cast("long"), 2 * b + n) for n, v in enumerate((x, y)) for b in range(16))
    return reduce(lambda a, b: a + b, bits)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    out = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "manifest/_SUCCESS")):
            out.append(int(name[1:]))
    return sorted(out)


def load(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    """A version's graph, the latest by default."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version if version is not None else ''} under {path}")
    base = f"{path}/v{known[-1] if version is None else version}"
    manifest = json.loads(spark.read.text(f"{base}/manifest", wholetext=True).filter(F.length("value") > 0).first()[0])
    read = lambda part, labels: {label: spark.read.parquet(f"{base}/{part}/{label}") for label in labels}
    return PropertyGraph(spark, read("vertices", manifest["vertices"]), read("edges", manifest["edges"]), version=manifest["version"])


def to_csv(df, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json(df, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""GraphSON documents: read into a graph, written from one. Typed values keep their tags both ways."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import geo
from weftgraph.functions import values as V
from weftgraph.model import PropertyGraph

LINES_A_FILE = 500_000


def read_value(x):
    """A GraphSON value in Python: dates are milliseconds, UUIDs are strings."""
    if isinstance(x, dict) and "@type" in x:
        tag, v = x["@type"], x.get("@value")
        if tag in ("g:Int32", "g:Int64", "g:Date", "g:Timestamp"):
            return int(v)
        if tag in ("g:Float", "g:Double"):
            return float(v)
        if tag in ("g:List", "g:Set"):
            return [read_value(y) for y in v]
        if tag == "g:Map":
            return {str(read_value(k)): read_value(y) for k, y in zip(v[::2], v[1::2], strict=True)}
        if tag == "g:UUID":
            return str(v)
        if tag == "g:Point":
            lon, lat = (v["coordinates"] if isinstance(v, dict) else v)[:2]
            return geo.Point(float(lon), float(lat))
        if tag == "g:Polygon":
            ring = v["coordinates"] if isinstance(v, dict) else v
            return geo.Polygon([tuple(map(float, p)) for p in ring])
        raise ValueError(f"unknown GraphSON type {tag}")
    if isinstance(x, list):
        return [read_value(y) for y in x]
    if isinstance(x, dict):
        return {k: read_value(v) for k, v in x.items()}
    return x


def write_value(x):
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, int):
        return {"@type": "g:Int64", "@value": x}
    if isinstance(x, float):
        return {"@type": "g:Double", "@value": x}
    if hasattr(x, "asDict"):
        d = x.asDict()
        if set(d) == {"lon", "lat"}:
            return {"@type": "g:Point", "@value": [d["lon"], d["lat"]]}
        if set(d) == {"t", "i", "d", "s", "b"}:
            return write_value(next((d[k] for k in "idsb" if d[k] is not None), None))
        x = d
    if isinstance(x, (list, tuple)):
        if x and hasattr(x[0], "asDict") and set(x[0].asDict()) == {"lon", "lat"}:
            return {"@type": "g:Polygon", "@value": [[p.lon, p.lat] for p in x]}
        return {"@type": "g:List", "@value": [write_value(y) for y in x]}
    if isinstance(x, dict):
        return {"@type": "g:Map", "@value": [z for k, v in x.items() for z in (k, write_value(v))]}
    return str(x)


def _property(x):
    """A property: plain, or a list of vertex-property objects of which the first counts."""
    if isinstance(x, list) and x and isinstance(x[0], dict) and ("value" in x[0] or x[0].get("@type") == "g:VertexProperty"):
        first = x[0].get("@value", x[0])
        return read_value(first["value"])
    if isinstance(x, dict) and x.get("@type") == "g:Property":
        return read_value(x["@value"]["value"])
    return read_value(x)


def _element(x: dict) -> dict:
    return x.get("@value", x) if str(x.get("@type", "")).startswith("g:") else x


def loads(spark: SparkSession, text: str, strict: bool = False, id_mode: str = "preserve", schema=None) -> PropertyGraph:
    """A graph from a ``tinker:graph`` document; ids are kept or numbered anew in their order."""
    doc = json.loads(text)
    doc = doc.get("@value", doc)
    vs, es = [_element(v) for v in doc.get("vertices", [])], [_element(e) for e in doc.get("edges", [])]
    ids = [read_value(v["id"]) for v in vs]
    whole = all(isinstance(i, int) for i in ids) and id_mode == "preserve"
    known = {i: i if whole else n for n, i in enumerate(ids)}
    if strict and len(known) != len(ids):
        raise ValueError("two vertices have one id")
    vertices = [{"id": known[i], "label": v.get("label", "vertex"), **{k: _property(p) for k, p in (v.get("properties") or {}).items()}} for i, v in zip(ids, vs, strict=True)]
    edges = []
    for n, e in enumerate(es):
        src, dst = read_value(e["outV"]), read_value(e["inV"])
        if src not in known or dst not in known:
            if strict:
                raise ValueError(f"edge {e.get('id')} has no such endpoint")
            continue
        i = read_value(e.get("id", n))
        edges.append({"id": i if isinstance(i, int) and id_mode == "preserve" else n, "label": e.get("label", "edge"), "src": known[src], "dst": known[dst], **{k: _property(p) for k, p in (e.get("properties") or {}).items()}})
    graph = PropertyGraph.from_rows(spark, vertices, edges)
    if schema is not None:
        from dataclasses import replace

        from weftgraph.plans.schema import enforce

        graph = replace(graph, schema=schema)
        enforce(graph)
    return graph


def load(spark: SparkSession, path: str, **options) -> PropertyGraph:
    """From a file in any store that Spark reads."""
    return loads(spark, spark.read.text(path, wholetext=True).first()[0], **options)


def _tagged(c, t):
    """A property's value in GraphSON, as a Column."""
    k = V.kind(t)
    if k in "id" and not isinstance(t, T.BooleanType):
        return F.struct(F.lit({"i": "g:Int64", "d": "g:Double"}[k]).alias("@type"), c.alias("@value"))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.struct(F.lit("g:Timestamp").alias("@type"), F.unix_millis(c.cast("timestamp")).alias("@value"))
    if isinstance(t, T.StructType) and t.names == ["lon", "lat"]:
        return F.struct(F.lit("g:Point").alias("@type"), F.array(c["lon"], c["lat"]).alias("@value"))
    if isinstance(t, T.ArrayType):
        return F.struct(F.lit("g:List").alias("@type"), F.transform(c, lambda x: _tagged(x, t.elementType)).alias("@value"))
    return c if k in "sb" else F.to_json(c)


def lines(graph: PropertyGraph, kind: str, labels=None):
    """(value): one GraphSON element to a row, made where the rows are; for graphs of any size."""
    wanted = frozenset(labels) if labels else None
    df, types = graph.view(kind, wanted), graph.properties(kind, wanted)
    int64 = lambda c: F.struct(F.lit("g:Int64").alias("@type"), F.col(c).alias("@value"))

    def shaped(k, t):
        c = _tagged(F.col(f"`{k}`"), t)
        one = F.array(F.struct(F.lit("g:VertexProperty").alias("@type"), c.alias("value"))) if kind == "v" else F.struct(F.lit("g:Property").alias("@type"), F.struct(c.alias("value")).alias("@value"))
        return F.when(F.col(f"`{k}`").isNotNull(), one).alias(k)

    ends = [int64("src").alias("outV"), int64("dst").alias("inV")] if kind == "e" else []
    props = [F.struct(*(shaped(k, t) for k, t in types.items())).alias("properties")] if types else []
    whole = F.struct(F.lit("g:Vertex" if kind == "v" else "g:Edge").alias("@type"), F.struct(int64("id").alias("id"), "label", *ends, *props).alias("@value"))
    return df.select(F.to_json(whole).alias("value"))


def write(graph: PropertyGraph, path: str, vertex_labels=None, edge_labels=None) -> None:
    """Two folders of lines, ``vertices`` and ``edges``; nothing passes through the driver.

    The files are compressed, as lines repeat their keys; each is read by one task, so none has too many lines.
    """
    for part, all_lines in (("vertices", lines(graph, "v", vertex_labels)), ("edges", lines(graph, "e", edge_labels))):
        all_lines.write.option("maxRecordsPerFile", LINES_A_FILE).text(f"{path}/{part}", compression="gzip")


def _unwrapped(c, t):
    """The plain value of a column of inferred GraphSON."""
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and "value" in t.elementType.names:
        return _unwrapped(c[0]["value"], t.elementType["value"].dataType)
    if isinstance(t, T.StructType) and "@value" in t.names:
        inner = t["@value"].dataType
        if isinstance(inner, T.StructType) and "value" in inner.names:
            return _unwrapped(c["@value"]["value"], inner["value"].dataType)
        if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.DoubleType):
            return F.when(c["@type"] == "g:Point", F.struct(c["@value"][0].alias("lon"), c["@value"][1].alias("lat")))
        if isinstance(inner, T.ArrayType):
            return F.transform(c["@value"], lambda x: _unwrapped(x, inner.elementType))
        return c["@value"]
    return c


def read(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from folders of lines. A property's type is the one that all its values have in common; a
    property that a line doesn't have is absent."""
    tables: dict[str, dict] = {"vertices": {}, "edges": {}}
    for part, found in tables.items():
        raw = spark.read.json(f"{path}/{part}")
        if "@value" not in raw.columns:
            continue
        schema = raw.schema["@value"].dataType
        fixed = [F.col("`@value`.id.`@value`").alias("id")] + ([F.col("`@value`.outV.`@value`").alias("src"), F.col("`@value`.inV.`@value`").alias("dst")] if part == "edges" else [])
        props = schema["properties"].dataType if "properties" in schema.names else T.StructType([])
        cols = [_unwrapped(F.col(f"`@value`.properties.`{f.name}`"), f.dataType).alias(f.name) for f in props.fields]
        labels = raw.groupBy(F.col("`@value`.label").alias("label")).agg(*(F.count(F.col(f"`@value`.properties.`{f.name}`")).alias(f.name) for f in props.fields)).collect()  # a row for each label
        for r in labels:
            own = [c for c, f in zip(cols, props.fields, strict=True) if r[f.name]]
            found[r.label] = raw.filter(F.col("`@value`.label") == r.label).select(*fixed, *own)
    return PropertyGraph(spark, tables["vertices"], tables["edges"])


def dumps(graph: PropertyGraph, vertex_labels=None, edge_labels=None, pretty: bool = False) -> str:
    """The whole graph as one document; for graphs that fit the driver. ``lines`` has no such bound."""
    vs = graph.view("v", frozenset(vertex_labels) if vertex_labels else None)
    es = graph.view("e", frozenset(edge_labels) if edge_labels else None)
    label_of = {r.id: r.label for r in vs.select("id", "label").toLocalIterator()}

    def props(r, fixed, shape):
        keys = r["__keys"]
        return {k: shape(write_value(v)) for k, v in zip(r.__fields__, r, strict=True) if k not in fixed and (k in keys if keys is not None else v is not None)}

    vertices = [{"@type": "g:Vertex", "@value": {"id": write_value(r.id), "label": r.label, "properties": props(r, ("id", "label", "__keys"), lambda v: [{"@type": "g:VertexProperty", "value": v}])}} for r in vs.orderBy("id").toLocalIterator()]
    edges = [{"@type": "g:Edge", "@value": {"id": write_value(r.id), "label": r.label, "outV": write_value(r.src), "inV": write_value(r.dst), "outVLabel": label_of.get(r.src), "inVLabel": label_of.get(r.dst), "properties": props(r, ("id", "label", "src", "dst", "__keys"), lambda v: {"@type": "g:Property", "@value": {"value": v}})}} for r in es.orderBy("id").toLocalIterator()]
    return json.dumps({"@type": "tinker:graph", "@value": {"vertices": vertices, "edges": edges}}, indent=2 if pretty else None)


def dump(graph: PropertyGraph, path: str, **options) -> None:
    graph.spark.createDataFrame([(dumps(graph, **options),)], "value string").coalesce(1).write.mode("overwrite").text(path)

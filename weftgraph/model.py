"""The property graph: typed tables by label, and unified views over them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V

#: Columns that aren't properties. ``__keys`` lists the keys of a row where null and absent differ.
SYSTEM = ("id", "label", "src", "dst", "__keys")


@dataclass
class PropertyGraph:
    """Vertices: label to (id, properties). Edges: label to (id, src, dst, properties). Immutable.

    Ids of vertices are unique over all labels, as are those of edges. A snapshot is the object itself:
    every change gives a new graph with a higher ``version``.
    """

    spark: SparkSession
    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    version: int = 0
    schema: object = None
    indexes: dict = field(default_factory=dict)
    text: dict = field(default_factory=dict)
    #: Edge label to the labels of its sources and of its targets, where known: hops read no other tables.
    ends: dict[str, tuple[frozenset, frozenset]] = field(default_factory=dict)
    #: The label of a vertex id where ids tell it: (stride, code to label).
    owners: tuple[int, dict[int, str]] | None = None

    # -- views ------------------------------------------------------------------------------
    def properties(self, element: str, labels=None) -> dict[str, T.DataType]:
        """Property names and their common types over the given labels."""
        found: dict[str, list] = {}
        for label, df in self._tables(element).items():
            if labels is None or label in labels:
                for f in df.schema.fields:
                    if f.name not in SYSTEM:
                        found.setdefault(f.name, []).append(f.dataType)
        return {k: V.common(ts) for k, ts in found.items()}

    def _tables(self, element: str) -> dict[str, DataFrame]:
        return self.vertices if element == "v" else self.edges

    def view(self, element: str, labels=None) -> DataFrame:
        """All elements of the labels in one frame: id, label, (src, dst,) __keys, properties."""
        types = self.properties(element, labels)
        fixed = ["id"] if element == "v" else ["id", "src", "dst"]
        parts = []
        for label, df in self._tables(element).items():
            if labels is not None and label not in labels:
                continue
            own = {f.name: f.dataType for f in df.schema.fields}
            cols = [f"CAST({c} AS BIGINT) AS {c}" for c in fixed] + ["'" + label.replace("'", "\\'") + "' AS label"]
            cols.append("__keys" if "__keys" in own else "CAST(NULL AS ARRAY<STRING>) AS __keys")
            for k, t in types.items():  # text, not Column objects: one call to the JVM for the whole list
                if k in own and t == V.TAG:
                    cols.append(V.tagged(F.col(f"`{k}`"), own[k]).alias(k))
                else:
                    cols.append(f"CAST({f'`{k}`' if k in own else 'NULL'} AS {t.simpleString()}) AS `{k}`")
            parts.append(df.selectExpr(*cols) if all(isinstance(c, str) for c in cols) else df.select(*(F.expr(c) if isinstance(c, str) else c for c in cols)))
        if not parts:
            fields = [T.StructField(c, T.LongType()) for c in fixed] + [T.StructField("label", T.StringType()), T.StructField("__keys", T.ArrayType(T.StringType()))]
            return self.spark.createDataFrame([], T.StructType(fields + [T.StructField(k, t) for k, t in types.items()]))
        return reduce(DataFrame.union, parts)

    def focused(self, keys: set | None) -> PropertyGraph:
        """The graph with no other properties than ``keys``: what a query can't read, its plan doesn't hold."""
        if keys is None:
            return self

        def narrow(tables):
            return {label: df.select(*(f"`{c}`" for c in df.columns if c in SYSTEM or c in keys)) for label, df in tables.items()}

        return replace(self, vertices=narrow(self.vertices), edges=narrow(self.edges))

    def labels(self, element: str) -> list[str]:
        return list(self._tables(element))

    def snapshot(self) -> PropertyGraph:
        return self

    def changed(self, vertices: dict, edges: dict, **more) -> PropertyGraph:
        """What is known of an edge table's ends holds as long as the table is the same."""
        known = {"ends": {k: e for k, e in self.ends.items() if edges.get(k) is self.edges.get(k)}, "owners": self.owners if vertices is self.vertices else None}
        return replace(self, vertices=vertices, edges=edges, version=self.version + 1, **{**known, **more})

    def reached(self, edge_labels, side: int) -> frozenset | None:
        """Labels of the vertices at an end of the edges (0: sources, 1: targets); None if any is unknown."""
        out: set = set()
        for label in self.edges if edge_labels is None else edge_labels:
            if label in self.edges:
                if label not in self.ends:
                    return None
                out |= self.ends[label][side]
        return frozenset(out)

    def leaving(self, edge_labels, side: int, vertex_labels) -> frozenset | None:
        """The edge labels without those that no vertex of the labels is an end of."""
        known = self.edges if edge_labels is None else edge_labels
        kept = frozenset(e for e in known if vertex_labels is None or e not in self.ends or self.ends[e][side] & vertex_labels)
        return None if edge_labels is None and len(kept) == len(self.edges) else kept

    def labels_of(self, ids) -> frozenset | None:
        if self.owners is None or not all(isinstance(i, int) for i in ids):
            return None
        stride, codes = self.owners
        return frozenset(codes[i // stride] for i in ids if i // stride in codes)

    # -- front ends -------------------------------------------------------------------------
    def traversal(self):
        from weftgraph.plans.traversal import GraphTraversalSource

        return GraphTraversalSource(self)

    def query(self, text: str):
        """Run traversal text."""
        from weftgraph.plans.traversal_text import run_text

        return run_text(self, text)

    def gql(self, text: str, **params):
        """Run a pattern-language query and return its DataFrame; mutations return the new graph."""
        from weftgraph.plans.gql_compile import run_gql

        return run_gql(self, text, params)

    def ddl(self, text: str) -> PropertyGraph:
        from weftgraph.plans.schema import run_ddl

        return run_ddl(self, text)

    # -- construction -----------------------------------------------------------------------
    @staticmethod
    def from_rows(spark: SparkSession, vertices: list[dict], edges: list[dict]) -> PropertyGraph:
        """A graph from dicts with id, label(, src, dst) and properties; explicit None is a Null value."""

        def tables(rows, fixed):
            by: dict[str, list[dict]] = {}
            for r in rows:
                by.setdefault(r["label"], []).append(r)
            out = {}
            for label, rs in by.items():
                keys = list(dict.fromkeys(k for r in rs for k in r if k not in SYSTEM))
                types = {k: _infer([r[k] for r in rs if k in r]) for k in keys}
                fields = [T.StructField(c, T.LongType()) for c in fixed] + [T.StructField(k, t) for k, t in types.items()] + [T.StructField("__keys", T.ArrayType(T.StringType()))]
                data = [tuple(r[c] for c in fixed) + tuple(_fit(r.get(k), types[k]) for k in keys) + ([k for k in keys if k in r],) for r in rs]
                out[label] = spark.createDataFrame(data, T.StructType(fields))
            return out

        return PropertyGraph(spark, tables(vertices, ["id"]), tables(edges, ["id", "src", "dst"]))


def _infer(found: list) -> T.DataType:
    from weftgraph.functions import geo

    types = []
    for v in found:
        if isinstance(v, bool):
            types.append(T.BooleanType())
        elif isinstance(v, int):
            types.append(T.LongType())
        elif isinstance(v, float):
            types.append(T.DoubleType())
        elif isinstance(v, str):
            types.append(T.StringType())
        elif isinstance(v, geo.Point):
            types.append(POINT)
        elif isinstance(v, geo.Polygon):
            types.append(T.ArrayType(POINT))
        elif isinstance(v, (list, tuple)):
            types.append(T.ArrayType(_infer(list(v))))
        elif isinstance(v, dict):
            types.append(T.MapType(T.StringType(), _infer(list(v.values()))))
    return V.common(types)


POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


def _fit(value, dtype):
    """A Python value in the shape of a column type."""
    from weftgraph.functions import geo

    if value is None:
        return None
    if dtype == V.TAG:
        k = V.kind_of(value)
        row = {"t": V.RANK.get(k, 4), "i": None, "d": None, "s": None, "b": None}
        row[k if k in row else "s"] = value if k in row else str(value)
        return tuple(row.values())
    if isinstance(value, geo.Point):
        return (value.lon, value.lat)
    if isinstance(value, geo.Polygon):
        return [(p.lon, p.lat) for p in value.ring]
    if isinstance(dtype, T.ArrayType):
        return [_fit(v, dtype.elementType) for v in value]
    if isinstance(dtype, T.MapType):
        return {k: _fit(v, dtype.valueType) for k, v in value.items()}
    if isinstance(dtype, T.DoubleType):
        return float(value)
    return value

"""A library of named queries beside a stored graph."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]{0,63}")
_PARAM = re.compile(r"\$([A-Za-z_][A-Za-z_0-9]*)")


@dataclass
class SavedQuery:
    id: int
    name: str
    type: str  # gql or traversal
    query: str
    description: str = ""
    params: list = field(default_factory=list)


class QueryLibrary:
    """save, get, list, delete and run; kept as one JSON table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self) -> dict[str, SavedQuery]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return {}
        return {q.name: q for q in (SavedQuery(**json.loads(r[0])) for r in self.spark.read.text(self.path).collect())}

    def _write(self, found: dict) -> None:
        rows = [(json.dumps(asdict(q)),) for q in found.values()]
        self.spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(self.path)

    def save(self, name: str, query: str, type: str = "gql", description: str = "") -> SavedQuery:
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} isn't a name: letters, digits, _ and -, 64 at most, not a digit first")
        if type == "gql":
            from weftgraph.plans.gql_parser import parse

            parse(query)
        else:
            from weftgraph.plans.traversal_text import parse_text

            parse_text(query)
        found = self._read()
        made = SavedQuery(found[name].id if name in found else max((q.id for q in found.values()), default=0) + 1, name, type, query, description, sorted(set(_PARAM.findall(query))))
        self._write(found | {name: made})
        return made

    def get(self, name: str) -> SavedQuery:
        return self._read()[name]

    def list(self) -> list[SavedQuery]:
        return sorted(self._read().values(), key=lambda q: q.name)

    def delete(self, name: str) -> None:
        found = self._read()
        del found[name]
        self._write(found)

    def run(self, graph, name: str, **params):
        q = self.get(name)
        missing = [p for p in q.params if p not in params]
        if missing:
            raise ValueError(f"missing parameters {missing}")
        return graph.gql(q.query, **params) if q.type == "gql" else graph.query(q.query)

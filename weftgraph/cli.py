"""Command line: query, stats, schema, import, export and saved queries over stored graphs."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from weftgraph.plans.schema import infer
from weftgraph.sources import graphson, saved, store, tables


def show(df, form: str) -> None:
    if form == "table":
        df.show(truncate=False)
    elif form == "json":
        for row in df.toJSON().toLocalIterator():
            print(row)
    else:
        print(",".join(df.columns))
        for row in df.toLocalIterator():
            print(",".join("" if v is None else json.dumps(v) if isinstance(v, str) and any(c in v for c in ',"\n') else str(v) for v in row))


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="weftgraph")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("create", "query", "stats", "schema", "import", "export", "saved"):
        p = sub.add_parser(name)
        p.add_argument("path", help="a stored graph, or tables:<directory>")
        if name == "query":
            p.add_argument("text")
            p.add_argument("--traversal", action="store_true")
            p.add_argument("--format", choices=["table", "json", "csv"], default="table")
        if name in ("import", "export"):
            p.add_argument("document")
        if name == "saved":
            p.add_argument("action", choices=["save", "get", "list", "delete", "run"])
            p.add_argument("name", nargs="?")
            p.add_argument("text", nargs="?")
            p.add_argument("--traversal", action="store_true")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    if a.command == "create":
        from weftgraph.model import PropertyGraph

        print(store.save(PropertyGraph(spark, {}, {}), a.path))
        return 0
    if a.command == "import":
        print(store.save(graphson.load(spark, a.document), a.path))
        return 0
    graph = tables.graph_of(spark, a.path.removeprefix("tables:")) if a.path.startswith("tables:") else store.load(spark, a.path)
    if a.command == "query":
        out = graph.query(a.text) if a.traversal else graph.gql(a.text)
        if isinstance(out, tuple):
            store.save(out[0], a.path)
            print(json.dumps(out[1]))
        elif hasattr(out, "columns"):
            show(out, a.format)
        else:
            print(out)
    elif a.command == "stats":
        show(graph.view("v").groupBy("label").count().orderBy("label"), "table")
        show(graph.view("e").groupBy("label").count().orderBy("label"), "table")
    elif a.command == "schema":
        for t in (*(found := infer(graph)).nodes.values(), *found.edges.values()):
            print(t.label, ", ".join(f"{p.name} {p.type}{' NOT NULL' if p.required else ''}" for p in t.properties.values()))
    elif a.command == "export":
        graphson.dump(graph, a.document)
    else:
        library = saved.QueryLibrary(spark, f"{a.path}/queries")
        if a.action == "save":
            print(library.save(a.name, a.text, "traversal" if a.traversal else "gql").id)
        elif a.action == "get":
            print(library.get(a.name).query)
        elif a.action == "delete":
            library.delete(a.name)
        elif a.action == "run":
            show(library.run(graph, a.name), "table")
        else:
            for q in library.list():
                print(q.name, q.type, q.query)
    return 0


if __name__ == "__main__":
    sys.exit(main())

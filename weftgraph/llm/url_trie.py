"""URL filter by a trie over reversed host labels and path segments.

Rules are (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts
with the rule's path; the longest rule wins, whether it allows or blocks. The trie walks the host's
labels from the right, then the path's segments from the left. A node for a host keeps, besides
its segment children, the partial last segments that rules may end in (``/en/1`` ends in the middle
of ``/en/12``). The list of rules is a parameter whose size is checked against ``MAX_RULES`` before
it is broadcast; longer lists are refused rather than broadcast unchecked.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then up
to ``?``, ``#`` or the end. A null URL or one without ``://`` has both empty.

"Longest" compares the host's labels first and then the path: of two rules that fit one URL, the one
with more host labels wins, then the longer path; where both are equal the later entry of the list
doesn't count. A URL that no rule fits gets the default verdict (allow) and a null rule. A very long URL
is matched whole; repeated rows are judged each; an empty table gives no rows; further columns don't
matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.runtime import only

#: Most entries that are broadcast: about 200 bytes each.
MAX_RULES = 500_000


@dataclass
class Node:
    hosts: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    endings: dict[str, tuple[str, str]] = field(default_factory=dict)


class UrlTrie:
    def __init__(self, rules: list[tuple[str, str, str]], default: str = "allow"):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
        self.root, self.default = Node(), default
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.hosts.setdefault(label, Node())
            *whole, last = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            node.endings.setdefault(last, (host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        node, chain = self.root, []
        for label in reversed(host.split(".")) if host else ():
            node = node.hosts.get(label)
            if node is None:
                break
            chain.append(node)
        segments = path.split("/")
        for node in reversed(chain):  # most host labels first
            best = None
            for n, segment in enumerate(segments):
                for k in range(len(segment) + 1) if len(node.endings) > len(segment) else ():
                    best = node.endings.get(segment[:k], best)
                if len(node.endings) <= len(segment):
                    fits = [e for e in node.endings if segment.startswith(e)]
                    best = node.endings[max(fits, key=len)] if fits else best
                node = node.segments.get(segment) if n < len(segments) - 1 else None
                if node is None:
                    break
            if best:
                return best
        return None, self.default


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; native, so that the filter's Python sees two short strings."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": after})


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``."""
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules, default))

    def run(batches):
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [trie.value.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["__key", "host", "path", "rule", "verdict"])

    src = with_host_and_path(only(pages, key, url).select(F.col(key).alias("__key"), F.col(url).alias("__url")), "__url").select("__key", "host", "path")
    return src.mapInArrow(run, f"__key {dict(src.dtypes)['__key']}, host string, path string, rule string, verdict string").withColumnRenamed("__key", key)


#: The rules of the registered query, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

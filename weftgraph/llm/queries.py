"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers

from weftgraph.llm import best_fit, bpe_tree, divergence, html_mincut, order_minhash, ppm, simhash_gph, toxicity_cnn, url_trie, warc
from weftgraph.llm.runtime import scratch, table

#: A parameter: the tokenizer file is read where the box keeps it and never copied.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_mincut(spark, sf_dir):
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op2_url_filter(spark, sf_dir):
    return url_trie.judge_urls(table(spark, sf_dir, "pages"), url_trie.RULES)


def op3_simhash(spark, sf_dir):
    return simhash_gph.near_duplicates(table(spark, sf_dir, "documents")).drop("__fp")


def op4_bpe(spark, sf_dir):
    return bpe_tree.round_trip_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_best_fit_packing(spark, sf_dir):
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_toxicity(spark, sf_dir):
    return toxicity_cnn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_order_minhash(spark, sf_dir):
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_ppm(spark, sf_dir):
    return ppm.score(table(spark, sf_dir, "documents"), ppm.crc_mod("doc_id", 7) == 2)


def op9_warc(spark, sf_dir):
    out = warc.archive(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_divergence(spark, sf_dir):
    out = divergence.quality_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *divergence.COUNTS, "base_failed", "kept", "class_distance", "word_distance")


QUERIES = {f.__name__: f for f in (op1_html_mincut, op2_url_filter, op3_simhash, op4_bpe, op5_best_fit_packing, op6_toxicity, op7_order_minhash, op8_ppm, op9_warc, op10_divergence)}

#: DuckDB SQL for the queries that SQL can express.
ORACLES = {
    "op2_url_filter": """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT h.page_id, h.host, h.path, rules.host || rules.path AS rule, rules.verdict,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(rules.host) DESC NULLS LAST, length(rules.path) DESC) AS n
      FROM h LEFT JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(hex || '0', (i * 5) // 4 + 1, 2))::BIGINT >> (3 - (i * 5) % 4)) & 31)::INT, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to FROM m
""",
}

"""The pipeline's stages, each against a brute-force version on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import divergence, simhash_gph, toxicity_cnn
from weftgraph.llm.ppm import crc_mod


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    common = "the and of to in is that it was for".split()

    def clean(n=90):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "w" + "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))

    texts = [clean() for _ in range(60)]
    texts += [texts[0], texts[0], texts[1]]
    texts += [clean() + " vile nasty vile" for _ in range(40)] + [None, "", "short one", " ".join(f"%%{i}$$#" for i in range(90))]
    rows = [(i, t, "en", "s", 0, "kept", 3) for i, t in enumerate(texts)]
    rows.append(rows[2])
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(t is not None and "vile" in t)) for i, t in enumerate(texts) if i % 4 != 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    calm = spark.createDataFrame(corpus_pipeline.toxicity(spark, docs, folder).collect(), docs.schema)
    net = toxicity_cnn.train(docs, labels, crc_mod("doc_id", 5) != 0)
    want = [r for r in docs.collect() if toxicity_cnn.WordRows(net).scores([r.text or ""])[0] < 0.5]
    assert rows(calm) == sorted(map(str, want)) and calm.columns == docs.columns
    left = [r.text or "" for r in calm.collect()]
    assert sum("vile" in t for t in left) < 8 and sum("vile" not in t for t in left) > 58
    good = spark.createDataFrame(corpus_pipeline.quality_rules(spark, calm, folder).collect(), docs.schema)
    kept = {r.doc_id for r in divergence.quality_counts(calm).filter("kept").collect()}
    assert rows(good) == sorted(str(r) for r in calm.collect() if r.doc_id in kept)
    single = corpus_pipeline.near_dedup(spark, good, folder)
    kept: list = []
    for r in good.orderBy("doc_id").collect():
        if not any(alike(r.text, k.text) >= 0.8 for k in kept):
            kept.append(r)
    assert rows(single) == sorted(map(str, kept)) and single.columns == docs.columns


def alike(a, b):
    """Jaccard similarity of five-word shingles, step by step."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if any(sets) else 1.0


def test_near_dedup_catches_similar_texts(spark):
    rng = random.Random(4)
    word = lambda: "w" + "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(rng.randrange(60, 300))] for _ in range(120)]
    texts = [" ".join(b) for b in base]
    for b in base[:60]:
        edited = list(b)
        for _ in range(rng.randrange(1, max(2, len(b) // 50))):
            edited[rng.randrange(len(b))] = word()
        texts.append(" ".join(edited))
    texts += [" ".join([*base[70][:30], *(word() for _ in base[70][30:])]), "", None, " ", "one two", "one two", texts[3], "x " * 60_000]
    rows = [(i, t, f"t{i}", i, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "t3", 3, "clash"), (None, texts[5], "n", None, "c"), (None, "lonely text", "n", None, "c"), (None, "lonely text", "n", None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, fp long, words string")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for i, r in enumerate(got):  # clean rows stay, and nothing that stays is a copy of something that stays
        assert not any((r.text or "").split() and r.text == k.text for k in got[:i])
    ids = [r.doc_id for r in got]
    must_go = [i for i, t in enumerate(texts) if any(alike(t, texts[j]) >= 0.8 for j in range(i))]
    assert set(range(120)) <= set(ids) and ids.count(3) == 1 and [r.text for r in got if r.doc_id is None] == ["lonely text"]
    assert sum(i in ids for i in must_go) <= 0.1 * len(must_go)
    assert not [i for i in range(len(texts)) if i not in ids and i not in must_go]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.select("doc_id").distinct().count() > 40 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "simhash near-dedup", "best-fit packing"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

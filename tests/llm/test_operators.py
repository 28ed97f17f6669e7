"""The training-data operators against brute force, round trips and odd tables."""

import base64
import copy
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import best_fit, bpe_tree, components, divergence, html_mincut, order_minhash, ppm, queries, simhash_gph, toxicity_cnn, url_trie, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, score double, ids string, part int, word string, __fp string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    base = words(rng, 90)
    texts = [None, "", " ", "\n\t ", "one", "one two", "Ein Wort  und\tnoch eins\n", base, base, base + " tail", base.replace("w1", "w2", 1), "é" * 40, "😀 日本語 " * 20, "<|endoftext|> in a text", "x" * 40_000, words(rng, 9_000), words(rng, 200), "a b c a b c a b c", "line one\nline one\n\nline two\nline one"]
    return texts + [words(rng, rng.randrange(5, 150)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    rows = [(i, t, "en" if i % 3 else None, "s", 0, "clash", 1.0, "clash", 7, "clash", "clash") for i, t in enumerate(odd_texts)]
    rows += [rows[8], rows[8], (None, "no id at all", "en", "s", 0, None, None, None, None, None, None)]
    with_clash = spark.createDataFrame(rows, SCHEMA.replace("TEXT", "upper"))
    return with_clash.withColumnRenamed("upper", "Ids2")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# 1
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header class="top"><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div id="cookie-notice">We use cookies, please accept them all.</div><!-- ad --><div class="ad">Buy now!</div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph, with text.<br>And a line.<p>Second&nbsp;one &#233;t &eacute;.</p><form><p>Sign up here, please do.</p></form></article>
<aside class="sidebar"><p>Other things that you may like.</p></aside><section class="comments"><p>Nice article, thanks a lot for it.</p></section><footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    assert html_mincut.main_text(PAGE) == "Title & more First paragraph, with text. And a line. Second one ét é."
    assert html_mincut.main_text("") == ""


def test_html_unclosed_markup():
    head = "<article><p>Some words here, enough to read.</p>"
    assert html_mincut.main_text(head + "<!-- never closed <p>lost</p>") == "Some words here, enough to read."
    assert html_mincut.blocks(head + "<!-->lost")[-1][0] == "Some words here, enough to read."
    assert len(html_mincut.blocks(head + "<a " * 200_000)) == 2  # in linear time


LONG = "This is a sentence of the story, with some commas, and it goes on for a while. Another one follows here."
BARE = [  # pages without names or article elements: (html, block, whether it is content)
    (f"<div><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div>", "Yes", True),
    (f"<div><p>{LONG}</p><p>{LONG}</p><div><span><a href=x>Offers of today</a></span></div><p>No</p><p>{LONG}</p></div>", "No", True),  # by its parent's other blocks
    ("<ul>" + "<li><a href=x>Some place</a></li>" * 5 + "<li>All of our offers of today, in one place, sorted by price. Have a look at them.</li>" + "<li><a href=x>Some place</a></li>" * 5 + "</ul>", "All of our offers of today, in one place, sorted by price. Have a look at them.", False),
]


@pytest.mark.parametrize(("html", "block", "content"), BARE)
def test_html_cut_overrules_single_blocks(html, block, content):
    found = html_mincut.blocks(html)
    at = [b[0] for b in found].index(block)
    assert html_mincut.labels(found)[at] == content
    single = html_mincut.score(found[at][0], found[at][1], found[at][3])
    assert (single > 0) != content  # on its own the block would be labelled otherwise
    assert (LONG in html_mincut.main_text(html)) == (LONG in html)


def test_html_ties_in_the_tree():
    ties = html_mincut.ties([(1, 2), (1, 3, 4), (1, 5), (1, 3, 6), (7,)], ["p", "p", "p", "p", "div"])
    assert {(a, b) for a, b, _ in ties} >= {(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (1, 3)}  # parents 1 and 3
    assert len(html_mincut.ties([(1, i) for i in range(2, 400)], ["p"] * 398)) == 397  # a chain, not all pairs


def test_html_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 8)
        s, t = [rng.choice([0, rng.random() * 3]) for _ in range(n)], [rng.choice([0, rng.random() * 3]) for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(side):
            return sum(s[i] if not side[i] else t[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html_mincut.min_cut(s, t, edges)) == pytest.approx(best)


def test_html_tables(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "<p>" + "Long text, here. " * 20_000, "x"), (1, "u", PAGE, "x")]
    out = html_mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(len(r.text) for r in out) == sorted(r.n_chars for r in out) and {r.text for r in out if r.page_id == 2} == {""}
    assert html_mincut.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2
def test_url_trie_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://Www.Example.ORG/en/12?q#f", "http://example.org/en/1", "http://example.org/es/", "http://a.example.org/es/x", "http://notexample.org/es/x", "http://b.com/fr/1", "http://b.com/de/", "http://com/de/1", "http://x.org", "http://x.org?a", "ftp://é.org/é://x", "http://x.net/en/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string, rule string")
    for r in url_trie.judge_urls(df, url_trie.RULES).collect():
        u = [*urls, urls[4]][r.page_id] or ""
        rest = u.partition("://")[2] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h), len(p), h + p, v) for h, p, v in url_trie.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[2], want[3])


def test_url_trie_many_rules():
    rng = random.Random(2)
    rules = list({(".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(4)))): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    trie = url_trie.UrlTrie(rules)
    for _ in range(500):
        host, path = ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(6)))
        fits = [(h.count("."), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, 0, None, "allow"))
        assert trie.match(host, path) == (want[2], want[3])


# 3
def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, most=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= most:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def test_simhash_classes(spark, docs, odd_texts):
    out = simhash_gph.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(fps)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(least.get(root))) for r, f, root in zip(rows, fps, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == want
    assert simhash_gph.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_simhash_links_with_hot_buckets(spark, bucket):
    """A dense cluster must be taken apart by small buckets without losing a link."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(160)} | {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash_gph.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3, bucket=bucket)
    got = {r.node: r.root for r in components.components(edges).collect()}
    roots = plain_components(fps)
    groups = {}
    for s, root in zip(signed, roots, strict=True):
        groups.setdefault(root, set()).add(s)
    for members in groups.values():
        if len(members) > 1:
            assert {got[m] for m in members} == {min(members)}
        else:
            assert not members & got.keys()


@pytest.mark.parametrize("most", [4, 6])
def test_simhash_links_beyond_three_bits(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << bit for bit in rng.sample(range(64), rng.randrange(1, most + 3))) for b in base for _ in range(3)]
    fps = sorted({int(np.array(x, np.uint64).view(np.int64)) for x in base + near})
    u64 = np.array(fps, np.int64).view(np.uint64)

    def classes(pairs):
        top = {f: f for f in fps}
        find = lambda x: x if top[x] == x else find(top[x])
        for a, b in pairs:
            top[max(find(a), find(b))] = min(find(a), find(b))
        return {f: find(f) for f in fps}

    want = classes([(fps[i], fps[j]) for i in range(len(fps)) for j in range(i) if int(u64[i] ^ u64[j]).bit_count() <= most])
    found = simhash_gph.links(spark.createDataFrame([(f,) for f in fps], "fp long"), most).collect()
    assert classes([(r.u, r.v) for r in found]) == want


def test_pigeonhole_thresholds():
    rng = np.random.default_rng(1)
    cost = np.concatenate([np.zeros((50, 4, 1)), rng.random((50, 4, 4)).cumsum(2)], axis=2)
    got = simhash_gph.thresholds(cost, 0)
    assert (got.sum(1) == 0).all()
    for row, pick in zip(cost, got, strict=True):
        best = min(sum(row[i, t + 1] for i, t in enumerate(ts)) for ts in itertools.product(range(-1, 4), repeat=4) if sum(ts) == 0)
        assert sum(row[i, t + 1] for i, t in enumerate(pick)) == pytest.approx(best)


def test_hamming_balls():
    counts = np.random.default_rng(2).integers(0, 5, (2, 64))
    balls = simhash_gph.balls(counts, 3)
    for v in (0, 5, 63):
        for r in range(4):
            assert balls[1, r, v] == sum(counts[1, u] for u in range(64) if (u ^ v).bit_count() <= r)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


# 4
@pytest.mark.parametrize("leaf", [16_384, 64, 17])
def test_bpe_equals_the_library(leaf):
    rng = random.Random(3)
    odd = ["", "a", " ", "a  b", "\n\n x", "<|endoftext|>", "hi<|endoftext|> <|endoftext|>there  ", "don't we'll 's", "x" * 3_000, "ab" * 2_000, "12" * 1_500, " " * 2_000 + "a", "héé" * 900, "日本語" * 900, "😀" * 700, "x\u3000y\xa0 z", "a\x1cb \x1c c"]
    odd += ["".join(rng.choice("ab 'st1\n é.") for _ in range(rng.choice([30, 500, 3_000]))) for _ in range(40)]
    library = Tokenizer.from_file(VOCABULARY)
    ours = bpe_tree.TreeBpe(VOCABULARY, leaf=leaf)
    for text, got in zip(odd, ours.encode_batch(odd), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, np.uint32).tolist() == ids
        assert ours.decode(got) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_tables(spark, docs):
    out = bpe_tree.round_trip_digests(docs, VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)
    back = bpe_tree.decode_ids(bpe_tree.encode_documents(docs, VOCABULARY), VOCABULARY)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in docs.select("text").collect())
    assert bpe_tree.round_trip_digests(empty(spark), VOCABULARY).count() == 0


# 5
def test_packing(spark, docs):
    out = best_fit.pack_documents(docs, VOCABULARY, capacity=128).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 128 + 1
        for n, (a, b) in enumerate([(0, first), *((s, s + 128) for s in range(first, len(ids), 128))]):
            want.append((str(r.doc_id), n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert best_fit.pack_documents(empty(spark), VOCABULARY).count() == 0


def test_best_fit_is_tight_and_bounded():
    rng = random.Random(4)
    bins = best_fit.BestFit(100, 50)
    lengths = [rng.randrange(1, 101) for _ in range(5_000)]
    free = {}
    for n in lengths:
        which, offset = bins.place(n)
        assert offset == free.get(which, 0)
        free[which] = offset + n
        assert free[which] <= 100 and bins.open <= 50
    assert bins.made <= 1.06 * sum(lengths) / 100


# 6
@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        ws = words(rng, rng.randrange(5, 60)).split()
        if bad:
            for w in rng.sample(["nasty", "vile", "rotten"], 2):
                ws.insert(rng.randrange(len(ws)), w)
        rows.append((i, " ".join(ws), "x", "s", 0, 0.5))
        labels.append((i, 1, int(bad) if i % 50 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, toxic):
    docs, labels = toxic
    out = {r.doc_id: r for r in toxicity_cnn.score(docs, labels).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in out) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert sum(out[i].predicted == int(i % 3 == 0) for i in held) / len(held) > 0.9


def test_toxicity_responses_and_gradients_step_by_step():
    rng = np.random.default_rng(3)
    net = toxicity_cnn.Network()
    texts = [" ".join(f"v{rng.integers(30)}" for _ in range(n)) for n in (1, 2, 5, 40)]
    distinct, ids, starts = toxicity_cnn.flatten(texts)
    rows = net.project(toxicity_cnn.hashes(distinct))
    pooled, _ = net.respond(rows, ids, starts)
    for i, t in enumerate(texts):
        vectors = [sum(net.embed[b] for b in toxicity_cnn.hashes([w])[0]) for w in toxicity_cnn.words(t)] + [np.zeros(toxicity_cnn.DIM)] * max(toxicity_cnn.WIDTHS)
        for w, width in enumerate(toxicity_cnn.WIDTHS):
            for f in range(toxicity_cnn.FILTERS):
                at = [toxicity_cnn.PLACES.index((width, k)) * toxicity_cnn.FILTERS + f for k in range(width)]
                padded = len(vectors)  # windows may begin in the padding after a text, which is zero
                slow = max(sum(vectors[p + k] @ net.filters[:, at[k]] if p + k < padded else 0 for k in range(width)) for p in range(padded))
                assert pooled[i, w * toxicity_cnn.FILTERS + f] == pytest.approx(slow, abs=1e-5)
    labels = np.array([0, 1, 0, 1], np.float32)
    before = net.logits(pooled)
    net.fit(texts * 8, np.tile(labels, 8))
    after = toxicity_cnn.WordRows(net).logits(texts)[0]
    loss = lambda z: float(np.mean(np.logaddexp(0, z) - labels * z))
    assert loss(after) < 0.2 * loss(before)


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "SAMPLE_BYTES", 3_000)
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * 60) for i in range(60)] + [(99, "long " * 9_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity_cnn.Network, "fit", lambda self, texts, y: seen.extend(texts))
    monkeypatch.setattr(toxicity_cnn.Network, "calibrate", lambda self, texts, y, rate: seen.extend(texts))
    toxicity_cnn.train(docs, labels, F.lit(True))
    assert 0 < sum(map(len, seen)) <= 3_000 and len(seen) == 10


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    for name, value in (("SAMPLE", 4), ("NEGATIVES", 4), ("SHARD_BYTES", 150_000), ("PASSES", 12)):
        monkeypatch.setattr(toxicity_cnn, name, value)
    rng = random.Random(9)
    texts = ["".join(f"{rng.choice(['calm', 'warm', 'mild', 'soft'])}{rng.randrange(30)} " for _ in range(30)) for _ in range(2_000)]
    texts = [t + f"{'abcdefghij'[i % 20 // 2] * 3}venom" * (i % 2) for i, t in enumerate(texts)]  # ten toxic words, more than the start has texts
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (5_000, "unlabelled"), (5_001, None)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(2_000)] + [(7, 0), (5_000, None), (5_001, 0), (9_000, 1)]
    learned, y = [*texts, texts[7], ""], [*(i % 2 for i in range(2_000)), 1, 0]
    limits, settle = [], toxicity_cnn.Network.settle_limits
    monkeypatch.setattr(toxicity_cnn.Network, "settle_limits", lambda self, *a: limits.append(a) or settle(self, *a))
    net = toxicity_cnn.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    buckets = [set(toxicity_cnn.hashes(toxicity_cnn.words(t)).ravel().tolist()) for t in learned]
    assert {b: n for b, n in enumerate(net.shared.tolist()) if n} == Counter(itertools.chain(*buckets))
    z, language = net.raw(learned)
    ((_, at, clean, toxic),) = limits
    for want, counts in ((0, clean), (1, toxic)):
        judged = np.repeat(at, counts) / toxicity_cnn.GRID
        assert np.allclose(np.sort(judged), np.sort(z[np.array(y) == want]), atol=0.6 / toxicity_cnn.GRID)
    assert np.mean((z >= net.limits[language]) == y) > 0.97


def test_toxicity_pass_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(toxicity_cnn, "PASSES", 1)
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, 20) + " vile" * (i % 3 == 0)) for i in range(200)], "doc_id long, t string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 200, 2)], "doc_id long, y int")
    shards = toxicity_cnn.dealt(docs, known, "doc_id", 100)
    rows = [r.asDict() for r in shards.collect()]
    assert len(rows) > 3 and sum(len(r["labels"]) for r in rows) == 100 and sum(sum(r["labels"]) for r in rows) == 34
    net, slow = toxicity_cnn.Network(), toxicity_cnn.Network()
    for n in (net, slow):
        n.shared = sum(np.frombuffer(r["shared"], np.int64) for r in rows)
        n.embed[:-1][n.shared < toxicity_cnn.LEAST_TEXTS] = 0
    toxicity_cnn._passes(net, shards)
    before, _ = slow.table()
    total, steps = np.zeros((len(before), 2 * toxicity_cnn.DIM)), np.zeros(len(before))
    for r in rows:
        own = copy.deepcopy(slow)
        touched = toxicity_cnn.Shard(r).learn(own, toxicity_cnn.weight_of(34, 100), 0)
        total += np.concatenate(own.table(), 1) * touched[:, None]
        steps += touched
    want = np.concatenate(slow.table(), 1)
    want[steps > 0] = total[steps > 0] / steps[steps > 0, None]
    assert np.allclose(np.concatenate(net.table(), 1), want, atol=1e-4) and np.abs(want[:, : toxicity_cnn.DIM] - before).max() > 0.05
    assert not net.embed[:-1][net.shared < toxicity_cnn.LEAST_TEXTS].any()


def test_forest_of_many_near_prints_takes_little_memory():
    fps = np.unique(np.random.default_rng(3).integers(0, 1 << 11, 2_000))  # all within 11 bits
    rows = np.stack([np.zeros_like(fps)] * 3 + [fps, np.full_like(fps, simhash_gph.BOTH)])
    tracemalloc.start()
    try:
        out = simhash_gph._trees(rows, 11)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    apart = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)).astype(np.int64)
    i, j = np.nonzero(apart)
    want = simhash_gph.spanning(np.stack([fps[i], fps[j], apart[i, j]]))  # all pairs at once
    assert out.num_rows == len(fps) - 1 and set(zip(*(c.to_pylist() for c in out.columns), strict=True)) == set(zip(*want[:2].tolist(), strict=True))
    assert peak < 60e6


def test_toxicity_shard_is_packed_in_little_memory():
    texts = ["the a b c d e f g h i " * 10] * 4_000  # 400,000 words
    tracemalloc.start()
    try:
        row = toxicity_cnn.Shard.packed(0, texts, [0] * 4_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 * 400_000 and set(row["languages"]) == {0}


def test_toxicity_train_starts_no_workers_for_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("rows go through Python workers of their own"))
    fitted, fit = [], toxicity_cnn.Network.fit
    monkeypatch.setattr(toxicity_cnn.Network, "fit", lambda self, texts, y: fitted.extend(zip(texts, y.tolist(), strict=True)) or fit(self, texts, y))
    toxicity_cnn.train(docs, labels, F.lit(True))
    assert sorted(fitted) == sorted((("vile " if i % 2 else "kind ") * 9, i % 2) for i in range(40))


def test_toxicity_odd_tables(spark, docs, toxic):
    labels = toxic[1]
    assert toxicity_cnn.score(docs, labels).count() == docs.count()
    assert toxicity_cnn.score(empty(spark), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity_cnn.score(docs, none).collect()} == {0.0}


# 7
def test_order_minhash(spark, docs):
    out = order_minhash.fingerprints(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        f, g, h = (order_minhash.sketch(order_minhash.codes_of(x)) for x in (text, edited, after))
        want.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest(), order_minhash.as_text(f), order_minhash.as_text(g), (f == g).mean(), (f == h).mean()))
    assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(want)
    assert order_minhash.fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "alone in the world")], "doc_id long, text string")
    assert order_minhash.fingerprints(one).first().near_next == 1.0


@pytest.mark.parametrize("border", [64, 512, 1024, 4096, 8192])
def test_order_minhash_across_a_power_of_two(border):
    rng = random.Random(border)
    text = words(rng, border, 5_000)[: border + order_minhash.K - 1]
    s = lambda t: order_minhash.sketch(order_minhash.codes_of(t))
    for cut in range(-1, 2):
        one = text[: len(text) + cut] + "." * (cut > 0)
        assert order_minhash.likeness(s(one), s(one + "x")) > 0.85


def slow_sketch(text):
    """Slot by slot: rank every numbered k-mer, take the first ones, hash them in text order."""
    k, mask = min(order_minhash.K, len(text)), (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    prime, hashes, times, numbers = int(order_minhash._PRIME), [], Counter(), []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * prime + ord(c) + 1) & mask
        hashes.append(mix(h))
        kind = hashes[-1] >> 20
        numbers.append(mix((kind + times[kind] * prime + 1) & mask) >> 32)
        times[kind] += 1
    out = []
    for first, second in zip(*order_minhash._KEYS.tolist(), strict=True):
        ranked = sorted(range(len(hashes)), key=lambda i: ((numbers[i] ^ first) * second & 0xFFFFFFFF, i))
        chosen = sorted(ranked[: order_minhash.PICKED])
        h = min(order_minhash.PICKED, len(hashes))
        for i in chosen:
            h = mix((h * prime + hashes[i]) & mask)
        out.append(h >> 48)
    return out


def test_order_minhash_slot_by_slot(monkeypatch):
    rng = random.Random(3)
    texts = ["a", "ab", "abcde", "abcdef", "aaaaaaaaaa", "é😀" * 30, words(rng, 12), words(rng, 200, 20)]
    for cells in (1, 1 << 18):
        monkeypatch.setattr(order_minhash, "_CELLS", cells)
        for t in texts:
            assert order_minhash.sketch(order_minhash.codes_of(t)).tolist() == slow_sketch(t)


def test_order_minhash_slots_are_independent():
    rng = random.Random(5)
    s = lambda t: order_minhash.sketch(order_minhash.codes_of(t))
    assert len(set(s(" ".join(f"word{rng.randrange(10**6)}" for _ in range(10))).tolist())) > 100
    got = []
    for _ in range(300):
        ws = [f"word{rng.randrange(10**6)}" for _ in range(10)]
        got.append(order_minhash.likeness(s(" ".join(ws)), s(" ".join([*ws[:5], f"word{rng.randrange(10**6)}", *ws[6:]]))))
    assert np.std(got) < 0.06  # about 0.044 for independent slots


def test_order_minhash_sees_order():
    rng = random.Random(7)
    a, b = words(rng, 60), words(rng, 60)
    s = lambda t: order_minhash.sketch(order_minhash.codes_of(t))
    swapped = order_minhash.likeness(s(f"{a} {b}"), s(f"{b} {a}"))
    edited = order_minhash.likeness(s(f"{a} {b}"), s(f"{a} {b}".replace("w7", "w8", 1)))
    assert edited > 0.7 > swapped


# 8
def plain_base(texts, train):
    counts = Counter(w for t in train for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()))
    n, v, end = sum(counts.values()) + len(train), len(counts) + bool(train), len(train)
    out = []
    for t in texts:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        cs = [counts[w] for w in ws] + [end]
        out.append((len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 1) / (n + v + 1)) for c in cs)))
    return out


def test_ppm_base_and_order(spark, docs):
    out = ppm.score(docs, ppm.crc_mod("doc_id", 7) == 2).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    want = plain_base([t for _, t in rows], [t for i, t in rows if not held(i)])
    ours = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert ours == sorted((str(i), held(i), a, b, c, round(d, 6)) for (i, _), (a, b, c, d) in zip(rows, want, strict=True))
    assert all(r.score < 0 for r in out)
    assert ppm.score(empty(spark), F.lit(False)).count() == 0


def slow_ppm(train, nodes_of, order):
    """Escape and exclusion step by step over plain counts."""

    def logp(context, symbol):
        p, ruled = 1.0, set()
        for j in range(order, -1, -1):
            ctx = context[len(context) - j :] if j else ()
            kept = nodes_of(ctx)
            if kept is None:
                continue
            counts, total = kept
            open_ = {s: c for s, c in counts.items() if s not in ruled}
            pruned = total - sum(counts.values())
            whole = sum(open_.values()) + pruned + len(open_)
            if symbol in open_:
                return math.log10(p * open_[symbol] / whole)
            if whole:
                p *= (pruned + len(open_)) / whole
            ruled = set(counts)
        return math.log10(p / (ppm.SYMBOLS - len(ruled)))

    return logp


@pytest.mark.parametrize("least", [1, 2, 4])
def test_ppm_trie_against_plain_ppm(least):
    rng = random.Random(8)
    train = ["".join(rng.choice("abé ") for _ in range(rng.randrange(40))) for _ in range(12)]
    order = ppm.ORDER
    full = Counter()
    for t in train:
        s = [ppm.START] * order + list(t.encode()) + [ppm.END]
        for i in range(order, len(s)):
            for j in range(order + 1):
                full[tuple(s[i - j : i + 1])] += 1
    nodes = []
    for j in range(order + 1):
        kept = {k: c for k, c in full.items() if len(k) == j + 1 and c >= least}
        keys = np.array([sum(b << 8 * (j - n) for n, b in enumerate(k)) for k in kept], np.uint64)
        at = np.argsort(keys)
        nodes.append((keys[at], np.array(list(kept.values()), np.int64)[at]))
    seen = sum(c for k, c in full.items() if len(k) == 1)
    trie = ppm.Trie(nodes, len(train), seen)

    def nodes_of(ctx):
        counts = {k[-1]: c for k, c in full.items() if len(k) == len(ctx) + 1 and k[:-1] == ctx and c >= least}
        return (counts, sum(c for k, c in full.items() if len(k) == len(ctx) + 1 and k[:-1] == ctx)) if counts else None

    slow = slow_ppm(train, nodes_of, order)
    texts = [*train[:4], "ab zzz é", ""]
    fast = ppm.Scorer(trie, bits=6).totals(texts)
    for t, got in zip(texts, fast, strict=True):
        s = [ppm.START] * order + list(t.encode()) + [ppm.END]
        assert got == pytest.approx(sum(slow(tuple(s[i - order : i]), s[i]) for i in range(order, len(s))))
    every = [b for b in range(256) if b != ppm.START]
    for ctx in [(ppm.START,) * order, tuple(b"a" * order), tuple(b"zab" + b"a" * order)[-order:]]:
        keys = np.array([sum(b << 8 * (order - n) for n, b in enumerate((*ctx, s))) for s in every], np.uint64)
        assert (10 ** trie.log10(keys)).sum() == pytest.approx(1)


@pytest.mark.parametrize("hot", [1, 64, 1 << 21])
def test_ppm_scores_do_not_depend_on_the_cache(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_GRAMS", hot)
    monkeypatch.setattr(ppm, "_BUCKET", 500)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    train = [t for i, t in rows if not held(i)]
    nodes = []
    keys, counts = np.unique(ppm.symbols(train)[0], return_counts=True)
    for j in range(ppm.ORDER + 1):
        nodes.append(ppm.merge([(keys & np.uint64((1 << 8 * (j + 1)) - 1), counts)]))
    scorer = ppm.Scorer(ppm.Trie(nodes, len(train), int(counts.sum())), bits=8)
    want = sorted((str(i), round(float(x), 4)) for (i, _), x in zip(rows, scorer.totals([t for _, t in rows]), strict=True))
    out = ppm.score(docs, ppm.crc_mod("doc_id", 7) == 2).collect()
    ours = sorted((str(r.doc_id), round(r.score, 4)) for r in out)
    assert [i for i, _ in ours] == [i for i, _ in want]
    assert [x for _, x in ours] == pytest.approx([x for _, x in want], abs=1e-3)


def test_ppm_whole_query_against_step_by_step_ppm(spark, monkeypatch):
    for name, value in (("_RAW", 60), ("_FLUSH_GRAMS", 50), ("_FLUSH_WORDS", 10), ("_FLUSH_ASKS", 40), ("_ROWS", 3), ("_BUCKET", 30), ("HOT_GRAMS", 40), ("HOT_WORDS", 20)):
        monkeypatch.setattr(ppm, name, value)  # many flushes and buckets
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", " ", "zz new"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    full, order = Counter(), ppm.ORDER
    symbols = lambda t: [ppm.START] * order + list((t or "").encode()) + [ppm.END]
    train = [t for i, t in enumerate(texts) if i % 4]
    for t in train:
        s = symbols(t)
        full.update(tuple(s[i - j : i + 1]) for i in range(order, len(s)) for j in range(order + 1))
    contexts = {}
    for k, c in full.items():
        contexts.setdefault(k[:-1], {})[k[-1]] = c
    slow = slow_ppm(train, lambda ctx: (contexts[ctx], sum(contexts[ctx].values())) if ctx in contexts else None, order)
    got = {r.doc_id: r for r in ppm.score(docs, F.col("doc_id") % 4 == 0).collect()}
    assert len(got) == len(texts)
    for (i, t), (n, known, _, base) in zip(enumerate(texts), plain_base([t or "" for t in texts], [t or "" for t in train]), strict=True):
        s = symbols(t)
        assert got[i].score == pytest.approx(sum(slow(tuple(s[j - order : j]), s[j]) for j in range(order, len(s))))
        assert (got[i].n_tokens, got[i].n_known, got[i].base_score) == (n, known, pytest.approx(base))


def test_ppm_rare_contexts_stay_in_the_model(spark):
    text = "common words here " * 3_000  # pads the corpus
    seldom = "qz xk vj"
    score = lambda pad: {r.doc_id: r.score for r in ppm.score(spark.createDataFrame([(i, t) for i, t in enumerate([seldom] * 2 + [text] * pad)], "doc_id long, text string"), F.col("doc_id") == 0).collect()}[0]
    assert score(40) > score(1) - 9


# 9
def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(9)
    html = ["<p>same</p>", "", None, "a\r\n\r\nb", "WARC/1.1\r\n\r\n", "é\u2028x" * 9, words(rng, 4_000)]
    rows = [(i, f"http://x/{i}\n z", html[i % 7], "c") for i in range(30)] + [(3, "u", html[3], "c"), (29, None, "<p>same</p>", "c"), (29, None, "<p>same</p>", "c"), (None, "u", "lonely", "c")]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), f"file://{tmp_path}/w").collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in out) == sorted((str(p), len((h or "").encode())) for p, _, h, _ in rows)
    body_of = {}
    for r in out:
        if r.record_type == "response":
            assert r.payload_digest not in body_of
            body_of[r.payload_digest] = (r.page_id, bytes(r.payload))
    for p, _, h, _ in rows:
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        assert body_of[digest][1] == (h or "").encode()
    largest = {}
    for p, _, h, _ in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    for r in out:
        if r.record_type == "revisit":
            assert r.refers_to == body_of[r.payload_digest][0] and r.payload is None
    assert {largest[b.decode()] for _, b in body_of.values()} == {-1 if p is None else p for p, _ in body_of.values()}
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e").count() == 0


def test_warc_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 2_000)
    rows = [(i, f"http://x/{i % 9}", f"page {i % 7} " * (1 + i % 5) * 20) for i in range(40)] + [(3, "http://x/3", "page 3 " * 80)] * 2 + [(90, None, "long " * 3_000)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w").count()
    files = [warc.gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")]
    found = [list(warc.parse_archive(raw)) for raw in files]
    assert len(files) > 5 and all(len(raw) < 3_000 or len(f) == 2 for raw, f in zip(files, found, strict=True))
    assert all(f[0][0]["warc-type"] == "warcinfo" and all(h["warc-type"] != "warcinfo" for h, _ in f[1:]) for f in found)
    heads = [h for f in found for h, _ in f[1:]]
    by_id = {h["warc-record-id"]: h for h in heads}
    assert len(by_id) == len(heads) == len(rows) and len({h["warc-date"] for h in heads}) == 1 and heads[0]["warc-date"] > "2020"
    for h in heads:
        if h["warc-type"] == "revisit":
            first = by_id[h["warc-refers-to"]]
            assert first["warc-type"] == "response" and first["warc-payload-digest"] == h["warc-payload-digest"]
            assert (first["warc-target-uri"], first["warc-date"], first["x-page-id"]) == (h["warc-refers-to-target-uri"], h["warc-refers-to-date"], h["x-refers-to-page"])


def test_warc_small_payloads_stay(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/s", least_bytes=4).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


# 10
def plain_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    inside = set()
    for i in range(len(ws) - 2):
        if windows[tuple(ws[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, docs):
    out = divergence.quality_counts(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        c = plain_counts(r.text or "")
        want.append((str(r.doc_id), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == sorted(want)
    assert not any(r.kept and r.base_failed for r in out)
    assert divergence.quality_counts(empty(spark)).count() == 0


def test_quality_divergence(spark):
    rng = random.Random(10)
    common = "the and of to in is that it was for".split()
    clean = [" ".join(rng.choice(common) if rng.random() < 0.4 else f"w{'abcdefghij'[rng.randrange(10)]}{'klmnop'[rng.randrange(6)] * 3}" for _ in range(120)) for _ in range(60)]
    junk = [" ".join(f"%%{rng.randrange(10**6)}$$#" for _ in range(120)) for _ in range(4)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in divergence.quality(df).filter("kept").collect()}
    assert kept == set(range(60))


def plain_histograms(text):
    """Shares of character classes (upper, other letters, digits, stops, symbols, the rest) and of common words."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = [c for w in ws for c in w]
    kind = lambda c: 0 if unicodedata.category(c) == "Lu" else 1 if unicodedata.category(c)[0] == "L" else 2 if c in "0123456789" else 3 if c in ".,;:'\"!?()-" else 4 if c in "#*$%&|<>" else 5
    classes = Counter(map(kind, chars))
    counts = Counter(w if w in divergence.COMMON_WORDS else None for w in ws)
    return [classes[k] / max(1, len(chars)) for k in range(6)], [counts[w] / max(1, len(ws)) for w in [*divergence.COMMON_WORDS, None]]


def plain_distance(p, q):
    part = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True))
    return math.sqrt(max(0.0, part / 2))


def test_quality_verdicts_step_by_step(spark):
    rng = random.Random(12)
    texts = {}
    for lang, common in (("en", "the and of to in is that it was for"), ("de", "der die und das den von mit sich"), (None, "le la les des et un")):
        for n in range(41):
            symbols = rng.choice([0, 0, 0, 0.1, 0.4, 0.9])
            word = lambda c=common, s=symbols: "".join(rng.choice("abcÉß,9") for _ in range(4)) if rng.random() < 0.6 else rng.choice(c.split()) if rng.random() > s else "$#%"
            texts[lang, n] = " ".join(word() for _ in range(rng.choice([3, 55, 60, 200])))
    rows = [(i, t, lang, "clash") for i, ((lang, _), t) in enumerate(texts.items())] + [(999, None, "en", "c"), (999, "", "xx", "c")]
    got = {(r.doc_id, r.lang): r for r in divergence.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept0 string")).collect()}
    shown = {i: plain_histograms(t or "") for i, t, _, _ in rows}
    decided = Counter()
    for lang in {lang for _, _, lang, _ in rows}:
        known = [i for i, t, own, _ in rows if own == lang and plain_counts(t or "")[0] >= divergence.MIN_WORDS]
        if known:
            middle = [sorted(shown[i][0][k] for i in known)[-(-len(known) // 2) - 1] for k in range(6)]
            reference = [x / sum(middle) for x in middle], [sum(shown[i][1][k] for i in known) / len(known) for k in range(len(divergence.COMMON_WORDS) + 1)]
        for i, t, own, _ in rows:
            if own != lang:
                continue
            counts, r = plain_counts(t or ""), got[i, lang]
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            if known and (t or "").strip():
                apart = [plain_distance(shown[i][k], reference[k]) for k in (0, 1)]
                assert (r.class_distance, r.word_distance) == (pytest.approx(apart[0], abs=1e-9), pytest.approx(apart[1], abs=1e-9))
                unsure = 1 / math.sqrt(max(1, counts[0]))
                far = apart[0] > divergence.CLASS_LIMIT + divergence.CLASS_NOISE * unsure or apart[1] > divergence.WORD_LIMIT + divergence.WORD_NOISE * unsure
                assert r.kept == (not failed and not (far and counts[0] >= divergence.MIN_WORDS))
                decided[failed, r.kept] += 1
            else:
                assert not r.kept
    assert decided[False, True] > 20 and decided[False, False] > 5


def test_quality_is_native(spark, docs):
    plan = divergence.quality(docs.select("doc_id", "text", "lang"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.5, 0.5, 0.0]), ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(divergence.distance("p", "q")).collect()] == pytest.approx([0, 1])


def test_every_query_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11)) and queries.ORACLES.keys() <= queries.QUERIES.keys()

"""Byte-level BPE, encoded and decoded exactly, with tree concatenation for long texts.

A text of up to ``leaf`` code points is encoded at once. A longer one is halved until the parts
are leaves, the leaves are encoded in parallel, and neighbours are joined bottom-up: a window of
tokens around each join is encoded again and grown until it agrees with both sides. Agreement is
exact, not a matter of likelihood:

* a place where a non-space character is followed by white space always starts a new pre-token,
  whatever stands around it, so two encodings that both have a token boundary there agree beyond it;
* inside one run of letters (or digits) two neighbouring tokens may stay together exactly if
  encoding their joined text gives the same two tokens; a token sequence whose neighbours all pass
  that test is the BPE encoding of the run.

A window that never agrees grows to the whole text, which is the plain encoding.

Defined cases: null text is empty; the empty text has no ids; added special tokens written in a
text become their id, as the tokenizer file says; repeated rows are encoded like any others; a very
long text takes memory in proportion to its own length, and one that is a single run of letters is
joined like any other; where several windows agree the smallest counts, and all of them give the same
ids; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.runtime import only, slices, text_of

#: Code points of a leaf; texts of at least ``SHARED`` leaves are encoded by several threads.
LEAF, SHARED = 1_024, 64

#: Fixed value: the pre-token pattern of the vocabulary file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class TreeBpe:
    """Encoder and decoder over a byte-level ``tokenizers`` JSON file."""

    def __init__(self, path: str, leaf: int = LEAF, threads: int = 2):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in k): v for k, v in vocab.items() if k not in specials}
        self.leaf, self.threads, self.pool = leaf, threads, None
        self.specials = specials
        self._enc = tiktoken.Encoding("weft", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *specials.values()]) + 1
        self.pieces = [b""] * size
        for k, v in ranks.items():
            self.pieces[v] = k
        for k, v in specials.items():
            self.pieces[v] = k.encode()
        self.decimal = [str(i) for i in range(size)]

    # -- encoding ---------------------------------------------------------------------------
    def _plain(self, text: str) -> np.ndarray:
        return self._enc.encode_to_numpy(text).astype(np.uint32, copy=False) if text else np.empty(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_batch([text])[0], dtype=np.uint32)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if any(s in text for s in self.specials):
                out.append(self._with_specials(text))
            else:
                out.append((self.tree(text) if len(text) > self.leaf else self._plain(text)).tobytes())
        return out

    def _with_specials(self, text: str) -> bytes:
        parts, rest = [], text
        while rest:
            places = [(rest.find(s), -len(s), s) for s in self.specials if s in rest]
            at, _, mark = min(places, default=(len(rest), 0, ""))
            parts += self.encode_batch([rest[:at]])
            if mark:
                parts.append(np.array([self.specials[mark]], np.uint32).tobytes())
            rest = rest[at + len(mark) :]
        return b"".join(parts)

    def tree(self, text: str) -> np.ndarray:
        """Encode leaves in parallel, then join neighbours level by level."""
        cuts = [0]
        depth = max(0, (max(len(text), 1) - 1) // self.leaf).bit_length()
        for k in range(1, 1 << depth):
            cuts.append(len(text) * k >> depth)
        cuts.append(len(text))
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        run = map
        if len(parts) >= SHARED and self.threads > 1:
            self.pool = self.pool or ThreadPoolExecutor(self.threads)  # one for the encoder's life
            run = self.pool.map
        level = list(run(self._plain, parts))
        while len(level) > 1:
            level = list(run(lambda p: self.join(*p), zip(level[::2], level[1::2], strict=True)))
        return level[0]

    def join(self, left: np.ndarray, right: np.ndarray, window: int = 16) -> np.ndarray:
        """The encoding of both texts together, from the encodings of each."""
        while window < max(len(left), len(right)):
            a, b = max(0, len(left) - window), min(window, len(right))
            text = self._text(left[a:], right[:b])
            if text is not None:
                middle = self._plain(text)
                before = a == 0 or self._holds(int(left[a - 1]), int(middle[0]))
                after = b == len(right) or self._holds(int(middle[-1]), int(right[b]))
                if before and after:
                    return np.concatenate([left[:a], middle, right[b:]])
            window *= 2
        return self._plain(self._text(left, right))

    def _text(self, *ids: np.ndarray) -> str | None:
        raw = b"".join(self.pieces[i] for part in ids for i in part.tolist())
        try:
            return raw.decode()
        except UnicodeDecodeError:  # the window begins or ends inside a character
            return None

    def _holds(self, x: int, y: int) -> bool:
        """Whether the border between two neighbouring tokens is one in every encoding around it."""
        try:
            a, b = self.pieces[x].decode(), self.pieces[y].decode()
        except UnicodeDecodeError:
            return False
        if not a[-1].isspace() and b[0] == " " and len(b) > 1 and not b[1].isspace():
            return True
        core = a[1:] if a[0] == " " and len(a) > 1 else a
        if (core.isalpha() and b.isalpha()) or (core.isdecimal() and b.isdecimal()):
            return self._plain(a + b).tolist() == [x, y]
        return False

    # -- decoding ---------------------------------------------------------------------------
    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, np.uint32).tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def joined(self, ids: bytes) -> str:
        return ",".join(map(self.decimal.__getitem__, np.frombuffer(ids, np.uint32).tolist()))


_loaded: dict[tuple, TreeBpe] = {}


def worker_encoder(path: str, leaf: int = LEAF) -> TreeBpe:
    """One encoder for a Python worker's life."""
    if (path, leaf) not in _loaded:
        _loaded[path, leaf] = TreeBpe(path, leaf)
    return _loaded[path, leaf]


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(key, ids as binary of unsigned 32-bit, n_tokens) for every row; other columns don't matter."""

    def run(batches):
        bpe = worker_encoder(vocabulary, leaf)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = bpe.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["__key", "ids", "n_tokens"])

    src = only(docs, key, text).select(F.col(key).alias("__key"), text_of(text).alias("__text"))
    kind = dict(src.dtypes)["__key"]
    return src.mapInArrow(run, f"__key {kind}, ids binary, n_tokens long").withColumnRenamed("__key", key)


def decode_ids(encoded: DataFrame, vocabulary: str, key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """(key, text) back from ``encode_documents``."""

    def run(batches):
        bpe = worker_encoder(vocabulary, leaf)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__key", "text"])

    src = encoded.select(F.col(key).alias("__key"), "ids")
    return src.mapInArrow(run, f"__key {dict(src.dtypes)['__key']}, text string").withColumnRenamed("__key", key)


def round_trip_digests(docs: DataFrame, vocabulary: str, leaf: int = LEAF) -> DataFrame:
    """Per document: token count, hash of the ids and hash of the text decoded from those ids."""

    def run(batches):
        bpe = worker_encoder(vocabulary, leaf)
        sha = hashlib.sha256
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = bpe.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(a, b - a),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(bpe.joined(x).encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([sha(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    src = only(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")

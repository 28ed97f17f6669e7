"""Best-fit packing of documents into fixed-length token sequences.

Bounded-space online best-fit: at most ``open_bins`` sequences are open at a time. They hang in
stacks by free space, and a bitset (one bit for each free space from 0 to ``capacity``) finds the
tightest open bin that still takes a piece with two bit operations. When one bin too many is open,
the fullest closes first. A full bin closes at once.

A document is its ids and one end id. Only a document longer than ``capacity`` is cut, into pieces
of ``capacity`` tokens; the first piece is the one that may be shorter, and pieces of full length
are sequences of their own.

Spark's part: tokens are counted where the documents lie; only (document, piece, length, checksum)
is shuffled, dealt evenly over a few packing tasks by a hash and sorted there, so that a retried
task packs in the same way. Each packing task holds ``open_bins`` bins and one batch of pieces, so
its memory doesn't grow with the input. Pieces arrive in blocks of ``LOOKAHEAD``, and a block's
longest pieces are placed first. Sequence numbers are the task's number and a count.

Defined cases: a null text is empty and has the end id alone; repeated rows are packed each; a very long
text is cut after it has been encoded whole, in memory for one text; of equal lengths the one that comes
first is placed first, and of equal bins the one opened last is taken; an empty table gives no pieces; null
ids are kept; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.bpe_tree import worker_encoder
from weftgraph.llm.runtime import only, slices, text_of

#: Code points that are encoded at once; longer texts go through the tree of ``bpe_tree``. The ids are the same.
LEAF = 16_384
#: Pieces to a packing task: enough that the bins left open at its end don't count. Pieces are reckoned as the
#: documents and one more for each ``PIECE_BYTES`` of text, before any is made.
PIECES_PER_TASK, PIECE_BYTES = 400_000, 2_048
#: Pieces that are taken together, longest first.
LOOKAHEAD = 6_000


class BestFit:
    """Online best-fit over bounded space; ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = self.stacks[free]
            which = stack.pop()
            if not stack:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            which, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            stack = self.stacks[left]
            if not stack:
                self.bits |= 1 << left
            stack.append(which)
            self.open += 1
            if self.open > self.open_bins:
                self._close_fullest()
        return which, self.capacity - free

    def _close_fullest(self) -> None:
        least = self.bits & -self.bits
        stack = self.stacks[least.bit_length() - 1]
        stack.pop(0)
        if not stack:
            self.bits ^= least
        self.open -= 1


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is over."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches):
        bpe = worker_encoder(vocabulary, LEAF)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                out: list[tuple] = []
                for key, ids in zip(keys[a:b], bpe.encode_batch(texts[a:b]), strict=True):
                    ids += end
                    for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        out.append((key, n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                cols = list(zip(*out, strict=True))
                kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = only(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, tasks: int, capacity: int = 1024, open_bins: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of at most ``capacity``."""

    def run(batches):
        task, bins = TaskContext.get().partitionId(), BestFit(capacity, open_bins)
        for batch in (b.slice(s, LOOKAHEAD) for b in batches for s in range(0, b.num_rows, LOOKAHEAD)):
            lengths = batch.column("length").to_numpy()
            placed = [(0, 0)] * len(lengths)
            for i in np.argsort(-lengths, kind="stable").tolist():
                placed[i] = bins.place(int(lengths[i]))
            which = pa.array([(task << 40) + w for w, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, which, pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    order = [c for c in parts.columns if c != "length"]
    dealt = parts.repartition(tasks, F.xxhash64(*parts.columns)).sortWithinPartitions(F.xxhash64(*order), *order)
    kinds = ", ".join(f"`{c}` {k}" for c, k in parts.dtypes)
    return dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, open_bins: int = 4096) -> DataFrame:
    """All documents as pieces of sequences; the task count follows the number of pieces."""
    rows, size = only(docs, "doc_id", "text").agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()
    tasks = max(1, -(-(rows + size // PIECE_BYTES) // PIECES_PER_TASK))
    return pack(pieces(docs, vocabulary, capacity, end_id), tasks, capacity, open_bins)

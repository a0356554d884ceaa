"""Best-fit-decreasing packing of token sequences into training windows.

Overlong documents are first cut into full windows; what is left of each document goes, longest first, to the open
window with the least room that still holds it.  Open windows hang in a segment tree indexed by remaining capacity, so
the tightest fit is found in O(log window).  Packing is done per block: a task's documents are gathered until they hold
``block_tokens`` tokens (about a thousand windows), packed, emitted and forgotten, so memory is bounded whatever the
partition's size, a document never leaves its task, and a rerun task replaces all of its own windows.

Defined results: null text counts as empty, an empty document is its end-of-text id alone, very long texts are cut as
often as needed, repeated rows are packed separately, an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.bpe import VOCABULARY, encoder
from gridloom.llm.common import parts_of, table

WINDOW = 4096
#: Id put after every document.
END_OF_TEXT = 2
#: Tokens packed together before a block is emitted.
BLOCK_TOKENS = 4_000_000


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities finds the smallest that is large enough."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << max(1, window.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.at.setdefault(capacity, []).append(window)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest open window with room for ``size``, as (capacity, window); taken out of the tree."""
        count, node = self.count, self.leaves + size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each size (each at most ``window``), and how many windows there are; ties keep their order."""
    bins, offsets, opened, tree = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0, OpenWindows(window)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room, own = tree.take(size) or (window, opened)
        opened += own == opened
        bins[i], offsets[i] = own, window - room
        if room > size:
            tree.put(room - size, own)
    return bins, offsets, opened


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_OF_TEXT, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document (columns doc_id and text are read), placed in a window.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers, the form training files use.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def place(block: list[tuple[pa.Array, np.ndarray, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        keys = pa.concat_arrays([k for k, _, _ in block])
        sizes, flat = (np.concatenate([b[i] for b in block]) for i in (1, 2))
        block.clear()
        pieces = -(-sizes // window)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        length = np.minimum(window, sizes[doc] - start)
        bins, offsets, opened = best_fit_decreasing(length, window)
        ends = pa.array(4 * np.concatenate([[0], np.cumsum(length)]), pa.int32())
        raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, ends.buffers()[1], pa.py_buffer(flat.astype("<u4", copy=False))])
        columns = [keys.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, sizes[doc], bins + first, offsets))]
        return pa.RecordBatch.from_arrays([*columns, raw], PIECES.names), first + opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = encoder(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        block: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for part in parts_of(batch, "text"):
                flat, ends = own.encode(part.column("text"))
                flat = np.insert(flat.view(np.uint32), ends, end_id)
                block.append((part.column("doc_id"), np.diff(ends, prepend=0) + 1, flat))
                held += len(flat)
                if held >= block_tokens:
                    out, first = place(block, first)
                    held = 0
                    yield out
                    del out
        if block:
            yield place(block, first)[0]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens; ids reduced to their crc32."""
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Best-fit packing of tokenised documents into fixed-length sequences (operator 3).

Bounded-space online best-fit: at most ``open_bins`` sequences are open; a bitset keyed by free
space finds the tightest fit in one scan of a 2049-bit integer; when a new sequence is needed and
the limit is reached, the fullest open one closes first.  A piece is placed as it comes and never moved.

Packing needs lengths only.  Documents are tokenised once where they are read, and pieces (a few dozen
bytes each) are dealt over ``pieces / pieces_per_task`` tasks, where they come in the order of a hash of
theirs, so that every task sees the same mix of lengths and a task that is run again packs alike.

Defined cases: a null or empty text is one piece holding the end id alone; repeated rows are packed
like any other rows; an empty table gives no rows; a null id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text, stored

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


class BestFit:
    """Open bins by free space; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free_bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.at[free]
        found = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.limit:  # the fullest closes first
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, found = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.at[left].append(found)
            self.free_bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def cut(batches):
        known = tokens.load(tokenizer)
        for batch in batches:
            for first, ids, off in known.runs(batch.column(1), end_id):
                own = np.repeat(np.arange(len(off) - 1), -(-np.diff(off) // capacity))
                piece = np.arange(len(own)) - np.searchsorted(own, own)
                at = off[own] + piece * capacity
                size = np.minimum(off[own + 1] - at, capacity)
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + first)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024, pieces_per_task: int = 131_072, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``open_bins`` bounds what a task holds open; each task ends with some sequences half full, so fewer,
    larger lots (``pieces_per_task``) waste less.
    """
    pieces = stored(tokenised_pieces(id_and_text(docs, id_col, text_col), tokenizer or tokens.default_path(), capacity, end_id), "pieces")
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece")

    def place(batches):
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in found], pa.int64()), pa.array([at for _, at in found], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, PACKED_SCHEMA)

"""Token ids as one wavelet matrix per shard (operator 9).

A shard holds whole documents in ascending id order.  Its file is::

    b"WMX2" | uint32 header length | header (JSON) | document table | plane 0 | plane 1 | ...

Plane ``l`` has one bit per token (bit ``levels-1-l`` of the id, tokens stably parted by the earlier
bits) and, behind its bits, its rank directory: the ones before each 512-bit block, as uint32.  With
it ``rank`` is a popcount in a block and ``select`` a binary search over the directory; access, counting
and occurrence lookup follow from these alone, for one place or for many at once.

The document table and every plane are sections of their own: zstd-compressed where that saves a tenth,
else as they are.  A reader takes from the file only the planes it asks for; an uncompressed plane's bits
and directory are used in place, without a copy.

Shards are written as rows of a Parquet table (payload = one file's bytes) by Spark's committer, so
a lost executor leaves no half-written file and any store works; ``payload`` can be written to a
file of its own unchanged.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text, stored

MAGIC = b"WMX2"
BLOCK = 512
SHARD_SCHEMA = "part int, seq int, tokens_before long, n_tokens long, n_docs long, payload binary"


def _bits(bits: np.ndarray, n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])


def _plane_of(values: pa.Array, shift: int) -> tuple[np.ndarray, pa.Array, int]:
    """(packed bits, values stably parted by them, number of zeros)."""
    own = values.to_numpy()
    bits = np.packbits((own & own.dtype.type(1 << shift)) != 0, bitorder="little")
    zeros, ones = values.filter(_bits(~bits, len(values))), values.filter(_bits(bits, len(values)))
    return bits, pa.concat_arrays([zeros, ones]), len(zeros)


def _section(raw: bytes, level: int) -> tuple[bytes, bool]:
    small = zstandard.ZstdCompressor(level=level).compress(raw)
    return (small, True) if 10 * len(small) <= 9 * len(raw) else (raw, False)


class WaveletShard:
    """A wavelet matrix over the ids of some documents, and their document table."""

    def __init__(self, header: dict, sections: list[memoryview]):
        self.n, self.levels, self.zeros = header["n"], header["levels"], header["zeros"]
        self._sections, self._small, self._planes = sections, header["small"], {}
        table = np.frombuffer(self._raw(0), "<i8")
        self.null_ids = set(header["null_ids"])
        self.doc_ids, self.doc_starts = table[: header["docs"]], table[header["docs"] :]

    @classmethod
    def to_bytes(cls, ids: np.ndarray, doc_ids: list, doc_starts: np.ndarray, level: int = 1) -> bytes:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        values = pa.array(ids.astype(np.uint16 if levels <= 16 else np.uint32))
        null_ids = [k for k, d in enumerate(doc_ids) if d is None]
        table = np.concatenate((np.asarray([0 if d is None else d for d in doc_ids], "<i8"), np.asarray(doc_starts, "<i8")))
        sections, zeros = [_section(table.tobytes(), level)], []
        for shift in reversed(range(levels)):
            bits, values, z = _plane_of(values, shift)
            padded = np.zeros((max(1, -(-len(ids) // BLOCK)), BLOCK // 8), np.uint8)
            padded.ravel()[: len(bits)] = bits
            ones = np.cumsum(np.bitwise_count(padded.view("<u8")).sum(axis=1, dtype=np.uint32), dtype="<u4")
            zeros.append(z)
            sections.append(_section(padded.tobytes() + np.append(np.zeros(1, "<u4"), ones).tobytes(), level))
        told = {"n": len(ids), "levels": levels, "zeros": zeros, "docs": len(doc_ids), "null_ids": null_ids, "sections": [len(s) for s, _ in sections], "small": [c for _, c in sections]}
        header = json.dumps(told).encode()
        return b"".join((MAGIC, struct.pack("<I", len(header)), header, *(s for s, _ in sections)))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<I", data[4:8])[0]
        header = json.loads(data[8 : 8 + size])
        sections, at, view = [], 8 + size, memoryview(data)
        for length in header["sections"]:
            sections.append(view[at : at + length])
            at += length
        return cls(header, sections)

    def _raw(self, k: int):
        return zstandard.decompress(self._sections[k]) if self._small[k] else self._sections[k]

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """A plane's packed bits (whole blocks) and its directory, as they are in the file."""
        if level not in self._planes:
            raw, size = self._raw(1 + level), max(1, -(-self.n // BLOCK)) * BLOCK // 8
            self._planes[level] = np.frombuffer(raw, np.uint8, size), np.frombuffer(raw, "<u4", offset=size)
        return self._planes[level]

    def _ones_before(self, level: int, i: int) -> int:
        bits, before = self._plane(level)
        block, rest = divmod(i, BLOCK)
        count = int(before[block])
        if rest:
            at = block * BLOCK // 8
            whole, odd = divmod(rest, 8)
            count += int(np.bitwise_count(bits[at : at + whole]).sum())
            if odd:
                count += (int(bits[at + whole]) & ((1 << odd) - 1)).bit_count()
        return count

    def _ones_before_many(self, level: int, i: np.ndarray) -> np.ndarray:
        """``_ones_before`` of many places: their blocks' directory entries and popcounts of masked words."""
        bits, before = self._plane(level)
        words = bits.view("<u8")
        block, rest = i // BLOCK, i % BLOCK
        inside = np.minimum(block, len(words) // (BLOCK // 64) - 1)[:, None] * (BLOCK // 64) + np.arange(BLOCK // 64)
        kept = np.clip(rest[:, None] - 64 * np.arange(BLOCK // 64), 0, 64).astype(np.uint64)
        mask = np.where(kept == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(kept, np.uint64(63))) - np.uint64(1))
        return before[block].astype(np.int64) + np.bitwise_count(words[inside] & mask).sum(axis=1, dtype=np.int64)

    def access_many(self, i: np.ndarray) -> np.ndarray:
        """``access`` of many places."""
        i, value = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for level in range(self.levels):
            bit = (self._plane(level)[0][i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)
            ones = self._ones_before_many(level, i)
            value = value << 1 | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return value

    def rank_many(self, token: int, i: np.ndarray) -> np.ndarray:
        """``rank`` before many places."""
        lo, hi = np.zeros(1, np.int64), np.asarray(i, np.int64)
        if token >> self.levels:
            return np.zeros(len(hi), np.int64)
        for level in range(self.levels):
            a, b = self._ones_before_many(level, lo), self._ones_before_many(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[0][i >> 3]) >> (i & 7) & 1

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        bits, before = self._plane(level)
        held = lambda b: int(before[b]) if bit else b * BLOCK - int(before[b])
        block = bisect_right(range(len(before)), k, key=held) - 1
        own = np.unpackbits(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - held(block)])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones_before(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where ``token`` begins in the last order, and where its occurrences before ``i`` end."""
        lo, hi = 0, i
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before place ``i``."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, read bottom-up: each plane deals the lower order's values back to their places."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            ones = np.unpackbits(self._plane(level)[0], count=self.n, bitorder="little").view(bool)
            z, out = self.zeros[level], np.empty_like(values)
            out[np.flatnonzero(~ones)] = values[:z]
            out[np.flatnonzero(ones)] = values[z:] | values.dtype.type(1 << (self.levels - 1 - level))
            values = out
        return values.astype("<u4")


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shard table and return it (read from storage): SHARD_SCHEMA.

    Documents are range-partitioned and sorted by id; a shard ends after ``shard_tokens`` ids (a
    longer document makes a longer shard).  ``tokens_before`` counts within its part.
    """
    tokenizer = tokenizer or tokens.default_path()
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def build(batches):
        known, part, seq, before = tokens.load(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, starts, size = [], [], [], 0

        def shard():
            payload = WaveletShard.to_bytes(np.concatenate(ids), doc_ids, np.asarray(starts))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "tokens_before", "n_tokens", "n_docs", "payload"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, run, off in known.runs(batch.column(1), end_id):
                i, n = 0, len(off) - 1
                while i < n:  # as many documents as the shard still takes, the one that fills it included
                    j = min(int(np.searchsorted(off, off[i] + shard_tokens - size)), n)
                    doc_ids += names[first + i : first + j]
                    starts += (off[i:j] - off[i] + size).tolist()
                    ids.append(run[off[i] : off[j]])
                    size += int(off[j] - off[i])
                    i = j
                    if size >= shard_tokens:
                        yield shard()
                        seq, before = seq + 1, before + size
                        ids, doc_ids, starts, size = [], [], [], 0
        if doc_ids:
            yield shard()

    return stored(ordered.mapInArrow(build, SHARD_SCHEMA), "wavelet")


def read_back(shards: DataFrame, end_id: int = 1) -> DataFrame:
    """One row per document of the shard table: doc_id, start, n_tokens, ids_crc32, last_id, n_end_ids.

    The digest is of the decoded ids; ``last_id`` (always the end id) is read by ``access`` and ``n_end_ids``
    by ``rank``, from the planes' directories alone.

    Only one total per part (a part is a task of the writer) comes to the driver.
    Null ids stay null; a null or empty text has the end id alone.
    """
    base, starts = 0, {}
    for part, total in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts[part], base = base, base + total

    def read(batches):
        for batch in batches:
            for part, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = WaveletShard.from_bytes(payload.as_py())
                ids = shard.decode()
                edges = np.append(shard.doc_starts, shard.n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                doc = pa.array(shard.doc_ids, pa.int64(), mask=np.isin(np.arange(len(crc)), list(shard.null_ids)) if shard.null_ids else None)
                # Not from the decoded ids: the last id of each document by access, the end ids in it by rank.
                last, ends = shard.access_many(edges[1:] - 1), np.diff(shard.rank_many(end_id, edges))
                yield pa.RecordBatch.from_arrays([doc, pa.array(shard.doc_starts + (starts[part] + before), pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64()), pa.array(last, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "last_id", "n_end_ids"])

    return shards.select("part", "tokens_before", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long, n_end_ids long")

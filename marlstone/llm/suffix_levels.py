"""A logarithmic family of suffix arrays over bytes (operator 7).

Where repeated anchors are dealt (see ``repeats``), the text around them arrives as runs of
consecutive windows, equal runs combined under their least document id.  Each part builds an index
in document order: a batch of runs gets a suffix array (all its window suffixes in byte order, to
the depth of one window), which is merge-scanned against every existing level for matches of full
depth; the suffixes not found become a new level, and levels of like size merge geometrically, so a
suffix is merged a logarithmic number of times.  As batches come in ascending id, a match tells the
first document of a window.

Defined cases: null and empty texts keep nothing; strings repeated within one document only are
kept; documents that share an id are one document; a null id counts as the greatest; repeated rows
with different ids are repeats; texts under ``window`` bytes are never touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import stored
from .repeats import Anchored, Chunks, covered, dealt, part_of, ragged, repeated_anchors, replies, reply_of, stretches, unpack

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BATCH_SUFFIXES = 1 << 17


class LevelIndex:
    """Sorted levels of distinct window suffixes with the first document of each."""

    def __init__(self, ratio: int = 2):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.ratio = ratio

    def add(self, suffixes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """First document of each suffix of a batch; ids are not below those of earlier batches."""
        order = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        ranked = suffixes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        keys, own = ranked[new], ids[order][new]
        unseen = np.ones(len(keys), bool)
        for level, firsts in self.levels:  # merge-scan
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            same = level[at] == keys
            own[same] = np.minimum(own[same], firsts[at[same]])
            unseen &= ~same
        if unseen.any():
            self.levels.append((keys[unseen], own[unseen].copy()))
            while len(self.levels) > 1 and len(self.levels[-2][0]) < self.ratio * len(self.levels[-1][0]):
                (a, x), (b, y) = self.levels.pop(), self.levels.pop()
                both = np.concatenate((b, a))
                merged = np.argsort(both, kind="stable")
                self.levels.append((both[merged], np.concatenate((y, x))[merged]))
        out = np.empty(len(ids), np.int64)
        out[order] = own[group]
        return out


def first_documents(text: np.ndarray, counts: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """First document of every window of some runs (run r: counts[r] windows, ids[r]).

    Runs of equal bytes are indexed once, under their least document.
    """
    edges = np.concatenate(([0], np.cumsum(counts + window - 1)))
    raw, known, order = text.tobytes(), {}, np.argsort(ids, kind="stable")
    stands = np.empty(len(ids), np.int64)
    for r, a, b in zip(order.tolist(), edges[order].tolist(), edges[order + 1].tolist(), strict=True):
        stands[r] = known.setdefault(raw[a:b], r)
    order = np.fromiter(known.values(), np.int64, len(known))
    del known
    out_at = np.concatenate(([0], np.cumsum(counts)))
    out, index = np.empty(out_at[-1], np.int64), LevelIndex()
    fill = np.cumsum(counts[order])
    begin = 0
    while begin < len(order):
        base = fill[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(fill, base + BATCH_SUFFIXES, "right")))
        runs = order[begin:end]
        starts = ragged(edges[runs], counts[runs])
        windows = np.lib.stride_tricks.sliding_window_view(text, window)[starts]
        found = index.add(np.ascontiguousarray(windows).view(f"S{window}").ravel(), np.repeat(ids[runs], counts[runs]))
        out[ragged(out_at[runs], counts[runs])] = found
        begin = end
    return out[ragged(out_at[stands], counts)]


def run_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each run of (eight or more) bytes, eight at a time; the last eight may overlap those before."""
    eight, out = tv.eight_bytes(data), tv.mix(length.astype(np.uint64))
    for k in range(0, int(length.max(initial=0)), 8):
        own = np.flatnonzero(length > k)
        out[own] = tv.joined(out[own], eight[begin[own] + np.minimum(k, length[own] - 8)])
    return out


def equal_neighbours(data: np.ndarray, content: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each run has the same bytes as the one before it (compared as bytes, where hashes agree)."""
    same = (content[1:] == content[:-1]) & (length[1:] == length[:-1])
    at, eight = np.flatnonzero(same), tv.eight_bytes(data)
    for k in range(0, int(length.max(initial=0)), 8):  # the last eight bytes may overlap those before
        step = np.minimum(k, length[at] - 8)
        at = at[eight[begin[at] + step] == eight[begin[at + 1] + step]]
    out = np.zeros(len(same), bool)
    out[at] = True
    return out


class SentRuns:
    """Runs of repeated anchors in a chunk, equal ones combined under their least document id.

    Runs of heavy anchors are taken apart into single windows, dealt by their own content: however
    many documents hold such an anchor, each in its own surroundings, no part receives them all.
    """

    def __init__(self, a: Anchored, data: np.ndarray, runs: np.ndarray, heavy: np.ndarray):
        runs = np.setdiff1d(runs, heavy)
        owner = np.concatenate((runs, np.repeat(heavy, a.run_len[heavy])))
        self.at = np.concatenate((a.run_at[runs], ragged(a.run_at[heavy], a.run_len[heavy])))  # first window, and number of windows
        self.size = np.concatenate((a.run_len[runs], np.ones(len(owner) - len(runs), np.int64)))
        begin, length = self.at, self.size + a.window - 1
        self.ids = a.run_ids[owner]
        content = run_hashes(data, begin, length)
        deal = np.concatenate((a.anchor[runs], content[len(runs) :] >> np.uint64(17)))
        order = np.lexsort((self.ids, content, deal))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(deal[order]) != 0) | ~equal_neighbours(data, content[order], begin[order], length[order])
        heads = order[new]  # a least document of each distinct run
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.deal, self.begin, self.length = deal[heads], begin[heads], length[heads]
        self.count, self.least = self.size[heads], self.ids[heads]

    def removed(self, reply: list[tuple[int, bytes]], parts: int) -> np.ndarray:
        """Starts of windows to remove."""
        edges = np.concatenate(([0], np.cumsum(self.count)))
        marks = np.zeros(edges[-1], bool)
        part = part_of(self.deal, parts, 47)
        for p, bits in reply:
            lo, hi = edges[np.searchsorted(part, p)], edges[np.searchsorted(part, p, "right")]
            marks[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).view(bool)
        gone = marks[ragged(edges[self.group], self.size)] | np.repeat(self.ids > self.least[self.group], self.size)
        return ragged(self.at, self.size)[gone]


def find(docs: DataFrame, window: int = 50, seed: int = 24, heavy_chunks: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, SCHEMA.  ``heavy_chunks`` changes how work is dealt, never results."""
    chunks = Chunks(docs, id_col, text_col)
    parts1, parts2 = chunks.parts(chunks.bytes, 64 << 20), chunks.parts(chunks.bytes, 2 << 20)

    def anchored(ids, nulls, data, off):
        return Anchored(data, off, ids, window, seed)

    def chosen(a, data, reply):
        return SentRuns(a, data, a.repeated(reply, parts1), a.repeated(reply, parts1, heavy=True))

    level1 = stored(repeated_anchors(chunks.table, lambda batch, r: anchored(*unpack(batch, r)).sent(), parts1, chunks.bytes, heavy_chunks), "anchors")

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for r in range(batch.num_rows):
                ids, nulls, data, off = unpack(batch, r)
                a = anchored(ids, nulls, data, off)
                sent = chosen(a, data, reply_of(batch, r, "reply0"))
                part, edges = stretches(part_of(sent.deal, parts2, 47))
                texts = [squeeze(data[ragged(sent.begin[x:y], sent.length[x:y])].tobytes()) for x, y in edges]
                table = [squeeze(np.concatenate((sent.count[x:y], sent.least[x:y])).astype(np.int64).tobytes()) for x, y in edges]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(edges), pa.int64()), pa.array(table, pa.binary()), pa.array(texts, pa.binary())], ["part", "chunk", "runs", "text"])

    def resolve(group):
        inflate = zstandard.ZstdDecompressor().decompress
        tables = [np.frombuffer(inflate(x.as_py()), np.int64).reshape(2, -1) for x in group.column("runs")]
        counts, ids = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
        edges = np.concatenate(([0], np.cumsum([t[0].sum() for t in tables])))
        text = np.frombuffer(b"".join(inflate(x.as_py()) for x in group.column("text")), np.uint8)
        return replies(group, edges, first_documents(text, counts, ids, window) < np.repeat(ids, counts))

    level2 = stored(dealt(chunks.with_replies(level1), send, "runs binary, text binary", parts2, resolve, "chunk long, part int, bits binary", 2 * chunks.bytes), "windows")

    def apply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, nulls, data, off = unpack(batch, r)
                a = anchored(ids, nulls, data, off)
                gone = covered(chosen(a, data, reply_of(batch, r, "reply0")).removed(reply_of(batch, r, "reply1"), parts2), window, len(data))
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                inner = off[:-1][off[:-1] < len(gone)]
                starts[inner] = gone[inner]  # a span ends with its document
                total, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(starts)))
                lost = total[off[1:]] - total[off[:-1]]
                digest = [hashlib.sha256(data[x:y][~gone[x:y]] if n else data[x:y]).hexdigest() for x, y, n in zip(off[:-1], off[1:], lost, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=nulls), pa.array(np.diff(off), pa.int64()), pa.array(lost, pa.int64()), pa.array(spans[off[1:]] - spans[off[:-1]], pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return chunks.with_replies(level1, level2).mapInArrow(apply, SCHEMA)

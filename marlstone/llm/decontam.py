"""Benchmark decontamination by a prefix-filtered set join (operator 5).

Every benchmark item gives windows of ``window`` consecutive words (an item of fewer words is one
window).  A window is the set of its ``shingle``-word shingles; a document holds it only if it holds
all of them, so under any global order the window's first shingle alone is its necessary prefix.
The order is by rarity: document frequencies of all benchmark shingles are counted over the whole
corpus, and each window is filed under its rarest one.

1. Count, for each distinct benchmark shingle, the documents that hold it (map-side, one pass).
2. File each distinct window under its rarest shingle with that shingle's place in the window.
3. Probe: each document shingle that is some window's prefix gives a candidate start; the length and
   positional bounds (the window must begin and end inside the document) prune it; the words are
   then compared exactly.

The benchmark index is broadcast: arrays of at most about 13 bytes for each byte of benchmark text (a
window every second byte at most, a word's span, its text).  A benchmark of more than ``index_bytes`` is
taken in blocks of that size, each a pass over the documents with the marks carried along.

Defined cases: null or wordless texts have no words, no hits and the digest of no items; items
without words have no window; items with a null id mark words but are not listed; repeated rows are
judged one by one.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import quoted, slices, stored, summed, utf8_view
from .repeats import ragged

REPORT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MARKS = "__marlstone_marks__"
PIECES = 8


class Lookup:
    """Place of a hash among some sorted hashes, with a one-byte table to reject most at once."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[hashes >> np.uint64(64 - self.BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h``, places in the sorted hashes) of the hashes that are there."""
        at = np.flatnonzero(self.table[h >> np.uint64(64 - self.BITS)])
        k = np.searchsorted(self.hashes, h[at])
        ok = k < len(self.hashes)
        at, k = at[ok], k[ok]
        same = self.hashes[k] == h[at]
        return at[same], k[same]


class Windows:
    """Distinct windows of a block of items, as places in the items' words.

    Words lie once in ``text`` (word k is ``text[begin[k]:end[k]]``); window w is words ``at[w]`` to
    ``at[w] + size[w]``, held by ``items[ptr[w]:ptr[w + 1]]``.  Windows of equal words are found by
    128-bit hashes of them.
    """

    def __init__(self, rows: list[tuple], window: int, shingle: int):
        data, off = utf8_view(pa.array([t or "" for _, t in rows], pa.large_string()))
        data = tv.ALNUM_LOWER[1][data]
        self.text = data.tobytes()
        begin, end, first = tv.words(data, off, tv.ALNUM_LOWER)
        self.begin, self.end = begin.astype(np.int32), end.astype(np.int32)
        hashes = tv.word_hashes(data, begin, end, tv.ALNUM_LOWER)
        second = tv.word_hashes(data, begin, end, tv.ALNUM_LOWER, lane=1)
        at, size, item = [], [], []
        for k, n in enumerate(np.diff(first).tolist()):
            count = max(1, n - window + 1) if n else 0
            at.append(np.arange(first[k], first[k] + count))
            size.append(np.full(count, min(n, window)))
            item.append(np.full(count, k))
        at, size, item = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, size, item))
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for n in np.unique(size).tolist():
            own = size == n
            a[own], b[own] = (tv.window_hashes(h, n)[at[own]] for h in (hashes, second))
        order = np.lexsort((item, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        self.at, self.size = at[order][new].astype(np.int32), size[order][new].astype(np.uint8 if window < 256 else np.int32)
        held = np.stack((np.cumsum(new) - 1, item[order]), axis=1)
        held = held[np.append(True, (np.diff(held, axis=0) != 0).any(axis=1))] if len(held) else held
        names = [None if i is None else str(i) for i, _ in rows]
        held = held[np.asarray([names[k] is not None for k in held[:, 1].tolist()], bool)] if len(held) else held
        self.items, self.names = held[:, 1].astype(np.int32), names
        self.ptr = np.searchsorted(held[:, 0], np.arange(len(self.at) + 1)).astype(np.int32)
        self.lengths = np.minimum(self.size, shingle)
        self.shingles = {int(n): tv.window_hashes(hashes, int(n)) for n in np.unique(self.lengths)}

    def distinct(self) -> dict[int, np.ndarray]:
        """By shingle length, the sorted distinct shingles of the windows."""
        out = {}
        for n, h in self.shingles.items():
            own = self.lengths == n
            out[n] = np.unique(h[ragged(self.at[own].astype(np.int64), self.size[own].astype(np.int64) - n + 1)])
        return out

    def words(self, w: int) -> list[bytes]:
        a, n = int(self.at[w]), int(self.size[w])
        return [self.text[x:y] for x, y in zip(self.begin[a : a + n].tolist(), self.end[a : a + n].tolist(), strict=True)]

    def held_by(self, w: int) -> set[str]:
        return {self.names[k] for k in self.items[self.ptr[w] : self.ptr[w + 1]].tolist()}


def document_words(data, off):
    starts, ends, first = tv.words(data, off, tv.ALNUM_LOWER)
    return starts, ends, first, tv.word_hashes(data, starts, ends, tv.ALNUM_LOWER)


def frequencies(docs: DataFrame, text_col: str, distinct: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Documents that hold each benchmark shingle, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(distinct)

    def count(batches):
        known = {n: (Lookup(h), np.zeros(len(h), np.int64)) for n, h in sent.value.items()}
        for batch in batches:
            raw, offsets = utf8_view(batch.column(0))
            for i, j in slices(offsets):
                data, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, _, first, hashes = document_words(data, off)
                for n, (lookup, total) in known.items():
                    at, k = lookup.find(tv.window_hashes(hashes, n))
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + n <= first[doc + 1]
                    pairs = np.unique(doc[inside] * np.int64(len(total)) + k[inside])
                    np.add.at(total, pairs % len(total), 1)
        return np.concatenate([total for _, total in known.values()])

    sizes = [len(h) for h in distinct.values()]
    total = summed(docs.select(F.col(quoted(text_col)).cast("string")), count, sum(sizes), np.int64, PIECES)
    sent.unpersist()
    return dict(zip(distinct, np.split(total, np.cumsum(sizes)[:-1]), strict=True))


def prefix_index(windows: Windows, distinct: dict[int, np.ndarray], df: dict[int, np.ndarray]) -> dict:
    """By shingle length: sorted prefix hashes, and where in (window, place) the ones filed under each begin."""
    filed = {}
    for n, known in distinct.items():
        own = np.flatnonzero(windows.lengths == n)
        best = np.full(len(own), -1)
        least, least_hash = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.uint64)
        size = windows.size[own].astype(np.int64) - n + 1
        for place in range(int(size.max())):  # the rarest shingle of each window, by hash among equals
            w = np.flatnonzero(size > place)
            h = windows.shingles[n][windows.at[own[w]] + place]
            rarity = df[n][np.searchsorted(known, h)]
            less = (rarity < least[w]) | ((rarity == least[w]) & (h < least_hash[w]))
            best[w[less]], least[w[less]], least_hash[w[less]] = place, rarity[less], h[less]
        there = least > 0  # a shingle that no document holds: the window occurs nowhere
        own, best, h = own[there], best[there], least_hash[there]
        order = np.argsort(h, kind="stable")
        hashes, begin = np.unique(h[order], return_index=True)
        if len(hashes):
            filed[n] = hashes, np.append(begin, len(h)).astype(np.int32), own[order].astype(np.int32), best[order].astype(np.int32)
    return filed


def probe(index: dict, lookups: dict, windows: Windows, data: np.ndarray, off: np.ndarray):
    """Number of words by document, and the verified (document, first word, window) of a run."""
    starts, ends, first, hashes = document_words(data, off)
    lower = None
    found = []
    for n, (_, begin_at, filed, places) in index.items():
        at, k = lookups[n].find(tv.window_hashes(hashes, n))
        count = np.diff(begin_at)[k]
        entry, p = ragged(begin_at[k].astype(np.int64), count), np.repeat(at, count)
        w, begin = filed[entry], p - places[entry]
        doc = np.searchsorted(first, p, "right") - 1
        inside = (begin >= first[doc]) & (begin + windows.size[w] <= first[doc + 1])  # length and positional bounds
        for d, b, own in zip(doc[inside].tolist(), begin[inside].tolist(), w[inside].tolist(), strict=True):
            if lower is None:
                lower = tv.ALNUM_LOWER[1][data].tobytes()
            if all(lower[starts[b + x] : ends[b + x]] == word for x, word in enumerate(windows.words(own))):
                found.append((d, b - int(first[d]), own))
    return np.diff(first), found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, index_bytes: int):
    """The items in blocks of about ``index_bytes`` of text, each with whether it is the last."""
    items = benchmark.select(F.col(quoted(item_col)).alias("item"), F.col(quoted(text_col)).cast("string").alias("text")).distinct()
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    count = max(1, min(-(-(size or 0) // index_bytes), n))
    for k in range(count):
        own = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        rows = [tuple(r) for r in own.collect()]
        if rows or k == count - 1:  # a block that no item falls into needs no pass
            yield k == count - 1, rows


def _pack(spans: list[tuple[int, int]], items: set[str]) -> bytes:
    return struct.pack(f"<I{2 * len(spans)}q", len(spans), *(x for s in spans for x in s)) + "\0".join(sorted(items)).encode()


def _unpack(raw: bytes | None) -> tuple[list[tuple[int, int]], set[str]]:
    if not raw:
        return [], set()
    n = struct.unpack_from("<I", raw)[0]
    flat, rest = struct.unpack_from(f"<{2 * n}q", raw, 4), raw[4 + 16 * n :]
    return list(zip(flat[::2], flat[1::2], strict=True)), set(rest.decode().split("\0")) if rest else set()


def judged(docs: DataFrame, benchmark: DataFrame, emit, schema, window: int = 13, shingle: int = 5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = 8 << 20) -> DataFrame:
    """Run the join; ``emit(batch, verdicts)`` makes each batch's output rows.

    A verdict is (n_words, n_hit, items sorted as strings) of a row.
    """
    current, width = docs, len(docs.columns)
    at = docs.columns.index(text_col)
    for last, items in _blocks(benchmark, item_col, item_text, index_bytes):
        windows = Windows(items, window, shingle)
        distinct = windows.distinct()
        index = prefix_index(windows, distinct, frequencies(docs, text_col, distinct) if distinct else {})
        del windows.shingles, windows.lengths
        sent = docs.sparkSession.sparkContext.broadcast((index, windows))

        def mark(batches, sent=sent, last=last):
            index, windows = sent.value
            lookups = {n: Lookup(x[0]) for n, x in index.items()}
            for batch in batches:
                carried = batch.column(width).to_pylist() if batch.num_columns > width else [None] * batch.num_rows
                raw, offsets = utf8_view(batch.column(at))
                rows = []
                for i, j in slices(offsets):
                    sizes, found = probe(index, lookups, windows, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    here = [_unpack(c) for c in carried[i:j]]
                    for d, begin, w in found:
                        here[d][0].append((begin, begin + int(windows.size[w])))
                        here[d][1].update(windows.held_by(w))
                    rows += [(int(n), *x) for n, x in zip(sizes, here, strict=True)]
                own = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
                if last:
                    yield emit(own, [(n, covered(s), sorted(i)) for n, s, i in rows])
                else:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([_pack(s, i) for _, s, i in rows], pa.binary())], [*own.schema.names, MARKS])

        if last:
            return current.mapInArrow(mark, schema)
        carrying = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{MARKS}` binary"
        current = stored(current.mapInArrow(mark, carrying), "decontam")
        sent.unpersist()
    raise AssertionError("a benchmark has one block at least")


def covered(spans: list[tuple[int, int]]) -> int:
    total, done = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, done))
        done = max(done, b)
    return total


def contaminated(n_words: int, n_hit: int, per: int = 20) -> bool:
    return n_hit > 0 and per * n_hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document, REPORT_SCHEMA."""

    def emit(batch, verdicts):
        digest = [hashlib.sha256(",".join(items).encode()).hexdigest() for _, _, items in verdicts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([v[0] for v in verdicts], pa.int64()), pa.array([v[1] for v in verdicts], pa.int64()), pa.array([len(v[2]) for v in verdicts], pa.int64()), pa.array(digest, pa.string()), pa.array([contaminated(v[0], v[1]) for v in verdicts], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return judged(own, benchmark, emit, REPORT_SCHEMA, **options)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", per: int | None = None, **options) -> DataFrame:
    """The documents without any occurrence of a window, columns unchanged.

    With ``per``, only documents that have a ``per``-th of their words in occurrences go.
    """
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def emit(batch, verdicts):
        goes = [contaminated(v[0], v[1], per) if per else v[1] > 0 for v in verdicts]
        return batch.filter(pa.array([not x for x in goes], pa.bool_()))

    return judged(plain, benchmark, emit, plain.schema, text_col=f"c{docs.columns.index(text_col)}", **options).toDF(*docs.columns)

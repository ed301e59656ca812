"""Level-wise doubling over word windows (operator 8).

Levels are lengths that double up to ``window`` (13, 25, 50 words).  Windows that more than one
document holds at one length alone are extended to twice it, until no candidate survives or
the full length is reached, where survivors are removed.  Each level is sampled by the one above
without loss: a window has one anchor, its least-hashed run of half the length (leftmost on ties),
so equal windows have equal anchors, and a window whose anchor is not repeated is not repeated.

A level sends each chunk's distinct hashes and gets a bit for each (see ``repeats``).  At the full
length windows go as 128-bit hashes (two keyed lanes over the words' bytes), combined within a chunk; the
least document id of each is found where its hash is dealt.

Defined cases: null and wordless texts keep the empty string; windows repeated within one document
only are kept; documents that share an id are one document; a null id counts as the greatest;
repeated rows with different ids are repeats; texts under ``window`` words are never touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import stored
from .repeats import LAST_ID, POSITION_BITS, Chunks, covered, dealt, distinct_marked, marks_of, part_of, repeated_anchors, replies, reply_of, stretches, unpack, valid

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def lengths(window: int, least: int) -> list[int]:
    """Levels below and with ``window``: each at least half of the next, none under ``least`` but one of its own."""
    out = [window]
    while -(-out[0] // 2) >= least and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


class Levels:
    """Candidate windows of a chunk by level; ``places[k]`` are those that level ``k`` has to look at."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, off: np.ndarray, sizes: list[int]):
        self.ids, self.data, self.sizes = ids, data, sizes
        self.begin, self.end, self.first = tv.words(data, off, tv.SPACED)
        self.n = n = len(self.begin)
        top = sizes[-1]
        places = np.flatnonzero(valid(self.first, top, n)) if n >= top else np.zeros(0, np.int64)
        self.symbols = tv.word_hashes(data, self.begin, self.end, tv.SPACED) if len(places) else np.zeros(0, np.uint64)
        self.places, self.anchor, self.hashes = [places], [], []
        low = np.uint64((1 << POSITION_BITS) - 1)
        for short, long in zip(reversed(sizes[:-1]), reversed(sizes[1:]), strict=True):
            h = tv.window_hashes(self.symbols, short)
            least = tv.sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), long - short + 1)
            at = (least[self.places[0]] & low).astype(np.int64)  # never falls from one place to the next
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            self.anchor.insert(0, np.cumsum(new) - 1)  # of each place a level up: which place below
            self.places.insert(0, at[new])
            self.hashes.insert(0, h[at[new]] >> np.uint64(17))

    def owners(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.first, places, "right") - 1]

    def survivors(self, level: int, answers: list[list[tuple[int, bytes]]], parts: int) -> np.ndarray:
        """Which of a level's places are left by the levels below it."""
        alive = np.ones(len(self.places[0]), bool)
        for k in range(level):
            own = np.flatnonzero(alive)
            distinct, inverse = np.unique(self.hashes[k][own], return_inverse=True)
            repeated = np.zeros(len(alive), bool)
            repeated[own] = marks_of(distinct, answers[k], parts, 47)[inverse]
            alive = repeated[self.anchor[k]]
        return np.flatnonzero(alive)

    def sent(self, level: int, answers: list, parts: int) -> np.ndarray:
        own = self.survivors(level, answers, parts)
        return distinct_marked(self.hashes[level][own], self.owners(self.places[level][own]))


class Sent:
    """Surviving windows of the full length, equal ones combined under their least document id."""

    def __init__(self, levels: Levels, answers: list, parts: int):
        self.places = levels.places[-1][levels.survivors(len(levels.sizes) - 1, answers, parts)]
        top, second = levels.sizes[-1], np.zeros(0, np.uint64)
        if len(self.places):
            second = tv.word_hashes(levels.data, levels.begin, levels.end, tv.SPACED, lane=1)
        a, b = (tv.window_hashes(h, top)[self.places] for h in (levels.symbols, second))
        self.ids = levels.owners(self.places)
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.hashes, self.second = a[order[new]], b[order[new]]
        self.least = np.full(len(self.hashes), LAST_ID)
        np.minimum.at(self.least, self.inverse, self.ids)

    def removed(self, reply: list[tuple[int, bytes]], parts: int) -> np.ndarray:
        """Window places to remove: not from the least document here, or that one has a lesser elsewhere."""
        elsewhere = marks_of(self.hashes, reply, parts, 64)
        return self.places[(self.ids > self.least[self.inverse]) | elsewhere[self.inverse]]


def find(docs: DataFrame, window: int = 50, least: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, SCHEMA.  ``least`` is the shortest level's least length; it changes work, never results."""
    sizes = lengths(window, least)
    chunks = Chunks(docs, id_col, text_col)
    parts1, parts2 = chunks.parts(chunks.bytes, 256 << 20), chunks.parts(chunks.bytes, 16 << 20)

    def opened(batch, r):
        ids, nulls, data, off = unpack(batch, r)
        return Levels(ids, data, off, sizes), nulls, off

    def answers(batch, r):
        return [reply_of(batch, r, f"reply{k}") for k in range(len(sizes) - 1)]

    found: list[DataFrame] = []
    for level in range(len(sizes) - 1):

        def send(batch, r, level=level):
            return opened(batch, r)[0].sent(level, answers(batch, r), parts1)

        marks = stored(repeated_anchors(chunks.with_replies(*found, left=False), send, parts1, chunks.bytes // 4), f"level{level}")
        found.append(marks)
        if marks.isEmpty():  # no candidate survives: nothing repeats
            break
    last = f"reply{len(found)}"
    alive = len(found) == len(sizes) - 1 and not (found and found[-1].isEmpty())

    def extend(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sent = Sent(opened(batch, r)[0], answers(batch, r), parts1)
                part, edges = stretches(part_of(sent.hashes, parts2, 64))
                owners = [np.unique(sent.least[x:y], return_inverse=True) for x, y in edges]
                hashes = [sent.hashes[x:y].tobytes() + sent.second[x:y].tobytes() for x, y in edges]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(edges), pa.int64()), pa.array(hashes, pa.binary()), pa.array([i.tobytes() for i, _ in owners], pa.binary()), pa.array([w.astype(np.uint32).tobytes() for _, w in owners], pa.binary())], ["part", "chunk", "hashes", "ids", "which"])

    def resolve(group):
        hashes = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in group.column("hashes")]
        edges = np.concatenate(([0], np.cumsum([x.shape[1] for x in hashes])))
        ids = np.concatenate([np.frombuffer(i.as_py(), np.int64)[np.frombuffer(w.as_py(), np.uint32)] for i, w in zip(group.column("ids"), group.column("which"), strict=True)])
        a, b = np.concatenate(hashes, axis=1)
        order = np.lexsort((ids, b, a))  # the first of equal windows is from their least document
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = ids[order[new]][np.cumsum(new) - 1]
        return replies(group, edges, ids > least)

    payload = "hashes binary, ids binary, which binary"
    ends = [stored(dealt(chunks.with_replies(*found, left=False), extend, payload, parts2, resolve, "chunk long, part int, bits binary", 2 * chunks.bytes), "windows")] if alive else []

    def apply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                levels, nulls, off = opened(batch, r)
                first, gone = levels.first, np.zeros(levels.n, bool)
                if alive:
                    at = Sent(levels, answers(batch, r), parts1).removed(reply_of(batch, r, last), parts2)
                    gone = covered(at, window, levels.n)
                raw, n_removed, digest = levels.data.tobytes(), [], []
                for d in range(len(nulls)):
                    own, lost = raw[off[d] : off[d + 1]].split(), gone[first[d] : first[d + 1]]
                    count = int(lost.sum())
                    n_removed.append(count)
                    digest.append(hashlib.sha256(b" ".join([w for w, x in zip(own, lost, strict=True) if not x] if count else own)).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(levels.ids, pa.int64(), mask=nulls), pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return chunks.with_replies(*(found if alive else []), *ends).mapInArrow(apply, SCHEMA)

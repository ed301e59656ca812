"""Common ground of the two exact repeat finders (operators 7 and 8).

Both remove every symbol (byte or word) covered by a window of T symbols that also starts in a
document with a smaller id.  Windows are far too many to shuffle, so work goes by *anchors*: each
window has one anchor, its least-hashed run of K symbols (leftmost on ties), which depends on the
window's content alone; equal windows have equal anchors at equal places.  About 2 in T-K+2
positions are anchors.

1. Documents are written once as chunks (some MB of whole texts) in a table bucketed by chunk, one
   file for each bucket and as many buckets as the input's bytes ask for, so that every later pass joins its
   small replies to the chunks without moving text again.
2. Each chunk sends the distinct 47-bit hashes of its anchors, dealt by hash; the reply is one bit
   per hash: does it occur in more than one document?  A hash goes once per chunk, whatever its
   frequency, so a passage in a third of all rows is no hot key.
3. Windows of repeated anchors are resolved exactly by the operator; within a chunk equal ones are
   combined first (the least id stands for all).  The reply is one bit per window sent.
4. A last pass over the chunks applies the replies.

What a chunk sends goes to one of many parts by hash.  Beyond FAN parts it goes in two steps (``dealt``):
a chunk sends at most FAN bundles, and tasks that each see bundles of many chunks cut them into parts, so
that the number of messages follows the bytes sent, not chunks times parts.

All three passes derive the same anchors from the same bytes; a lost task is simply run again.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import id_and_text, scratch, slots, utf8_view

CHUNK_BYTES = 2 << 20
CHUNK_SCHEMA = "chunk long, n_bytes long, ids binary, nulls binary, ends binary, data binary"
POSITION_BITS = 30
#: Bytes of text that a bucket of chunks is meant for, and Spark's own limit of buckets (tasks read buckets chunk by chunk).
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 100_000
#: Most messages of a chunk, and bytes of bundles that are cut into parts at once.
FAN, BUNDLE_BYTES = 1024, 16 << 20
LAST_ID = np.iinfo(np.int64).max


class Chunks:
    """The documents as a bucketed table of chunks."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES):
        self.spark = docs.sparkSession
        own = id_and_text(docs, id_col, text_col)
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = min(max(slots(self.spark), math.ceil(size / BUCKET_BYTES)), MOST_BUCKETS)
        name = f"marlstone_chunks_{uuid.uuid4().hex}"

        def cut(batches):
            part, seq = TaskContext.get().partitionId(), 0
            ids, nulls, ends, data, size = [], [], [], [], 0

            def chunk():
                row = [(part << 32) | seq, size, np.concatenate(ids).tobytes(), np.concatenate(nulls).tobytes(), np.concatenate(ends).tobytes(), b"".join(data)]
                kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["chunk", "n_bytes", "ids", "nulls", "ends", "data"])

            for batch in batches:
                own_ids = np.asarray(batch.column(0).fill_null(0))
                own_nulls = np.asarray(batch.column(0).is_null())
                raw, off = utf8_view(batch.column(1))
                i, n = 0, batch.num_rows
                while i < n:
                    j = int(np.searchsorted(off, off[i] + chunk_bytes - size, "right")) - 1
                    j = min(max(j, i + 1 if not size else i), n)
                    if j > i:
                        ids.append(own_ids[i:j])
                        nulls.append(own_nulls[i:j])
                        ends.append(off[i + 1 : j + 1] - off[i] + size)
                        data.append(raw[off[i] : off[j]].tobytes())
                        size += int(off[j] - off[i])
                        i = j
                    if i < n:
                        yield chunk()
                        seq, size = seq + 1, 0
                        ids, nulls, ends, data = [], [], [], []
            if ids:
                yield chunk()

        writer = own.mapInArrow(cut, CHUNK_SCHEMA).repartition(self.buckets, "chunk").write
        writer.bucketBy(self.buckets, "chunk").option("path", scratch(self.spark, "chunks")).option("compression", "zstd").saveAsTable(name)
        self.table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone: the resolved plan has the files and their buckets
        self.bytes = self.table.agg(F.sum("n_bytes")).first()[0] or 0

    def parts(self, amount: float, per_part: float) -> int:
        """Groups to deal by: a few for each task, more as the data grows."""
        return max(2 * self.buckets, math.ceil(amount / per_part))

    def with_replies(self, *replies: DataFrame, left: bool = True) -> DataFrame:
        """The chunks and, for each reply table (chunk, part, bits), its rows as an array.

        Without ``left`` only chunks with a row in the last table.
        """
        out = self.table
        for k, reply in enumerate(replies):
            grouped = reply.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(f"reply{k}"))
            out = out.join(grouped, "chunk", "left" if left or k + 1 < len(replies) else "inner")
        return out


def unpack(batch, r: int):
    """(ids with nulls last, null marks, bytes, offsets) of a chunk row."""
    col = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names) if n in ("ids", "nulls", "ends", "data")}
    ids, nulls = np.frombuffer(col["ids"], np.int64), np.frombuffer(col["nulls"], bool)
    off = np.concatenate(([0], np.frombuffer(col["ends"], np.int64)))
    return np.where(nulls, LAST_ID, ids), nulls, np.frombuffer(col["data"], np.uint8), off


def reply_of(batch, r: int, name: str) -> list[tuple[int, bytes]]:
    if name not in batch.schema.names:
        return []
    rows = batch.column(batch.schema.get_field_index(name))[r].as_py() or []
    return [(x["part"], x["bits"]) for x in rows]


class Anchored:
    """Byte windows of a chunk by anchor: runs of consecutive windows with one anchor in one document."""

    def __init__(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, window: int, seed: int):
        self.window, self.n = window, len(data)
        size = np.diff(off)
        own = np.flatnonzero(size >= window)
        if not len(own):
            self.run_at = self.run_len = self.run_ids = np.zeros(0, np.int64)
            self.anchor = self.distinct = np.zeros(0, np.uint64)
            self.inverse = np.zeros(0, np.int64)
            return
        at = anchor_places(data, window, seed)
        inside = np.zeros(self.n - window + 2, np.int8)  # window starts that stay in one document
        np.add.at(inside, off[:-1][own], 1)
        np.add.at(inside, off[1:][own] - window + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        new[off[:-1][own]] = True
        self.run_at = np.flatnonzero(new)  # its first window
        doc = np.searchsorted(off, self.run_at, "right") - 1
        self.run_len = np.minimum(np.append(self.run_at[1:], self.n), off[doc + 1] - window + 1) - self.run_at
        self.run_ids = ids[doc]
        self.anchor = seed_hashes(tv.eight_bytes(data), at[self.run_at].astype(np.int64), seed) >> np.uint64(17)
        self.distinct, self.inverse = np.unique(self.anchor, return_inverse=True)

    def sent(self) -> np.ndarray:
        """Each distinct anchor hash once; the low bit says that two documents here hold it."""
        return distinct_marked(self.anchor, self.run_ids)

    def repeated(self, reply: list[tuple[int, bytes]], parts: int, heavy: bool = False) -> np.ndarray:
        """Runs whose anchor hash occurs in several documents, or, of those, in very many chunks."""
        if not len(self.anchor):
            return np.zeros(0, np.int64)
        return np.flatnonzero(marks_of(self.distinct, [(p % parts, bits) for p, bits in reply if (p >= parts) == heavy], parts, 47)[self.inverse])


_SEED_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def seed_hashes(eight: np.ndarray, places, seed: int) -> np.ndarray:
    """A hash of the ``seed`` bytes (eight at least) at some places (a slice or an array of them).

    It only has to be even and to depend on those bytes alone: whatever meets by it is compared later.
    """
    at = lambda k: eight[places.start + k : places.stop + k] if isinstance(places, slice) else eight[places + k]
    h = None
    for j, k in enumerate([*range(0, seed - 8, 8), seed - 8]):
        own = at(k) * _SEED_ODD[j % 4]
        if h is None:
            h = own
        else:
            h ^= h >> np.uint64(29)
            h += own
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchor_places(data: np.ndarray, window: int, seed: int, step: int = 1 << 15) -> np.ndarray:
    """Place of the least-hashed run of ``seed`` bytes (leftmost on ties) in the window at each place; in steps that stay in cache."""
    total, width = len(data) - window + 1, window - seed + 1
    eight, low = tv.eight_bytes(data), np.uint64((1 << POSITION_BITS) - 1)
    out = np.empty(max(total, 0), np.int32)
    for a in range(0, total, step):
        b = min(a + step, total)
        h = seed_hashes(eight, slice(a, b + width - 1), seed)
        h &= ~low
        h |= np.arange(a, b + width - 1, dtype=np.uint64)
        out[a:b] = tv.sliding_min(h, width) & low
    return out


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def distinct_marked(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each distinct 47-bit hash once, shifted up; the low bit says that two documents hold it."""
    order = np.lexsort((ids, hashes))
    h, i = hashes[order], ids[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    last = np.append(at[1:], len(h)) - 1 if len(h) else at
    return h[at] << np.uint64(1) | (i[at] != i[last]).astype(np.uint64)


def marks_of(hashes: np.ndarray, reply: list[tuple[int, bytes]], parts: int, bits: int) -> np.ndarray:
    """The replies' marks for sorted hashes of ``bits`` bits, as they were sent by part."""
    part, marks = part_of(hashes, parts, bits), np.zeros(len(hashes), bool)
    for p, raw in reply:
        lo, hi = np.searchsorted(part, p), np.searchsorted(part, p, "right")
        marks[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=hi - lo).view(bool)
    return marks


def valid(first: np.ndarray, window: int, n: int) -> np.ndarray:
    """Window starts that stay in one document."""
    owner_end = np.repeat(first[1:], np.diff(first))
    return np.arange(n - window + 1) + window <= owner_end[: n - window + 1]


def part_of(hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Part by the high bits, so that sorted hashes lie in sorted parts."""
    return ((hashes >> np.uint64(bits - 31)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


def stretches(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The distinct parts of sorted parts, and the stretch [a, b) of each (none for no parts)."""
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    return part[cut].astype(np.int32), list(zip(cut.tolist(), [*cut[1:].tolist(), len(part)][: len(cut)], strict=True))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], ..., starts[0]+lengths[0]-1, starts[1], ..."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _listed(column: pa.Array, edges: np.ndarray) -> pa.Array:
    """Consecutive values as lists that end at ``edges``."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), column)


def bundled(send, parts: int, names: list[str]):
    """``send`` with a chunk's messages in at most FAN bundles of neighbouring parts."""
    width = -(-parts // FAN)

    def bundle(batches):
        for batch in send(batches):
            if batch.num_rows:
                coarse = np.asarray(batch.column("part")) // width
                at = np.flatnonzero(np.diff(coarse, prepend=-1))
                edges = np.append(at, batch.num_rows)
                lists = [_listed(batch.column(n), edges) for n in ("part", *names)]
                yield pa.RecordBatch.from_arrays([pa.array(coarse[at].astype(np.int32)), batch.column("chunk").take(pa.array(at)), *lists], ["coarse", "chunk", "parts", *names])

    return bundle


def dealt(table: DataFrame, send, payload: str, parts: int, answer, schema: str, amount: int) -> DataFrame:
    """Messages (part, chunk, payload columns) of ``send`` to ``answer``, a function of all those of one part.

    ``send`` yields one batch for each chunk, in order of parts; ``amount`` is about the bytes sent by all.
    """
    fields = f"part int, chunk long, {payload}"
    if parts <= FAN:
        return table.mapInArrow(send, fields).groupBy("part").applyInArrow(answer, schema)
    names = [f.split()[0] for f in payload.split(", ")]
    listed = ", ".join(f"{f.split()[0]} array<{f.split()[1]}>" for f in payload.split(", "))

    def cut(batches):
        own, size = [], 0

        def made():
            rows = pa.Table.from_batches(own).combine_chunks()
            lists = {n: rows.column(n).combine_chunks() for n in ("parts", *names)}
            part = np.asarray(lists["parts"].flatten())
            chunk = np.repeat(np.asarray(rows.column("chunk")), np.asarray(lists["parts"].value_lengths()))
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=-1))
            edges, take = np.append(at, len(part)), pa.array(order)
            columns = [pa.array(part[order][at]), _listed(pa.array(chunk[order]), edges), *(_listed(lists[n].flatten().take(take), edges) for n in names)]
            return pa.RecordBatch.from_arrays(columns, ["part", "chunks", *names])

        for batch in batches:
            own.append(batch)
            size += batch.nbytes
            if size >= BUNDLE_BYTES:
                yield made()
                own, size = [], 0
        if own:
            yield made()

    def opened(group):
        part = np.repeat(np.asarray(group.column("part")), np.asarray(pc.list_value_length(group.column("chunks"))))
        flat = [pc.list_flatten(group.column(n)) for n in ("chunks", *names)]
        return answer(pa.table([pa.array(part, pa.int32()), *flat], names=["part", "chunk", *names]))

    tasks = max(slots(table.sparkSession), math.ceil(amount / (128 << 20)))
    bundles = table.mapInArrow(bundled(send, parts, names), f"coarse int, chunk long, parts array<int>, {listed}")
    grouped = bundles.withColumn("of", F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-tasks // FAN))))).repartition(tasks, "coarse", "of").sortWithinPartitions("coarse").drop("of", "coarse")
    return grouped.mapInArrow(cut, f"part int, chunks array<long>, {listed}").groupBy("part").applyInArrow(opened, schema)


def repeated_anchors(table: DataFrame, sender, parts: int, amount: int, heavy_chunks: int | None = None) -> DataFrame:
    """A level: (chunk, part, bits) for the chunks' distinct hashes that several documents hold.

    ``sender(batch, r)`` gives a row's ``distinct_marked`` hashes.  With ``heavy_chunks``, further rows (part + parts) mark those that more chunks hold.
    """

    def send(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sent = sender(batch, r)
                own, edges = stretches(part_of(sent >> np.uint64(1), parts, 47))
                six = sent.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows = [six[a:b].tobytes() for a, b in edges]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["part", "chunk", "sent"])

    def answer(group):
        rows = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 6) for x in group.column("sent")]
        edges = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        wide = np.zeros((edges[-1], 8), np.uint8)
        wide[:, :6] = np.concatenate(rows)
        value = wide.view("<u8").ravel()
        _, inverse, count = np.unique(value >> np.uint64(1), return_inverse=True, return_counts=True)
        several = count > 1
        several[inverse[value & np.uint64(1) == 1]] = True
        out = replies(group, edges, several[inverse])
        if heavy_chunks is None or not (count > heavy_chunks).any():
            return out
        heavy = replies(group, edges, (count > heavy_chunks)[inverse])
        return pa.concat_tables([out, heavy.set_column(1, "part", pc.add(heavy.column("part"), pa.scalar(parts, pa.int32())))])

    return dealt(table.drop("n_bytes"), send, "sent binary", parts, answer, "chunk long, part int, bits binary", amount)


def replies(group, edges: np.ndarray, marks: np.ndarray):
    """Rows (chunk, part, bits) for those senders that get any mark."""
    hit = [k for k in range(group.num_rows) if marks[edges[k] : edges[k + 1]].any()]
    bits = [np.packbits(marks[edges[k] : edges[k + 1]]).tobytes() for k in hit]
    return pa.table({"chunk": group.column("chunk").take(pa.array(hit, pa.int64())).cast(pa.int64()), "part": group.column("part").take(pa.array(hit, pa.int64())).cast(pa.int32()), "bits": pa.array(bits, pa.binary())})

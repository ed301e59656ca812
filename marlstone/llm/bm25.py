"""Exact top-k BM25 search with block-max pruning (operator 6).

Documents are cut into shards (some MB of whole texts; like documents lie together).  A shard's inverted
index holds its distinct words (64-bit hashes), their postings (document, frequency) and document
lengths, and is written once; searches never touch the texts again.

Scores use global statistics (documents, mean length, document frequencies), so that results of
shards merge exactly: sum over a query's distinct words of
``ln(1 + (N - df + .5) / (df + .5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / mean))``.

A task searches neighbouring shards as one, up to ``MERGED_WORDS``, for TOGETHER queries of like main word and
length at once.  A query's rarer words are scored from their postings; its frequent words only bound what each
block of ``BLOCK`` documents can still gain (block maxima, as in block-max WAND), for all these queries in
one product.  Blocks whose bound is below the k-th best score found so far for each of the queries are skipped,
single documents of the others are bounded again by a product, and only those that still qualify are scored;
the threshold is carried through a task.  Scores are compared after rounding to nine
decimals, ties by least document id, so the result does not depend on how shards are cut.

Queries are taken in blocks of at most ``block_bytes`` of text, each broadcast to one pass over the
index.  Defined cases: texts without words are no queries and are never found; a document finds
itself; repeated rows are found apiece; a null id sorts last and is no query; fewer than k documents
that share a word give fewer rows.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import id_and_text, parts_for, slices, stored, summed, utf8_view
from .repeats import LAST_ID, ragged

K1, B = 1.2, 0.75
BLOCK = 64
PIECES = 16
#: A word is frequent in a shard of n documents if more than n / FREQUENT of them hold it.
FREQUENT = 12
#: Queries of one product at most, and its cells (queries times documents).
TOGETHER, CELLS = 128, 1 << 21
#: Words of neighbouring shards that are searched as one, and of those that one task searches (where tasks are many).
MERGED_WORDS, TASK_WORDS = 8_000_000, 128_000_000
DIGITS = 9
SCHEMA = "query_id long, rank int, doc_id long, score double"


def slack(terms: int, total):
    """More than a single-precision sum of ``terms`` gains that comes to ``total`` can be off by, rounding to DIGITS included.

    No gain is negative, so roundings of weights, gains, products and sums in any order lose at most
    (terms + 2) * 2^-24 of the true sum; twice that of the computed one is more.
    """
    return (terms + 3) * 2.0**-23 * total + 2 * 10.0**-DIGITS


def document_words(data, off):
    """First word of each document, and the hashes of all words; texts are taken in slices."""
    first, hashes, total = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], 0
    for i, j in slices(off):
        own = data[off[i] : off[j]]
        starts, ends, at = tv.words(own, off[i : j + 1] - off[i], tv.ALNUM_LOWER)
        hashes.append(tv.word_hashes(own, starts, ends, tv.ALNUM_LOWER))
        first.append(at[1:] + total)
        total += len(starts)
    return np.concatenate(first), np.concatenate(hashes)


class Shard:
    """terms, ptr: postings of term t are ptr[t]:ptr[t+1]; doc, tf by posting; ids, length by document."""

    FIELDS = ("ids", "length", "terms", "ptr", "doc", "tf")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> Shard:
        first, hashes = document_words(data, off)
        length, n = np.diff(first), len(ids)
        owner = np.repeat(np.arange(n), length)
        order = np.lexsort((owner, hashes))
        h, d = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        h, d = h[at], d[at]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        # Documents with the same most frequent word (so, as a rule, of one language) and like length lie together.
        main = np.zeros(n, np.uint64)
        np.maximum.at(main, d, (tf.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        by = np.lexsort((length, main & np.uint64((1 << 40) - 1)))
        place = np.empty(n, np.int64)
        place[by] = np.arange(n)
        term = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
        order = np.argsort(term * max(n, 1) + place[d], kind="stable")
        return cls(ids=ids[by], length=length[by], terms=h[start], ptr=np.append(start, len(h)), doc=place[d][order].astype(np.uint32), tf=tf[order].astype(np.uint32))

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [squeeze(getattr(self, f).tobytes()) for f in self.FIELDS]
        head = json.dumps([[f, str(getattr(self, f).dtype), len(p)] for f, p in zip(self.FIELDS, parts, strict=True)]).encode()
        return struct.pack("<I", len(head)) + head + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        size = struct.unpack("<I", raw[:4])[0]
        at, out = 4 + size, {}
        for name, kind, length in json.loads(raw[4:at]):
            out[name] = np.frombuffer(zstandard.decompress(raw[at : at + length]), kind)
            at += length
        return cls(**out)


    @classmethod
    def merged(cls, shards: list[Shard]) -> Shard:
        """Some shards as one; each keeps its documents together, in its own order."""
        if len(shards) == 1:
            return shards[0]
        terms, at = np.unique(np.concatenate([s.terms for s in shards]), return_inverse=True)
        counts = np.zeros(len(terms), np.int64)
        at = np.split(at, np.cumsum([len(s.terms) for s in shards])[:-1])
        for shard, own in zip(shards, at, strict=True):
            counts[own] += np.diff(shard.ptr)
        ptr = np.concatenate(([0], np.cumsum(counts)))
        doc, tf, free, before = np.empty(ptr[-1], np.uint32), np.empty(ptr[-1], np.uint32), ptr[:-1].copy(), 0
        for shard, own in zip(shards, at, strict=True):
            sizes = np.diff(shard.ptr)
            places = ragged(free[own], sizes)
            doc[places], tf[places] = shard.doc + np.uint32(before), shard.tf
            free[own] += sizes
            before += len(shard.ids)
        return cls(ids=np.concatenate([s.ids for s in shards]), length=np.concatenate([s.length for s in shards]), terms=terms, ptr=ptr, doc=doc, tf=tf)


def build_index(docs: DataFrame, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per shard (n_docs, n_words, payload)."""

    def each(batches):
        ids, raw, sizes, total = [], [], [], 0

        def shard():
            off = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
            own = Shard.build(np.concatenate(ids), np.concatenate(raw), off)
            return pa.RecordBatch.from_arrays([pa.array([len(own.ids)], pa.int64()), pa.array([int(own.length.sum())], pa.int64()), pa.array([own.to_bytes()], pa.binary())], ["n_docs", "n_words", "payload"])

        for batch in batches:
            own_ids = np.asarray(batch.column(0).fill_null(LAST_ID))
            data, off = utf8_view(batch.column(1))
            i, n = 0, batch.num_rows
            while i < n:
                j = int(np.searchsorted(off, off[i] + shard_bytes - total, "right")) - 1
                j = min(max(j, i + 1 if not total else i), n)
                if j > i:
                    ids.append(own_ids[i:j])
                    raw.append(data[off[i] : off[j]].copy())
                    sizes.append(np.diff(off[i : j + 1]))
                    total += int(off[j] - off[i])
                    i = j
                if i < n:
                    yield shard()
                    ids, raw, sizes, total = [], [], [], 0
        if ids:
            yield shard()

    return stored(id_and_text(docs, id_col, text_col).mapInArrow(each, "n_docs long, n_words long, payload binary"), "bm25")


def document_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of a block's terms, over all shards."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def each(batches):
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for payload in batch.column(0):
                shard = Shard.from_bytes(payload.as_py())
                if len(shard.terms):
                    at = np.minimum(np.searchsorted(shard.terms, wanted), len(shard.terms) - 1)
                    total += np.where(shard.terms[at] == wanted, np.diff(shard.ptr)[at], 0)
        return total

    out = summed(index.select("payload"), each, len(terms), np.int64, PIECES)
    sent.unpersist()
    return out


class Searcher:
    """One shard prepared for a block of queries: impacts of its postings, dense rows and block maxima of frequent words.

    ``code`` tells of each of the block's terms what it is here: -1 absent, then rows of frequent words, then places
    in ``docs`` and ``impacts``, the postings of the others as bytes (which join faster than arrays).
    """

    def __init__(self, shard: Shard, terms: np.ndarray, idf: np.ndarray, mean: float):
        self.n, self.blocks = len(shard.ids), -(-len(shard.ids) // BLOCK)
        counts, ptr = np.diff(shard.ptr), shard.ptr
        at = np.minimum(np.searchsorted(shard.terms, terms), max(len(shard.terms) - 1, 0))
        here = shard.terms[at] == terms if len(shard.terms) else np.zeros(len(terms), bool)
        weight = np.zeros(len(shard.terms))
        weight[at[here]] = idf[here]
        self.norm = K1 * (1 - B + B * shard.length / mean)
        doc = shard.doc.astype(np.uint16) if self.n <= 1 << 16 else shard.doc
        impact, tf = shard.tf * (K1 + 1), self.norm[doc]
        tf += shard.tf
        impact /= tf
        impact *= np.repeat(weight, counts)
        del tf
        often = counts > max(BLOCK, self.n // FREQUENT)
        which, others = np.flatnonzero(often & (weight > 0)), np.flatnonzero(~often & (weight > 0))
        self.kind, spans = doc.dtype, list(zip(ptr[others].tolist(), ptr[others + 1].tolist(), strict=True))
        self.docs, self.impacts = ([raw[i * size : j * size] for i, j in spans] for raw, size in ((x.tobytes(), x.itemsize) for x in (doc, impact)))
        code = np.empty(len(counts), np.int32)
        code[which], code[others] = np.arange(len(which)), np.arange(len(which), len(which) + len(others))
        self.code = np.full(len(terms), -1, np.int32)
        self.code[here] = code[at[here]]
        self.weight = weight[which]
        places, rows = ragged(ptr[which], counts[which]), np.repeat(np.arange(len(which)), counts[which])
        own = shard.tf[places]
        self.tf = np.zeros((len(which), self.n), np.min_scalar_type(own.max(initial=0)))
        self.tf[rows, doc[places]] = own
        rough = np.zeros((len(which), self.blocks * BLOCK), np.float32)
        rough[rows, doc[places]] = impact[places]
        self.rough = rough.reshape(len(which), self.blocks, BLOCK)
        self.most = self.rough.max(axis=2)
        #: Queries that ``search_together`` takes at once.
        self.together = min(max(1, CELLS // max(1, self.blocks * BLOCK)), TOGETHER)

    def search(self, terms: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best; ``terms`` are places in the block's terms."""
        for _, docs, found in self.search_together([terms], k, np.asarray([floor])):
            return docs, found
        return np.zeros(0, np.int64), np.zeros(0)

    def search_together(self, asked: list[np.ndarray], k: int, floors: np.ndarray):
        """(query, documents, scores) of each of some queries that has documents that may be among its k best.

        Words that are not frequent are scored exactly, query by query.  Frequent ones bound blocks for all
        queries in one product, then single documents of the blocks that any query has left, in single
        precision (within ``slack``); what still qualifies is scored.
        """
        n, width, often = len(asked), self.blocks * BLOCK, len(self.weight)
        owner, code = np.repeat(np.arange(n), [len(x) for x in asked]), self.code[np.concatenate(asked)]
        here = code >= 0
        owner, code = owner[here], code[here]
        if not len(code):
            return

        def of_kind(kind):
            return code[kind], np.concatenate(([0], np.cumsum(np.bincount(owner[kind], minlength=n)))).tolist()

        (row, row_at), (other, other_at) = of_kind(code < often), of_kind(code >= often)
        other = (other - often).tolist()
        score = np.zeros((n, width))
        for q in range(n):
            if own := other[other_at[q] : other_at[q + 1]]:
                docs, impacts = b"".join([self.docs[t] for t in own]), b"".join([self.impacts[t] for t in own])
                score[q] = np.bincount(np.frombuffer(docs, self.kind), weights=np.frombuffer(impacts), minlength=width)
        cut = score.reshape(n, self.blocks, BLOCK)
        asks = np.zeros((n, often), np.float32)
        asks[owner[code < often], row] = 1
        used = np.flatnonzero(asks.any(axis=0))
        asks = asks[:, used]
        # What a sum in single precision must reach for the true one to reach the floor: see slack.
        terms = np.bincount(owner, minlength=n)
        least = ((floors - slack(0, 0)) / (1 + slack(terms, 1) - slack(0, 0)) * (1 - 2.0**-40))[:, None]
        left = np.flatnonzero((asks @ self.most[used] + cut.max(axis=2) >= least).any(axis=0))
        if not len(left):
            return
        rough = (asks @ self.rough[used[:, None], left].reshape(len(used), len(left) * BLOCK)) + cut[:, left].reshape(n, -1)
        maybe = rough >= np.maximum(least, np.finfo(np.float32).tiny)
        for q in np.flatnonzero(maybe.any(axis=1)).tolist():
            at = np.flatnonzero(maybe[q])
            if len(at) > k:
                low, off = rough[q, at], slack(terms[q], rough[q, at])
                at = at[low + off >= np.partition(low - off, -k)[-k]]
            docs = left[at // BLOCK] * BLOCK + at % BLOCK
            own = row[row_at[q] : row_at[q + 1]]
            tf = self.tf[own[:, None], docs].astype(np.float64)
            found = score[q, docs] + self.weight[own] @ (tf * (K1 + 1) / (tf + self.norm[docs]))
            good = found > 0
            if good.any():
                yield q, docs[good], found[good]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores = np.round(scores, DIGITS)
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def joined_shards(batches):
    """The shards of some batches of payloads, neighbours merged up to MERGED_WORDS."""
    have, words = [], 0
    for batch in batches:
        for payload in batch.column(0):
            shard = Shard.from_bytes(payload.as_py())
            own = int(shard.length.sum())
            if have and words + own > MERGED_WORDS:
                yield Shard.merged(have)
                have, words = [], 0
            have.append(shard)
            words += own
    if have:
        yield Shard.merged(have)


def search(index: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """queries (query_id, text) against the index: SCHEMA."""
    spark = index.sparkSession
    n_docs, n_words = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_words")).first())
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, -(-size // block_bytes)), None
    mean = max(n_words / max(n_docs, 1), 1e-9)
    tasks = max(3 * spark.sparkContext.defaultParallelism, -(-n_words // TASK_WORDS))
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = [r for r in own.select("query_id", "text").collect() if r.text]
        data, off = utf8_view(pa.array([r.text for r in rows], pa.large_string()))
        first, hashes = document_words(data, off)
        found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        # As in a shard, queries with the same most frequent word and like length lie together.
        order = sorted((q for q, (s, _) in enumerate(found) if len(s)), key=lambda q: (found[q][0][found[q][1].argmax()], len(found[q][0])))
        sets = [found[q][0] for q in order]
        terms = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        df = document_frequencies(index, terms)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        places = [np.searchsorted(terms, s).astype(np.uint32) for s in sets]
        sent = spark.sparkContext.broadcast((terms, idf, [(rows[q].query_id, p) for q, p in zip(order, places, strict=True)]))

        def each(batches, sent=sent):
            terms, idf, asked = sent.value
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
            floors = np.zeros(len(asked))
            for shard in joined_shards(batches):
                searcher = Searcher(shard, terms, idf, mean)
                for i in range(0, len(asked), searcher.together):
                    own = [p for _, p in asked[i : i + searcher.together]]
                    for q, docs, found in searcher.search_together(own, k, floors[i : i + len(own)]):
                        ids, scores = best[i + q]
                        best[i + q] = ids, scores = _best(np.concatenate((ids, shard.ids[docs])), np.concatenate((scores, found)), k)
                        floors[i + q] = scores[-1] if len(scores) >= k else 0.0
            keep = [q for q in range(len(asked)) if len(best[q][0])]
            yield pa.RecordBatch.from_arrays([pa.array([asked[q][0] for q in keep], pa.int64()), pa.array([best[q][0].tobytes() for q in keep], pa.binary()), pa.array([best[q][1].tobytes() for q in keep], pa.binary())], ["query_id", "ids", "scores"])

        def merge(group):
            by: dict[int, list] = {}
            for q, i, s in zip(group.column("query_id").to_pylist(), group.column("ids").to_pylist(), group.column("scores").to_pylist(), strict=True):
                by.setdefault(q, []).append((np.frombuffer(i, np.int64), np.frombuffer(s)))
            rows = [(q, r + 1, int(d), float(s)) for q, found in by.items() for r, (d, s) in enumerate(zip(*_best(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), k), strict=True))]
            q, r, d, s = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
            return pa.table({"query_id": pa.array(q, pa.int64()), "rank": pa.array(r, pa.int32()), "doc_id": pa.array([None if x == LAST_ID else x for x in d], pa.int64()), "score": pa.array(s, pa.float64())})

        found = index.select("payload").coalesce(tasks).mapInArrow(each, "query_id long, ids binary, scores binary").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts_for(spark, len(rows), 1000))))
        merged = found.groupBy("part").applyInArrow(merge, SCHEMA)
        out = merged if out is None else out.union(merged)
    return out


def divisible_queries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: int = 100) -> DataFrame:
    own = id_and_text(docs, id_col, text_col)
    return own.where(F.col("doc_id") % by == 0).select(F.col("doc_id").alias("query_id"), "text")

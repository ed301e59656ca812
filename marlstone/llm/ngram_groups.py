"""N-gram Jaccard join by a token-group matrix (operator 10).

A document is the set of its distinct n-word shingles; two link when 100 * |A n B| >= percent * |A u B|
(a ``Rule``: 3 words and 90 in the registered query, 5 words and 80 in the corpus pipeline).

1. Documents go once into a table of chunks (see ``repeats``); every pass derives the sets again, so
   no token table is stored.  Equal sets are one class, stood for by its least document.
2. *Partition into groups*: classes that share a min-hash key are compared with the key's least
   member; verified links make clusters of similar documents, which are cut by hash into groups of
   about ``group_size``.
3. *Candidate groups*: under a global order by rarity (a table of counts over all documents,
   sized by the corpus up to 16 MB) linked sets share a token among their first |A| - ceil(t|A|) + 1.  Tokens held by
   several clusters give (document, group) candidates of fitting sizes, each pair of clusters in
   one direction, if their parity sketches allow a link: a sketch has a bit for the parity of the
   tokens in each slot, so two sets differ in at least as many tokens as their sketches in bits.
4. *Matrix row and bound*: a candidate group's row is the union of its members' tokens; a query
   that has fewer than ceil(t|A|) tokens in it cannot qualify.  Only qualifying groups are opened
   and their members compared exactly; a group is connected already, so one link is enough.
5. Components by least-label propagation with pointer jumping over the few links.

Equal sets, a cluster's own members and the pairs within a group are never expanded, so thousands of
near copies cost one comparison each; groups and their query lists are split to bounded sizes.
Tokens are 64-bit hashes (of their words' bytes, through a finaliser), cut to 48 bits only where
candidates are sought.

Defined cases: null and wordless texts have the empty set and are their own component; fewer than
n words are one shingle; rows that share an id are of one component (not in ``keep_one``, which goes
by row); a null id is the greatest, joins no rows, and its component is null if no other id is in it;
an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import quoted, stored, summed
from .repeats import LAST_ID, Chunks, dealt, part_of, ragged, stretches, unpack

COUNT_PIECES = 16
BLOCK, PAIRS = 4096, 1 << 20
#: Rows to drop that may be broadcast (8 MB of ids and text digests); more are joined by shuffling.
BROADCAST_ROWS = (8 << 20) // 24
KEYS, PER_KEY = 4, 2
SCHEMA = "doc_id long, n_shingles long, component_id long"


@dataclasses.dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link from ``percent`` hundredths of their union in common."""

    words: int = 3
    percent: int = 90

    def needed(self, n):
        """Least intersection of a set of ``n`` with anything it links to."""
        return -(-self.percent * n // 100)

    def fits(self, n, m):
        """Whether sets of ``n`` and ``m`` can link at all (numbers, arrays or columns)."""
        return (n * 100 >= m * self.percent) & (m * 100 >= n * self.percent)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Exact test on sorted distinct tokens."""
        if not self.fits(len(a), len(b)):
            return False
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[at] == a).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def size_class(self, n: int) -> int:
        """Sizes that fit are of one class or of neighbours."""
        return int(np.log(max(n, 1)) / np.log(100 / min(self.percent, 90)) + 1e-9)

    def differ(self, n):
        """Most tokens in which linked sets of together ``n`` tokens differ."""
        return (100 - self.percent) * n // (100 + self.percent)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each document."""
    starts, ends, first = tv.words(data, off, tv.SPACED_LOWER)
    hashes = tv.word_hashes(data, starts, ends, tv.SPACED_LOWER)
    windows = tv.window_hashes(hashes, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(windows[a : b - words + 1]) if b - a >= words else tv.window_hashes(hashes[a:b], b - a) if b > a else windows[:0])
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each slot; as many bits as tokens, rounded up to a power of two."""
    bits = 1 << max(6, len(tokens).bit_length())
    odd = np.bincount((tokens >> np.uint64(16) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(rule: Rule, a: np.ndarray, b: np.ndarray, n: np.ndarray, words: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Which pairs of rows (a, b) can still link by sizes and sketches (row r: words[r] words of ``flat`` at at[r])."""
    out, most = rule.fits(n[a], n[b]), rule.differ(n[a] + n[b])
    width = np.minimum(words[a], words[b])

    def folded(rows, w):
        """Sketches of ``rows`` as w words: a wider one is the exclusive or of its stretches."""
        got = np.zeros((len(rows), w), np.uint64)
        for times in np.unique(words[rows] // w):
            own = np.flatnonzero(words[rows] // w == times)
            for k in range(times):
                got[own] ^= flat[at[rows[own]][:, None] + np.arange(k * w, (k + 1) * w)]
        return got

    for w in np.unique(width[out]):
        which = np.flatnonzero(out & (width == w))
        for begin in range(0, len(which), max(1, PAIRS // int(w))):
            own = which[begin : begin + max(1, PAIRS // int(w))]
            apart = np.bitwise_count(folded(a[own], int(w)) ^ folded(b[own], int(w))).sum(axis=1, dtype=np.int64)
            out[own] = apart <= most[own]
    return out


def sketches(columns: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, places, words of all) of sketch columns, one after another."""
    raw = [x for c in columns for x in c.to_pylist()]
    words = np.asarray([len(x) // 8 for x in raw], np.int64)
    return words, np.concatenate(([0], np.cumsum(words)))[:-1], np.frombuffer(b"".join(raw), np.uint64)


def short(tokens: np.ndarray) -> np.ndarray:
    return np.unique(tokens >> np.uint64(16))


def six(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, :6] = part
    return wide.view("<u8").ravel().astype(np.uint64)


def count_bits(n_bytes: int) -> int:
    """Slots of the rarity table, as a power of two: one for each 128 bytes of text, between 2^22 and 2^24."""
    return min(max(22, math.ceil(math.log2(max(n_bytes, 1) / 128))), 24)


def token_counts(chunks: Chunks, rule: Rule) -> np.ndarray:
    """Documents by token slot over the whole corpus, a byte each: eight times the binary logarithm, so none saturates."""
    size = 1 << count_bits(chunks.bytes)

    def each(batches):
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for r in range(batch.num_rows):
                _, _, data, off = unpack(batch, r)
                sets = [short(s) for s in shingle_sets(data, off, rule.words)]
                if sets:
                    slots, times = np.unique(np.concatenate(sets) & np.uint64(size - 1), return_counts=True)
                    total[slots.astype(np.int64)] += times.astype(np.uint32)
        return total

    counted = summed(chunks.table.select("ids", "nulls", "ends", "data"), each, size, np.int64, COUNT_PIECES)
    return np.minimum(np.rint(8 * np.log2(counted.astype(np.float32) + 1)), 255).astype(np.uint8)


def profiles(chunks: Chunks, rule: Rule, by_row: bool = False) -> DataFrame:
    """doc_id, chunk, idx, n, fp, text, sig, keys of every document; text is its digest (empty if not ``by_row``)."""

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, _, data, off = unpack(batch, r)
                fps, sigs, keys, sizes = [], [], [], []
                for s in shingle_sets(data, off, rule.words):
                    sizes.append(len(s))
                    fps.append(hashlib.md5(s.tobytes()).digest())
                    sigs.append(sketch(s))
                    least = [int(tv.mix(s ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))).min()) for j in range(KEYS * PER_KEY)] if len(s) else []
                    keys.append([hash((k, *least[k * PER_KEY : (k + 1) * PER_KEY])) for k in range(KEYS)] if least else [])
                n = len(sizes)
                texts = [hashlib.md5(data[a:b]).digest() if by_row else b"" for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([batch.column(0)[r].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(texts, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "chunk", "idx", "n", "fp", "text", "sig", "keys"])

    return chunks.table.select("chunk", "ids", "nulls", "ends", "data").mapInArrow(each, "doc_id long, chunk long, idx int, n long, fp binary, text binary, sig binary, keys array<long>")


def ship(chunks: Chunks, rule: Rule, requests: DataFrame) -> DataFrame:
    """Token sets to where they are compared: requests (chunk, idx, node, target, salt, query) -> target, salt, query, node, tokens."""
    asked = requests.groupBy("chunk").agg(F.collect_list(F.struct("idx", "node", "target", "salt", "query")).alias("asked"))
    schema = "target long, salt int, query boolean, node long, tokens binary"

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                _, _, data, off = unpack(batch, r)
                asked = batch.column(batch.schema.get_field_index("asked"))[r].as_py()
                wanted = np.unique([x["idx"] for x in asked])
                size = off[wanted + 1] - off[wanted]
                sets = shingle_sets(data[ragged(off[wanted], size)], np.concatenate(([0], np.cumsum(size))), rule.words)
                done = {int(i): x.astype("<u8").tobytes() for i, x in zip(wanted, sets, strict=True)}
                for begin in range(0, len(asked), 1000):
                    rows = asked[begin : begin + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([x["target"] for x in rows], pa.int64()), pa.array([x["salt"] for x in rows], pa.int32()), pa.array([x["query"] for x in rows], pa.bool_()), pa.array([x["node"] for x in rows], pa.int64()), pa.array([done[x["idx"]] for x in rows], pa.binary())], ["target", "salt", "query", "node", "tokens"])

    return chunks.table.join(asked, "chunk").mapInArrow(each, schema)


def _sides(group) -> tuple[list, list]:
    rows = list(zip(group.column("query").to_pylist(), group.column("node").to_pylist(), group.column("tokens").to_pylist(), strict=True))
    sets = lambda asks: [(d, np.frombuffer(t, "<u8")) for q, d, t in rows if q == asks]
    return sets(False), sets(True)


def open_group(rule: Rule, group):
    """Queries against one group: bound by the union of its members' tokens, then compare."""
    members, queries = _sides(group)
    a, b = [], []
    if members and queries:
        union = np.unique(np.concatenate([t for _, t in members]))
        for q, tokens in queries:
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            if int((union[at] == tokens).sum()) < rule.needed(len(tokens)):
                continue  # the group does not qualify
            found = next((m for m, t in members if rule.links(tokens, t)), None)
            if found is not None:
                a.append(q)
                b.append(found)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _plausible(rule: Rule, batches):
    """Rows whose document may link to the head beside it."""
    for batch in batches:
        rows = batch.num_rows
        n = np.concatenate([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("n", "h_n")])
        ok = may_link(rule, np.arange(rows), np.arange(rows, 2 * rows), n, *sketches([batch.column(batch.schema.get_field_index(c)) for c in ("sig", "h_sig")]))
        yield batch.filter(pa.array(ok))


def close_pairs(rule: Rule, group):
    """Rows (token, side, chunk, idx, n, label, members, block, sig) -> (document, group) candidates.

    Pairs of rows with one token, of different clusters, that may link; the document is of the
    lesser cluster (members, label).  ``side`` tells the two blocks of a split token's rows apart.
    """
    order = np.lexsort((np.asarray(group.column("split")), np.asarray(group.column("token"))))
    group = group.take(pa.array(order))
    col = {c: np.asarray(group.column(c)) for c in ("token", "split", "side", "chunk", "idx", "n", "label", "members", "block")}
    words, at, flat = sketches([group.column("sig")])
    last = np.append((col["token"][1:] != col["token"][:-1]) | (col["split"][1:] != col["split"][:-1]), True)
    ends = np.flatnonzero(last) + 1
    partners = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(len(last)) - 1
    total, found, begin = np.cumsum(partners), [], 0
    while begin < len(partners):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        rows = np.arange(begin, end)
        a, b = np.repeat(rows, partners[rows]), ragged(rows + 1, partners[rows])
        keep = (col["label"][a] != col["label"][b]) & ((col["side"][a] != col["side"][b]) | (col["side"][a] == 0))
        a, b = a[keep], b[keep]
        keep = may_link(rule, a, b, col["n"], words, at, flat)
        a, b = a[keep], b[keep]
        swap = (col["members"][a] > col["members"][b]) | ((col["members"][a] == col["members"][b]) & (col["label"][a] > col["label"][b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        found.append(np.stack((col["chunk"][a], col["idx"][a].astype(np.int64), col["label"][a], col["label"][b], col["block"][b].astype(np.int64)), axis=1))
        begin = end
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 5), np.int64)
    return pa.table({"chunk": pa.array(rows[:, 0]), "idx": pa.array(rows[:, 1].astype(np.int32)), "label": pa.array(rows[:, 2]), "g_label": pa.array(rows[:, 3]), "g_block": pa.array(rows[:, 4].astype(np.int32))})


def components(edges: DataFrame) -> DataFrame:
    """(node, label): least node reachable, for every node of ``edges`` (a, b)."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label"))
        step = stored(step, "labels")
        changed = not step.where("was <> label").isEmpty()
        labels = step.select("node", "label")
        if not changed:
            return labels


def shared_ids(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the classes of each id that has several; rows without an id share none."""
    own = profile.where(F.col("n") > 0).where(F.col("doc_id") != LAST_ID)
    several = own.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id", "x")
    pairs = own.join(several, "doc_id").where("fp <> x").select("fp", "x").distinct()
    return pairs.join(classes.select("fp", F.col("node").alias("a")), "fp").join(classes.select(F.col("fp").alias("x"), F.col("node").alias("b")), "x").select("a", "b")


def linked_rows(docs: DataFrame, rule: Rule, id_col: str, text_col: str, group_size: int = 128, member_rows: int = 1024, by_row: bool = False) -> DataFrame:
    """One row per document: doc_id, n, text, and its component's least head (doc_id, text), null for the empty set.

    Classes are linked by their sets alone if ``by_row``, else those that share an id as well.
    """
    chunks = Chunks(docs, id_col, text_col)
    spark = chunks.spark
    profile = stored(profiles(chunks, rule, by_row), "profiles")
    classes = stored(profile.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "text", "chunk", "idx", "n", "sig", "keys")).alias("r")).select(F.monotonically_increasing_id().alias("node"), "fp", "r.*"), "classes")

    # Groups: compare each class with the least one of its keys.
    keyed = classes.select("node", "doc_id", "chunk", "idx", "n", "sig", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "node", "chunk", "idx", "n", "sig")).alias("h"), F.count("*").alias("size")).where("size > 1")
    pairs = keyed.join(heads, "key").where("node <> h.node").select("chunk", "idx", "node", "n", "sig", F.col("h.node").alias("target"), F.col("h.chunk").alias("h_chunk"), F.col("h.idx").alias("h_idx"), F.col("h.n").alias("h_n"), F.col("h.sig").alias("h_sig"))
    members = stored(pairs.mapInArrow(partial(_plausible, rule), pairs.schema).select("chunk", "idx", "node", "target", "h_chunk", "h_idx").distinct(), "members")
    sizes = members.groupBy("target", "h_chunk", "h_idx").agg(F.count("*").alias("size")).withColumn("salts", F.ceil(F.col("size") / member_rows).cast("int"))
    asked = members.join(sizes.select("target", "salts"), "target").select("chunk", "idx", "node", "target", F.pmod(F.xxhash64("chunk", "idx"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("query"))
    asked = asked.union(sizes.select(F.col("h_chunk").alias("chunk"), F.col("h_idx").alias("idx"), F.col("target").alias("node"), "target", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False)))
    near = stored(ship(chunks, rule, asked).groupBy("target", "salt").applyInArrow(lambda group: open_group(rule, group), "a long, b long"), "near")
    label = components(near if by_row else near.union(shared_ids(profile, classes))).withColumnRenamed("node", "l_node")
    labelled = classes.join(label, F.col("node") == F.col("l_node"), "left").select("fp", "doc_id", "text", "chunk", "idx", "n", "sig", F.coalesce("label", "node").alias("label"))
    cluster = labelled.groupBy("label").agg(F.count("*").alias("members"))
    grouped = stored(labelled.join(cluster, "label").withColumn("block", F.pmod(F.xxhash64("chunk", "idx"), F.ceil(F.col("members") / group_size).cast("long")).cast("int")), "groups")

    # Candidate groups: rare tokens that several clusters hold.
    counts = spark.sparkContext.broadcast(token_counts(chunks, rule))
    parts = chunks.parts(chunks.bytes, 64 << 20)

    def rare(batches):
        table = counts.value
        for batch in batches:
            for r in range(batch.num_rows):
                _, _, data, off = unpack(batch, r)
                known = {x["idx"]: x["label"] for x in batch.column(batch.schema.get_field_index("info"))[r].as_py()}
                sets, tokens, idx, label = shingle_sets(data, off, rule.words), [], [], []
                for i, own in known.items():
                    t = short(sets[i])
                    order = np.lexsort((t, table[(t & np.uint64(len(table) - 1)).astype(np.int64)]))
                    first = t[order[: len(t) - rule.needed(len(t)) + 1]]
                    tokens.append(first)
                    idx.append(np.full(len(first), i, np.uint32))
                    label.append(np.full(len(first), own, np.int64))
                if not tokens:
                    continue
                tokens, idx, label = map(np.concatenate, (tokens, idx, label))
                order = np.argsort(tokens, kind="stable")
                tokens, idx, label = tokens[order], idx[order], label[order]
                kind = np.asarray([rule.size_class(len(x)) for x in sets], np.uint8)[idx]
                places = idx.astype(np.uint16) if len(sets) < 65536 else idx
                part, rows = stretches(part_of(tokens, parts, 48))
                sent = [b"".join((six(tokens[x:y]), label[x:y].tobytes(), kind[x:y].tobytes(), places[x:y].tobytes())) for x, y in rows]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(rows), pa.int64()), pa.array([y - x for x, y in rows], pa.int32()), pa.array(sent, pa.binary())], ["part", "chunk", "size", "sent"])

    def shared(group):
        """Entries of tokens that several clusters hold, with a holder of like size; heavy tokens in blocks."""
        tokens, label, kind, idx = [], [], [], []
        size = np.asarray(group.column("size"))
        for n, raw in zip(size.tolist(), group.column("sent").to_pylist(), strict=True):
            tokens.append(unsix(raw[: 6 * n]))
            label.append(np.frombuffer(raw[6 * n : 14 * n], np.int64))
            kind.append(np.frombuffer(raw[14 * n : 15 * n], np.uint8).astype(np.int64))
            idx.append(np.frombuffer(raw[15 * n :], np.uint16 if len(raw) == 17 * n else np.uint32).astype(np.int64))
        tokens, label, kind, idx = map(np.concatenate, (tokens, label, kind, idx))
        chunk = np.repeat(np.asarray(group.column("chunk")), size)
        order = np.lexsort((label, kind, tokens))
        t, k = tokens[order], kind[order]
        near = (t[1:] == t[:-1]) & (k[1:] - k[:-1] <= 1)
        order = order[np.append(near, False) | np.append(False, near)]
        order = order[np.lexsort((label[order], tokens[order]))]
        if not len(order):
            return pa.table({"token": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "idx": pa.array([], pa.int32()), "blocks": pa.array([], pa.int32())})
        t, own = tokens[order], label[order]
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        count = np.diff(np.append(start, len(t)))
        several = np.repeat(own[start] != own[start + count - 1], count)
        blocks = np.repeat(-(-count // BLOCK), count)[several]
        keep = order[several]
        return pa.table({"token": pa.array(tokens[keep].astype(np.int64)), "chunk": pa.array(chunk[keep], pa.int64()), "idx": pa.array(idx[keep].astype(np.int32)), "blocks": pa.array(blocks.astype(np.int32))})

    info = grouped.groupBy("chunk").agg(F.collect_list(F.struct("idx", "label")).alias("info"))
    told = chunks.table.select("chunk", "ids", "nulls", "ends", "data").join(info, "chunk")
    hits = dealt(told, rare, "size int, sent binary", parts, shared, "token long, chunk long, idx int, blocks int", chunks.bytes // 4)
    hits = hits.join(grouped.select("chunk", "idx", "n", "sig", "label", "members", "block"), ["chunk", "idx"])
    own = F.pmod(F.xxhash64("chunk", "idx"), F.col("blocks")).cast("int")
    met = hits.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.withColumn("split", (low * F.col("blocks") + high).cast("long")).withColumn("side", F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2))
    met = met.withColumn("part", F.pmod(F.xxhash64("token", "split"), F.lit(parts))).select("part", "token", "split", "side", "chunk", "idx", "n", "label", "members", "block", "sig")
    candidates = stored(met.groupBy("part").applyInArrow(lambda group: close_pairs(rule, group), "chunk long, idx int, label long, g_label long, g_block int").distinct(), "candidates")

    # Matrix rows, bounds, and opened groups.
    asked_groups = candidates.groupBy("g_label", "g_block").agg(F.count("*").alias("queries")).withColumn("salts", F.ceil(F.col("queries") / member_rows).cast("int"))
    target = F.xxhash64("g_label", "g_block").alias("target")
    wanted = candidates.join(asked_groups, ["g_label", "g_block"]).select("chunk", "idx", F.col("label").alias("node"), target, F.pmod(F.xxhash64("chunk", "idx"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("query"))
    rows = grouped.select("chunk", "idx", F.col("label").alias("g_label"), F.col("block").alias("g_block")).join(asked_groups, ["g_label", "g_block"])
    wanted = wanted.union(rows.select("chunk", "idx", F.col("g_label").alias("node"), target, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False)))
    far = stored(ship(chunks, rule, wanted).groupBy("target", "salt").applyInArrow(lambda group: open_group(rule, group), "a long, b long"), "far")

    # Components of clusters (``far`` links their labels), then the least head of each.
    of_class = grouped.select("fp", "doc_id", "text", "label")
    if not far.isEmpty():
        joined = components(far).select(F.col("node").alias("label"), F.col("label").alias("root"))
        of_class = of_class.join(joined, "label", "left").select("fp", "doc_id", "text", F.coalesce("root", "label").alias("label"))
    heads = of_class.groupBy("label").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    return profile.select("doc_id", "n", "text", "fp").join(of_class.select("fp", "label").join(heads, "label").select("fp", "head"), "fp", "left").select("doc_id", "n", "text", "head")


def link_classes(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", group_size: int = 128, member_rows: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    out = linked_rows(docs, rule, id_col, text_col, group_size, member_rows)
    real = lambda c: F.when(c != LAST_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("head.doc_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(5, 80), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies (the one with the least id), columns unchanged; empty texts stay.

    Rows are told apart by id and text, so rows that share an id, or have none, stay or go by their
    own texts; of rows alike in both one stays.
    """
    rows = linked_rows(docs, rule, id_col, text_col, by_row=True).where("head IS NOT NULL")
    rows = rows.groupBy("doc_id", "text").agg(F.first("head").alias("head"), F.count("*").alias("rows"))
    stays = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("text") == F.col("head.text"))
    own = uuid.uuid4().hex  # no column of ``docs`` has such names
    row_id, row_text = f"id_{own}", f"text_{own}"
    rows = stored(rows.where(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias(row_id), F.col("text").alias(row_text), stays.alias("stays")), "extra")
    few = rows.count() <= BROADCAST_ROWS
    same = (F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(LAST_ID)) == F.col(row_id)) & (F.unhex(F.md5(F.col(quoted(text_col)).cast("string"))) == F.col(row_text))
    told = lambda r: F.broadcast(r.drop("stays")) if few else r.drop("stays").hint("merge")
    out, twins = docs.join(told(rows), same, "left_anti"), rows.where("stays")
    if twins.isEmpty():
        return out
    return out.union(docs.join(told(twins), same).dropDuplicates([row_id, row_text]).drop(row_id, row_text))

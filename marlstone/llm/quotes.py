"""Quotation linking for conversations (operator 1).

A line that starts with ``>`` marks (blanks between them allowed) is quoted, as deep as it has marks;
a passage is a maximal run of lines of one depth.  Passages, and each line of them, are normalised
(marks gone, A-Z lowered, white space collapsed) and hashed; unquoted runs and lines of messages are
hashed alike.  The original of a hash is the earliest message of the conversation that wrote it; a
passage is linked to its own hash's original, else to the latest original among its lines'.

A message answers the greatest original among its least deep linked passages, else the message one
turn before it.  ``reply_path`` orders a conversation by replies: a message that answers another than
its predecessor starts a branch, placed right after the message it answers.  Sorted by (conv_id,
reply_path), the bodies are the conversation without quotes.

Scale: hashes meet by (conversation, hash) with one row per side after map-side combining, so a
conversation or line that holds a third of all rows is never gathered; branches are found by running
maxima over spans of turns and a carry between spans, and their paths by pointer doubling (a path is
as long as branches are nested).

Defined cases: null and empty texts have an empty body; rows that share (conv_id, turn) are one place
in the order and answer alike if they quote alike; a null conv_id or turn links to nothing and its
path is null; passages without words are not counted; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MARKS = re.compile(r"[ \t]*>[> \t]*")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PARSED = "row long, conv_id long, turn long, role string, body string, n_quotes int, max_depth int, units array<string>, quotes array<struct<k:int,depth:int,level:int,hash:string>>"
SPAN = 1024


def normalised(text: str) -> str:
    return SPACE.sub(" ", text.translate(LOWER)).strip(" ")


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def parse(text: str | None) -> tuple[str, int, int, list[str], list[dict]]:
    """(body, passages, greatest depth, hashes of own units, quoted units)."""
    lines = []
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        lines.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    runs: list[tuple[int, list[str]]] = []
    for depth, content in lines:
        if not runs or runs[-1][0] != depth:
            runs.append((depth, []))
        runs[-1][1].append(content)
    units, quotes, k, deepest = set(), [], 0, 0
    for depth, content in runs:
        whole = normalised(" ".join(content))
        if not whole:
            continue
        each = {digest(x) for x in map(normalised, content) if x}
        if depth == 0:
            units |= each | {digest(whole)}
        else:
            deepest = max(deepest, depth)
            quotes.append({"k": k, "depth": depth, "level": 0, "hash": digest(whole)})
            quotes += [{"k": k, "depth": depth, "level": 1, "hash": h} for h in sorted(each)]
            k += 1
    body = "\n".join(c for d, c in lines if d == 0).strip(" \t\r\n\x0b\x0c")
    return body, k, deepest, sorted(units), quotes


def parsed(messages: DataFrame) -> DataFrame:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("k", pa.int32()), ("depth", pa.int32()), ("level", pa.int32()), ("hash", pa.string())]))]
    names = ["row", "conv_id", "turn", "role", "body", "n_quotes", "max_depth", "units", "quotes"]

    def each(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = list(zip(*(parse(t) for t in batch.column(3).to_pylist()), strict=True)) or [[]] * 5
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[:3], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)

    own = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return stored(own.mapInArrow(each, PARSED), "quotes")


def links(table: DataFrame) -> DataFrame:
    """row -> n_linked, linked (the turn it answers by quotation)."""
    originals = table.select("conv_id", F.explode("units").alias("hash"), "turn").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quoted = table.select("row", "conv_id", "turn", F.inline("quotes")).join(originals, ["conv_id", "hash"]).where("original < turn")
    passages = quoted.groupBy("row", "k", "depth").agg(F.max(F.struct((-F.col("level")).alias("level"), "original")).alias("best"))
    return passages.groupBy("row").agg(F.count("*").alias("n_linked"), F.max(F.struct((-F.col("depth")).alias("up"), F.col("best.original").alias("turn"))).alias("top")).select("row", "n_linked", F.col("top.turn").alias("linked"))


def threads(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the latest branch start at or before each turn."""
    span = turns.withColumn("span", F.floor(F.col("turn") / SPAN)).withColumn("at", F.when(F.col("starts"), F.col("turn")))
    local = F.max("at").over(Window.partitionBy("conv_id", "span").orderBy("turn"))
    before = F.max("last").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    carry = span.groupBy("conv_id", "span").agg(F.max("at").alias("last")).select("conv_id", "span", before.alias("carry"))
    return span.withColumn("own", local).join(carry, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("own", "carry").alias("thread"))


def thread_paths(starts: DataFrame) -> DataFrame:
    """(conv_id, thread, path) from (conv_id, thread, parent turn, up): pointer doubling over branches."""
    step = F.when(F.col("up").isNull(), F.array().cast("array<long>")).otherwise(F.array("parent", "thread"))
    now = stored(starts.select("conv_id", "thread", "up", step.alias("path")), "paths")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select("conv_id", F.col("thread").alias("up"), F.col("path").alias("prefix"), F.col("up").alias("further"))
        now = stored(now.join(above, ["conv_id", "up"], "left").select("conv_id", "thread", F.col("further").alias("up"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("prefix", "path")).alias("path")), "paths")
    return now.select("conv_id", "thread", "path")


def padded(turn):
    """A turn as text that sorts by number: ten digits; longer ones 19 behind ``a``, negative ones counted from the least behind ``-``."""
    wide = lambda x: F.lpad(x.cast("string"), 19, "0")
    long = F.when(turn < 0, F.concat(F.lit("-"), wide(turn.bitwiseAND(F.lit((1 << 63) - 1))))).otherwise(F.concat(F.lit("a"), wide(turn)))
    return F.when((turn >= 0) & (turn < 10**10), F.lpad(turn.cast("string"), 10, "0")).otherwise(long)


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quotes, max_depth, n_linked, reply_to, reply_path."""
    table = parsed(messages)
    told = table.drop("units", "quotes").join(links(table), "row", "left")
    there = table.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", (F.col("turn") + 1).alias("turn")).distinct().withColumn("before", F.col("turn") - 1)
    told = stored(told.join(there, ["conv_id", "turn"], "left"), "linked")
    parent = F.coalesce("linked", "before")
    turns = told.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("linked").alias("linked"), F.max("before").alias("before")).withColumn("parent", parent)
    turns = stored(turns.withColumn("starts", F.col("parent").isNull() | ~F.col("parent").eqNullSafe(F.col("before"))), "turns")
    thread = stored(threads(turns), "threads")
    up = thread.select("conv_id", F.col("turn").alias("parent"), F.col("thread").alias("up"))
    starts = turns.where("starts").select("conv_id", F.col("turn").alias("thread"), "parent").join(up, ["conv_id", "parent"], "left")
    paths = thread_paths(starts)
    key = F.array_join(F.transform(F.concat("path", F.array("turn")), padded), ".")
    place = thread.join(paths, ["conv_id", "thread"]).select("conv_id", "turn", key.alias("reply_path"))
    out = told.join(place, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", F.col("n_quotes").cast("long"), F.col("max_depth").cast("long"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), parent.alias("reply_to"), "reply_path")

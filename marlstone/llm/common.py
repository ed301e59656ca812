"""Shared plumbing of the training-data operators: table access, scratch tables, Arrow views of text.

Conventions that hold for every operator here:

* an operator first selects the columns it needs, so further columns (also ones whose names clash
  with its outputs) never reach it;
* a null text is the empty text; a null id is carried through as null;
* an empty table gives an empty result with the documented schema;
* intermediate tables go to ``spark.checkpoint.dir`` (shared storage), never to a local folder.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at once (a longer document is taken alone).
SLICE_BYTES = 2 << 20
#: Partial results that one task adds up at most.
FAN = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master (tests) makes its own where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and current.isDefined():
        path = current.get()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/marlstone-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def slots(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, amount: int, per_part: int) -> int:
    """Partitions that hold at most ``per_part`` on average, and never fewer than the session's own count."""
    return max(slots(spark), math.ceil(amount / per_part))


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever marks it holds."""
    return "`" + name.replace("`", "``") + "`"


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))


def mapped(docs: DataFrame, function) -> DataFrame:
    """``mapInArrow`` that keeps the columns of ``docs``, whatever their names (dots, repeated ones)."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(function, plain.schema).toDF(*docs.columns)


def utf8_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs [i, j) of documents with at most ``limit`` bytes; a longer document makes a run alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def summed(table: DataFrame, partial, size: int, kind=np.float64, pieces: int = 1) -> np.ndarray:
    """The sum over all tasks of ``partial(batches)``, an array of ``size`` numbers of ``kind``.

    Each task sends its array once, cut into ``pieces``; arrays are added up in a tree in which no
    task takes more than FAN of them, however many tasks there are, and one array reaches the driver.
    """
    kind, edges = np.dtype(kind), np.linspace(0, size, pieces + 1).astype(int)

    def each(batches):
        total, squeeze = partial(batches), zstandard.ZstdCompressor(level=1).compress
        rows = [squeeze(total[a:b].astype(kind).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * pieces, pa.int32()), pa.array(range(pieces), pa.int32()), pa.array(rows, pa.binary())], ["task", "piece", "part"])

    def total_of(rows):
        inflate = zstandard.ZstdDecompressor().decompress
        return sum(np.frombuffer(inflate(r), kind) for r in rows)

    def add(group):
        one = zstandard.ZstdCompressor(level=1).compress(total_of(x.as_py() for x in group.column("part")).tobytes())
        return pa.table([group.column("task")[:1], group.column("piece")[:1], pa.array([one], pa.binary())], names=["task", "piece", "part"])

    schema = "task int, piece int, part binary"
    rows, tasks = table.mapInArrow(each, schema), table.rdd.getNumPartitions()
    while tasks > 1 and (tasks > FAN or pieces > 1):
        tasks = -(-tasks // FAN)
        rows = rows.select(F.floor(F.col("task") / FAN).cast("int").alias("task"), "piece", "part").groupBy("task", "piece").applyInArrow(add, schema)
    out = np.zeros(size, kind)
    for _, k, part in rows.collect():
        out[edges[k] : edges[k + 1]] += total_of([part])
    return out


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())

"""A training corpus from ``documents`` in five stages, each one operator over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each stage as Parquet in the shared folder and reads it for the next.

Cases that hold for every stage: an empty table gives an empty one; a null text is an empty one and
stays null where a row stays; rows are judged one by one, so repeated rows, rows that share an id and rows
without one stay or go by their own texts; further columns, whatever their names, are carried along; ties
go by the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, ngram_groups, packing, quality, secretscan
from marlstone.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go; empty texts all score alike, and without labels all score 0.5 and stay."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, four fifths in common.

    The one with the least id stays, a row without an id only if none has one; texts without words all stay.
    """
    return ngram_groups.keep_one(docs, ngram_groups.Rule(words=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage (13 words in a row, or a whole shorter item) go; items without words have none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are replaced by marks of their kind; ``n_chars`` follows the text (null with it); no document goes."""
    redacted = secretscan.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 2048 tokens at most; an empty text is one piece, the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Not expressible in SQL (a fitted model, a tokenizer); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

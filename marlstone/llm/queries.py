"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, decontam, ngram_groups, packing, quality, quotes, secretscan, substring_doubling, suffix_levels, wavelet
from .common import table


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(table(spark, sf_dir, "conversations"))


def op2_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(bm25.build_index(docs), bm25.divisible_queries(docs), k=10)
    return found.withColumn("score", F.round("score", 6))


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.find(table(spark, sf_dir, "documents"))


def op8_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_doubling.find(table(spark, sf_dir, "documents"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_back(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op10_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups.link_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quotation_linking, op2_credential_linking, op3_best_fit_packing, op4_pu_quality, op5_benchmark_decontamination, op6_bm25_topk, op7_suffix_levels, op8_substring_doubling, op9_wavelet_shards, op10_ngram_groups)}
#: Words as bm25 takes them: A-Z lowered, runs of digits, letters and everything beyond ASCII.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE: dict[str, str] = {
    "op1_quotation_linking": r"""
WITH RECURSIVE
messages AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
numbered AS (SELECT id, conv_id, turn, generate_subscripts(l, 1) AS pos, unnest(l) AS line
             FROM (SELECT id, conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l FROM messages)),
lines AS (SELECT id, conv_id, turn, pos, regexp_extract(line, '^[ \t]*>[> \t]*') AS mark, line FROM numbered),
cut AS (SELECT id, conv_id, turn, pos, length(mark) - length(replace(mark, '>', '')) AS depth, substr(line, length(mark) + 1) AS content FROM lines),
grouped AS (SELECT *, pos - row_number() OVER (PARTITION BY id, depth ORDER BY pos) AS run FROM cut),
normal AS (SELECT *, trim(regexp_replace(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM grouped),
runs AS (SELECT id, conv_id, turn, depth, run, min(pos) AS pos,
                trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), ' +', ' ', 'g'), ' ') AS whole
         FROM normal GROUP BY id, conv_id, turn, depth, run),
units AS (SELECT id, conv_id, turn, depth, pos AS k, 0 AS level, whole AS unit FROM runs WHERE whole <> ''
          UNION SELECT n.id, n.conv_id, n.turn, n.depth, r.pos, 1, n.line
          FROM normal n JOIN runs r USING (id, depth, run) WHERE n.line <> ''),
originals AS (SELECT conv_id, md5(unit) AS hash, min(turn) AS original FROM units WHERE depth = 0 GROUP BY ALL),
passages AS (SELECT u.id, u.k, u.depth, max({'level': -u.level, 'original': o.original}) AS best
             FROM units u JOIN originals o ON o.conv_id = u.conv_id AND o.hash = md5(u.unit) AND o.original < u.turn
             WHERE u.depth > 0 GROUP BY ALL),
linked AS (SELECT id, count(*) AS n_linked, max({'up': -depth, 'turn': best.original}).turn AS linked FROM passages GROUP BY id),
quoted AS (SELECT id, count(*) AS n_quotes, max(depth) AS max_depth FROM runs WHERE depth > 0 AND whole <> '' GROUP BY id),
bodies AS (SELECT id, trim(string_agg(content, chr(10) ORDER BY pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM cut WHERE depth = 0 GROUP BY id),
told AS (SELECT m.conv_id, m.turn, m.role, coalesce(b.body, '') AS body, coalesce(n_quotes, 0) AS n_quotes, coalesce(max_depth, 0) AS max_depth,
                coalesce(n_linked, 0) AS n_linked, l.linked, p.turn AS before
         FROM messages m LEFT JOIN linked l USING (id) LEFT JOIN quoted q USING (id) LEFT JOIN bodies b USING (id)
         LEFT JOIN (SELECT DISTINCT conv_id, turn FROM messages) p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1),
turns AS (SELECT conv_id, turn, max(linked) AS linked, max(before) AS before FROM told GROUP BY ALL),
paths AS (
  SELECT conv_id, turn, [turn] AS path FROM turns WHERE coalesce(linked, before) IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, CASE WHEN coalesce(t.linked, t.before) = t.before THEN list_concat(p.path[1:len(p.path) - 1], [t.turn]) ELSE list_concat(p.path, [t.turn, t.turn]) END
  FROM paths p JOIN turns t ON t.conv_id = p.conv_id AND coalesce(t.linked, t.before) = p.turn)
SELECT t.conv_id, t.turn, t.role, t.body, CAST(t.n_quotes AS BIGINT) AS n_quotes, CAST(t.max_depth AS BIGINT) AS max_depth, CAST(t.n_linked AS BIGINT) AS n_linked,
       coalesce(t.linked, t.before) AS reply_to,
       array_to_string(list_transform(p.path, lambda x: lpad(CAST(x AS VARCHAR), 10, '0')), '.') AS reply_path
FROM told t LEFT JOIN paths p USING (conv_id, turn)
""",
    "op6_bm25_topk": f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT doc_id, len(w) AS n FROM words),
stats AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM lengths),
postings AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM words) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM postings GROUP BY t),
scored AS (
  SELECT q.doc_id AS query_id, p.doc_id,
         round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score
  FROM postings q JOIN postings p USING (t) JOIN df USING (t) JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN stats
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, p.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
""",
}

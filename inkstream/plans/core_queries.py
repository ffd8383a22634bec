"""Queries over references and raw lines, with the same questions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.operators.references import Target, orphan_counts, orphan_references
from inkstream.session import table
from inkstream.sources.records import bad_lines, valid_records

QRELS = "qrels_retrieval_dev"


def _targets(spark: SparkSession, sf_dir: str) -> list[Target]:
    return [Target("passage_collection", table(spark, sf_dir, "passage_collection"), "pid", "pid"), Target("queries_dev", table(spark, sf_dir, "queries_dev"), "qid", "qid")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(table(spark, sf_dir, QRELS), "qrel_id", "judged_at", _targets(spark, sf_dir)).withColumnRenamed("row_id", "qrel_id")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(table(spark, sf_dir, QRELS), "qrel_id", "judged_at", _targets(spark, sf_dir)).withColumn("period", F.date_format("period", "yyyy-MM"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_lines(table(spark, sf_dir, "raw_lines")).select("line_id", "reason")


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_records(table(spark, sf_dir, "raw_lines")).select("line_id", "file_name", "record_key", "record_text")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_lines(table(spark, sf_dir, "raw_lines")).groupBy("file_name", "reason").agg(F.count("*").alias("n_lines"))


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p5_found, p5_valid, p5_reasons)}

_KEY = r"""nullif(regexp_replace(regexp_replace(translate(regexp_replace({0}, '^[\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{200b}}\x{{feff}}]+|[\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{200b}}\x{{feff}}]+$', '', 'g'), '０１２３４５６７８９．－＋', '0123456789.-+'), '^([+-]?)0*([0-9]+?)(?:\.0*)?$', '\1\2'), '^(?:\+|-(0$))', '\1'), '')"""
_CASES = f"""
WITH refs AS (
  SELECT qrel_id, 'passage_collection' AS ref_table, {_KEY.format('pid')} AS key, judged_at FROM qrels_retrieval_dev
  UNION ALL SELECT qrel_id, 'queries_dev', {_KEY.format('qid')}, judged_at FROM qrels_retrieval_dev),
spans AS (
  SELECT ref_table, key, min(added_at) AS added_at, min(deleted_at) AS deleted_at FROM (
    SELECT 'passage_collection' AS ref_table, {_KEY.format('pid')} AS key, added_at, deleted_at FROM passage_collection
    UNION ALL SELECT 'queries_dev', {_KEY.format('qid')}, added_at, deleted_at FROM queries_dev)
  WHERE key IS NOT NULL GROUP BY ALL),
cases AS (
  SELECT DISTINCT r.qrel_id, r.ref_table, r.judged_at, CASE WHEN s.key IS NULL THEN 'missing' WHEN s.added_at > r.judged_at THEN 'late' WHEN s.deleted_at <= r.judged_at THEN 'deleted' END AS state
  FROM refs r LEFT JOIN spans s ON r.ref_table = s.ref_table AND r.key = s.key WHERE r.key IS NOT NULL)
"""
_FIELD = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
_PLAIN = "CASE WHEN starts_with({0}, '\"') THEN replace(substring({0}, 2, length({0}) - 2), '\"\"', '\"') ELSE {0} END"
_LINES = rf"""
WITH lines AS (SELECT line_id, file_name, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS line FROM raw_lines),
parts AS (SELECT *, regexp_full_match(line, '{_FIELD}(?:\t{_FIELD})*', 's') AS sound, regexp_full_match(line, '{_FIELD}\t{_FIELD}', 's') AS pair,
  regexp_extract(line, '^({_FIELD})\t({_FIELD})\z', 1, 's') AS f1, regexp_extract(line, '^({_FIELD})\t({_FIELD})\z', 2, 's') AS f2 FROM lines),
fields AS (SELECT *, {_PLAIN.format('f1')} AS k, {_PLAIN.format('f2')} AS t FROM parts),
judged AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN NOT pair THEN 'columns'
  WHEN NOT regexp_full_match(k, '[1-9][0-9]{{0,9}}') OR regexp_full_match(t, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]*', 's') OR regexp_matches(t, '[\x{{FFFD}}\x7f\x00-\x08\x0a-\x1f]') THEN 'value' END AS reason FROM fields)
"""

ORACLE = {
    "p4_found": _CASES + "SELECT DISTINCT qrel_id, ref_table, state FROM cases WHERE state IS NOT NULL",
    "p4_counts": _CASES + "SELECT ref_table, strftime(judged_at, '%Y-%m') AS period, state, count(DISTINCT qrel_id) AS n_refs FROM cases WHERE state IS NOT NULL GROUP BY ALL",
    "p5_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_valid": _LINES + "SELECT line_id, file_name, k AS record_key, t AS record_text FROM judged WHERE reason IS NULL",
    "p5_reasons": _LINES + "SELECT file_name, reason, count(*) AS n_lines FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}

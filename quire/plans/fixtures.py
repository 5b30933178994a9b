"""Inputs derived from the driver's tables: readings, books, brackets, ledgers, patch logs.

Each fixture is a Spark function and, under the same name in ``SQL``, the DuckDB subquery that
gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, A, B, C): three readings of each document."""
    b = "CASE doc_id % 4 WHEN 1 THEN replace(text, 'l', '1') WHEN 2 THEN replace(text, ' ', '  ') ELSE text END"
    c = "CASE doc_id % 6 WHEN 1 THEN replace(text, 'e', 'c') ELSE text END"
    return table(spark, d, "documents").selectExpr("doc_id", "source", "text AS A", f"{b} AS B", f"{c} AS C")


def confidence(token, run):
    """Confidence of a token in these fixtures."""
    return F.when(F.length(token) % 7 == 0, 60.0).otherwise(95.0)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, a, b): two readings."""
    b = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN replace(text, 'l', '1') WHEN 3 THEN translate(text, 'aeiou', 'AEIOU') ELSE replace(text, '.', ',') END"
    return table(spark, d, "documents").selectExpr("doc_id", "source", "text AS a", f"{b} AS b")


def quads(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, r1, r2, rec, p4)."""
    return table(spark, d, "documents").selectExpr(
        "doc_id", "source", "text AS r1", "replace(text, 'l', '1') AS r2",
        "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'l', '1') ELSE replace(text, 'e', '3') END AS rec",
        "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'l', '1') WHEN 2 THEN replace(text, 'e', '3') ELSE replace(text, 'o', '0') END AS p4",
    )


def books(spark: SparkSession, d: str) -> DataFrame:
    """(book, page, text, reconcile, spot): stages of each page, null where a stage is missing."""
    return table(spark, d, "conversations").selectExpr(
        "conv_id AS book", "cast(turn + 1 AS int) AS page", "text",
        "CASE WHEN (turn + 1) % 3 = 0 THEN concat('R ', text) END AS reconcile",
        "CASE WHEN (turn + 1) % 7 = 0 THEN '' WHEN (turn + 1) % 4 = 0 THEN concat('S ', text) END AS spot",
    )


def bracketed(spark: SparkSession, d: str) -> DataFrame:
    """(book, page, text) with reconstructions split across pages."""
    return books(spark, d).selectExpr("book", "page", "CASE WHEN page % 4 = 1 THEN concat(text, ' [de edifi-') WHEN page % 4 = 2 OR page % 4 = 3 AND book % 3 = 0 THEN concat('car] ', text) ELSE text END AS text")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """(licence, key, event_id, total, cost) attempts."""
    return table(spark, d, "events").selectExpr("user_id AS licence", "concat('p', cast(event_id % 40 AS string)) AS key", "event_id", "20 + user_id % 30 AS total", "event_id % 7 + 1 AS cost")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(licence, t, event_id): calls with a time in seconds."""
    return table(spark, d, "events").selectExpr("user_id AS licence", "cast((day(ts) - 1) * 24 + hour(ts) AS bigint) AS t", "event_id")


def patch_log(spark: SparkSession, d: str) -> DataFrame:
    """(page, op, term, applied, reason)."""
    reason = "CASE WHEN event_type = 'view' THEN 'unchanged' WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 IN (1, 2) THEN 'unchanged' WHEN event_id % 5 = 3 THEN 'impossible_string' ELSE 'missing_hard_term' END"
    rows = table(spark, d, "events").selectExpr("event_id div 20 AS page", "event_id % 20 AS op", "event_type AS term", f"{reason} AS reason")
    return rows.withColumn("applied", F.col("reason").isNull())


def patches(spark: SparkSession, d: str) -> DataFrame:
    """(book, op_index, sentence, candidate, terms): one op per turn."""
    candidate = "CASE turn % 7 WHEN 0 THEN '' WHEN 1 THEN concat('Here is ', text) WHEN 2 THEN concat(text, ' badtypo') WHEN 3 THEN concat(text, '*') WHEN 4 THEN replace(text, ' ', '  ') WHEN 5 THEN 'xyz' ELSE concat(text, ' ok') END"
    return table(spark, d, "conversations").selectExpr("conv_id AS book", "cast(turn AS bigint) AS op_index", "text AS sentence", f"{candidate} AS candidate", "array(split_part(text, ' ', 1)) AS terms")


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, text): what a reader returned, with skip lines, chatter, boilerplate, stamps."""
    t = "CASE doc_id % 11 WHEN 1 THEN '[Skipped: blank page]' WHEN 2 THEN concat('I can see ', text) WHEN 3 THEN concat(text, ' google book') WHEN 4 THEN 'library stamp' WHEN 5 THEN '' ELSE text END"
    return table(spark, d, "documents").selectExpr("doc_id", "source", f"{t} AS text")


def sections(spark: SparkSession, d: str) -> DataFrame:
    p = "CASE doc_id % 7 WHEN 0 THEN 'PRESENTACIÓN ' WHEN 1 THEN '[Nican moteneu] [xiuhmolpilli] Ācatl ' WHEN 2 THEN 'como que los ' WHEN 3 THEN 'traducción ' WHEN 4 THEN '[abcd] ' WHEN 5 THEN '[Skipped: ' ELSE '' END"
    return table(spark, d, "documents").selectExpr("doc_id", "source", f"concat({p}, text) AS text")


def front_pages(spark: SparkSession, d: str) -> DataFrame:
    t = "CASE page_id % 3 WHEN 0 THEN concat('Terms of use, public domain. ', html) WHEN 1 THEN concat('Terms of use. ', html) ELSE html END"
    return table(spark, d, "pages").selectExpr("page_id", f"{t} AS text")


def broken(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, text): lines with hyphens, list marks and blank lines."""
    t = "CASE WHEN doc_id % 3 = 0 THEN replace(text, '\\n', '-\\n') ELSE text END"
    t = f"CASE WHEN doc_id % 4 = 0 THEN replace({t}, '\\n', '\\n- ') ELSE {t} END"
    t = f"CASE WHEN doc_id % 5 = 0 THEN replace({t}, '\\n', '\\n\\n') ELSE {t} END"
    return table(spark, d, "documents").selectExpr("doc_id", "source", f"{t} AS text")


_LB = "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), '-' || chr(10)) ELSE text END"
_LB = f"CASE WHEN doc_id % 4 = 0 THEN replace({_LB}, chr(10), chr(10) || '- ') ELSE {_LB} END"
_LB = f"CASE WHEN doc_id % 5 = 0 THEN replace({_LB}, chr(10), chr(10) || chr(10)) ELSE {_LB} END"

#: DuckDB: the same rows.
SQL = {
    "readings": "(SELECT doc_id, source, text AS A, CASE doc_id % 4 WHEN 1 THEN replace(text, 'l', '1') WHEN 2 THEN replace(text, ' ', '  ') ELSE text END AS B, CASE doc_id % 6 WHEN 1 THEN replace(text, 'e', 'c') ELSE text END AS C FROM documents)",
    "pairs": "(SELECT doc_id, source, text AS a, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN replace(text, 'l', '1') WHEN 3 THEN translate(text, 'aeiou', 'AEIOU') ELSE replace(text, '.', ',') END AS b FROM documents)",
    "quads": "(SELECT doc_id, source, text AS r1, replace(text, 'l', '1') AS r2, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'l', '1') ELSE replace(text, 'e', '3') END AS rec, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'l', '1') WHEN 2 THEN replace(text, 'e', '3') ELSE replace(text, 'o', '0') END AS p4 FROM documents)",
    "books": "(SELECT conv_id AS book, (turn + 1)::INT AS page, text, CASE WHEN (turn + 1) % 3 = 0 THEN 'R ' || text END AS reconcile, CASE WHEN (turn + 1) % 7 = 0 THEN '' WHEN (turn + 1) % 4 = 0 THEN 'S ' || text END AS spot FROM conversations)",
    "bracketed": "(SELECT conv_id AS book, (turn + 1)::INT AS page, CASE WHEN (turn + 1) % 4 = 1 THEN text || ' [de edifi-' WHEN (turn + 1) % 4 = 2 OR (turn + 1) % 4 = 3 AND conv_id % 3 = 0 THEN 'car] ' || text ELSE text END AS text FROM conversations)",
    "ledger": "(SELECT user_id AS licence, 'p' || (event_id % 40) AS key, event_id, 20 + user_id % 30 AS total, event_id % 7 + 1 AS cost FROM events)",
    "calls": "(SELECT user_id AS licence, ((day(ts) - 1) * 24 + hour(ts))::BIGINT AS t, event_id FROM events)",
    "patch_log": "(SELECT event_id // 20 AS page, event_id % 20 AS op, event_type AS term, CASE WHEN event_type = 'view' THEN 'unchanged' WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 IN (1, 2) THEN 'unchanged' WHEN event_id % 5 = 3 THEN 'impossible_string' ELSE 'missing_hard_term' END AS reason FROM events)",
    "patches": "(SELECT conv_id AS book, turn::BIGINT AS op_index, text AS sentence, CASE turn % 7 WHEN 0 THEN '' WHEN 1 THEN 'Here is ' || text WHEN 2 THEN text || ' badtypo' WHEN 3 THEN text || '*' WHEN 4 THEN replace(text, ' ', '  ') WHEN 5 THEN 'xyz' ELSE text || ' ok' END AS candidate, [split_part(text, ' ', 1)] AS terms FROM conversations)",
    "outputs": "(SELECT doc_id, source, CASE doc_id % 11 WHEN 1 THEN '[Skipped: blank page]' WHEN 2 THEN 'I can see ' || text WHEN 3 THEN text || ' google book' WHEN 4 THEN 'library stamp' WHEN 5 THEN '' ELSE text END AS text FROM documents)",
    "sections": "(SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN 'PRESENTACIÓN ' WHEN 1 THEN '[Nican moteneu] [xiuhmolpilli] Ācatl ' WHEN 2 THEN 'como que los ' WHEN 3 THEN 'traducción ' WHEN 4 THEN '[abcd] ' WHEN 5 THEN '[Skipped: ' ELSE '' END || text AS text FROM documents)",
    "front_pages": "(SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Terms of use, public domain. ' || html WHEN 1 THEN 'Terms of use. ' || html ELSE html END AS text FROM pages)",
    "broken": f"(SELECT doc_id, source, {_LB} AS text FROM documents)",
}

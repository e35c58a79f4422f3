"""Scanning queries; documents stand in for repository files (path = doc_id, content = text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import loglines, repo, retrieval
from faultline.plans.retrieval import bm25_topk
from faultline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
n AS (SELECT *, bool_or(regexp_matches(line, '^npm WARN')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS near FROM l)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS BIGINT) AS line_no FROM n WHERE near AND regexp_matches(line, '^\[ERROR\]')""")
def nearby_directive(spark, folder):
    return repo.nearby_directive(_files(spark, folder), r"^\[ERROR\]", "^npm WARN").select("path", F.col("line_no").cast("bigint").alias("line_no"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE contains(lower(text), 'removed from the registry') ORDER BY path LIMIT 10")
def text_search(spark, folder):
    return repo.search(_files(spark, folder), "Removed from the Registry")


@query("""SELECT root, doc_id AS pos FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY doc_id) AS r FROM (
SELECT doc_id, regexp_extract(text, '(/apps/[a-z]+)', 1) AS root FROM documents) WHERE root <> '') WHERE r > 1""")
def duplicate_roots(spark, folder):
    filters = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("pos"), F.nullif(F.regexp_extract("text", "(/apps/[a-z]+)", 1), F.lit("")).alias("root"))
    return repo.duplicate_roots(filters).select("root", "pos")


@query(r"""SELECT CASE WHEN regexp_matches(execution_id, '^\d+$') THEN 'execution' WHEN regexp_matches(execution_id, '^risk-[0-9a-f]+-\w+$') THEN 'prediction' WHEN regexp_matches(execution_id, '^report:.+:\d+$') THEN 'report' ELSE 'other' END AS origin,
count(*) AS n FROM predictions GROUP BY 1""")
def incident_source(spark, folder):
    return table(spark, folder, "predictions").groupBy(retrieval.incident_source(F.col("execution_id")).alias("origin")).agg(F.count("*").alias("n"))


@query()
def distinct_incidents(spark, folder):
    """BM25 hits of each query without near copies: same step, and both whole text and repository alike."""
    texts = table(spark, folder, "documents").select("doc_id", "step", "text", "repo")
    hits = bm25_topk(spark, folder).join(texts, "doc_id")
    return retrieval.distinct_incidents(hits, "query_id", "rank", "step", "text", "repo", width=None).select("query_id", "rank", "doc_id")


_MASKED = r"regexp_replace(regexp_replace(regexp_replace(trim({0}), '\b[0-9]+\b', '<NUM>', 'g'), '(?i)\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\b', '<UUID>', 'g'), '(?i)0x[0-9a-f]+', '<HEX>', 'g')"


@query(f"""WITH l AS (SELECT log_id, CAST(generate_subscripts(key_lines, 1) - 1 AS BIGINT) AS line_no, unnest(key_lines) AS line FROM parsed_logs), m AS (SELECT log_id, line_no, {_MASKED.format("line")} AS mask FROM l),
t AS (SELECT DISTINCT {_MASKED.format("error_message")} AS k FROM parsed_logs), d AS (SELECT DISTINCT mask FROM m WHERE length(mask) > 0),
n AS (SELECT mask FROM d WHERE EXISTS (SELECT 1 FROM t WHERE k = mask OR (length(k) > 20 AND contains(mask, k)) OR (length(mask) > 20 AND contains(k, mask))))
SELECT log_id, line_no FROM m WHERE mask IN (SELECT mask FROM n)""")
def noise_lines(spark, folder):
    """Masked log lines of failing steps that also occur, whole or in part, in summaries of other logs."""
    logs = table(spark, folder, "parsed_logs")
    lines = loglines.lines_of_arrays(logs, "log_id", "key_lines").select("log_id", "line_no", loglines.mask_line(F.col("line")).alias("mask"))
    templates = logs.select(loglines.mask_line(F.col("error_message")).alias("template"))
    return retrieval.noise_lines(lines, "mask", templates, "template").select("log_id", F.col("line_no").cast("bigint").alias("line_no"))

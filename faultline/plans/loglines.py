"""Log-reduction, parsing and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number_long
from faultline.operators import loglines as ops
from faultline.operators import retrieval
from faultline.plans.retrieval import pipeline_runs, success_templates
from faultline.session import cut_lineage
from faultline.sources.tables import table

QUERIES, SQL = {}, {}

_LINES = "WITH l AS (SELECT log_id, regexp_replace(lower(step), '[^a-z0-9]', '', 'g') AS step, CAST(generate_subscripts(key_lines, 1) - 1 AS BIGINT) AS line_no, unnest(key_lines) AS line FROM parsed_logs)"
_MASK = r"regexp_replace(regexp_replace(regexp_replace(trim(line), '\b[0-9]+\b', '<NUM>', 'g'), '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<UUID>', 'g'), '(?i)0x[0-9a-f]+', '<HEX>', 'g')"
_STEP = "regexp_replace(lower(step), '[^a-z0-9]', '', 'g')"
#: Written out on their own, not taken from the operators.
_WORDS = r"""(regexp_matches(lower(line), 'fatal|panic|error|exit|kill|no such file|err:|failures:|exception|build failure|npm err!|compilation error|fail:')
 OR coalesce(step = 'build' AND regexp_matches(line, '(?i)\[ERROR\]|BUILD FAILURE|Cannot find module|Module not found|npm ERR!|error TS[0-9]+'), false)
 OR coalesce(step = 'securitytest' AND regexp_matches(line, '(?i)- Failed|WARN -|ERROR'), false) OR coalesce(step = 'deploy' AND regexp_matches(line, '(?i)ERROR|FAILED|Deployment failed'), false)
 OR coalesce(step = 'loadtest' AND regexp_matches(line, '(?i)FAILED|ERROR|AssertionError'), false) OR coalesce(step = 'codequality' AND regexp_matches(line, '(?i)FAILED|Quality gate|ERROR'), false))"""
_FAIL = "(?i)FAIL:|Failures:|BUILD FAILURE|npm ERR!"


def _pipeline_sql(budget: int) -> str:
    return f"""{_LINES},
k AS (SELECT *, substr(md5({_MASK}), 1, 12) AS template, row_number() OVER (PARTITION BY log_id ORDER BY line_no) - 1 AS pos, count(*) OVER (PARTITION BY log_id) AS n FROM l WHERE trim(line) <> ''),
s AS (SELECT *, CASE WHEN n <= 1 THEN 1.0 ELSE pos / (n - 1) END AS tail_score FROM k),
m AS (SELECT *, ({_WORDS} OR tail_score >= 0.85) AS matched FROM s),
f AS (SELECT *, matched AND row_number() OVER (PARTITION BY log_id, template, matched ORDER BY line_no) = 1 AS first FROM m),
c AS (SELECT *, first OR (sum(CAST(first AS INT)) OVER (PARTITION BY log_id) <= 2 AND pos >= n - 20) AS candidate, max(line_no) OVER (PARTITION BY log_id) AS last_line FROM f),
sp AS (SELECT log_id, greatest(line_no - 4, 0) AS a, least(line_no + 6, last_line) AS z, line_no FROM c WHERE candidate),
o AS (SELECT *, CASE WHEN coalesce(a > max(z) OVER (PARTITION BY log_id ORDER BY a, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) THEN 1 ELSE 0 END AS opens FROM sp),
g AS (SELECT *, sum(opens) OVER (PARTITION BY log_id ORDER BY a, line_no ROWS UNBOUNDED PRECEDING) AS block_no FROM o),
b AS (SELECT log_id, CAST(block_no AS BIGINT) AS block_no, min(a) AS a, max(z) AS z FROM g GROUP BY ALL),
w0 AS (SELECT *, CASE WHEN candidate THEN CASE WHEN sum(CAST(candidate AS INT)) OVER (PARTITION BY log_id) <= 500 THEN 3.0 ELSE 1.0 END ELSE 0.0 END AS base FROM c),
w1 AS (SELECT *, CASE WHEN regexp_matches(line, '{_FAIL}') THEN 10.0 WHEN starts_with(ltrim(line), '#') THEN base + 2 WHEN candidate AND base < 2 THEN base + 1 ELSE base END AS w FROM w0),
w2 AS (SELECT *, CASE WHEN max(w) OVER (PARTITION BY log_id) = 1 OR sum(CAST(w >= 1 AS INT)) OVER (PARTITION BY log_id) <= 500 THEN 1.0 ELSE 3.0 END AS theta FROM w1),
w3 AS (SELECT w2.log_id, line_no, block_no, w, theta, line, max(w) OVER (PARTITION BY w2.log_id, block_no) AS heaviest FROM w2 JOIN b ON b.log_id = w2.log_id AND line_no BETWEEN a AND z),
wt AS (SELECT log_id, line_no, block_no, CASE WHEN heaviest >= theta AND w < 1 THEN 1.0 ELSE w END AS weight, greatest(1, CAST(floor(length(line) / 4) AS BIGINT)) AS tokens FROM w3),
d AS (SELECT log_id, block_no, count(*) AS n_lines, CAST(sum(tokens) AS BIGINT) AS tokens, sum(weight) / count(*) AS density FROM wt GROUP BY ALL) """


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return ops.lines_of_arrays(table(spark, folder, "parsed_logs"), "log_id", "key_lines")


def _candidates_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the patterns of their step, without noise: lines of the success templates of their pipeline and step.

    Action: the templates (those of three logs per pipeline and step) are kept in the checkpoint folder.
    """
    logs = table(spark, folder, "parsed_logs").select("log_id", whole_number_long(F.col("execution_id")).alias("eid"), F.regexp_replace(F.lower("step"), "[^a-z0-9]", "").alias("step"), "key_lines")
    templates = cut_lineage(success_templates(spark, folder).select("pipeline", "step", ops.mask_line(F.col("template")).alias("template")))
    lines = logs.select("log_id", "step", F.posexplode("key_lines").alias("line_no", "line"))
    named = logs.join(pipeline_runs(spark, folder).select("eid", "pipeline"), "eid").select("log_id", "pipeline", "step", F.posexplode("key_lines").alias("line_no", "line"))
    noise = retrieval.template_noise(named.withColumn("mask", ops.mask_line(F.col("line"))), "mask", templates, "template", ["pipeline", "step"])
    return ops.candidates(lines, noise, step="step")


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    logs = table(spark, folder, "parsed_logs").select("log_id", F.regexp_replace(F.lower("step"), "[^a-z0-9]", "").alias("step"), F.posexplode("key_lines").alias("line_no", "line"))
    return ops.candidates(logs, step="step")


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return _with_last(_candidates(spark, folder))


def _with_last(chosen: DataFrame) -> DataFrame:
    last = chosen.groupBy("log_id").agg(F.max("line_no").alias("last_line"))
    return chosen.join(last, "log_id")


@query(f"{_LINES} SELECT log_id, line_no, md5({_MASK}) AS mask_md5 FROM l")
def mask_lines(spark, folder):
    return _lines(spark, folder).select("log_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5(ops.mask_line(F.col("line"))).alias("mask_md5"))


@query(f"{_LINES} SELECT substr(md5({_MASK}), 1, 12) AS template, count(*) AS n, count(DISTINCT log_id) AS n_logs FROM l WHERE trim(line) <> '' GROUP BY 1")
def template_ids(spark, folder):
    return _lines(spark, folder).where(F.trim("line") != "").groupBy(ops.template_id(F.col("line")).alias("template")).agg(F.count("*").alias("n"), F.count_distinct("log_id").alias("n_logs"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(api[_-]?key|password|secret|token)\s*[=:]\s*\S+', '\1=***', 'g'), '(?i)DefaultEndpointsProtocol=https;AccountKey=[^;]+', 'AccountKey=***', 'g')) AS redacted_md5 FROM documents WHERE text IS NOT NULL")
def redact(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(ops.redact(F.col("text"))).alias("redacted_md5"))


@query(r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM
(SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_./\-:]+') AS t FROM documents WHERE text IS NOT NULL)""")
def tokenize_terms(spark, folder):
    terms = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-zA-Z0-9_./\-:]+"), F.lit(0))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", terms.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_terms"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(_LINES + r""", h AS (SELECT log_id, trim(line) AS line, min(line_no) AS line_no FROM l WHERE regexp_matches(trim(line), '(?i)cannot find symbol|npm ERR!|error rate|Syntax error') GROUP BY ALL)
SELECT log_id, rank, md5(line) AS line_md5 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS BIGINT) AS rank FROM h) WHERE rank <= 3""")
def key_lines(spark, folder):
    found = ops.key_lines(_lines(spark, folder), ["cannot find symbol", "npm ERR!", "error rate", "Syntax error"], 3)
    return found.select("log_id", F.col("rank").cast("bigint").alias("rank"), F.md5("line").alias("line_md5"))


@query(_pipeline_sql(0) + "SELECT log_id, line_no, round(tail_score, 6) AS tail_score, candidate FROM c")
def log_candidates(spark, folder):
    return _candidates(spark, folder).select("log_id", F.col("line_no").cast("bigint").alias("line_no"), F.round("tail_score", 6).alias("tail_score"), "candidate")


@query()
def log_candidates_whole(spark, folder):
    """Candidates by error words, patterns of the step and tail, noise of success templates dropped; ``log_candidates`` drops no noise."""
    return _candidates_whole(spark, folder).select("log_id", F.col("line_no").cast("bigint").alias("line_no"), F.round("tail_score", 6).alias("tail_score"), "candidate")


@query(_pipeline_sql(0) + "SELECT log_id, block_no, a AS start_line, z AS end_line FROM b")
def context_blocks(spark, folder):
    found = ops.context_blocks(_marked(spark, folder))
    return found.select("log_id", "block_no", F.col("start").cast("bigint").alias("start_line"), F.col("end").cast("bigint").alias("end_line"))


@query(_pipeline_sql(0) + "SELECT log_id, line_no, block_no, CAST(weight AS DOUBLE) AS weight, tokens FROM wt")
def line_weights(spark, folder):
    marked = _marked(spark, folder)
    return ops.line_weights(marked, ops.context_blocks(marked)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(_pipeline_sql(0) + "SELECT log_id, block_no, n_lines, tokens, round(CAST(density AS DOUBLE), 6) AS density FROM d")
def block_density(spark, folder):
    return ops.block_density(line_weights(spark, folder)).withColumn("density", F.round("density", 6))


@query()
def pack_blocks(spark, folder):
    """Blocks chosen under a budget of 60 tokens a log, around the candidates of ``log_candidates_whole``."""
    marked = _with_last(_candidates_whole(spark, folder))
    return ops.pack_blocks(ops.block_density(ops.line_weights(marked, ops.context_blocks(marked))), 60)


@query(_pipeline_sql(0).replace("WITH l AS", "WITH RECURSIVE l AS", 1) + """, rk AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY density DESC, block_no) AS r FROM d),
rec AS (SELECT log_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS block_no FROM rk WHERE r = 1
UNION ALL SELECT rk.log_id, rk.r, CASE WHEN used + tokens <= 40 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 40 THEN rk.block_no END FROM rec JOIN rk ON rk.log_id = rec.log_id AND rk.r = rec.r + 1)
SELECT log_id, block_no FROM rec WHERE block_no IS NOT NULL UNION ALL SELECT log_id, block_no FROM rk WHERE r = 1 AND log_id NOT IN (SELECT log_id FROM rec WHERE block_no IS NOT NULL)""")
def packed_blocks(spark, folder):
    """Blocks chosen under a budget of 40 tokens a log, around the candidates of ``log_candidates``."""
    return ops.pack_blocks(ops.block_density(line_weights(spark, folder)), 40)


@query(_LINES + r""", p AS (SELECT *, last_value(CASE WHEN contains(line, '[ERROR]') THEN line END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS cause FROM l)
SELECT log_id, line_no, md5(cause) AS cause_md5 FROM p WHERE regexp_matches(line, 'Caused by')""")
def preceding_error(spark, folder):
    return ops.preceding_match(_lines(spark, folder), "Caused by", r"\[ERROR\]").select("log_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5("cause").alias("cause_md5"))


@query(_LINES + r""", t AS (SELECT log_id, min(line_no) AS target FROM l WHERE regexp_matches(line, 'Caused by') GROUP BY 1)
SELECT log_id, target, md5(string_agg(printf('%s %4d | %s', CASE WHEN line_no = target THEN '>>>' ELSE '   ' END, line_no + 1, line), chr(10) ORDER BY line_no)) AS snippet_md5
FROM l JOIN t USING (log_id) WHERE abs(line_no - target) <= 2 GROUP BY log_id, target""")
def source_window(spark, folder):
    lines = _lines(spark, folder)
    targets = lines.where(F.col("line").rlike("Caused by")).groupBy("log_id").agg(F.min("line_no").alias("target"))
    return ops.source_window(lines, targets, 2).select("log_id", F.col("target").cast("bigint").alias("target"), F.md5("snippet").alias("snippet_md5"))


@query(_LINES + r""", o AS (SELECT log_id, min(line_no) AS first_line FROM l WHERE regexp_matches(line, '^\{') GROUP BY 1),
r AS (SELECT l.log_id, line_no, first_line, sum(len(regexp_extract_all(line, '[{\[]')) - len(regexp_extract_all(line, '[}\]]'))) OVER (PARTITION BY l.log_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS depth
FROM l JOIN o ON o.log_id = l.log_id AND line_no >= first_line AND line_no < first_line + 60)
SELECT log_id, min(first_line) AS first_line, coalesce(min(line_no) FILTER (depth <= 0 AND line_no - first_line >= 4), max(line_no)) AS last_line FROM r GROUP BY log_id""")
def brace_sections(spark, folder):
    """Sections of at least five lines, closed by curly and square brackets alone."""
    found = ops.brace_sections(_lines(spark, folder), r"^\{")
    return found.select("log_id", *[F.col(c).cast("bigint").alias(c) for c in ("first_line", "last_line")])


@query(rf"""SELECT log_id, CASE WHEN t IS NULL OR trim(t) = '' THEN 'no_log'
WHEN s = 'build' THEN CASE WHEN regexp_matches(t, 'Module not found: Error: Can''t resolve ''[^'']+'' in ''[^'']+''') THEN 'missing_npm_module' WHEN regexp_matches(t, 'Failed to run task: ''.+?'' failed') THEN 'npm_build_failed'
  WHEN regexp_matches(t, 'error TS[0-9]+: .') THEN 'typescript_error' WHEN regexp_matches(t, 'COMPILATION ERROR|cannot find symbol|error: package .+? does not exist') THEN 'java_compile_error' WHEN contains(t, 'OutOfMemoryError') THEN 'oom' ELSE 'build_failure' END
WHEN s = 'securitytest' THEN 'security_failure'
WHEN s = 'deploy' THEN CASE WHEN regexp_matches(t, 'Config variables are not defined: \S+') THEN 'missing_env_variable' WHEN regexp_matches(t, 'Syntax error on line [0-9]+ of [^\n:]+: .') THEN 'apache_config_syntax_error' ELSE 'deploy_failure' END
WHEN s = 'loadtest' THEN CASE WHEN regexp_matches(t, '(?i)FAILED\s+.+?\s+threshold|p95\s*=\s*[0-9.]+ms') THEN 'load_test_failure' ELSE 'load_test_unknown' END
WHEN s = 'codequality' THEN CASE WHEN regexp_matches(t, '[0-9]+\s+BLOCKER|(?i)coverage.*?[0-9.]+\s*%.*?required.*?[0-9.]+\s*%') THEN 'code_quality_failure' ELSE 'code_quality_unknown' END
ELSE 'unparsed' END AS error_class FROM (SELECT log_id, {_STEP} AS s, array_to_string(key_lines, chr(10)) AS t FROM parsed_logs)""")
def parse_logs(spark, folder):
    logs = table(spark, folder, "parsed_logs").select("log_id", F.regexp_replace(F.lower("step"), "[^a-z0-9]", "").alias("s"), F.array_join("key_lines", "\n").alias("t"))
    return logs.select("log_id", ops.log_class(F.col("s"), F.col("t")).alias("error_class"))


@query(r"""WITH t AS (SELECT log_id, array_to_string(key_lines, chr(10)) AS t FROM parsed_logs)
SELECT log_id, 'missing_env_variable' AS type, unnest(regexp_extract_all(t, 'Config variables are not defined: (\S+)', 1)) AS detail, NULL AS file_path, CAST(NULL AS BIGINT) AS line_no FROM t
UNION ALL SELECT log_id, 'apache_config_syntax_error', trim(unnest(regexp_extract_all(t, 'Syntax error on line ([0-9]+) of ([^\n:]+): ([^\n]+)', 3))), trim(unnest(regexp_extract_all(t, 'Syntax error on line ([0-9]+) of ([^\n:]+): ([^\n]+)', 2))),
CAST(unnest(regexp_extract_all(t, 'Syntax error on line ([0-9]+) of ([^\n:]+): ([^\n]+)', 1)) AS BIGINT) FROM t""")
def deploy_errors(spark, folder):
    logs = table(spark, folder, "parsed_logs").select("log_id", F.array_join("key_lines", "\n").alias("t"))
    return ops.deploy_errors(logs, "log_id", "t").withColumn("line_no", F.col("line_no").cast("bigint"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^\+')) - len(regexp_extract_all(text, '(?m)^\+\+\+')) AS BIGINT) AS added,
CAST(len(regexp_extract_all(text, '(?m)^-')) - len(regexp_extract_all(text, '(?m)^---')) AS BIGINT) AS removed, CAST(len(regexp_extract_all(text, '(?m)^@@ ')) AS BIGINT) AS hunks FROM documents WHERE text IS NOT NULL""")
def diff_churn(spark, folder):
    return ops.diff_churn(table(spark, folder, "documents").where("text is not null"), "doc_id", "text")


@query(r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?m)^([+-])[ \t]*<artifactId>([^<\n]+)</artifactId>', 1)) AS sign,
unnest(regexp_extract_all(text, '(?m)^([+-])[ \t]*<artifactId>([^<\n]+)</artifactId>', 2)) AS artifact FROM documents""")
def diff_artifacts(spark, folder):
    return ops.diff_artifacts(table(spark, folder, "documents"), "doc_id", "text")


@query(r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'PUBLISH_[A-Z0-9_]+') || regexp_extract_all(text, 'AUTHOR_[A-Z0-9_]+')
|| regexp_extract_all(text, 'Config variables are not defined: (\S+)', 1) || regexp_extract_all(text, '\$\{([A-Z][A-Z0-9_]*)\}', 1) || regexp_extract_all(text, 'os\.environ\[[''"]([A-Z][A-Z0-9_]*)[''"]\]', 1)) AS name FROM documents WHERE text IS NOT NULL""")
def env_references(spark, folder):
    return ops.env_references(table(spark, folder, "documents").where("text is not null"), "doc_id", "text")


@query("""SELECT doc_id, CAST(len(string_split(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10) || '$', ''), chr(10))) AS BIGINT) AS n_lines FROM documents WHERE text IS NOT NULL""")
def text_lines(spark, folder):
    return ops.lines_of_texts(table(spark, folder, "documents"), "doc_id", "text").groupBy(F.col("log_id").alias("doc_id")).agg(F.count("*").alias("n_lines"))

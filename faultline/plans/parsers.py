"""Queries of the step-log parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators.parsers import parse_step_logs
from faultline.operators.repo import failed_on_all_nodes, security_nodes
from faultline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_STEP = "regexp_replace(lower(step), '[^a-z0-9]', '', 'g')"
_SECURE = f"""s AS (SELECT log_id, CAST(generate_subscripts(key_lines, 1) AS BIGINT) AS p, trim(unnest(key_lines)) AS l FROM parsed_logs WHERE {_STEP} = 'securitytest'),
sm AS (SELECT *, last_value(CASE WHEN l <> '' AND NOT starts_with(l, '-') AND NOT regexp_matches(l, 'Failed|Passed|WARN|INFO') THEN l END IGNORE NULLS) OVER w AS node, sum(CASE WHEN contains(l, '- Failed') THEN 1 ELSE 0 END) OVER w AS n FROM s WINDOW w AS (PARTITION BY log_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
sc AS (SELECT log_id, n, arg_min(node, p) AS node, trim(replace(arg_min(l, p), '- Failed', '')) AS "check", trim(replace(arg_max(l, p) FILTER (starts_with(l, 'WARN -')), 'WARN -', '')) AS reason FROM sm WHERE n > 0 GROUP BY log_id, n)"""
_PARSE = rf"""WITH t AS (SELECT log_id, {_STEP} AS s, key_lines AS raw, array_to_string(key_lines, chr(10)) AS t, list_filter(list_transform(key_lines, lambda x: trim(x)), lambda x: x <> '') AS kept FROM parsed_logs), {_SECURE},
sg AS (SELECT log_id, count(*) AS n_checks, list({{'type': 'security_check_failed', 'detail': "check", 'file_path': reason, 'line_no': CAST(NULL AS INT)}} ORDER BY n) AS errs, list("check" ORDER BY n) AS names FROM sc GROUP BY log_id),
sn AS (SELECT log_id, list_distinct(list_filter(kept, lambda x: NOT starts_with(x, '-') AND NOT regexp_matches(x, 'Failed|Passed|WARN|INFO'))) AS nodes FROM t),
x AS (SELECT t.*, coalesce(n_checks, 0) AS n_checks, errs, len(nodes) AS n_nodes,
(SELECT string_agg(c, ', ' ORDER BY f) FROM (SELECT c, min(i) AS f FROM (SELECT unnest(names) AS c, generate_subscripts(names, 1) AS i) GROUP BY c HAVING count(*) = len(nodes) ORDER BY f LIMIT 3)) AS everywhere,
regexp_extract_all(t, 'Config variables are not defined: (\S+)', 1) AS vars,
regexp_extract_all(t, 'Syntax error on line (\d+) of ([^\n:]+): (.+)', 1) AS sa, regexp_extract_all(t, 'Syntax error on line (\d+) of ([^\n:]+): (.+)', 2) AS sb, regexp_extract_all(t, 'Syntax error on line (\d+) of ([^\n:]+): (.+)', 3) AS sd,
regexp_extract_all(t, '(?i)FAILED\s+(.+?)\s+threshold', 1) AS thr, regexp_extract_all(t, 'p95\s*=\s*([\d.]+)ms', 1)[1] AS p95, regexp_extract_all(t, '(?i)Quality Gate (?:status|result)[:\s]+(\w+)', 1)[1] AS gate,
regexp_extract_all(t, '(\d+)\s+BLOCKER', 1) AS blk, regexp_extract_all(t, '(?i)coverage.*?(\d+(?:\.\d+)?)\s*%.*?required.*?(\d+(?:\.\d+)?)\s*%', 1)[1] AS ca, regexp_extract_all(t, '(?i)coverage.*?(\d+(?:\.\d+)?)\s*%.*?required.*?(\d+(?:\.\d+)?)\s*%', 2)[1] AS cb,
(SELECT min(i) FROM (SELECT unnest(range(1, len(raw) + 1)) AS i) WHERE contains(raw[i], 'BUILD FAILURE') AND len(list_filter(raw[greatest(i - 11, 0) + 2:i - 1], lambda y: contains(y, '[ERROR]'))) > 0) AS bf
FROM t LEFT JOIN sg USING (log_id) JOIN sn USING (log_id)),
e AS (SELECT *, CASE WHEN trim(t) = '' OR t IS NULL THEN [] WHEN s = 'securitytest' THEN coalesce(errs, [])[1:20]
WHEN s = 'deploy' THEN list_transform(vars, lambda v: {{'type': 'missing_env_variable', 'detail': 'Undefined variable: ' || v, 'file_path': CAST(NULL AS VARCHAR), 'line_no': CAST(NULL AS INT)}})
 || list_transform(range(1, len(sa) + 1), lambda i: {{'type': 'apache_config_syntax_error', 'detail': 'Line ' || sa[i] || ' in ' || trim(sb[i]) || ': ' || trim(sd[i]), 'file_path': trim(sb[i]), 'line_no': CAST(sa[i] AS INT)}})
WHEN s = 'loadtest' THEN list_transform(thr, lambda v: {{'type': 'threshold_exceeded', 'detail': 'Threshold failed: ' || trim(v), 'file_path': CAST(NULL AS VARCHAR), 'line_no': CAST(NULL AS INT)}})
 || CASE WHEN p95 IS NULL THEN [] ELSE [{{'type': 'response_time_exceeded', 'detail': 'p95 response time: ' || p95 || 'ms', 'file_path': CAST(NULL AS VARCHAR), 'line_no': CAST(NULL AS INT)}}] END
WHEN s = 'codequality' THEN CASE WHEN upper(gate) <> 'OK' THEN [{{'type': 'quality_gate_failure', 'detail': 'Quality Gate: ' || gate, 'file_path': CAST(NULL AS VARCHAR), 'line_no': CAST(NULL AS INT)}}] ELSE [] END
 || list_transform(blk, lambda v: {{'type': 'blocker_violation', 'detail': v || ' blocker violation(s)', 'file_path': CAST(NULL AS VARCHAR), 'line_no': CAST(NULL AS INT)}})
 || CASE WHEN ca IS NULL THEN [] ELSE [{{'type': 'coverage_insufficient', 'detail': 'Coverage ' || ca || '% below required ' || cb || '%', 'file_path': CAST(NULL AS VARCHAR), 'line_no': CAST(NULL AS INT)}}] END
ELSE [] END AS errors FROM x),
p AS (SELECT *, regexp_matches(t, 'Failed to run task: ''(.+?)'' failed') AS tk, regexp_matches(t, 'error TS(\d+): (.+)') AS ts, regexp_matches(t, 'COMPILATION ERROR|cannot find symbol|error: package (.+?) does not exist') AS ce,
regexp_extract_all(t, 'Module not found: Error: Can''t resolve ''([^'']+)'' in ''([^'']+)''', 1)[1] AS mm, regexp_extract_all(t, 'Module not found: Error: Can''t resolve ''([^'']+)'' in ''([^'']+)''', 2)[1] AS mp FROM e)
SELECT log_id, CASE WHEN trim(t) = '' OR t IS NULL THEN 'no_log' WHEN s = 'build' THEN CASE WHEN mm IS NOT NULL THEN 'missing_npm_module' WHEN tk THEN 'npm_build_failed' WHEN ts THEN 'typescript_error' WHEN ce THEN 'java_compile_error' WHEN contains(t, 'OutOfMemoryError') THEN 'oom' ELSE 'build_failure' END
WHEN s = 'securitytest' THEN 'security_failure' WHEN s = 'deploy' THEN coalesce(errors[1].type, 'deploy_failure') WHEN s = 'loadtest' THEN CASE WHEN len(errors) > 0 THEN 'load_test_failure' ELSE 'load_test_unknown' END
WHEN s = 'codequality' THEN CASE WHEN len(errors) > 0 THEN 'code_quality_failure' ELSE 'code_quality_unknown' END ELSE 'unparsed' END AS error_type,
CASE WHEN trim(t) = '' OR t IS NULL THEN 'Log text was empty or unavailable' WHEN s = 'build' THEN CASE WHEN mm IS NOT NULL THEN 'Missing npm package: ' || mm WHEN tk THEN 'npm task failed: ' || regexp_extract(t, 'Failed to run task: ''(.+?)'' failed', 1)
 WHEN ts THEN 'TS' || regexp_extract(t, 'error TS(\d+): (.+)', 1) || ': ' || regexp_extract(t, 'error TS(\d+): (.+)', 2)[1:200] WHEN ce THEN regexp_extract(t, 'COMPILATION ERROR|cannot find symbol|error: package (.+?) does not exist')[1:200]
 WHEN contains(t, 'OutOfMemoryError') THEN 'Java OutOfMemoryError during build' WHEN bf IS NOT NULL THEN trim(list_filter(raw[greatest(bf - 11, 0) + 2:bf - 1], lambda y: contains(y, '[ERROR]'))[-1])[1:300] ELSE 'BUILD FAILURE — could not extract specific error' END
WHEN s = 'securitytest' THEN n_checks || ' security checks failed across ' || n_nodes || ' nodes' || CASE WHEN n_nodes > 0 AND everywhere IS NOT NULL THEN '. All-node failures: ' || everywhere ELSE '' END
WHEN s = 'deploy' THEN coalesce(errors[1].detail, 'Deploy failed on: ' || nullif(array_to_string(regexp_extract_all(t, 'Failed to deploy dispatcher on instance (\S+)', 1), ', '), ''), 'Deployment failed — no specific error extracted')
WHEN s = 'loadtest' THEN coalesce(errors[1].detail, 'Load test failed') WHEN s = 'codequality' THEN coalesce(errors[1].detail, 'Code quality check failed') ELSE t[1:300] END AS error_message,
CASE WHEN s = 'build' AND mm IS NOT NULL THEN split_part(mp, '/', -1) END AS module, CAST(len(errors) AS BIGINT) AS n_errors,
md5(array_to_string(list_transform(errors, lambda x: x.type || '|' || x.detail || '|' || coalesce(x.file_path, '') || '|' || coalesce(CAST(x.line_no AS VARCHAR), '')), chr(10))) AS errors_md5, CAST(len(kept) AS BIGINT) AS n_kept FROM p"""


@query(_PARSE)
def step_logs(spark, folder):
    """Every log parsed by its step: type, message, module, errors with file and line."""
    logs = table(spark, folder, "parsed_logs").select("log_id", F.regexp_replace(F.lower("step"), "[^a-z0-9]", "").alias("s"), F.array_join("key_lines", "\n").alias("t"), F.size(F.filter(F.transform("key_lines", lambda x: F.trim(x)), lambda x: x != "")).cast("bigint").alias("n_kept"))
    parsed = parse_step_logs(logs, "log_id", "s", "t")
    text = lambda e: F.concat_ws("|", e["type"], e["detail"], F.coalesce(e["file_path"], F.lit("")), F.coalesce(e["line_no"].cast("string"), F.lit("")))
    out = parsed.select("log_id", "error_type", "error_message", "module", F.size("errors").cast("bigint").alias("n_errors"), F.md5(F.array_join(F.transform("errors", text), "\n")).alias("errors_md5"))
    return out.join(logs.select("log_id", "n_kept"), "log_id")


@query(f"WITH {_SECURE} SELECT log_id, CAST(n AS BIGINT) AS n, node, \"check\", reason FROM sc")
def security_checks(spark, folder):
    """Failed checks of security logs with their node and the warning that explains them."""
    return security_nodes(_security_lines(spark, folder))


@query(f"WITH {_SECURE}, k AS (SELECT log_id, count(DISTINCT node) AS nodes FROM sc GROUP BY 1) SELECT log_id, \"check\" FROM sc JOIN k USING (log_id) GROUP BY log_id, \"check\", nodes HAVING count(*) = nodes")
def checks_on_all_nodes(spark, folder):
    return failed_on_all_nodes(security_nodes(_security_lines(spark, folder)))


def _security_lines(spark, folder):
    return table(spark, folder, "parsed_logs").where(F.regexp_replace(F.lower("step"), "[^a-z0-9]", "") == "securitytest").select("log_id", F.posexplode("key_lines").alias("line_no", "line"))

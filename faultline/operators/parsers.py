"""Parsers of step logs: error type, message, module, errors with file and line, and key lines, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.repo import security_nodes

#: Patterns (any case) of the lines worth keeping, per step.
KEY_PATTERNS = {
    "build": [
        r"\[ERROR\]", "BUILD FAILURE", "Cannot find module", "Module not found", "COMPILATION ERROR", "cannot find symbol", "npm ERR!", r"error TS\d+", "OutOfMemoryError",
        "error: package .+ does not exist", "Failed to run task",
    ],
    "securitytest": ["- Failed", "WARN -", "ERROR"],
    "deploy": ["Syntax error", "not defined", "Failed to deploy", r"\[error\]", r"AH\d+", "invalid command", "undefined variable"],
    "loadtest": ["FAILED", "threshold", r"p\d+\s*=", "response time", "error rate"],
    "codequality": ["ERROR", "BLOCKER", "CRITICAL", "Quality Gate", "violations", "coverage"],
}
ERROR = "struct<type: string, detail: string, file_path: string, line_no: int>"
MOST_ERRORS, MOST_KEY_LINES = 20, 10


def _error(kind: str, detail: Column, file_path: Column | None = None, line_no: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), detail.alias("detail"), (F.lit(None) if file_path is None else file_path).cast("string").alias("file_path"), (F.lit(None) if line_no is None else line_no).cast("int").alias("line_no"))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without one."""
    return F.get(_all(text, pattern, group), F.lit(0))


def _error_before_failure(lines: Column) -> Column:
    """The nearest line with [ERROR] among the nine (but never the log's first line) before the first BUILD FAILURE that has one."""
    at = lambda i: F.greatest(i - 10, F.lit(0)) + 1
    near = lambda i: F.when(at(i) < i, F.filter(F.sequence(F.least(at(i), i - 1), i - 1), lambda j: F.contains(F.get(lines, j), F.lit("[ERROR]"))))
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.contains(F.get(lines, i), F.lit("BUILD FAILURE")) & (F.coalesce(F.size(near(i)), F.lit(0)) > 0))
    return F.substring(F.trim(F.get(lines, F.array_max(near(F.get(places, F.lit(0)))))), 1, 300)


def parse_step_logs(logs: DataFrame, log_id: str, step: str, text: str) -> DataFrame:
    """(log_id, step, error_type, error_message, module, errors, key_lines, raw_line_count) of each log; ``step`` in lower-case letters.

    The first of a step's patterns that matches decides the type.  NULL and
    blank logs are 'no_log'; logs of unknown or NULL steps 'unparsed', with
    their first five lines.  A log of any length is read whole; it lists at
    most 20 security errors and 10 key lines (the first distinct ones).  Log
    ids must be unique; the security part goes line by line through windows.
    """
    rows = logs.select(F.col(log_id).alias("log_id"), F.col(step).alias("step"), F.regexp_replace(F.col(text), "\r\n?", "\n").alias("t"))
    rows = rows.withColumn("raw", F.split(F.regexp_replace("t", "\n$", ""), "\n"))
    rows = rows.withColumn("kept", F.filter(F.transform("raw", lambda x: F.btrim(x, F.lit(" \t\r\v\f"))), lambda x: x != ""))

    t, kept = F.col("t"), F.col("kept")
    secure = rows.where("step = 'securitytest'").select("log_id", F.posexplode("raw").alias("line_no", "line"))
    failed = security_nodes(secure).groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("n", "check", "reason"))).alias("checks"))
    rows = rows.join(failed, "log_id", "left")
    checks = F.coalesce("checks", F.array().cast("array<struct<n: bigint, check: string, reason: string>>"))
    nodes = F.array_distinct(F.filter(kept, lambda x: ~x.startswith("-") & ~x.rlike("Failed|Passed|WARN|INFO")))
    names = F.transform(checks, lambda c: c["check"])
    everywhere = F.filter(F.array_distinct(names), lambda c: F.size(F.filter(names, lambda o: o == c)) == F.size(nodes))
    secure_message = F.concat(F.size(checks).cast("string"), F.lit(" security checks failed across "), F.size(nodes).cast("string"), F.lit(" nodes"))
    secure_message = F.concat(secure_message, F.when((F.size(nodes) > 0) & (F.size(everywhere) > 0), F.concat(F.lit(". All-node failures: "), F.array_join(F.slice(everywhere, 1, 3), ", "))).otherwise(""))

    pair = r"Module not found: Error: Can't resolve '([^']+)' in '([^']+)'"
    task, typed, compiled = r"Failed to run task: '(.+?)' failed", r"error TS(\d+): (.+)", "COMPILATION ERROR|cannot find symbol|error: package (.+?) does not exist"
    syntax = r"Syntax error on line (\d+) of ([^\n:]+): (.+)"
    syntaxes = F.arrays_zip(_all(t, syntax, 1).alias("a"), _all(t, syntax, 2).alias("b"), _all(t, syntax, 3).alias("c"))
    deploy = F.concat(
        F.transform(_all(t, r"Config variables are not defined: (\S+)"), lambda v: _error("missing_env_variable", F.concat(F.lit("Undefined variable: "), v))),
        F.transform(syntaxes, lambda x: _error("apache_config_syntax_error", F.concat(F.lit("Line "), x["a"], F.lit(" in "), F.trim(x["b"]), F.lit(": "), F.trim(x["c"])), F.trim(x["b"]), x["a"].try_cast("int"))),
    )
    instances = F.array_join(_all(t, r"Failed to deploy dispatcher on instance (\S+)"), ", ")
    some = lambda value, make: F.when(value.isNotNull(), F.array(make)).otherwise(F.array().cast(f"array<{ERROR}>"))
    p95 = _first(t, r"p95\s*=\s*([\d.]+)ms")
    load = F.concat(F.transform(_all(t, r"(?i)FAILED\s+(.+?)\s+threshold"), lambda v: _error("threshold_exceeded", F.concat(F.lit("Threshold failed: "), F.trim(v)))), some(p95, _error("response_time_exceeded", F.concat(F.lit("p95 response time: "), p95, F.lit("ms")))))
    gate = _first(t, r"(?i)Quality Gate (?:status|result)[:\s]+(\w+)")
    gate = F.when(F.upper(gate) != "OK", gate)
    cover = r"(?i)coverage.*?(\d+(?:\.\d+)?)\s*%.*?required.*?(\d+(?:\.\d+)?)\s*%"
    quality = F.concat(
        some(gate, _error("quality_gate_failure", F.concat(F.lit("Quality Gate: "), gate))),
        F.transform(_all(t, r"(\d+)\s+BLOCKER"), lambda v: _error("blocker_violation", F.concat(v, F.lit(" blocker violation(s)")))),
        some(_first(t, cover), _error("coverage_insufficient", F.concat(F.lit("Coverage "), _first(t, cover, 1), F.lit("% below required "), _first(t, cover, 2), F.lit("%")))),
    )
    is_step = lambda name: F.col("step").eqNullSafe(F.lit(name))
    blank = t.isNull() | ~t.rlike(r"\S")
    rows = rows.withColumn(
        "errors",
        F.when(blank, F.lit(None)).when(is_step("securitytest"), F.slice(F.transform(checks, lambda c: _error("security_check_failed", c["check"], c["reason"])), 1, MOST_ERRORS))
        .when(is_step("deploy"), deploy).when(is_step("loadtest"), load).when(is_step("codequality"), quality).cast(f"array<{ERROR}>"),
    ).withColumn("errors", F.coalesce("errors", F.array().cast(f"array<{ERROR}>")))

    first = F.get("errors", F.lit(0))
    missing, before = _first(t, pair), _error_before_failure(F.col("raw"))
    build_type = (
        F.when(missing.isNotNull(), "missing_npm_module").when(t.rlike(task), "npm_build_failed").when(t.rlike(typed), "typescript_error")
        .when(t.rlike(compiled), "java_compile_error").when(t.contains("OutOfMemoryError"), "oom").otherwise("build_failure")
    )
    build_message = (
        F.when(missing.isNotNull(), F.concat(F.lit("Missing npm package: "), missing))
        .when(t.rlike(task), F.concat(F.lit("npm task failed: "), _first(t, task)))
        .when(t.rlike(typed), F.concat(F.lit("TS"), _first(t, typed), F.lit(": "), F.substring(_first(t, typed, 2), 1, 200)))
        .when(t.rlike(compiled), F.substring(_first(t, compiled, 0), 1, 200))
        .when(t.contains("OutOfMemoryError"), "Java OutOfMemoryError during build")
        .otherwise(F.coalesce(before, F.lit("BUILD FAILURE — could not extract specific error")))
    )
    has = F.size("errors") > 0
    kind = (
        F.when(blank, "no_log").when(is_step("build"), build_type).when(is_step("securitytest"), "security_failure").when(is_step("deploy"), F.coalesce(first["type"], F.lit("deploy_failure")))
        .when(is_step("loadtest"), F.when(has, "load_test_failure").otherwise("load_test_unknown")).when(is_step("codequality"), F.when(has, "code_quality_failure").otherwise("code_quality_unknown"))
        .otherwise("unparsed")
    )
    message = (
        F.when(blank, "Log text was empty or unavailable").when(is_step("build"), build_message).when(is_step("securitytest"), secure_message)
        .when(is_step("deploy"), F.coalesce(first["detail"], F.when(instances != "", F.concat(F.lit("Deploy failed on: "), instances)), F.lit("Deployment failed — no specific error extracted")))
        .when(is_step("loadtest"), F.coalesce(first["detail"], F.lit("Load test failed"))).when(is_step("codequality"), F.coalesce(first["detail"], F.lit("Code quality check failed")))
        .otherwise(F.substring(t, 1, 300))
    )
    key = F.when(blank, F.array().cast("array<string>"))
    matching = lambda pattern: F.filter(kept, lambda x: x.rlike(pattern))
    for name, patterns in KEY_PATTERNS.items():
        key = key.when(is_step(name), F.slice(F.array_distinct(matching("(?i)" + "|".join(patterns))), 1, MOST_KEY_LINES))
    key = key.otherwise(F.slice(kept, 1, 5))
    module = F.when(is_step("build") & missing.isNotNull() & ~blank, F.element_at(F.split(_first(t, pair, 2), "/"), -1))
    return rows.select("log_id", "step", kind.alias("error_type"), message.alias("error_message"), module.alias("module"), "errors", key.alias("key_lines"), F.when(blank, 0).otherwise(F.size("raw")).alias("raw_line_count"))

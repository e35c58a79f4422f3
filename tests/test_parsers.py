import pytest

from faultline.operators.parsers import parse_step_logs

LOGS = {
    "npm": ("build", "[ERROR] Module not found: Error: Can't resolve 'left' in '/srv/ui/site'\nBUILD FAILURE"),
    "task": ("build", "Failed to run task: 'npm run x' failed. y"),
    "ts": ("build", "a\nerror TS2304: Cannot find name 'q'.\n"),
    "java": ("build", "error: package a.b does not exist"),
    "oom": ("build", "java.lang.OutOfMemoryError"),
    "before": ("build", "\n".join(["[ERROR] first", "[ERROR] near", *"abcdefg", "BUILD FAILURE"])),
    "far": ("build", "\n".join(["[ERROR] first", *"abcdefghijk", "BUILD FAILURE"])),
    "sec": ("securitytest", "node one\nc1 - Failed\nWARN - open\nnode two\nc1 - Failed\nINFO x"),
    "deploy": ("deploy", "Syntax error on line 7 of /etc/a.conf: bad\nConfig variables are not defined: HOST_A"),
    "instance": ("deploy", "Failed to deploy dispatcher on instance d1\nFailed to deploy dispatcher on instance d2"),
    "load": ("loadtest", "FAILED  rt  threshold\np95 = 91.5ms"),
    "quality": ("codequality", "Quality Gate status: ERROR\n3 BLOCKER\ncoverage 61.5% , required 80%"),
    "ok": ("codequality", "Quality Gate result: OK"),
    "other": ("smoke", " a \n\nb"),
    "none": (None, "x"),
    "empty": ("build", " \n"),
    "null": ("deploy", None),
}
WANT = {
    "npm": ("missing_npm_module", "Missing npm package: left", "site", []),
    "task": ("npm_build_failed", "npm task failed: npm run x", None, []),
    "ts": ("typescript_error", "TS2304: Cannot find name 'q'.", None, []),
    "java": ("java_compile_error", "error: package a.b does not exist", None, []),
    "oom": ("oom", "Java OutOfMemoryError during build", None, []),
    "before": ("build_failure", "[ERROR] near", None, []),
    "far": ("build_failure", "BUILD FAILURE — could not extract specific error", None, []),
    "sec": ("security_failure", "2 security checks failed across 2 nodes. All-node failures: c1", None, [("security_check_failed", "c1", "open", None), ("security_check_failed", "c1", None, None)]),
    "deploy": ("missing_env_variable", "Undefined variable: HOST_A", None, [("missing_env_variable", "Undefined variable: HOST_A", None, None), ("apache_config_syntax_error", "Line 7 in /etc/a.conf: bad", "/etc/a.conf", 7)]),
    "instance": ("deploy_failure", "Deploy failed on: d1, d2", None, []),
    "load": ("load_test_failure", "Threshold failed: rt", None, [("threshold_exceeded", "Threshold failed: rt", None, None), ("response_time_exceeded", "p95 response time: 91.5ms", None, None)]),
    "quality": ("code_quality_failure", "Quality Gate: ERROR", None, [("quality_gate_failure", "Quality Gate: ERROR", None, None), ("blocker_violation", "3 blocker violation(s)", None, None), ("coverage_insufficient", "Coverage 61.5% below required 80%", None, None)]),
    "ok": ("code_quality_unknown", "Code quality check failed", None, []),
    "other": ("unparsed", " a \n\nb", None, []),
    "none": ("unparsed", "x", None, []),
    "empty": ("no_log", "Log text was empty or unavailable", None, []),
    "null": ("no_log", "Log text was empty or unavailable", None, []),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, *v, "clash") for k, v in LOGS.items()], "log_id string, s string, t string, errors string")
    return {r["log_id"]: r for r in parse_step_logs(df, "log_id", "s", "t").collect()}


@pytest.mark.parametrize("name", LOGS)
def test_every_branch(parsed, name):
    r = parsed[name]
    assert (r["error_type"], r["error_message"], r["module"], [tuple(e) for e in r["errors"]]) == WANT[name]


def test_key_lines_and_counts(parsed):
    assert parsed["npm"]["key_lines"] == LOGS["npm"][1].split("\n") and parsed["other"]["key_lines"] == ["a", "b"]
    assert (parsed["npm"]["raw_line_count"], parsed["empty"]["raw_line_count"], parsed["null"]["key_lines"]) == (2, 0, [])
    assert parsed["sec"]["key_lines"] == ["c1 - Failed", "WARN - open"]


def test_empty(spark):
    assert parse_step_logs(spark.createDataFrame([], "log_id string, s string, t string"), "log_id", "s", "t").count() == 0

"""Candidates with the patterns of a step and without noise."""

import pytest

from faultline.operators import loglines, retrieval


@pytest.mark.parametrize(
    ("step", "line", "hit"),
    [
        ("build", "Module not found here", True), ("build", "Quality gate not met", False), ("codequality", "Quality gate not met", True), ("securitytest", "node 3 - failed", True), ("securitytest", "WARN - header", True),
        ("deploy", "upload FAILED", True), ("loadtest", "scenario failed", True), ("build", "upload FAILED", False), ("", "upload FAILED", False), (None, "upload FAILED", False),
    ],
)
def test_step_patterns(spark, step, line, hit):
    texts = [line] + [f"{w} has an error" for w in ("one", "two", "three")] + ["fine"] * 30
    df = spark.createDataFrame([("L", i, t, step) for i, t in enumerate(texts)], "log_id string, line_no int, line string, s string")
    assert {r["line_no"]: r["candidate"] for r in loglines.candidates(df, step="s").collect()}[0] is hit


def test_noise_is_dropped_also_from_the_fallback(spark):
    df = spark.createDataFrame([("L", 0, "error a"), ("L", 1, "calm"), ("L", 2, "error b"), ("M", 0, "error a")], "log_id string, line_no int, line string")
    noise = spark.createDataFrame([("L", 0), ("L", 0), ("L", 1)], "log_id string, line_no int")
    got = loglines.candidates(df, noise).where("candidate").collect()
    assert sorted((r["log_id"], r["line_no"]) for r in got) == [("L", 2), ("M", 0)]


def test_template_noise(spark):
    templates = [("p", "build", "Compilation failed in core"), ("p", "build", "ok then"), ("p", "build", "-" * 30), ("q", "build", "another pipeline's template"), ("p", "build", None)]
    texts = ["ompilation failed in core", "now Compilation failed in core again", "ok then", "ok then more", "-" * 25, "-" * 35, "another pipeline's template", "Compilation", " ", None]
    lines = spark.createDataFrame([("p", "build", t) for t in texts] + [(None, "build", "ok then")], "pipeline string, step string, line string")
    got = retrieval.template_noise(lines, "line", spark.createDataFrame(templates, "pipeline string, step string, template string"), "template", ["pipeline", "step"])
    assert sorted(r["line"] for r in got.collect()) == sorted([texts[0], texts[1], "ok then", "-" * 25, "-" * 35])

"""Brace sections against a line-by-line version."""

import pytest

from faultline.operators import loglines


def naive(texts, keyword, cap=60):
    first = next(i for i, t in enumerate(texts) if t.startswith(keyword))
    depth = 0
    for n, t in enumerate(texts[first:], 1):
        depth += t.count("{") + t.count("[") - t.count("}") - t.count("]")
        if (n > 4 and depth <= 0) or n >= cap:
            return first, first + n - 1
    return first, len(texts) - 1


@pytest.mark.parametrize(
    "texts",
    [
        ["x", '{"level": "error"}', "a", "b", "c", "d", "e", "f"],
        ["{", "(", "a", "}", "b", "c)", "d"],
        ["{ [", "a", "b", "c", "d", "]", "}", "after"],
        ["{", "a", "}"],
        ["{"] + ["a"] * 80,
    ],
)
def test_sections(spark, rows, texts):
    df = spark.createDataFrame([("L", i, t) for i, t in enumerate(texts)], "log_id string, line_no int, line string")
    assert rows(loglines.brace_sections(df, r"^\{")) == [("L", *naive(texts, "{"))]

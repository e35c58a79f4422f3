import random

import pytest

from faultline.operators.intervals import merge_intervals

SCHEMA = "who bigint, a bigint, z bigint, k string, s string"


def naive(rows):
    out, by = set(), {}
    for who, a, z, *_ in rows:
        if who is not None and a is not None and z is not None and z >= a:
            by.setdefault(who, []).append((a, z))
    for who, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for a, z in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        out |= {(who, "period", a, z) for a, z in merged}
        out |= {(who, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:], strict=False)}
    return sorted(out, key=repr)


def run(spark, rows, data, bucket=10):
    return rows(merge_intervals(spark.createDataFrame(data, SCHEMA), "who", "a", "z", bucket))


def test_touching_nested_empty_and_null(spark, rows):
    data = [(1, 0, 10), (1, 10, 20), (1, 21, 21), (1, 21, 21), (1, 22, 30), (1, 24, 25), (1, 90, 80), (1, None, 5), (1, 5, None), (None, 1, 2), (2, 7, 7)]
    data = [(*d, "x", None) for d in data]
    assert run(spark, rows, data) == naive(data)


def test_empty(spark, rows):
    assert run(spark, rows, []) == []


def test_long_interval_swallows_buckets(spark, rows):
    data = [(1, 3, 95, "", ""), (1, 12, 14, "", ""), (1, 55, 120, "", ""), (1, 121, 122, "", ""), (1, 300, 301, "", "")]
    assert run(spark, rows, data) == naive(data)


@pytest.mark.parametrize("seed", range(4))
def test_against_naive(spark, rows, seed):
    draw = random.Random(seed)
    data = [(draw.choice([1, 1, 1, 2, 3]), a := draw.randrange(-50, 400), a + draw.choice([0, 0, 1, 2, 5, 30]), "", "") for _ in range(300)]
    assert run(spark, rows, data, draw.choice([3, 10, 1000])) == naive(data)

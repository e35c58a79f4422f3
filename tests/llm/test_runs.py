import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from faultline.llm.runs import canonical_word, collapse_runs

SCHEMA = "who bigint, pos bigint, event string, t0 bigint, t1 bigint, entity string, chunk string"


def run(spark, data, **kwargs):
    df = spark.createDataFrame([(*d, "", "") for d in data], SCHEMA)
    return sorted(tuple(r) for r in collapse_runs(df, "who", "pos", "event", "t0", "t1", **kwargs).collect())


def naive(data, least=2):
    out = []
    kept = sorted(d for d in data if None not in d[:3])
    for who, mine in groupby(kept, key=lambda d: d[0]):
        for event, run_ in groupby(mine, key=lambda d: d[2]):
            r = list(run_)
            if len(r) >= least:
                a, z = r[0][3], r[-1][4]
                out.append((who, event, r[0][1], r[-1][1], len(r), a, z, None if a is None or z is None else z - a))
    return sorted(out)


def test_simple_and_nulls(spark):
    data = [(1, 1, "a", 0, 5), (1, 2, "a", 6, 9), (1, 3, "b", 10, 11), (1, 4, "b", None, None), (1, None, "b", 0, 0), (None, 5, "b", 0, 0), (1, 6, None, 0, 0), (2, 1, "a", 0, 1)]
    assert run(spark, data) == naive(data) == [(1, "a", 1, 2, 2, 0, 9, 9), (1, "b", 3, 4, 2, 10, None, None)]


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_stitching_over_chunks_and_batches(spark, seed):
    draw = random.Random(seed)
    data, pos = [], 0
    for who in (1, 1, 1, 2, 3):
        for _ in range(300):
            pos += draw.choice([1, 1, 2, 40])
            data.append((who, pos, draw.choice("aaaaab😀"), pos, pos + 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert run(spark, data, chunk_width=draw.choice([16, 100])) == naive(data)
        assert run(spark, data, chunk_width=50, least=1) == naive(data, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_run_over_many_chunks(spark):
    data = [(1, p, "x", p, p) for p in range(500)] + [(1, 500, "y", 0, 0)]
    assert run(spark, data, chunk_width=10) == [(1, "x", 0, 499, 500, 0, 499, 499)]


def test_slips(spark):
    words = ["FINISHED", "FINSIHED", "FINISHD", "Finished ", "fi-nished", "FINISHEDD", "FINIXHED", "FINXHED", "nan", "", " ", None, "code_quality", "Code Quality", "codeQuailty", "codeQuality securityTest"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(canonical_word(F.col("w"), ["FINISHED", "codeQuality"])).collect()]
    assert got == ["finished"] * 7 + ["finxhed"] + [None] * 4 + ["codequality"] * 3 + ["codequalitysecuritytest"]

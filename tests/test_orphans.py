import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number
from faultline.operators.orphans import RANGE_CODES, orphan_references, pack_codes, unpack_bits

REF = "table_name string, row_id bigint, execution_id string, exported_at timestamp_ntz, span string, period string"
PARENT = "execution_id string, exported_at timestamp_ntz, us string"
T = datetime(2026, 3, 5, 12)


def run(spark, rows, refs, parents):
    return rows(orphan_references(spark.createDataFrame([(*r, "", "") for r in refs], REF), spark.createDataFrame([(*p, "") for p in parents], PARENT)))


def test_bitmaps_round_trip():
    for codes in ([], [0], [9999], range(0, RANGE_CODES, 3), range(RANGE_CODES), [5, 5, 7]):
        assert np.flatnonzero(unpack_bits(pack_codes(np.array(list(codes), dtype=int)))).tolist() == sorted(set(codes))
    assert len(pack_codes(np.array([1, 2]))) < 10


def test_whole_numbers(spark):
    texts = ["17", " 17 ", "0017", "17.0", "\t17.0 ", "0", "000", "1.5", "-1", "", None, "phase", "17.00", "1e3", "9" * 40]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(whole_number(F.col("t"))).collect()]
    assert got == ["17"] * 5 + ["0", "0"] + [None] * 7 + ["9" * 40]


def test_kinds(spark, rows):
    parents = [("10", T), ("10", T + timedelta(days=9)), ("020.0", T + timedelta(seconds=1)), ("30", T + timedelta(days=40)), ("40", None), (None, T), ("phase", T)]
    refs = [("a", 1, " 10 ", T), ("a", 2, "20", T), ("b", 3, "30", T), ("b", 4, "5", T), ("b", 5, "100010", T), ("c", 6, "n/a", T), ("c", 7, None, T), ("c", 8, "40", T), ("c", 9, "10", None), ("c", 10, "77", None), ("c", 11, "9" * 40, T)]
    assert run(spark, rows, refs, parents) == sorted(
        [("a", 2, "late", "2026-03"), ("b", 3, "late", "2026-03"), ("b", 4, "missing", "2026-03"), ("b", 5, "missing", "2026-03"), ("c", 8, "late", "2026-03"), ("c", 10, "missing", None), ("c", 11, "missing", "2026-03")], key=repr
    )


def test_empty_sides(spark, rows):
    assert run(spark, rows, [], [("1", T)]) == []
    assert run(spark, rows, [("a", 1, "1", T)], []) == [("a", 1, "missing", "2026-03")]


def test_hot_key_and_repeated_rows_against_naive(spark, rows):
    draw = random.Random(5)
    parents = [(str(draw.randrange(0, 60_000, 7)), T + timedelta(hours=draw.randrange(200))) for _ in range(600)]
    refs = [("t", i, draw.choice(["77777", str(draw.randrange(60_000)), parents[i % 600][0]]), T + timedelta(hours=draw.randrange(200))) for i in range(1500)]
    first = {}
    for key, at in parents:
        first[key] = min(at, first.get(key, at))
    want = [(t, i, "missing" if k not in first else "late", at.strftime("%Y-%m")) for t, i, k, at in refs if k not in first or first[k] > at]
    assert run(spark, rows, refs, parents) == sorted(want, key=repr)

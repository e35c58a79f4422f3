from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline.operators import executions as ops
from faultline.operators import files, loglines, retrieval

T = datetime(2026, 5, 1)
EXPORT = "row_id bigint, execution_id string, program_id bigint, pipeline_id bigint, pipeline_name string, status string, duration_min double, exported_at timestamp_ntz, eid string, _x string"


def exported(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], EXPORT)


def test_latest_export_wins(spark, rows):
    data = [
        (1, "7", 1, 2, "Prod", "RUNNING", None, T), (2, "07.0", 1, 2, " Prod ", "finished ", 5.0, T + timedelta(1)), (3, "7", 1, 2, "Prod", "FAILED", -1.0, T + timedelta(1)),
        (4, "8", None, None, "nan", "", float("nan"), None), (5, "phase", 1, 1, "x", "y", 1.0, T), (6, None, 1, 1, "x", "y", 1.0, T),
    ]
    assert rows(ops.executions(exported(spark, data)).drop("exported_at")) == [(7, 1, 2, "Prod", "FAILED", None), (8, None, None, None, None, None)]


def test_summary_of_nothing(spark, rows):
    empty = ops.executions(exported(spark, []))
    assert rows(ops.summary(empty)) == [(0, 0, 0, 0, 0.0)]
    assert rows(ops.counts_with_zeros(empty, "status", ["A"])) == [("A", 0)]


def test_leading_run_and_top(spark, rows):
    df = spark.createDataFrame([(1, 5, "F"), (1, 4, "F"), (1, 3, "OK"), (1, 2, "F"), (2, 1, "F"), (3, 9, "OK"), (3, 8, None)], "k int, o int, s string")
    assert rows(ops.leading_run(df, "k", "o", F.col("s") == "OK")) == [(1, 2), (2, 1), (3, 0)]
    assert rows(ops.top_per_group(df, "k", [F.desc("o")], 1).select("k", "o")) == [(1, 5), (2, 1), (3, 9)]


def test_as_of_ties_nulls_and_clashes(spark, rows):
    left = spark.createDataFrame([(1, 1, 10, "l"), (2, 1, 5, "l"), (3, 2, 10, "l"), (4, None, 10, "l"), (5, 1, None, "l")], "id int, k int, t int, _row string")
    right = spark.createDataFrame([(7, 1, 10, "a"), (8, 1, 10, "b"), (9, 1, 11, "c"), (6, None, 1, "n")], "id int, k int, t int, _side string")
    got = ops.as_of(left, right, "k", "t", "t", ["id"], "id").select("id", "found_id").collect()
    assert dict(map(tuple, got))[1] == 8 and dict(map(tuple, got))[2] is None and dict(map(tuple, got))[3] is None and len(got) == 5


def test_pair_of_unknown(spark, rows):
    assert rows(ops.compare_pair(ops.executions(exported(spark, [])), 1, 2)) == [(None, None, None, None, 0.0)]


def test_paths(spark, rows):
    df = spark.createDataFrame([("ui.frontend/src/A.TS",), ("x\\ui.apps\\y",), ("a/POM.xml",), ("readme",), (None,), ("",)], "p string")
    module, step = files.module_of_path(F.col("p"))
    got = [tuple(r) for r in df.select(module, step, files.suffix(F.col("p"))).collect()]
    assert got == [("ui.frontend", "build", ".ts"), ("ui.apps", "build", ""), ("core", "build", ".xml"), ("other", "build", ""), (None, None, None), ("other", "build", "")]


def test_bulk_and_hot(spark, rows):
    df = spark.createDataFrame([(f, c, f"a{c % 2}", c, "bulk merge" if c == 4 else None) for c in range(5) for f in range(2 if c < 4 else 9)], "file int, commit int, author string, ts int, msg string")
    assert files.without_bulk(df, "commit", 3).count() == 8
    assert files.without_bulk(df, "commit", 99, "msg", "bulk").count() == 8
    assert rows(files.hot_files(df, "file", "author", "ts", "author", 5, "msg")) == [(0, 5, 2, ["a0", "a1"], 4, "a0", "bulk merge"), (1, 5, 2, ["a0", "a1"], 4, "a0", "bulk merge")]


def test_fill_down(spark, rows):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "#h1"), (1, 2, "a"), (1, 3, " "), (1, 4, None), (1, 5, "#h2"), (1, 6, "b"), (2, 0, "c")], "l int, p int, t string")
    assert rows(files.parse_change_log(df, "l", "p", "t", "^#").select("l", "t", "header")) == [(1, "a", "#h1"), (1, "b", "#h2")]


def lines(spark, texts):
    return spark.createDataFrame([("L", i, t) for i, t in enumerate(texts)], "log_id string, line_no int, line string")


def test_masks(spark):
    df = spark.createDataFrame([("  take 12 0xFF 123e4567-e89b-12d3-a456-42661417400a now",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(loglines.mask_line(F.col("t"))).collect()] == ["take <NUM> <HEX> <UUID> now", None, ""]
    assert spark.range(1).select(loglines.redact(F.lit("api-key = abc password:x y"))).first()[0] == "api-key=*** password=*** y"


def test_context_merge(spark, rows):
    df = spark.createDataFrame([("L", i, i in (5, 6, 15, 40), 60) for i in range(61)], "log_id string, line_no int, candidate boolean, last_line int")
    assert rows(loglines.context_blocks(df, 4, 6).select("start", "end")) == [(1, 21), (36, 46)]


def test_candidates_fall_back(spark):
    got = loglines.candidates(lines(spark, [f"step {chr(97 + i)} went well" for i in range(12)] + ["", None])).where("candidate").count()
    assert got == 12
    marked = {r["line"]: r["candidate"] for r in loglines.candidates(lines(spark, ["error 1", "error 2", "fatal a", "panic b", "exit c"] + ["fine"] * 40)).collect()}
    assert marked["error 1"] and not marked["error 2"] and marked["exit c"]


def test_weights_and_packing(spark, rows):
    texts = ["ok", "npm ERR! bad", "ok", "# head", "ok"]
    marked = loglines.candidates(lines(spark, texts)).withColumn("last_line", F.lit(4))
    weighed = loglines.line_weights(marked, loglines.context_blocks(marked, 0, 0))
    assert {r["line_no"]: r["weight"] for r in weighed.collect()}[1] == 10.0
    density = spark.createDataFrame([("L", 1, 5, 60, 3.0), ("L", 2, 5, 50, 2.0), ("L", 3, 5, 40, 1.0), ("M", 1, 1, 500, 1.0)], "log_id string, block_no bigint, n_lines int, tokens bigint, density double")
    assert rows(loglines.pack_blocks(density, 100)) == [("L", 1), ("L", 3), ("M", 1)]


def test_log_classes(spark):
    cases = [
        ("build", "Module not found: Error: Can't resolve '@x/y' in '/a/b'", "missing_npm_module"), ("build", "BUILD FAILURE", "build_failure"), ("securitytest", "x", "security_failure"),
        ("deploy", "Config variables are not defined: A_URL\nSyntax error on line 3 of /a.conf: bad", "missing_env_variable"), ("deploy", "Syntax error on line 3 of /a.conf: bad", "apache_config_syntax_error"), ("other", "x", "unparsed"), ("build", " ", "no_log"), ("build", None, "no_log"),
    ]
    df = spark.createDataFrame([(s, t) for s, t, _ in cases], "s string, t string")
    assert [r[0] for r in df.select(loglines.log_class(F.col("s"), F.col("t"))).collect()] == [c for *_, c in cases]
    found = loglines.deploy_errors(df, "s", "t").where("line_no is not null").select("file_path", "line_no", "detail").distinct().collect()
    assert [tuple(r) for r in found] == [("/a.conf", 3, "bad")]


def test_snippet(spark, rows):
    df = lines(spark, ["a", "b", "c", "d"])
    target = spark.createDataFrame([("L", 0)], "log_id string, target int")
    assert loglines.source_window(df, target, 1).first()["snippet"] == ">>>    1 | a\n       2 | b"


def test_retrieval(spark, rows):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [])], "id bigint, v array<float>")
    got = rows(retrieval.knn_topk(vectors, "id", "v", vectors, 1, least=0.5, block=2))
    assert got == [(1, 1, 2, 0.998752), (2, 1, 1, 0.998752)]
    assert retrieval.knn_topk(vectors.limit(0), "id", "v", vectors, 1).count() == 0
    df = spark.createDataFrame([("a b c", "a b c", None, "d"), ("", None, "nan x", "x nan")], "p string, q string, r string, s string")
    assert [r[0] for r in df.select(retrieval.normalised_query([F.col(c) for c in "pqrs"])).collect()] == ["a b c d", "nan x"]
    assert rows(spark.createDataFrame([(0, 2), (None, 0)], "a int, b int").select(retrieval.first_truthy(F.col("a"), F.col("b")))) == [(0.0,), (2.0,)]


def test_routes(spark, rows):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, s int")
    b = spark.createDataFrame([(2, 0), (4, 1), (5, 2), (1, 3)], "id int, s int")
    assert rows(retrieval.merge_routes([(a, [F.col("s")]), (b, [F.col("s")])], "id", 2)) == [(1, 0, 1), (2, 0, 2), (4, 1, 1), (5, 1, 2)]


def test_bm25_prefers_the_rare_term(spark, rows):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "alpha alpha delta"), (4, None), (5, "")], "id bigint, t string")
    asked = spark.createDataFrame([(9, "Gamma"), (8, None)], "q bigint, t string")
    got = rows(retrieval.bm25_topk(docs, "id", "t", asked, "q", "t", 3))
    assert [r[:3] for r in got] == [(9, 1, 2)]


def test_principal_axis(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(10)], "id bigint, v array<float>")
    pcs = [r["pc"] for r in retrieval.principal_components(df, "id", "v", 2).orderBy("id").collect()]
    assert abs(pcs[9][0] - pcs[0][0] - 9 * 5**0.5) < 1e-6 and all(abs(p[1]) < 1e-6 for p in pcs)

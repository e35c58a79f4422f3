import hashlib
import json

import duckdb
from pyspark.sql import functions as F

from faultline.operators import drain
from faultline.plans import exports as plans
from faultline.sources import exports, store
from faultline.streaming import incremental as st


def test_csv_exports(spark, tmp_path, rows):
    (tmp_path / "runs.csv").write_text(" Deploy Start Time ,Execution,Status,Duration (Min),programId,extra\n2026-05-14T21:07:16.000 PDT,7,FAILED,3.5,1,x\n,8,,bad,y,z\n")
    got = exports.read_executions_csv(spark, str(tmp_path / "runs.csv"))
    assert got.columns == ["deploy_start_time", "duration_min", "program_id", "execution_id", "status"]
    assert rows(got.select("execution_id", "duration_min", "program_id")) == [("7", 3.5, 1), ("8", None, None)]
    (tmp_path / "steps.csv").write_text("executionId,firstFailedStep,status\nphase,codeQuality securityTest,\n7,build,FAILED\n")
    assert rows(exports.read_failed_steps_csv(spark, str(tmp_path / "steps.csv"))) == [("7", "build", "FAILED")]
    (tmp_path / "shares.csv").write_text("executionId,shareName\n7,a\n7,b\n8,\n9,c\n")
    assert rows(exports.read_share_names_csv(spark, str(tmp_path / "shares.csv"))) == [("7", "b"), ("9", "c")]


def test_csv_executions_as_its_sql_on_odd_values(spark, tmp_path):
    ids = ["1", "\t2", "3\r", "4\n5", "\u00a06\u3000", "7,8", 'a"b', "c\\", " ", None]
    values = [("9", v) for v in (1.005, -0.125, 2.675, 0.285, 1e307, float("inf"), float("nan"), None)] + [(x, 1.0) for x in ids]
    data = spark.createDataFrame([(n, *x) for n, x in enumerate(values)], "row_id bigint, execution_id string, duration_min double").selectExpr("*", "1L AS program_id", "2L AS pipeline_id", "'a' AS status")
    data.coalesce(1).write.parquet(str(tmp_path / "pipelines_list.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pipelines_list AS SELECT * FROM read_parquet('{tmp_path}/pipelines_list.parquet/*.parquet')")
    columns = ["execution_id", "program_id", "pipeline_id", "duration_min", "n"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({plans.SQL['csv_executions']})").fetchall()
    got = [tuple(r) for r in plans.csv_executions(spark, str(tmp_path)).select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_json_sources(spark, tmp_path, rows):
    (tmp_path / "stream.json").write_text('{"result": {"a": "1"}}\nnot json\n{"preview": true}\n{"result": {"a": "2", "b": 3}}\n')
    assert rows(exports.read_result_stream(spark, str(tmp_path / "stream.json"), "a: string")) == [("1",), ("2",)]
    (tmp_path / "p.jsonl").write_text('{"id": "p1", "confidence": 5}\n{broken\n{"id": "p2", "top_factors": ["x"]}\n')
    assert rows(exports.read_predictions(spark, str(tmp_path / "p.jsonl")).select("id", "confidence")) == [("p1", 5), ("p2", None)]


def test_trees_and_logs(spark, tmp_path, rows):
    for name in ("src/a.py", "target/b.py", ".git/c.py", "src/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("one\ntwo")
    assert [r["path"].rsplit("/", 1)[1] for r in exports.read_repository(spark, str(tmp_path), "*.py").collect()] == ["a.py"]
    assert exports.list_files(spark, str(tmp_path)).count() == 3  # hidden folders are not listed
    assert {r["text"] for r in exports.read_logs(spark, str(tmp_path / "src")).collect()} == {"one\ntwo"}


def test_route_logs(spark, rows):
    wanted = spark.createDataFrame([(1, "s1", "build", "7"), (2, "s1", "codeQuality", "8"), (3, "s2", "Load Test", None), (4, "s3", None, "9"), (5, "s1", "build", " ")], "row int, share string, step string, execution_id string")
    logs = spark.createDataFrame([("s1", "build_debug_logs_7/build.log", "own"), ("s1", "build.log", "plain"), ("s2", "load-test.log", "load")], "share string, file string, text string")
    found = exports.route_logs(wanted, logs)
    assert rows(found.select("row", "file", "text")) == [(1, "build_debug_logs_7/build.log", "own"), (2, "build.log", "plain"), (3, "load-test.log", "load"), (4, None, None), (5, None, None)]
    assert found.where("row = 2").first()["cache_key"] == hashlib.md5(b"s1:build.log").hexdigest()


def test_route_logs_broadcasts_nothing(spark):
    wanted = spark.range(20).selectExpr("id AS row", "concat('s', id) AS share", "'build' AS step", "CAST(id AS STRING) AS execution_id")
    logs = wanted.selectExpr("share", "explode(array('build.log', 'load-test.log')) AS file", "'x' AS text")
    found = exports.route_logs(wanted, logs)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("file = 'build.log' and text = 'x'").count() == 20


def test_step_states(spark, rows):
    payload = json.dumps({"_embedded": {"stepStates": [{"action": "validate", "commitId": ""}, {"action": "build", "details": {"buildEnvironmentDetails": {"gitCommitSha": "abc"}}, "logUrl": "u"}, {"action": "build", "commitId": "def", "logUrl": "v"}]}})
    states = exports.step_states(spark.createDataFrame([(1, payload), (2, "{bad"), (3, None)], "id int, p string"), "id", "p")
    assert rows(exports.commit_of_execution(states, "id")) == [(1, "abc")]
    assert rows(exports.log_of_action(states, "id", "build")) == [(1, "u")]


def test_stores(spark, tmp_path, rows):
    path = str(tmp_path / "snap")
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert rows(store.resolve(spark, path, 100, 10, lambda: None, lambda: two)) == [(2, "b")]
    assert rows(store.resolve(spark, path, 100, 10, lambda: one, lambda: two)) == [(1, "a")]
    assert rows(store.resolve(spark, path, 105, 10, lambda: two, lambda: two)) == [(1, "a")]
    assert rows(store.resolve(spark, path, 200, 10, lambda: None, lambda: two)) == [(1, "a")]
    path = str(tmp_path / "log")
    store.append_once(one.union(one), path, "k")
    store.append_once(one.union(two), path, "k")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    path = str(tmp_path / "memory")
    store.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int"), path, "k", "at")
    store.upsert(spark.createDataFrame([(1, "c", 2)], "k int, v string, at int"), path, "k", "at")
    assert rows(store.latest(spark, path, "k").select("k", "v")) == [(1, "c"), (2, "b")]
    assert store.purge(spark, path, str(tmp_path / "kept"), F.col("v") == "b") == 1
    store.write_markdown(one, str(tmp_path / "md"), "Title")
    assert "| 1 | a |" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "md")).collect())


def test_streams(spark, tmp_path, rows):
    data = spark.createDataFrame([(1, "2026-01-01 10:00:00", "a"), (2, "2026-01-01 11:00:00", "a"), (1, "2026-01-02 10:00:00", "b")], "id int, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    data.repartition(3).write.parquet(str(tmp_path / "in.parquet"))
    path = str(tmp_path / "in.parquet")
    assert [r["n"] for r in st.run_available(st.trend(st.read_stream(spark, path), "ts", "kind"), "complete").orderBy("window_start").collect()] == [2, 1]
    assert rows(st.run_available(st.fold_states(st.read_stream(spark, path, 1), "id", "ts", "kind"), "complete").select("id", "status")) == [(1, "b"), (2, "a")]
    seen = []
    st.run_batches(st.read_stream(spark, path), lambda df, n: seen.append(df.count()), str(tmp_path / "ckpt"), "append")
    st.run_batches(st.read_stream(spark, path), lambda df, n: seen.append(df.count()), str(tmp_path / "ckpt"), "append")
    assert sum(seen) == 3


def test_drain(spark, rows):
    df = spark.createDataFrame([("k", f"timed out after {i} ms waiting for {w}") for i in range(5) for w in ("alpha", "beta")] + [(None, "timed out after"), ("k", "short"), ("k", None)], "k string, line string")
    assert rows(drain.mine(df, "k", "line")) == [("k", "timed out after <NUM> ms waiting for <*>", 10), (None, "timed out after", 1)]
    assert drain.mine(df.limit(0), "k", "line").count() == 0

"""Success logs: newest nine finished executions, three usable logs."""

from faultline.operators import executions as ex


def test_success_logs(spark, rows):
    runs = [("p", i, i * 10, "FINISHED") for i in range(1, 13)] + [("p", 90, 999, "FAILED"), ("p", 91, None, "FINISHED"), ("q", 50, 1, "FINISHED"), (None, 60, 1, "FINISHED")]
    usable, short = "x" * 51, "x" * 50
    logs = [(12, "build", "a", usable), (11, "build", "b", short), (10, "deploy", "c", usable), (9, "build", "d", usable), (8, "build", "e", usable), (7, "build", "f", usable), (3, "deploy", "g", usable)]
    logs += [(90, "build", "h", usable), (91, "build", "i", usable), (50, "build", "j", usable), (60, "build", "k", usable), (50, None, "l", usable), (50, "build", "m", None), (4, "deploy", "n", usable)]
    got = ex.success_logs(spark.createDataFrame(runs, "p string, eid bigint, t bigint, status string"), spark.createDataFrame(logs, "eid bigint, s string, id string, text string"), "p", "eid", "t", "s", "id", "text")
    assert rows(got.select("p", "s", "id")) == [("p", "build", "a"), ("p", "build", "d"), ("p", "build", "e"), ("p", "deploy", "c"), ("p", "deploy", "n"), ("q", "build", "j")]


def test_success_templates_leave_failed_logs_out(spark, tmp_path, monkeypatch):
    from faultline.plans import retrieval

    line = "Worker {} finished the upload of module core without any delay"
    frames = {
        "programs": spark.createDataFrame([(1, "Europe/Berlin")], "program_id bigint, zone_name string"),
        "pipelines_list": spark.createDataFrame(
            [(1, "1", " Dev Pipeline", "FINISHED", 1, "1752480312.0", 1), (2, "2", "dev pipeline", "FAILED", 1, "1752480313.0", 1)],
            "row_id bigint, execution_id string, pipeline_name string, status string, program_id bigint, deploy_start_time string, exported_at bigint",
        ),
        "parsed_logs": spark.createDataFrame([("a", "1", "Build", [line.format(1), line.format(2)]), ("b", "2.0", "build", ["COMPILATION ERROR in module core while building the whole project"])], "log_id string, execution_id string, step string, key_lines array<string>"),
    }
    monkeypatch.setattr(retrieval, "table", lambda _spark, _folder, name: frames[name])
    got = [tuple(r) for r in retrieval.success_templates(spark, "").collect()]
    assert got == [("dev pipeline", "build", line.format("<NUM>"), 2)]

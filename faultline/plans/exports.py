"""Queries of readers, stores and sinks: tables are exported to files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.ids import whole_number_long
from faultline.plans.executions import _EID
from faultline.session import work_folder
from faultline.sources import exports, store
from faultline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_KEY = r"nullif(regexp_extract(execution_id, '^\s*0*([0-9]+?)(?:\.0)?\s*$', 1), '')"


#: Unicode's space separators, which trim of the SQL drops, and no other white space.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def _hundredths(value):
    """``value`` rounded to two places as the SQL does: the product by 100, half away from zero; ``round`` takes the decimal digits instead (1.005)."""
    scaled = value * 100
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 100).otherwise(value)


@query("SELECT trim(execution_id) AS execution_id, program_id, pipeline_id, round(duration_min, 2) AS duration_min, count(*) AS n FROM pipelines_list WHERE trim(execution_id) <> '' GROUP BY ALL")
def csv_executions(spark, folder):
    """Executions written as the CSV export and read back with types."""
    path = work_folder(spark, "csv")
    names = {"program_id": "programId", "pipeline_id": "pipelineId", "execution_id": "Execution", "duration_min": " Duration (Min)", "status": "Status"}
    table(spark, folder, "pipelines_list").select(*[F.col(c).alias(h) for c, h in names.items()], F.lit("x").alias("Program")).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = exports.read_executions_csv(spark, path).withColumn("execution_id", F.btrim("execution_id", F.lit(_SPACES))).where("execution_id <> ''")
    return rows.groupBy("execution_id", "program_id", "pipeline_id", _hundredths(F.col("duration_min")).alias("duration_min")).agg(F.count("*").alias("n"))


@query(f"SELECT {_KEY} AS execution_id, count(*) AS n, count(nullif(trim(first_failed_step), '')) AS n_steps FROM first_failed_steps WHERE {_KEY} IS NOT NULL GROUP BY 1")
def csv_failed_steps(spark, folder):
    path = work_folder(spark, "csv")
    table(spark, folder, "first_failed_steps").select(F.col("execution_id").alias("executionId"), F.col("first_failed_step").alias("firstFailedStep"), "status").write.option("header", True).csv(path)
    return exports.read_failed_steps_csv(spark, path).groupBy("execution_id").agg(F.count("*").alias("n"), F.count(F.nullif(F.trim("first_failed_step"), F.lit(""))).alias("n_steps"))


@query(f"SELECT {_KEY} AS execution_id, arg_max(trim(share_name), row_id) AS share_name FROM share_names WHERE trim(share_name) <> '' AND {_KEY} IS NOT NULL GROUP BY 1")
def csv_share_names(spark, folder):
    """The last share of each execution, in the order of the exported file."""
    path = work_folder(spark, "csv")
    table(spark, folder, "share_names").orderBy("row_id").select(F.col("execution_id").alias("executionId"), F.col("share_name").alias("shareName")).write.option("header", True).csv(path)
    return exports.read_share_names_csv(spark, path).withColumn("share_name", F.trim("share_name"))


@query("SELECT log_id, step, CAST(raw_line_count AS BIGINT) AS n_lines FROM parsed_logs WHERE length(log_id) > 0 AND raw_line_count % 5 <> 0")
def ndjson_results(spark, folder):
    """Result objects of a stream of JSON lines, of which some are broken or hold none."""
    path = work_folder(spark, "ndjson")
    line = F.when(F.col("raw_line_count") % 10 == 0, F.lit('{"result": {')).when(F.col("raw_line_count") % 5 == 0, F.lit('{"preview": true}')).otherwise(F.to_json(F.struct(F.struct("log_id", "step", "raw_line_count").alias("result"))))
    table(spark, folder, "parsed_logs").select(line.alias("value")).write.text(path)
    return exports.read_result_stream(spark, path, "log_id string, step string, raw_line_count bigint").withColumnRenamed("raw_line_count", "n_lines")


@query("SELECT id, status, confidence, CAST(len(top_factors) AS BIGINT) AS n_factors FROM predictions WHERE id IS NOT NULL")
def jsonl_predictions(spark, folder):
    """Prediction records of JSON lines; a corrupt line is skipped."""
    path = work_folder(spark, "jsonl")
    rows = table(spark, folder, "predictions").drop("row_id", "exported_at")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    return exports.read_predictions(spark, path).select("id", "status", "confidence", F.when(F.col("top_factors").isNotNull(), F.size("top_factors")).cast("bigint").alias("n_factors"))


@query("SELECT count(DISTINCT id) AS n_ids, count(DISTINCT id) AS n_rows FROM predictions WHERE id IS NOT NULL")
def append_once(spark, folder):
    """Records appended twice to a store that takes each key once."""
    path = work_folder(spark, "once")
    rows = table(spark, folder, "predictions").select("id", "status")
    store.append_once(rows.where("length(id) % 2 = 0"), path, "id")
    store.append_once(rows, path, "id")
    return spark.read.parquet(path).agg(F.count_distinct("id").alias("n_ids"), F.count("*").alias("n_rows"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'changed' ELSE n_name END AS v FROM nation WHERE n_nationkey % 5 <> 0")
def store_upsert(spark, folder):
    """A store of versions: written, changed in part, purged of some keys, and read at its latest."""
    path = work_folder(spark, "store")
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    store.upsert(rows.withColumn("at", F.lit(1)), path, "k", "at")
    store.upsert(rows.where("k % 2 = 0").withColumns({"v": F.lit("changed"), "at": F.lit(2)}), path, "k", "at")
    kept = work_folder(spark, "store")
    store.purge(spark, path, kept, F.col("k") % 5 == 0)
    return store.latest(spark, kept, "k").select("k", "v")


@query("SELECT 25 AS n_rows, 100 AS written_at, 50 AS age, 25 AS fresh, 24 AS stale, false AS left_over")
def snapshot_refresh(spark, folder):
    """A snapshot read while fresh, replaced from the live source once too old, described and cleared."""
    path = work_folder(spark, "snapshot")
    rows = table(spark, folder, "nation")
    store.write_snapshot(rows, path, 100)
    described = store.info(spark, path, 150)
    described = spark.createDataFrame(described.collect(), described.schema)
    fresh = store.resolve(spark, path, 150, 60, lambda: rows.limit(0), lambda: rows).count()
    stale = store.resolve(spark, path, 200, 60, lambda: rows.where("n_nationkey > 0"), lambda: rows).count()
    store.clear(spark, path)
    left = store.read_fresh(spark, path, 200, 60) is not None
    return described.select(*[F.col(c).cast("int").alias(c) for c in ("n_rows", "written_at", "age")], F.lit(fresh).alias("fresh"), F.lit(stale).alias("stale"), F.lit(left).alias("left_over"))


@query("SELECT CAST(n_nationkey AS VARCHAR) || '.txt' AS name, length(n_name) AS n_chars FROM nation")
def log_files(spark, folder):
    """Text files of a folder read whole, with their names."""
    path = work_folder(spark, "logs")
    table(spark, folder, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    found = exports.read_logs(spark, path).select(F.concat(F.regexp_extract("path", "k=([0-9]+)/", 1), F.lit(".txt")).alias("name"), F.length(F.regexp_replace("text", "\n$", "")).cast("bigint").alias("n_chars"))
    listed = exports.list_files(spark, path).select(F.concat(F.regexp_extract("path", "k=([0-9]+)/", 1), F.lit(".txt")).alias("name")).where("name <> '.txt'")
    return found.join(listed, "name")


@query("SELECT 'k=' || n_nationkey AS folder, upper(n_name) AS content FROM nation WHERE n_nationkey <> 7")
def repository_files(spark, folder):
    """Files of a tree, without those in folders that are no sources."""
    path = work_folder(spark, "tree")
    rows = table(spark, folder, "nation").select(F.upper("n_name").alias("value"), F.concat(F.when(F.col("n_nationkey") == 7, "target/").otherwise("src/"), F.lit("k="), F.col("n_nationkey")).alias("d"))
    rows.where("d not like 'target/%'").select("value", F.regexp_replace("d", "^src/k=", "").alias("k")).write.partitionBy("k").text(path + "/src")
    rows.where("d like 'target/%'").select("value", F.lit("7").alias("k")).write.partitionBy("k").text(path + "/target")
    files = exports.read_repository(spark, path, "*.txt")
    return files.select(F.regexp_extract("path", "(k=[0-9]+)/", 1).alias("folder"), F.regexp_replace("content", "\n$", "").alias("content"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def report_sinks(spark, folder):
    """A report written as JSON lines and as Markdown and read back from both."""
    rows = table(spark, folder, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    as_json, as_text = work_folder(spark, "report"), work_folder(spark, "report")
    store.write_json(rows, as_json)
    store.write_markdown(rows, as_text, "Regions")
    cells = F.split("value", r" *\| *")
    lines = spark.read.text(as_text).where(F.col("value").rlike(r"^\| [0-9]")).select(cells[1].cast("int").alias("k"), cells[2].alias("name"))
    return spark.read.schema("k int, name string").json(as_json).join(lines, ["k", "name"])


_STATES = """'{"_embedded": {"stepStates": [{"action": "validate", "status": "FINISHED", "commitId": ""}, {"action": "build", "details": {"buildEnvironmentDetails": {"gitCommitSha": "c' || (s_suppkey % 9) || '"}}, "logUrl": "u' || s_suppkey || '"}, {"action": "build", "commitId": "later", "logUrl": "v"}]}}'"""


@query("SELECT s_suppkey AS k, 'c' || (s_suppkey % 9) AS commit, 'u' || s_suppkey AS log_url, CAST(3 AS BIGINT) AS n_states FROM supplier")
def execution_states(spark, folder):
    """States nested in execution records: how many, the first commit, and the log of the first build."""
    payloads = table(spark, folder, "supplier").selectExpr("s_suppkey AS k", f"{_STATES} AS payload")
    states = exports.step_states(payloads, "k", "payload")
    counts = states.groupBy("k").agg(F.count("*").alias("n_states"))
    return counts.join(exports.commit_of_execution(states, "k"), "k").join(exports.log_of_action(states, "k", "build"), "k").select("k", "commit", "log_url", "n_states")


@query(f"""WITH w AS (SELECT row_id, {_EID} AS eid, regexp_replace(lower(first_failed_step), '[^a-z0-9]', '', 'g') AS step FROM first_failed_steps),
p AS (SELECT row_id, CASE WHEN step IN ('build', 'codequality') THEN CASE WHEN eid % 2 = 0 THEN 'build_debug_logs_' || eid || '/build.log' ELSE 'build.log' END WHEN step = 'securitytest' THEN 'securityTests.log' WHEN step = 'deploy' THEN NULL WHEN step = 'loadtest' THEN 'load-test.log' ELSE 'build.log' END AS file, eid FROM w WHERE eid IS NOT NULL)
SELECT row_id, file, CASE WHEN file IS NOT NULL THEN md5('s' || eid || ':' || file) END AS cache_key FROM p""")
def routed_logs(spark, folder):
    """The log of each failed step: shares of even executions hold the build log of the execution, all hold the plain one, none the deployment's."""
    steps = table(spark, folder, "first_failed_steps").select(F.col("row_id").alias("row"), whole_number_long(F.col("execution_id")).alias("eid"), F.col("first_failed_step").alias("step")).where("eid is not null")
    wanted = steps.select("row", F.concat(F.lit("s"), F.col("eid")).alias("share"), "step", F.col("eid").cast("string").alias("execution_id"))
    shares = steps.select("eid").distinct()
    names = F.array(F.lit("build.log"), F.lit("securityTests.log"), F.lit("load-test.log"), F.when(F.col("eid") % 2 == 0, F.concat(F.lit("build_debug_logs_"), F.col("eid"), F.lit("/build.log"))))
    logs = shares.select(F.concat(F.lit("s"), F.col("eid")).alias("share"), F.explode(names).alias("file")).where("file is not null").withColumn("text", F.lit("x"))
    return exports.route_logs(wanted, logs).select(F.col("row").alias("row_id"), "file", "cache_key")


"""Readers of exported files: CSV exports, NDJSON, JSON lines, logs, repository trees, execution records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number

#: Export header -> column.
EXECUTION_COLUMNS = {
    "Deploy Start Time": "deploy_start_time", "End Time": "end_time", "Duration (Min)": "duration_min", "programId": "program_id",
    "pipelineId": "pipeline_id", "pipelineName": "pipeline_name", "Execution": "execution_id", "Status": "status",
}
PREDICTION_SCHEMA = (
    "id string, status string, program_id string, tenant_id string, pipeline_name string, execution_id string, commit_sha string, predicted_risk string, predicted_step string, confidence int, "
    "modules_at_risk array<string>, top_factors array<string>, predicted_at string, resolved_at string, actual_status string, actual_failed_step string, correct boolean, evaluation_note string, _corrupt string"
)


def _csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text with trimmed headers; no inference pass.  ``multi_line``: quoted values may hold line breaks, and a file is one task."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line).csv(path)
    return rows.toDF(*[c.strip() for c in rows.columns])


def read_executions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Executions of a CSV export: the known columns it has, renamed; ids as BIGINT, bad durations as NULL.

    Columns that are missing are tolerated, others are not read (column pruning reaches the scan).
    Quoted values may hold line breaks.
    """
    rows = _csv(spark, path, multi_line=True)
    kept = rows.select(*[F.col(f"`{h}`").alias(c) for h, c in EXECUTION_COLUMNS.items() if h in rows.columns])
    casts = {"duration_min": "double", "program_id": "bigint", "pipeline_id": "bigint"}
    return kept.withColumns({c: F.col(c).try_cast(kind) for c, kind in casts.items() if c in kept.columns})


def read_failed_steps_csv(spark: SparkSession, path: str) -> DataFrame:
    """First failed steps of a CSV export; rows whose execution id is no whole number are dropped."""
    rows = _csv(spark, path)
    return rows.select(whole_number(F.col("executionId")).alias("execution_id"), F.col("firstFailedStep").alias("first_failed_step"), F.col("status")).where("execution_id is not null")


def read_share_names_csv(spark: SparkSession, path: str) -> DataFrame:
    """One non-blank share per execution id, the last in file order."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("_pos", place).where(F.trim("shareName") != "")
    keyed = rows.withColumn("execution_id", whole_number(F.col("executionId"))).where("execution_id is not null")
    return keyed.groupBy("execution_id").agg(F.max_by("shareName", "_pos").alias("share_name"))


def read_result_stream(spark: SparkSession, path: str, result_schema: str) -> DataFrame:
    """Objects under ``result`` of NDJSON lines; lines that are no JSON or have no result are skipped."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", f"result struct<{result_schema}>", {"mode": "PERMISSIVE"}).alias("x"))
    return parsed.where("x.result is not null").select("x.result.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records of JSON lines; corrupt lines are skipped."""
    rows = spark.read.schema(PREDICTION_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and id is not null").drop("_corrupt")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, cache_key, text): whole text files below ``path``."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.md5(F.col("_metadata.file_path")).alias("cache_key"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files below ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def read_repository(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of repository files matching a glob, without what lies under .git, node_modules or target."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.where(~F.col("path").rlike(r"/(?:\.git|node_modules|target)/"))


def log_paths(step: Column, execution_id: Column) -> Column:
    """Candidate log files of a step, the likelier first (fixed values); the step in lower-case letters, case and signs aside."""
    plain = F.regexp_replace(F.lower(step), "[^a-z0-9]", "")
    named = F.nullif(F.trim(execution_id), F.lit(""))
    build = F.when(named.isNotNull(), F.array(F.concat(F.lit("build_debug_logs_"), named, F.lit("/build.log")), F.lit("build.log"))).otherwise(F.array(F.lit("build_debug_logs/build.log")))
    return (
        F.when(plain.isin("build", "codequality"), build).when(plain == "securitytest", F.array(F.lit("securityTests.log"))).when(plain == "deploy", F.array(F.lit("deploy/deploy.log")))
        .when(plain == "loadtest", F.array(F.lit("load-test.log"))).otherwise(F.array(F.lit("build.log")))
    )


def cache_key(share: Column, path: Column) -> Column:
    """The key a log is stored under: of its share and its path."""
    return F.md5(F.concat_ws(":", share, path))


def route_logs(wanted: DataFrame, logs: DataFrame) -> DataFrame:
    """``wanted`` (row, share, step, execution_id) with file, cache_key and text of the first candidate log its share has; NULL if it has none.

    ``logs``: share, file, text.  ``row`` is unique.  The texts join last, once the file is known.

    All joins merge: sizes are estimated without the rows that exploding adds, so
    sides that grow with the input would be taken for small and broadcast.
    """
    tried = wanted.select("row", "share", F.posexplode(log_paths(F.col("step"), F.col("execution_id"))).alias("_try", "file"))
    there = tried.join(logs.select("share", "file").distinct().hint("merge"), ["share", "file"], "left_semi")
    first = there.groupBy("row").agg(F.min_by(F.struct("share", "file"), "_try").alias("x")).select("row", "x.*")
    found = first.join(logs.select("share", "file", "text").hint("merge"), ["share", "file"]).select("row", "file", cache_key(F.col("share"), F.col("file")).alias("cache_key"), "text")
    return wanted.join(found.hint("merge"), "row", "left")


STEP_STATES = "_embedded struct<stepStates: array<struct<action: string, status: string, commitId: string, details: struct<buildEnvironmentDetails: struct<gitCommitSha: string>>, logUrl: string>>>"


def step_states(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, action, status, commit, log_url): the step states nested in execution records; bad JSON has none."""
    states = F.from_json(payload, STEP_STATES)["_embedded"]["stepStates"]
    rows = payloads.select(key, F.posexplode(states).alias("pos", "s"))
    commit = F.coalesce(F.nullif(F.col("s.commitId"), F.lit("")), F.nullif(F.col("s.details.buildEnvironmentDetails.gitCommitSha"), F.lit("")))
    return rows.select(key, "pos", "s.action", "s.status", commit.alias("commit"), F.col("s.logUrl").alias("log_url"))


def commit_of_execution(states: DataFrame, key: str) -> DataFrame:
    """(key, commit): the first commit that any state of the execution names."""
    return states.where("commit is not null").groupBy(key).agg(F.min_by("commit", "pos").alias("commit"))


def log_of_action(states: DataFrame, key: str, action: str) -> DataFrame:
    """(key, log_url): the first state of an action that has a log."""
    return states.where((F.col("action") == action) & F.col("log_url").isNotNull()).groupBy(key).agg(F.min_by("log_url", "pos").alias("log_url"))

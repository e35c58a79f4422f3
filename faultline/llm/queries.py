"""Queries of problems 3, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number_long
from faultline.functions.instants import add_utc_micros
from faultline.llm.leakage import leaked_items
from faultline.llm.mojibake import restored_texts
from faultline.llm.packing import CAPACITY, pack_documents
from faultline.llm.runs import canonical_word, collapse_runs
from faultline.operators.timenorm import with_zones
from faultline.plans.dataprep import instants_sql
from faultline.sources.tables import table

#: Statuses and steps whose slips are set right.
STATUSES = ["CANCELLED", "FAILED", "ERROR", "FINISHED", "RUNNING"]
STEPS = ["build", "codeQuality", "securityTest", "deploy", "loadTest"]


def _latest(rows: DataFrame, *columns: str) -> DataFrame:
    """Per execution id the columns of its row with the latest ``exported_at``, the larger ``row_id`` on a tie."""
    keyed = rows.withColumn("eid", whole_number_long(F.col("execution_id"))).where("eid is not null")
    return keyed.groupBy("eid").agg(F.max_by(F.struct(*columns), F.struct("exported_at", "row_id")).alias("x")).select("eid", "x.*")


def _execution_events(spark: SparkSession, folder: str, *times: str) -> DataFrame:
    """One row per execution: pipeline_id, eid, event (canonical status and step)."""
    extra = ["program_id", *times] if times else []
    runs = _latest(table(spark, folder, "pipelines_list"), "pipeline_id", "status", *extra)
    runs = runs.withColumn("state", canonical_word(F.col("status"), STATUSES)).where("pipeline_id is not null and state is not null")
    steps = _latest(table(spark, folder, "first_failed_steps"), "first_failed_step").select("eid", canonical_word(F.col("first_failed_step"), STEPS).alias("step"))
    event = F.concat(F.col("state"), F.lit("|"), F.coalesce(F.col("step"), F.lit("")))
    return runs.join(steps, "eid", "left").select("pipeline_id", "eid", event.alias("event"), *extra)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = collapse_runs(_execution_events(spark, folder), "pipeline_id", "eid", "event")
    return found.select(F.col("entity").alias("pipeline_id"), F.col("first_pos").alias("first_execution_id"), F.col("last_pos").alias("last_execution_id"), F.col("n").alias("n_executions"))


def p3_durations(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of p3_found with what repeats, and the time from the first start to the last end where both are instants."""
    runs, unique = with_zones(_execution_events(spark, folder, "deploy_start_time", "end_time"), "program_id", table(spark, folder, "programs"))
    runs = add_utc_micros(runs, "deploy_start_time", "_zone_name", "_abbreviations", "begins", unique)
    runs = add_utc_micros(runs, "end_time", "_zone_name", "_abbreviations", "ends", unique)
    found = collapse_runs(runs, "pipeline_id", "eid", "event", "begins", "ends")
    what = F.split("event", r"\|")
    return found.select(
        F.col("entity").alias("pipeline_id"), what[0].alias("status"), F.nullif(what[1], F.lit("")).alias("step"),
        F.col("first_pos").alias("first_execution_id"), F.col("last_pos").alias("last_execution_id"), F.col("n").alias("n_executions"), F.col("duration").alias("duration_micros"),
    )


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, the fewest that could do, tokens, and the share of room unused."""
    packed = p6_packed(spark, folder).agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return packed.select("n_containers", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_containers"), "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 6).alias("unused_share"))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What any packing must hold: every document is there, whole; no container is overfull; only documents over the capacity are split; at most 1 in 100 tokens of room is unused (from 100 containers on)."""
    packed = p6_packed(spark, folder)
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), F.count("*").alias("n_containers"), F.sum("used").alias("used"))
    pieces = packed.groupBy("doc_id", "n_pieces").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    needless = (F.col("n_pieces") > 1) & (F.col("tokens") <= CAPACITY)
    pieces = pieces.agg(F.sum(F.col("n") / F.col("n_pieces")).cast("bigint").alias("n_documents"), F.count_if(needless | (F.col("n") % F.col("n_pieces") != 0)).alias("badly_split"))
    both = pieces.join(F.broadcast(full))
    return both.select("n_documents", "badly_split", "overfull", ((F.col("n_containers") < 100) | (F.col("used") >= 0.99 * CAPACITY * F.col("n_containers"))).alias("tight"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_by_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Per suite: items that leaked, and documents that hold one of them."""
    suites = table(spark, folder, "eval_items").select("item_id", "suite")
    return p7_found(spark, folder).join(suites, "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = restored_texts(table(spark, folder, "documents"))
    return found.select("doc_id", F.coalesce(F.md5(F.col("restored_text").cast("binary")), F.lit("")).alias("restored_md5"))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The restored texts themselves; NULL where characters were destroyed."""
    return restored_texts(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_durations, p6_packed, p6_fill, p6_invariants, p7_found, p7_by_suite, p8_found, p8_restored)}
_ID = r"try_cast(nullif(regexp_extract(execution_id, '^\s*0*([0-9]+?)(?:\.0)?\s*$', 1), '') AS BIGINT)"


#: The statement's own words, not taken from the operator.
STATUS_NAMES, STEP_NAMES = ["cancelled", "failed", "error", "finished", "running"], ["build", "codequality", "securitytest", "deploy", "loadtest"]


def _canonical(column: str, vocabulary: list[str]) -> str:
    plain = f"regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    slips = " ".join(f"WHEN damerau_levenshtein({plain}, '{w.lower()}') <= 1 THEN '{w.lower()}'" for w in vocabulary)
    return f"CASE WHEN {plain} IS NULL OR {plain} IN ('', 'nan') THEN NULL {slips} ELSE {plain} END"


def _runs(extra: str = "") -> str:
    """The executions with their run numbers, as common table expressions; ``extra`` more columns of their latest row."""
    return f"""runs AS (SELECT {_ID} AS eid, *, row_number() OVER (PARTITION BY {_ID} ORDER BY exported_at DESC NULLS LAST, row_id DESC) AS n FROM pipelines_list),
steps AS (SELECT {_ID} AS eid, *, row_number() OVER (PARTITION BY {_ID} ORDER BY exported_at DESC NULLS LAST, row_id DESC) AS n FROM first_failed_steps),
events2 AS (SELECT pipeline_id, runs.eid, {_canonical("runs.status", STATUS_NAMES)} AS state, {_canonical("first_failed_step", STEP_NAMES)} AS step{extra} FROM runs LEFT JOIN steps ON steps.eid = runs.eid AND steps.n = 1 WHERE runs.eid IS NOT NULL AND runs.n = 1),
opened AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state OR lag(step) OVER w IS DISTINCT FROM step THEN 1 ELSE 0 END AS new FROM events2
WHERE pipeline_id IS NOT NULL AND state IS NOT NULL WINDOW w AS (PARTITION BY pipeline_id ORDER BY eid)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY pipeline_id ORDER BY eid ROWS UNBOUNDED PRECEDING) AS run FROM opened)"""


SQL: dict[str, str] = {
    "p6_invariants": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS badly_split, CAST(0 AS BIGINT) AS overfull, true AS tight FROM documents",
    "p3_found": f"WITH {_runs()} SELECT pipeline_id, min(eid) AS first_execution_id, max(eid) AS last_execution_id, count(*) AS n_executions FROM grouped GROUP BY pipeline_id, run HAVING count(*) > 1",
    "p3_durations": instants_sql(("pipelines_list", "deploy_start_time"), ("pipelines_list", "end_time")) + f""", {_runs(", runs.row_id")},
times AS (SELECT row_id, max(utc_micros) FILTER (field_name = 'deploy_start_time') AS a, max(utc_micros) FILTER (field_name = 'end_time') AS z FROM u GROUP BY row_id)
SELECT pipeline_id, any_value(state) AS status, any_value(step) AS step, min(eid) AS first_execution_id, max(eid) AS last_execution_id, count(*) AS n_executions, arg_max_null(z, eid) - arg_min_null(a, eid) AS duration_micros
FROM grouped JOIN times USING (row_id) GROUP BY pipeline_id, run HAVING count(*) > 1""",
}

"""Streaming queries, each run over all available files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.ids import whole_number, whole_number_long
from faultline.session import work_folder
from faultline.sources.tables import table
from faultline.streaming import incremental as st

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_trend(spark, folder):
    """Daily counts by type with a watermark, update mode."""
    return st.run_available(st.trend(st.read_stream(spark, f"{folder}/events.parquet"), "ts", "event_type"), "update", ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(r"""SELECT execution_id, min(exported_at) AS first_seen, max(exported_at) AS last_seen, arg_max(status, exported_at) AS status FROM
(SELECT nullif(regexp_extract(execution_id, '^\s*0*([0-9]+?)(?:\.0)?\s*$', 1), '') AS execution_id, exported_at, CASE WHEN actual_status IS NULL THEN 'RUNNING' ELSE 'ENDED' END AS status FROM predictions)
WHERE execution_id IS NOT NULL GROUP BY 1""")
def stream_fold(spark, folder):
    """Records of one execution folded to its first and last sight and latest state, update mode."""
    rows = st.read_stream(spark, f"{folder}/predictions.parquet").select(whole_number(F.col("execution_id")).alias("execution_id"), "exported_at", F.when(F.col("actual_status").isNull(), "RUNNING").otherwise("ENDED").alias("status"))
    return st.run_available(st.fold_states(rows, "execution_id", "exported_at", "status"), "update", ["execution_id"])


@query("SELECT count(DISTINCT id) AS n_ids FROM predictions WHERE id IS NOT NULL")
def stream_once(spark, folder):
    """Distinct ids let through by deduplication within a long watermark, append mode."""
    rows = st.read_stream(spark, f"{folder}/predictions.parquet").where("id is not null").select("id", "exported_at")
    return st.run_available(st.once(rows, "id", "exported_at", "3650 days"), "append").agg(F.count("*").alias("n_ids"))


@query(r"""WITH o AS (SELECT try_cast(nullif(regexp_extract(execution_id, '^\s*0*([0-9]+?)(?:\.0)?\s*$', 1), '') AS BIGINT) AS eid, upper(trim(status)) AS status, exported_at FROM pipelines_list WHERE upper(trim(status)) IN ('FINISHED', 'FAILED', 'ERROR', 'CANCELLED')),
l AS (SELECT eid, arg_max(status, (exported_at, status)) AS status FROM o WHERE eid IS NOT NULL GROUP BY eid)
SELECT row_id, l.status AS actual_status FROM predictions p JOIN l ON l.eid = try_cast(nullif(regexp_extract(execution_id, '^\s*0*([0-9]+?)(?:\.0)?\s*$', 1), '') AS BIGINT)""")
def stream_resolve(spark, folder):
    """Predictions resolved as outcomes of their executions arrive; the latest final status counts."""
    outcomes = st.read_stream(spark, f"{folder}/pipelines_list.parquet").select(whole_number_long(F.col("execution_id")).alias("eid"), F.upper(F.trim("status")).alias("status"), "exported_at")
    outcomes = outcomes.where(F.col("eid").isNotNull() & F.col("status").isin("FINISHED", "FAILED", "ERROR", "CANCELLED"))
    last = outcomes.groupBy("eid").agg(F.max(F.struct("exported_at", "status")).alias("x")).select("eid", F.col("x.status").alias("actual_status"))
    resolved = st.run_available(last, "update", ["eid"])
    asked = table(spark, folder, "predictions").select("row_id", whole_number_long(F.col("execution_id")).alias("eid"))
    return asked.join(resolved, "eid").select("row_id", "actual_status")


@query("SELECT row_id, id, confidence FROM predictions WHERE id IS NOT NULL")
def stream_json(spark, folder):
    """Records of JSON lines taken in as a stream, append mode."""
    lines = work_folder(spark, "lines")
    table(spark, folder, "predictions").select("row_id", "id", "confidence").write.json(lines)
    return st.run_available(st.read_json_stream(spark, lines, "row_id bigint, id string, confidence int").where("id is not null"), "append")

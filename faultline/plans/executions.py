"""Execution analytics queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.operators import executions as ops
from faultline.sources.tables import table

_EID = r"try_cast(nullif(regexp_extract(execution_id, '^\s*0*([0-9]+?)(?:\.0)?\s*$', 1), '') AS BIGINT)"
_TEXT = "CASE WHEN lower(trim({0})) NOT IN ('', 'nan') THEN trim({0}) END"
#: The cleaned views as common table expressions.
VIEWS = f"""WITH runs AS (
  SELECT eid, program_id, pipeline_id, {_TEXT.format("pipeline_name")} AS pipeline_name, upper({_TEXT.format("status")}) AS status,
         CASE WHEN NOT isnan(duration_min) AND duration_min >= 0 THEN duration_min END AS duration, exported_at
  FROM (SELECT *, {_EID} AS eid, row_number() OVER (PARTITION BY {_EID} ORDER BY exported_at DESC NULLS LAST, row_id DESC) AS rn FROM pipelines_list)
  WHERE eid IS NOT NULL AND rn = 1),
steps AS (
  SELECT eid, CASE WHEN plain NOT IN ('', 'nan') THEN plain END AS step
  FROM (SELECT {_EID} AS eid, regexp_replace(lower(first_failed_step), '[^a-z0-9]', '', 'g') AS plain,
               row_number() OVER (PARTITION BY {_EID} ORDER BY exported_at DESC NULLS LAST, row_id DESC) AS rn FROM first_failed_steps)
  WHERE eid IS NOT NULL AND rn = 1),
shares AS (
  SELECT eid, share FROM (SELECT {_EID} AS eid, lower(trim(share_name)) AS share,
               row_number() OVER (PARTITION BY {_EID} ORDER BY exported_at DESC NULLS LAST, row_id DESC) AS rn FROM share_names WHERE trim(share_name) <> '')
  WHERE eid IS NOT NULL AND rn = 1),
failed AS (SELECT runs.*, steps.step FROM runs LEFT JOIN steps USING (eid) WHERE status IN ('FAILED', 'ERROR', 'CANCELLED'))
"""


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return ops.executions(table(spark, folder, "pipelines_list"))


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    return ops.failed_steps(table(spark, folder, "first_failed_steps"))


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    return ops.share_map(table(spark, folder, "share_names"))


def _failed(spark: SparkSession, folder: str) -> DataFrame:
    return ops.failed_executions(_runs(spark, folder), _steps(spark, folder))


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL after the common views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = VIEWS + sql
        return f

    return register


@query("SELECT eid, program_id, pipeline_id, pipeline_name, status, round(duration, 4) AS duration FROM runs")
def executions_latest(spark, folder):
    return _runs(spark, folder).select("eid", "program_id", "pipeline_id", "pipeline_name", "status", F.round("duration", 4).alias("duration"))


@query("SELECT eid, share FROM shares")
def share_map_last(spark, folder):
    return _shares(spark, folder)


@query("SELECT eid, pipeline_name, status, step FROM failed")
def failed_exec_join(spark, folder):
    return _failed(spark, folder).select("eid", "pipeline_name", "status", "step")


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'FINISHED') AS finished, count(*) FILTER (status IN ('FAILED', 'ERROR')) AS failed,
count(*) FILTER (status = 'CANCELLED') AS cancelled, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (status = 'FINISHED') / count(*), 1) ELSE 0.0 END AS success_rate FROM runs""")
def exec_summary(spark, folder):
    return ops.summary(_runs(spark, folder))


@query("SELECT pipeline_name, step, status, count(*) AS n FROM failed WHERE pipeline_name IS NOT NULL AND step IS NOT NULL GROUP BY ALL")
def failure_patterns(spark, folder):
    return ops.patterns(_failed(spark, folder))


@query("SELECT pipeline_name, step, status, count(*) AS n FROM failed WHERE pipeline_name IS NOT NULL AND step IS NOT NULL GROUP BY ALL ORDER BY n DESC, pipeline_name, step, status LIMIT 5")
def top_patterns(spark, folder):
    return failure_patterns(spark, folder).orderBy(F.desc("n"), "pipeline_name", "step", "status").limit(5)


@query("SELECT eid, pipeline_name FROM failed ANTI JOIN shares USING (eid)")
def missing_share_anti(spark, folder):
    return _failed(spark, folder).join(_shares(spark, folder), "eid", "left_anti").select("eid", "pipeline_name")


@query("SELECT eid, pipeline_name FROM failed SEMI JOIN shares USING (eid)")
def known_share_semi(spark, folder):
    return _failed(spark, folder).join(_shares(spark, folder), "eid", "left_semi").select("eid", "pipeline_name")


@query("SELECT eid, pipeline_name, status, round(duration, 4) AS duration FROM runs WHERE status = 'CANCELLED' AND duration > 120 ORDER BY runs.duration DESC, eid LIMIT 10")
def stuck_topk(spark, folder):
    stuck = _runs(spark, folder).where("status = 'CANCELLED' and duration > 120").orderBy(F.desc("duration"), "eid").limit(10)
    return stuck.select("eid", "pipeline_name", "status", F.round("duration", 4).alias("duration"))


@query("""SELECT step, CAST(sum(n) AS BIGINT) AS n FROM (SELECT step, count(*) AS n FROM failed WHERE step IS NOT NULL AND regexp_matches(pipeline_name, '(?i)prod') GROUP BY step
UNION ALL SELECT unnest(['build', 'codequality', 'deploy', 'loadtest', 'securitytest']), 0) GROUP BY step""")
def by_step_prod(spark, folder):
    return ops.counts_with_zeros(_failed(spark, folder).where(F.col("pipeline_name").rlike("(?i)prod")), "step", ops.STEPS)


@query("SELECT DISTINCT pipeline_id, pipeline_name FROM runs WHERE NOT regexp_matches(pipeline_name, '(?i)prod')")
def non_production(spark, folder):
    return _runs(spark, folder).where(~F.col("pipeline_name").rlike("(?i)prod")).select("pipeline_id", "pipeline_name").distinct()


@query("SELECT round(avg(duration), 4) AS mean_minutes, count(duration) AS n FROM runs WHERE status = 'FINISHED'")
def mean_success_duration(spark, folder):
    return _runs(spark, folder).where("status = 'FINISHED'").agg(F.round(F.avg("duration"), 4).alias("mean_minutes"), F.count("duration").alias("n"))


@query("SELECT round(coalesce(sum(duration), 0) / 60, 1) AS hours FROM runs WHERE status IN ('FAILED', 'ERROR')")
def wasted_hours(spark, folder):
    return _runs(spark, folder).where(F.col("status").isin("FAILED", "ERROR")).agg(F.round(F.coalesce(F.sum("duration"), F.lit(0.0)) / 60, 1).alias("hours"))


@query("""SELECT step, count(*) AS n, round(coalesce(sum(duration), 0), 2) AS minutes, round(coalesce(sum(duration), 0) / 60, 1) AS hours, round(avg(duration), 4) AS mean_minutes
FROM failed WHERE status IN ('FAILED', 'ERROR') GROUP BY step""")
def impact_per_step(spark, folder):
    total = F.coalesce(F.sum("duration"), F.lit(0.0))
    grouped = _failed(spark, folder).where(F.col("status").isin("FAILED", "ERROR")).groupBy("step")
    return grouped.agg(F.count("*").alias("n"), F.round(total, 2).alias("minutes"), F.round(total / 60, 1).alias("hours"), F.round(F.avg("duration"), 4).alias("mean_minutes"))


@query("SELECT CAST(exported_at AS DATE) AS day, status, count(*) AS n FROM runs GROUP BY ALL")
def daily_trend(spark, folder):
    return _runs(spark, folder).groupBy(F.to_date("exported_at").alias("day"), "status").agg(F.count("*").alias("n"))


@query("""SELECT strftime(exported_at, '%Y-%m') AS month, count(*) FILTER (status = 'FINISHED') AS finished, count(*) FILTER (status = 'FAILED') AS failed,
count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'CANCELLED') AS cancelled FROM runs GROUP BY 1""")
def monthly_pivot(spark, folder):
    pivot = _runs(spark, folder).groupBy(F.date_format("exported_at", "yyyy-MM").alias("month")).pivot("status", ["FINISHED", "FAILED", "ERROR", "CANCELLED"]).agg(F.count(F.lit(1)))
    return pivot.select("month", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("FINISHED", "FAILED", "ERROR", "CANCELLED")])


@query("SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM runs WHERE status IS NOT NULL GROUP BY status")
def status_share(spark, folder):
    counts = _runs(spark, folder).where("status is not null").groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("SELECT step, count(*) AS n, max(count(*)) OVER () AS largest FROM failed WHERE step IS NOT NULL GROUP BY step")
def step_scale(spark, folder):
    counts = _failed(spark, folder).where("step is not null").groupBy("step").agg(F.count("*").alias("n"))
    return counts.withColumn("largest", F.max("n").over(Window.partitionBy()))


@query("""SELECT pipeline_id, step, n FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY n DESC, step) AS r FROM (
SELECT pipeline_id, step, count(*) AS n FROM failed WHERE step IS NOT NULL AND pipeline_id IS NOT NULL GROUP BY pipeline_id, step)) WHERE r = 1""")
def dominant_step(spark, folder):
    counts = _failed(spark, folder).where("step is not null and pipeline_id is not null").groupBy("pipeline_id", "step").agg(F.count("*").alias("n"))
    return ops.top_per_group(counts, "pipeline_id", [F.desc("n"), F.col("step")], 1).select("pipeline_id", "step", "n")


_ACTIVE = "SELECT * FROM runs WHERE status IN ('FAILED', 'ERROR', 'FINISHED') AND pipeline_id IS NOT NULL"


@query(f""", active AS ({_ACTIVE}), ok AS (SELECT pipeline_id, max(eid) FILTER (status = 'FINISHED') AS broken FROM active GROUP BY 1)
SELECT pipeline_id, count(*) FILTER (broken IS NULL OR eid > broken) AS n_leading FROM active JOIN ok USING (pipeline_id) GROUP BY 1""")
def consecutive_failures(spark, folder):
    active = _runs(spark, folder).where(F.col("status").isin("FAILED", "ERROR", "FINISHED") & F.col("pipeline_id").isNotNull())
    return ops.leading_run(active, "pipeline_id", "eid", F.col("status") == "FINISHED")


@query("""SELECT pipeline_id, CAST(date_diff('hour', max(exported_at) FILTER (status = 'FINISHED'), (SELECT max(exported_at) FROM runs)) AS BIGINT) AS hours FROM runs
WHERE pipeline_id IS NOT NULL GROUP BY pipeline_id HAVING count(*) FILTER (status = 'FINISHED') > 0""")
def hours_since_success(spark, folder):
    runs = _runs(spark, folder)
    # Whole clock hours between the two, as date_diff counts them.
    hour = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(3_600_000_000))
    per = runs.where("pipeline_id is not null").groupBy("pipeline_id").agg(F.max(F.when(F.col("status") == "FINISHED", F.col("exported_at"))).alias("ok")).where("ok is not null")
    now = runs.agg(F.max("exported_at").alias("now"))
    return per.join(F.broadcast(now)).select("pipeline_id", (hour(F.col("now")) - hour(F.col("ok"))).alias("hours"))


@query("SELECT step, eid, pipeline_name FROM (SELECT step, eid, pipeline_name, row_number() OVER (PARTITION BY step ORDER BY eid) AS r FROM failed WHERE step IS NOT NULL) WHERE r = 1")
def first_failure_per_step(spark, folder):
    return ops.top_per_group(_failed(spark, folder).where("step is not null"), "step", [F.col("eid")], 1).select("step", "eid", "pipeline_name")


@query("""SELECT step, rank, eid FROM (SELECT step, eid, CAST(row_number() OVER (PARTITION BY step ORDER BY duration DESC NULLS LAST, eid) AS BIGINT) AS rank
FROM failed WHERE step IS NOT NULL) WHERE rank <= 2""")
def top2_per_step(spark, folder):
    top = ops.top_per_group(_failed(spark, folder).where("step is not null"), "step", [F.desc_nulls_last("duration"), F.col("eid")], 2)
    return top.select("step", F.col("rank").cast("bigint").alias("rank"), "eid")


@query("SELECT eid, pipeline_name, status, step FROM failed ORDER BY exported_at DESC, eid DESC LIMIT 20")
def recent_failures(spark, folder):
    return _failed(spark, folder).orderBy(F.desc("exported_at"), F.desc("eid")).limit(20).select("eid", "pipeline_name", "status", "step")


@query("SELECT pipeline_name, count(*) AS n FROM runs WHERE pipeline_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, pipeline_name LIMIT 1")
def target_pipeline(spark, folder):
    return _runs(spark, folder).where("pipeline_name is not null").groupBy("pipeline_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pipeline_name").limit(1)


@query("""SELECT max(status) FILTER (eid = 10000003) AS status_a, round(max(duration) FILTER (eid = 10000003), 4) AS duration_a, max(status) FILTER (eid = 10000008) AS status_b,
round(max(duration) FILTER (eid = 10000008), 4) AS duration_b, round(coalesce(max(duration) FILTER (eid = 10000008), 0) - coalesce(max(duration) FILTER (eid = 10000003), 0), 4) AS delta
FROM runs WHERE eid IN (10000003, 10000008)""")
def compare_executions(spark, folder):
    pair = ops.compare_pair(_runs(spark, folder), 10000003, 10000008)
    return pair.withColumns({c: F.round(c, 4) for c in ("duration_a", "duration_b")})


@query(f"""SELECT {_EID} AS eid, min(exported_at) AS first_seen, max(exported_at) AS last_seen, count(*) AS n_rows,
array_to_string(list_sort(list(DISTINCT upper(trim(status))) FILTER (trim(status) <> '')), ',') AS statuses FROM pipelines_list WHERE {_EID} IS NOT NULL GROUP BY 1""")
def fold_events(spark, folder):
    rows = table(spark, folder, "pipelines_list").withColumn("eid", ops.whole_number_long(F.col("execution_id"))).where("eid is not null")
    status = F.when(F.trim("status") != "", F.upper(F.trim("status")))
    joined = F.concat_ws(",", F.sort_array(F.collect_set(status)))
    return rows.groupBy("eid").agg(F.min("exported_at").alias("first_seen"), F.max("exported_at").alias("last_seen"), F.count("*").alias("n_rows"), F.when(joined != "", joined).alias("statuses"))


@query("""SELECT module, CAST(sum(w) AS BIGINT) AS weight FROM (
SELECT module, count(*) AS w FROM parsed_logs WHERE module <> '' GROUP BY 1
UNION ALL SELECT 'dispatcher', count(*) FROM parsed_logs WHERE error_type IN ('missing_env_variable', 'apache_config_syntax_error')
UNION ALL SELECT 'ui.frontend', CAST(floor(n / 2) AS BIGINT) FROM (SELECT count(*) AS n FROM failed WHERE step = 'build' GROUP BY pipeline_name, status)) GROUP BY module""")
def by_module_weighted(spark, folder):
    logs = table(spark, folder, "parsed_logs")
    own = logs.where("module <> ''").groupBy("module").agg(F.count("*").alias("w"))
    deploy = logs.where(F.col("error_type").isin("missing_env_variable", "apache_config_syntax_error")).agg(F.count("*").alias("w")).select(F.lit("dispatcher").alias("module"), "w")
    build = _failed(spark, folder).where("step = 'build'").groupBy("pipeline_name", "status").agg(F.floor(F.count("*") / 2).alias("w")).select(F.lit("ui.frontend").alias("module"), "w")
    return own.unionByName(deploy).unionByName(build).groupBy("module").agg(F.sum("w").alias("weight"))


SQL["asof_purchase"] = """SELECT e.event_id, e.user_id, p.event_id AS found_event_id, round(p.value, 4) AS found_value
FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (
  SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
ON e.user_id = p.user_id AND e.ts >= p.ts"""


@query()
def asof_purchase(spark, folder):
    events = table(spark, folder, "events")
    asked = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    found = ops.as_of(asked, events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "ts", ["event_id", "value"], "event_id")
    return found.select("event_id", "user_id", "found_event_id", F.round("found_value", 4).alias("found_value"))


SQL["props_json"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


@query()
def props_json(spark, folder):
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


QUERIES = dict(QUERIES)

"""Execution analytics: cleaning, joins, aggregates and windows over pipeline history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number_long

#: The statuses that count as failed.
FAILED = ["FAILED", "ERROR", "CANCELLED"]
STEPS = ["build", "codequality", "deploy", "loadtest", "securitytest"]


def latest_by_key(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: that with the greatest ``order`` columns, NULLs least.  NULL keys are dropped.

    An aggregate, not a window: it combines before the shuffle, so a key with
    a third of all rows costs one row a task.
    """
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_x")).select(key, "_x.*")


def blank_to_null(value: Column) -> Column:
    """NULL for NULL, blank and 'nan' in any case, else the trimmed text."""
    text = F.trim(value)
    return F.when(~F.lower(text).isin("", "nan"), text)


def clean_duration(value: Column) -> Column:
    """Minutes, or NULL for NULL, NaN and negative."""
    minutes = value.try_cast("double")
    return F.when(~F.isnan(minutes) & (minutes >= 0), minutes)


def zone_stripped(value: Column) -> Column:
    """A time with its zone name cut off and the rest read as UTC (a coarse reading; ``timenorm`` has the exact one); NULL if it is no time."""
    bare = F.regexp_replace(value, r"\s*(PDT|PST|UTC|GMT)$", "")
    return F.concat(bare, F.lit("Z")).try_cast("timestamp")


def duration_minutes(start: Column, end: Column, running: Column, now: Column) -> Column:
    """Minutes from start to end, for running ones to ``now``, with two decimals."""
    return F.round((F.unix_micros(F.when(F.coalesce(running, F.lit(False)), now).otherwise(end)) - F.unix_micros(start)) / 60_000_000, 2)


def executions(exported: DataFrame) -> DataFrame:
    """One row per execution id from its latest export: eid, program_id, pipeline_id, pipeline_name, status, duration, exported_at."""
    keyed = exported.withColumn("eid", whole_number_long(F.col("execution_id")))
    last = latest_by_key(keyed, "eid", ["exported_at", "row_id"], ["program_id", "pipeline_id", "pipeline_name", "status", "duration_min", "exported_at"])
    return last.select(
        "eid", "program_id", "pipeline_id", blank_to_null(F.col("pipeline_name")).alias("pipeline_name"),
        F.upper(blank_to_null(F.col("status"))).alias("status"), clean_duration(F.col("duration_min")).alias("duration"), "exported_at",
    )


def failed_steps(exported: DataFrame) -> DataFrame:
    """One row per execution id: eid and its latest first-failed step, lower-case letters and digits, NULL if none is given."""
    keyed = exported.withColumn("eid", whole_number_long(F.col("execution_id")))
    last = latest_by_key(keyed, "eid", ["exported_at", "row_id"], ["first_failed_step"])
    plain = F.regexp_replace(F.lower("first_failed_step"), "[^a-z0-9]", "")
    return last.select("eid", F.when(~plain.isin("", "nan"), plain).alias("step"))


def share_map(exported: DataFrame) -> DataFrame:
    """One row per execution id that has a share: eid and the lower-case share name of its latest non-blank row."""
    keyed = exported.withColumns({"eid": whole_number_long(F.col("execution_id")), "share": F.lower(F.trim("share_name"))}).where("share <> ''")
    return latest_by_key(keyed, "eid", ["exported_at", "row_id"], ["share"])


def failed_executions(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Executions with a failed status and their step, NULL without one (left equi join on the key)."""
    return runs.where(F.col("status").isin(FAILED)).join(steps, "eid", "left")


def summary(runs: DataFrame) -> DataFrame:
    """One row: total, finished, failed, cancelled and the success rate in percent (0.0 if there are none)."""
    total, finished = F.count("*"), F.count_if(F.col("status") == "FINISHED")
    rate = F.when(total > 0, F.round(100 * finished / F.greatest(total, F.lit(1)), 1)).otherwise(0.0)
    return runs.agg(total.alias("total"), finished.alias("finished"), F.count_if(F.col("status").isin("FAILED", "ERROR")).alias("failed"), F.count_if(F.col("status") == "CANCELLED").alias("cancelled"), rate.alias("success_rate"))


def patterns(failed: DataFrame) -> DataFrame:
    """Failures counted by pipeline name, step and status; rows without a name or step do not count."""
    return failed.where("pipeline_name is not null and step is not null").groupBy("pipeline_name", "step", "status").agg(F.count("*").alias("n"))


def counts_with_zeros(rows: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Counts per value of ``column``; every value of ``known`` appears, with 0 if it must."""
    zeros = rows.sparkSession.createDataFrame([(k, 0) for k in known], f"{column} string, n bigint")
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).unionByName(zeros).groupBy(column).agg(F.sum("n").alias("n"))


def top_per_group(rows: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.  ``order`` must be total for a defined result.

    The rank filter is pushed into a partial limit before the shuffle
    (``WindowGroupLimit``), so a group with a third of all rows sends at most
    ``k`` rows a task.
    """
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")


def leading_run(rows: DataFrame, key: str, order: str, breaks: Column) -> DataFrame:
    """Per key how many of its newest rows precede the newest one where ``breaks`` holds (all of them if none does).

    Two aggregates instead of a window over the whole history: the newest
    break by key, then the rows after it.  Equal orders count as not after.
    """
    newest = rows.groupBy(key).agg(F.max(F.when(breaks, F.col(order))).alias("_broken"))
    joined = rows.join(newest, key)
    return joined.groupBy(key).agg(F.count_if(F.col("_broken").isNull() | (F.col(order) > F.col("_broken"))).alias("n_leading"))


def compare_pair(runs: DataFrame, a: int, b: int) -> DataFrame:
    """Two executions side by side: statuses, durations and the difference of durations (NULL counts as 0).

    One row; the side of an unknown id is NULL.
    """
    pick = lambda eid, c: F.max(F.when(F.col("eid") == eid, F.col(c)))
    chosen = runs.where(F.col("eid").isin(a, b)).agg(*[pick(i, c).alias(f"{c}_{n}") for n, i in (("a", a), ("b", b)) for c in ("status", "duration")])
    return chosen.withColumn("delta", F.round(F.coalesce("duration_b", F.lit(0.0)) - F.coalesce("duration_a", F.lit(0.0)), 4))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], tie: str) -> DataFrame:
    """Each left row with ``columns`` (as ``found_...``) of the newest right row of its key not after it; NULL if there is none.

    Equal right times: the greatest ``tie`` wins.  Left rows with a NULL key or
    time find nothing; right ones are never found.

    Both sides are stacked per key and bucket of time (a day, or 86400 units of
    a number) and the last right row is carried forward inside the bucket; the
    last right row of earlier buckets comes from a summary of one row per key
    and bucket.  So a key with a third of all rows is spread over its buckets.
    """
    stamp = "timestamp" in dict(left.dtypes)[left_time]
    bucket = (lambda c: F.to_date(c)) if stamp else (lambda c: F.floor(c / F.lit(86400)))
    hit = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.col(tie).cast("bigint").alias("_tie"), F.struct(*columns).alias("_hit")).where("_k is not null and _t is not null").withColumn("_b", bucket(F.col("_t")))
    kind, row = hit.schema["_hit"].dataType, left.select(F.struct("*").alias("r")).schema["r"].dataType
    asked = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(None).cast("bigint").alias("_tie"), F.lit(None).cast(kind).alias("_hit"), bucket(F.col(left_time)).alias("_b"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    stacked = hit.withColumns({"_side": F.lit(0), "_row": F.lit(None).cast(row)}).unionByName(asked)
    last = hit.groupBy("_k", "_b").agg(F.max_by("_hit", F.struct("_t", "_tie")).alias("_last"))
    # Buckets that only the left side has need a summary row too.
    marks = asked.select("_k", "_b").distinct().join(last, ["_k", "_b"], "full")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_k", "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn("_found", F.last("_hit", ignorenulls=True).over(inside)).where("_side = 1").join(carried, ["_k", "_b"], "left")
    answer = F.when(F.col("_t").isNotNull(), F.coalesce("_found", "_carried"))
    return found.withColumn("_answer", answer).select("_row.*", *[F.col(f"_answer.{c}").alias(f"found_{c}") for c in columns])


def success_logs(runs: DataFrame, logs: DataFrame, pipeline: str, execution: str, started: str, step: str, log_id: str, text: str, newest: int = 9, keep: int = 3, shortest: int = 50) -> DataFrame:
    """(pipeline, step, log_id, text): per pipeline and step the last ``keep`` usable logs among the ``newest`` finished executions of the pipeline.

    ``runs``: one row per execution with pipeline, execution, started, status.
    Usable is a log of more than ``shortest`` characters.  The newest start
    comes first, unknown starts last, ties go to the greater execution and then
    the smaller log.  Executions without a log of the step use up the
    ``newest``.  NULL pipelines, executions and steps have none.
    """
    order = [F.desc_nulls_last(started), F.desc(execution)]
    finished = runs.where((F.col("status") == "FINISHED") & F.col(pipeline).isNotNull()).select(pipeline, execution, started)
    last = top_per_group(finished, pipeline, order, newest).drop("rank")
    usable = logs.where((F.length(text) > shortest) & F.col(step).isNotNull()).select(execution, step, log_id, text)
    return top_per_group(last.join(usable, execution), [pipeline, step], [*order, F.col(log_id)], keep).select(pipeline, step, log_id, text)

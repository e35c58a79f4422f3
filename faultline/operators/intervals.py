"""Problem 2: overlapping and gapped intervals per entity to continuous periods and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut_lineage

DAY_MICROS = 86_400_000_000


def merge_intervals(rows: DataFrame, entity: str, start: str, end: str, bucket_micros: int = DAY_MICROS) -> DataFrame:
    """Rows (entity, kind, start_micros, end_micros): maximal covered stretches ('period') and what lies between them ('gap').

    ``start`` and ``end`` are micros (BIGINT).  Intervals are closed: they
    merge if the next start is not after the latest end so far, so touching
    and zero-length intervals count.  Rows with a NULL entity, start or end,
    or an end before the start, are left out; repeated rows change nothing;
    an entity with one interval gives one period and no gap.

    Method: ``session_window`` with the row's own duration merges within
    (entity, bucket of the start).  Only the few merged stretches of each
    bucket are then joined up across buckets, so an entity with a third of all
    rows is spread over its buckets and no task or array holds all of it.
    Session windows drop empty sessions, so time runs at two ticks a
    microsecond: an empty interval gets one tick, which can touch nothing
    that it should not.

    Action: the merged stretches (four numbers each) go to the checkpoint
    folder, since three branches read them and times may be dear to parse.
    """
    valid = rows.select(F.col(entity).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("k is not null and s is not null and e >= s")
    ticks = F.greatest((F.col("e") - F.col("s")) * 2, F.lit(1))
    session = F.session_window(F.timestamp_micros(F.col("s") * 2), F.make_interval(secs=(ticks / F.lit(1_000_000)).cast("decimal(18,6)")))
    bucketed = valid.withColumn("b", F.floor(F.col("s") / F.lit(bucket_micros)))
    merged = bucketed.groupBy("k", "b", session).agg(F.min("s").alias("s"), F.max("e").alias("e")).select("k", "b", "s", "e")
    merged = cut_lineage(merged)

    # What earlier buckets of the entity reach, one row per bucket.
    over_buckets = Window.partitionBy("k").orderBy("b")
    reach = merged.groupBy("k", "b").agg(F.max("e").alias("top")).select("k", "b", F.max("top").over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    in_bucket = Window.partitionBy("k", "b").orderBy("s", "e")
    stretches = merged.join(reach, ["k", "b"])
    opens = F.col("s") > F.coalesce(F.greatest(F.col("carried"), F.max("e").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))), F.lit(-(2**63)))
    numbered = stretches.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("k", "b", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))

    # Island 0 belongs to the last island of an earlier bucket.
    buckets = islands.groupBy("k", "b").agg(F.max(F.when(F.col("island") == 0, F.col("e"))).alias("absorbed"), F.min(F.when(F.col("island") > 0, F.col("s"))).alias("opening"), F.max("island").alias("last"))
    ordinal = F.sum((F.col("last") > 0).cast("int")).over(over_buckets.rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("owner", F.coalesce(ordinal, F.lit(0)))
    extension = buckets.groupBy("k", "owner").agg(F.max("absorbed").alias("extended"), F.min("opening").alias("next_opening"))
    own = buckets.where("last > 0").select("k", "b", "last", (F.col("owner") + 1).alias("owner")).join(extension, ["k", "owner"], "left").select("k", "b", "last", "extended", "next_opening")
    ends = islands.where("island > 0").join(own, ["k", "b"])
    final = F.col("island") == F.col("last")
    periods = ends.select(
        "k", "s",
        F.when(final, F.greatest("e", "extended")).otherwise(F.col("e")).alias("e"),
        F.when(final, F.col("next_opening")).otherwise(F.lead("s").over(Window.partitionBy("k", "b").orderBy("s"))).alias("following"),
    )
    out = F.array(F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("z")), F.struct(F.lit("gap").alias("kind"), F.col("e").alias("a"), F.col("following").alias("z")))
    tall = periods.select("k", F.explode(F.filter(out, lambda x: x["z"].isNotNull())).alias("x"))
    return tall.select(F.col("k").alias(entity), F.col("x.kind").alias("kind"), F.col("x.a").alias("start_micros"), F.col("x.z").alias("end_micros"))

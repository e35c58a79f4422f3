"""Snapshots, append-once stores and report sinks on Parquet and JSON folders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_snapshot(rows: DataFrame, path: str, written_at: int, partition_by: Sequence[str] = ()) -> None:
    """Replace the snapshot at ``path``; ``written_at`` is its time in epoch seconds."""
    rows.withColumn("_written_at", F.lit(written_at).cast("bigint")).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_fresh(spark: SparkSession, path: str, now: int, ttl: int) -> DataFrame | None:
    """The snapshot at ``path`` if its age is under ``ttl`` seconds, else None.  Reads one row group's statistics, not the data."""
    if not _exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    written = rows.agg(F.max("_written_at")).first()[0]
    return rows.drop("_written_at") if written is not None and now - written < ttl else None


def resolve(spark: SparkSession, path: str, now: int, ttl: int, live: Callable[[], DataFrame | None], fallback: Callable[[], DataFrame]) -> DataFrame:
    """Fresh snapshot, else the live source (which becomes the snapshot), else the stale snapshot, else the fallback."""
    if (fresh := read_fresh(spark, path, now, ttl)) is not None:
        return fresh
    if (rows := live()) is not None:
        write_snapshot(rows, path, now)
        return spark.read.parquet(path).drop("_written_at")
    return spark.read.parquet(path).drop("_written_at") if _exists(spark, path) else fallback()


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the store lacks, one row a key (an anti join on keys alone)."""
    spark = rows.sparkSession
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str, key: str, version: str) -> None:
    """Append a version of each row; ``latest`` reads the newest, so no reader ever sees a half-replaced store."""
    rows.withColumn("_version", F.col(version)).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest version of each key of an ``upsert`` store."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (key, "_version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_version").alias("x")).select(key, "x.*")


def purge(spark: SparkSession, path: str, to: str, unwanted) -> int:
    """Write the rows of ``path`` that are not ``unwanted`` (NULL counts as wanted) to ``to``; how many were left out."""
    rows = spark.read.parquet(path)
    hit = F.coalesce(unwanted, F.lit(False))
    rows.where(~hit).write.mode("overwrite").parquet(to)
    return rows.where(hit).count()


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def write_markdown(rows: DataFrame, path: str, title: str, most: int = 10_000) -> None:
    """A Markdown table of a small report; more than ``most`` rows are an error (use ``write_json`` for data)."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    body = "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)
    rows.sparkSession.createDataFrame([(head + body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def info(spark: SparkSession, path: str, now: int) -> DataFrame:
    """One row (n_rows, written_at, age) of the snapshot at ``path``; no row without one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "n_rows bigint, written_at bigint, age bigint")
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.max("_written_at").alias("written_at")).withColumn("age", F.lit(now).cast("bigint") - F.col("written_at"))


def clear(spark: SparkSession, path: str) -> bool:
    """Delete the snapshot at ``path``; whether there was one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

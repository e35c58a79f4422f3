"""Structured Streaming forms of the incremental parts: trend, folding, deduplication, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import work_folder


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder, or a single file, as a stream with the schema it has now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a folder as a stream; lines that are no JSON objects give NULLs."""
    return spark.readStream.schema(schema).json(path)


def trend(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, kind, n): events per tumbling window.

    In update and append mode, windows older than ``late`` are closed: their
    state is let go and events for them are dropped.  (Complete mode keeps all.)
    """
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def fold_states(events: DataFrame, key: str, time: str, status: str) -> DataFrame:
    """(key, first_seen, last_seen, status): start and end events folded to one row a key; the status is the latest."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.max_by(status, time).alias("status"))


def once(events: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """Each key's first event; repeats within ``late`` are dropped and state is let go."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def run_available(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all there is into the shared folder and read it back.

    With ``keys``, the last row of each key counts (update mode); without, all
    rows do (append mode), or those of the last batch (complete mode).  Each
    batch is written to its own folder, so a repeated batch replaces itself,
    and nothing goes through the driver.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run_batches(stream, write, f"{folder}/state", mode)
    try:
        rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    except AnalysisException:
        return spark.createDataFrame([], stream.schema)
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*").select(*stream.columns)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run a stream over all there is, each batch handed to ``write``; restarts go on from ``checkpoint``."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

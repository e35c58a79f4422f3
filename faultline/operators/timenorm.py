"""Problem 1: mixed timestamp formats and time zones to UTC instants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number
from faultline.functions.instants import add_utc_micros, zone_lookup


def with_zones(rows: DataFrame, program_key: str, programs: DataFrame, key: str = "program_id", zone: str = "zone_name") -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with ``_zone_name`` and ``_abbreviations`` of their program; rows without a known program keep NULL.

    The lookup is joined with an ordinary left join: Catalyst broadcasts it
    only while its size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    lookup, unique = zone_lookup(programs, key, zone)
    lookup = lookup.select(F.col("_zone_key").cast("string").alias("_zone_key"), F.col("zone_name").alias("_zone_name"), F.col("abbreviations").alias("_abbreviations"))
    keyed = rows.withColumn("_zone_key", whole_number(F.col(program_key).cast("string")))
    return keyed.join(lookup, "_zone_key", "left").drop("_zone_key"), unique


def normalise_times(
    rows: DataFrame,
    fields: Sequence[str],
    program_key: str,
    programs: DataFrame,
    row_key: str = "row_id",
    ambiguous: str = "earlier",
    nonexistent: str = "null",
) -> DataFrame:
    """One row (row_key, field_name, value, utc_micros) per field and input row; ``utc_micros`` is NULL where no instant is denoted.

    Reads the table once however many fields there are.  Rows repeat if the
    input repeats; an empty input gives an empty result; columns beyond those
    named are ignored, whatever they are called.
    """
    zoned, unique = with_zones(rows.select(F.col(row_key).alias("row_id"), F.col(program_key).alias("_program"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]), "_program", programs)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_f{i}").cast("string").alias("value")) for i, f in enumerate(fields)])
    tall = zoned.select("row_id", "_zone_name", "_abbreviations", F.explode(pairs).alias("p")).select("row_id", "_zone_name", "_abbreviations", "p.field_name", "p.value")
    out = add_utc_micros(tall, "value", "_zone_name", "_abbreviations", "utc_micros", unique, ambiguous, nonexistent)
    return out.select("row_id", "field_name", "value", "utc_micros")

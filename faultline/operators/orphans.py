"""Problem 4: references to records that do not exist, or did not yet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.ids import whole_number
from faultline.functions.instants import clock_micros

#: Keys of one range share all but their last digits; a range holds this many codes.
RANGE_DIGITS = 4
RANGE_CODES = 10**RANGE_DIGITS
#: Up to this many codes, a sorted array of 16-bit codes is smaller than the bit set.
_ARRAY_LIMIT = RANGE_CODES // 16


def pack_codes(codes: np.ndarray) -> bytes:
    """A compressed bitmap over one key range: a sorted array of codes while sparse, else a bit set."""
    codes = np.unique(np.asarray(codes, dtype=np.uint16))
    if len(codes) <= _ARRAY_LIMIT:
        return b"A" + codes.tobytes()
    bits = np.zeros(RANGE_CODES, dtype=np.uint8)
    bits[codes] = 1
    return b"B" + np.packbits(bits).tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    """The bit set of a compressed bitmap, as booleans."""
    bits = np.zeros(RANGE_CODES, dtype=bool)
    if packed[:1] == b"A":
        bits[np.frombuffer(packed, dtype=np.uint16, offset=1)] = True
    else:
        bits[:] = np.unpackbits(np.frombuffer(packed, dtype=np.uint8, offset=1), count=RANGE_CODES).astype(bool)
    return bits


@F.pandas_udf(T.BinaryType())
def _pack(codes: pd.Series) -> pd.Series:
    return codes.map(pack_codes)


def key_range(key: Column) -> Column:
    """All but the last digits of a canonical key; '' for short keys."""
    return F.substring(key, F.lit(1), F.greatest(F.length(key) - RANGE_DIGITS, F.lit(0)))


def key_code(key: Column) -> Column:
    """The key's place in its range."""
    return F.substring(key, -RANGE_DIGITS, RANGE_DIGITS).cast("int")


def _and_not(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per key range and bitmap of references (table, period): the codes left after AND-NOT with the parents that came in earlier periods."""
    for batch in batches:
        heads, codes, known = [], [], []
        for span, references, parents in zip(batch["span"], batch["refs"], batch["parents"], strict=True):
            # The range's parent bitmaps laid over one another, earliest last: each code's first period.
            first = np.full(RANGE_CODES, np.iinfo(np.int64).max)
            for parent in sorted(parents if parents is not None else (), key=lambda p: -p["period"]):
                first[unpack_bits(parent["bitmap"])] = parent["period"]
            for r in references:
                left = np.flatnonzero(unpack_bits(r["bitmap"]) & ~(first < r["period"]))
                heads += [(r["table_name"], span, r["period"])] * len(left)
                codes.append(left)
                known.append(first[left] < np.iinfo(np.int64).max)
        if heads:
            out = pd.DataFrame(heads, columns=["table_name", "span", "period"])
            yield out.assign(code=np.concatenate(codes), known=np.concatenate(known))


def orphan_references(references: DataFrame, parents: DataFrame, period_format: str = "yyyy-MM") -> DataFrame:
    """Rows (table_name, row_id, kind, period) for each reference whose key has no parent ('missing') or none until later ('late').

    ``references``: table_name, row_id, execution_id, exported_at.  ``parents``:
    execution_id, exported_at.  Keys are whole numbers in any spelling; a
    reference whose key is NULL or none is no reference.  A parent row with the
    same time as the reference is not late.  A NULL ``exported_at`` of a
    reference gives a NULL period and can only be missing; a parent row with a
    NULL time exists but has never arrived, so references to it alone are late.
    Empty parents make every reference missing.

    Method: a key is encoded as (key range, 14-bit code); references become one
    compressed bitmap per table, range and day, parents one per range and day
    of first arrival.  References AND-NOT earlier parents leaves the few codes
    that are missing, late or of the same day; those are decoded and joined
    back, where the times of same-day parents are compared exactly.  Sets are
    built by aggregates that combine before the shuffle and hold at most
    ``RANGE_CODES`` codes a group, so a key or range with a third of all rows
    shrinks to one code a task; the join back is an equi-join that AQE splits
    on skew.
    """
    far = F.lit(2**62).cast("bigint")
    day = lambda c: F.coalesce(F.floor(c / F.lit(86_400_000_000)), F.lit(2**40)).cast("bigint")

    # The last filter is what the joins below would infer, each for its side only; stated for all, branches can share an exchange.
    def coded(rows: DataFrame, *extra: Column) -> DataFrame:
        keyed = rows.select(*extra, whole_number(F.col("execution_id").cast("string")).alias("key"), clock_micros(rows, "exported_at").alias("us")).where("key is not null")
        return keyed.withColumns({"span": key_range(F.col("key")), "code": key_code(F.col("key"))}).drop("key").where("span is not null and code is not null")

    refs = coded(references, F.col("table_name"), F.col("row_id"), F.date_format("exported_at", period_format).alias("label")).withColumn("period", day(F.col("us")))
    first = coded(parents).groupBy("span", "code").agg(F.min(F.coalesce("us", far)).alias("first_us"))

    # One row a range on each side: lists of bitmaps, at most one per table and period, so nothing is repeated in the join.
    ref_maps = refs.groupBy("table_name", "span", "period").agg(F.collect_set("code").alias("codes")).select("span", F.struct("table_name", "period", _pack("codes").alias("bitmap")).alias("r"))
    parent_maps = first.withColumn("period", day(F.col("first_us"))).groupBy("span", "period").agg(F.collect_set("code").alias("codes")).select("span", F.struct("period", _pack("codes").alias("bitmap")).alias("p"))
    pairs = ref_maps.groupBy("span").agg(F.collect_list("r").alias("refs")).join(parent_maps.groupBy("span").agg(F.collect_list("p").alias("parents")), "span", "left")
    # Compressed bitmaps are so small that AQE would put all of them into one task; a stated number of partitions is kept.
    tasks = int(references.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = pairs.repartition(tasks, "span").mapInPandas(_and_not, "table_name string, span string, period bigint, code int, known boolean")

    decoded = left.join(first, ["span", "code"], "left").select("table_name", "span", "code", "period", "known", "first_us")
    found = refs.join(decoded, ["table_name", "span", "code", "period"]).where(~F.col("known") | (F.col("first_us") > F.coalesce("us", far)))
    return found.select("table_name", "row_id", F.when(F.col("known"), "late").otherwise("missing").alias("kind"), F.col("label").alias("period"))

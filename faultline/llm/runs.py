"""Problem 3: runs of equal consecutive events to one record each.

Method: each event becomes one Unicode code point, the events of an entity in
order become one string, and a backreference pattern finds its repetitions;
match spans lead back to the events' positions and times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One symbol and its repetitions.
RUN = re.compile(r"(.)\1*", re.DOTALL)
#: Code points from here to 0x10FFFF hold no surrogates, so each is one character.
FIRST_CODE_POINT = 0x10000
#: Order values of one chunk differ by less than this; a chunk is what one task reads in order.
CHUNK_WIDTH = 1 << 20


def canonical_word(value: Column, vocabulary: Sequence[str]) -> Column:
    """Lower-case letters and digits of ``value``, one slip away from a vocabulary word set right; NULL for NULL, blank or 'nan'.

    A slip is one character lost, added or changed, or two neighbours swapped.
    Words that match none stay as they are.  Vocabulary words are more than
    two slips apart from one another, so at most one can match.
    """
    plain = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
    words = {re.sub(r"[\W_]", "", w.lower()): w for w in vocabulary}
    out = F.when(plain.isNull() | plain.isin("", "nan"), F.lit(None).cast("string")).when(plain.isin(list(words)), plain)
    for word in words:
        swapped = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})
        out = out.when(plain.isin(swapped) | (F.levenshtein(plain, F.lit(word), 1) >= 0), F.lit(word))
    return out.otherwise(plain)


def _runs_of_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of each stretch of rows of one entity and chunk in a batch; ``edge`` marks those that may go on outside it."""
    for batch in batches:
        if batch.empty:
            continue
        change = (batch["entity"] != batch["entity"].shift()) | (batch["chunk"] != batch["chunk"].shift())
        starts = [*change.to_numpy().nonzero()[0], len(batch)]
        codes, events = pd.factorize(batch["event"])
        text = "".join(map(chr, codes + FIRST_CODE_POINT))
        entity, order, first_at, last_at = (batch[c].to_numpy() for c in ("entity", "pos", "begins", "ends"))
        out = []
        for a, z in zip(starts, starts[1:], strict=False):
            for match in RUN.finditer(text[a:z]):
                i, j = match.start() + a, match.end() + a - 1
                out.append((entity[a], events[codes[i]], order[i], order[j], j - i + 1, first_at[i], last_at[j], order[a], i == a or j == z - 1))
        yield pd.DataFrame(out, columns=["entity", "event", "first_pos", "last_pos", "n", "begins", "ends", "piece", "edge"]).astype({"begins": "Int64", "ends": "Int64"})


def collapse_runs(events: DataFrame, entity: str, order: str, event: str, begins: str | None = None, ends: str | None = None, least: int = 2, chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Rows (entity, event, first_pos, last_pos, n, begins, ends, duration) for each maximal run of at least ``least`` equal events.

    ``order`` is a BIGINT, unique within an entity (repeated values give runs
    in an undefined order among themselves).  ``begins`` and ``ends`` are
    optional times in micros: a run begins with its first event and ends with
    its last; the duration is NULL if either is.  Rows with a NULL entity,
    order or event are left out.  An empty input gives an empty result.

    An entity is cut into chunks of its order values, so one with a third of
    all rows is spread over its chunks; within a task rows arrive in sorted
    Arrow batches and a batch boundary only makes one more piece.  Runs at the
    edge of a piece, at most two a piece, are then stitched with a window.
    """
    null = F.lit(None).cast("bigint")
    rows = events.select(
        F.col(entity).cast("bigint").alias("entity"), F.col(order).cast("bigint").alias("pos"), F.col(event).cast("string").alias("event"),
        (F.col(begins).cast("bigint") if begins else null).alias("begins"), (F.col(ends).cast("bigint") if ends else null).alias("ends"),
    ).where("entity is not null and pos is not null and event is not null")
    chunked = rows.withColumn("chunk", F.floor(F.col("pos") / chunk_width)).repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "pos")
    schema = "entity bigint, event string, first_pos bigint, last_pos bigint, n bigint, begins bigint, ends bigint, piece bigint, edge boolean"
    pieces = chunked.mapInPandas(_runs_of_pieces, schema)
    # Runs inside a piece are final.  They get a salt of their own, so that only edge runs meet in a window per entity.
    salt = F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("first_pos"))
    in_order = Window.partitionBy("entity", "salt").orderBy("first_pos")
    joins = (F.col("salt") == -1) & (F.lag("event").over(in_order) == F.col("event")) & (F.lag("piece").over(in_order) != F.col("piece"))
    grouped = pieces.where(F.col("edge") | (F.col("n") >= least)).withColumn("salt", salt).withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    grouped = grouped.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = grouped.groupBy("entity", "salt", "run").agg(
        F.first("event").alias("event"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n").alias("n"),
        F.min_by("begins", "first_pos").alias("begins"), F.max_by("ends", "last_pos").alias("ends"),
    )
    return stitched.where(F.col("n") >= least).select("entity", "event", "first_pos", "last_pos", "n", "begins", "ends", (F.col("ends") - F.col("begins")).alias("duration"))

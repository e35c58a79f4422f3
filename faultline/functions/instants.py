"""Mixed time spellings to one UTC instant, as Catalyst expressions.

The cascade is a list of anchored patterns tried in order.  Each one rewrites
its spelling to the same nine fields ``year|month|day|hour|minute|second|
fraction|zone|am-pm``; a common tail then checks the calendar strictly and
resolves the zone, so that a new spelling costs one line.  All of it stays in
whole-stage code generation: no UDF.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.ids import strip_blanks

_HMS = r"(\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,12}))?"
_ZONE = r"(Z|z|[A-Za-z]{2,5}|[+-]\d{2}:?\d{2})?"
_REGION = r"(?:\[[A-Za-z0-9_+\-/]+\])?"
_MON = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"

_NAMES = "JanFebMarAprMayJunJulAugSepOctNovDec"

#: (name, anchored pattern, rewriting to the nine fields).  Order matters only where two patterns could match one text; none do.
CALENDAR_PATTERNS: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_HMS} ?{_ZONE}{_REGION}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    ("iso_minutes", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ](\d{{2}}):(\d{{2}}) ?{_ZONE}{_REGION}$", "$1|$2|$3|$4|$5|00||$6|"),
    ("slashed_iso", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}})[T ]{_HMS} ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,12}}))? ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    ("month_first_12h", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? (\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,12}}))? ([AaPp][Mm]) ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_HMS} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    ("mail", rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) {_MON} (\d{{4}}) {_HMS} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    ("month_name_12h", rf"^{_MON} (\d{{1,2}}), (\d{{4}}),? (\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,12}}))? ([AaPp][Mm]) ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    ("month_name_24h", rf"^{_MON} (\d{{1,2}}), (\d{{4}}),? {_HMS} ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|"),
]

#: Digits before the decimal mark of an epoch number -> micros per unit, as a power of ten.
EPOCH_DIGITS = [(9, 11, 6), (12, 14, 3), (15, 17, 0), (18, 20, -3)]

#: Abbreviations that mean the same everywhere.
UNIVERSAL_ZONES = ["Z", "UTC", "UT", "GMT"]

ZONE_LOOKUP = T.StructType([T.StructField("zone_name", T.StringType()), T.StructField("abbreviations", T.MapType(T.StringType(), T.IntegerType()))])
#: More distinct zone names than the IANA data base has, aliases included.
MAX_ZONES = 2000


def zone_abbreviations(zone_name: str, first_year: int = 1990, last_year: int = 2037) -> dict[str, int] | None:
    """Abbreviation -> seconds east of UTC as used in one zone; the latest meaning wins.  None for an unknown zone."""
    try:
        zone = ZoneInfo(zone_name)
    except (KeyError, ValueError, OSError, TypeError):
        return None
    out, at, end = {}, datetime(first_year, 1, 1, tzinfo=UTC), datetime(last_year, 1, 1, tzinfo=UTC)
    while at < end:
        local = at.astimezone(zone)
        if (name := local.tzname() or "").isalpha():
            out[name.upper()] = int(local.utcoffset().total_seconds())
        at += timedelta(days=15)
    return out


def zone_lookup(entities: DataFrame, key: str, zone: str) -> tuple[DataFrame, dict[str, int]]:
    """Entities with their zone's abbreviations, and the abbreviations that have one meaning over all those zones.

    Action: collects the distinct zone names (at most ``MAX_ZONES``, the IANA
    names; more is an error, never a cut).  Unknown zone names give NULL.
    One row per key: the smallest zone name wins if a key repeats.
    """
    names = [r[0] for r in entities.select(F.col(zone)).where(F.col(zone).isNotNull()).distinct().limit(MAX_ZONES + 1).collect()]
    if len(names) > MAX_ZONES:
        raise ValueError(f"{zone} holds more than {MAX_ZONES} distinct names, so it is no zone column")
    known = {n: a for n in names if (a := zone_abbreviations(n)) is not None}
    table = entities.sparkSession.createDataFrame(sorted(known.items()), ZONE_LOOKUP)
    meanings: dict[str, set[int]] = {}
    for abbreviations in known.values():
        for name, offset in abbreviations.items():
            meanings.setdefault(name, set()).add(offset)
    unique = {n: next(iter(o)) for n, o in meanings.items() if len(o) == 1}
    keyed = entities.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_zone_key")).agg(F.min(zone).alias("zone_name"))
    return keyed.join(F.broadcast(table), "zone_name", "left").withColumn("zone_name", F.when(F.col("abbreviations").isNotNull(), F.col("zone_name"))), unique


def clock_micros(rows: DataFrame, column: str) -> Column:
    """UTC micros of a clean timestamp column.  One without zone counts as UTC, whatever the session's zone."""
    if dict(rows.dtypes)[column] == "timestamp_ntz":
        return F.unix_micros(F.concat(F.col(column).cast("string"), F.lit("Z")).try_cast("timestamp"))
    return F.unix_micros(F.col(column).cast("timestamp"))


def _epoch_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(38,15)")


def _epoch_micros(number: Column) -> Column:
    """The unit follows from the digits before the decimal mark."""
    whole = F.floor(number)
    out = None
    for low, high, power in EPOCH_DIGITS:
        scaled = number * F.lit(10**power).cast("decimal(10,0)") if power >= 0 else number / F.lit(10**-power).cast("decimal(10,0)")
        fits = (whole >= F.lit(str(10 ** (low - 1))).cast("decimal(38,0)")) & (whole < F.lit(str(10**high)).cast("decimal(38,0)"))
        cut = F.floor(scaled).try_cast("bigint")
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out


def _calendar_fields(text: Column) -> Column:
    chain = None
    for _, pattern, rewriting in CALENDAR_PATTERNS:
        hit = F.regexp_replace(text, pattern, rewriting)
        chain = F.when(text.rlike(pattern), hit) if chain is None else chain.when(text.rlike(pattern), hit)
    return F.split(chain, r"\|")


def _local_micros(parts: Column) -> Column:
    """Wall-clock micros as if in UTC; NULL for a date or time that does not exist."""
    two = lambda c: F.lpad(c, 2, "0")
    month = F.when(parts[1].rlike("^[A-Z]"), two(F.floor((F.position(parts[1], F.lit(_NAMES)) + 2) / 3).cast("string"))).otherwise(two(parts[1]))
    clock = parts[3].try_cast("int")
    half = F.upper(parts[8])
    hour = F.when(half == "", parts[3]).when(clock.between(1, 12), (clock % 12 + F.when(half == "PM", 12).otherwise(0)).cast("string"))
    text = F.concat(parts[0], F.lit("-"), month, F.lit("-"), two(parts[2]), F.lit(" "), two(hour), F.lit(":"), parts[4], F.lit(":"), parts[5], F.lit("Z"))
    fraction = F.rpad(F.substring(parts[6], 1, 6), 6, "0").try_cast("bigint")
    return F.unix_micros(text.try_cast("timestamp")) + fraction


def _explicit_offset(zone: Column, abbreviations: Column, fallback: Column) -> Column:
    """Seconds east of UTC that the written zone states; NULL if none is written or it is unknown."""
    name = F.upper(zone)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.replace(F.substring(zone, 2, 5), F.lit(":"), F.lit(""))
    seconds = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    signed = F.when((seconds <= 18 * 3600) & (F.substring(digits, 3, 2) < "60"), sign * seconds)
    return F.when(name.isin(UNIVERSAL_ZONES), F.lit(0)).when(zone.rlike(r"^[+-]"), signed).otherwise(F.coalesce(F.try_element_at(abbreviations, name), F.try_element_at(fallback, name)))


def add_utc_micros(
    rows: DataFrame,
    value: str,
    zone_name: str,
    abbreviations: str,
    out: str,
    fallback: dict[str, int] | None = None,
    ambiguous: str = "earlier",
    nonexistent: str = "null",
) -> DataFrame:
    """``rows`` with ``out``: microseconds since 1970-01-01 UTC that ``value`` states, finer digits cut; NULL if it denotes no one instant.

    * A written offset or ``Z``/``UTC``/``GMT`` decides; a bracketed region after it is ignored.
    * An abbreviation is looked up in the row's zone first, then in ``fallback``.
    * Without zone the value is local time of ``zone_name``; NULL there gives NULL.
    * ``ambiguous``: 'earlier' (default), 'later' or 'null' for a repeated hour.
    * ``nonexistent``: 'null' (default) or 'shift' (forward by the gap) for a skipped hour.
    * NULL, blank, word and impossible dates (0000-00-00, 30 February, 25:00) give NULL.

    The steps are separate projections on purpose: Catalyst keeps a projection
    whose costly columns are used more than once, so each is computed once.
    The two offsets in force a day before and a day after a zoneless time are
    its candidates: if both give the same wall clock but differ, the time is
    ambiguous; if neither does, it does not exist.
    """
    t = lambda name: F.col(f"_{out}_{name}")
    add = lambda df, **columns: df.withColumns({f"_{out}_{k}": v for k, v in columns.items()})
    pairs = [x for k, v in sorted((fallback or {}).items()) for x in (F.lit(k), F.lit(v))]
    known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,int>")
    day = 86_400_000_000

    def wall(micros: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), F.col(zone_name)))

    df = add(rows, text=strip_blanks(F.col(value).cast("string")))
    df = add(df, numeric=t("text").rlike(r"^\d+(?:[.,]\d+)?(?:[eE]\+?\d+)?$"))
    df = add(df, parts=F.when(~t("numeric"), _calendar_fields(t("text"))), number=F.when(t("numeric"), _epoch_number(t("text"))))
    df = add(df, local=_local_micros(t("parts")), zone=t("parts")[7])
    df = add(df, offset=_explicit_offset(t("zone"), F.col(abbreviations), known).cast("bigint"), bare=F.when(t("zone") == "", t("local")))
    df = add(df, before=t("bare") - (wall(t("bare") - day) - (t("bare") - day)), after=t("bare") - (wall(t("bare") + day) - (t("bare") + day)))
    df = add(df, before_fits=wall(t("before")) == t("bare"), after_fits=wall(t("after")) == t("bare"))
    none = F.lit(None).cast("bigint")
    twice = {"earlier": F.least(t("before"), t("after")), "later": F.greatest(t("before"), t("after")), "null": none}[ambiguous]
    never = {"shift": t("before"), "null": none}[nonexistent]
    zoneless = F.when(t("before_fits") & t("after_fits"), F.when(t("before") == t("after"), t("before")).otherwise(twice)).when(t("before_fits"), t("before")).when(t("after_fits"), t("after")).when(t("bare").isNotNull(), never)
    result = F.when(t("numeric"), _epoch_micros(t("number"))).when(t("zone") == "", zoneless).otherwise(t("local") - t("offset") * 1_000_000)
    # A generator of one row: a filter on the result cannot be pushed through it, which would copy the whole cascade into the filter.
    return df.select(*[F.col(f"`{c}`") for c in rows.columns], F.explode(F.array(result)).alias(out))

"""Queries of the general data problems (1, 2, 4 and 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.instants import add_utc_micros
from faultline.operators.intervals import merge_intervals
from faultline.operators.logparse import parse_entries
from faultline.operators.orphans import orphan_references
from faultline.operators.timenorm import normalise_times, with_zones
from faultline.sources.tables import table

#: The usual spelling of each field, which needs no normalisation; a deploy time in any zone but PDT is not the usual one.
USUAL_FORMS = {
    "deploy_start_time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3} PDT$",
    "search_time": r"^\d+\.\d{9}$",
    "predicted_at": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$",
}
REFERRING = ("share_names", "first_failed_steps", "predictions")


def _all_times(spark: SparkSession, folder: str) -> DataFrame:
    programs = table(spark, folder, "programs")
    runs = normalise_times(table(spark, folder, "pipelines_list"), ["deploy_start_time", "search_time"], "program_id", programs)
    predicted = normalise_times(table(spark, folder, "predictions"), ["predicted_at"], "program_id", programs)
    return runs.withColumn("table_name", F.lit("pipelines_list")).unionByName(predicted.withColumn("table_name", F.lit("predictions")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    usual = reduce(lambda a, b: a | b, [(F.col("field_name") == f) & F.col("value").rlike(p) for f, p in USUAL_FORMS.items()])
    return _all_times(spark, folder).where(F.col("utc_micros").isNotNull() & ~usual).select("table_name", "row_id", "field_name", "utc_micros")


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per field: values, values that denote an instant, values that do not, NULLs."""
    return (
        _all_times(spark, folder)
        .groupBy("table_name", "field_name")
        .agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.count("utc_micros").alias("n_instants"))
    )


def busy_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(pipeline_id, start_micros, end_micros) of each exported row, NULL where a time denotes no instant."""
    runs, unique = with_zones(table(spark, folder, "pipelines_list").where("pipeline_id is not null").select("pipeline_id", "program_id", "deploy_start_time", "end_time"), "program_id", table(spark, folder, "programs"))
    runs = add_utc_micros(runs, "deploy_start_time", "_zone_name", "_abbreviations", "start_micros", unique)
    runs = add_utc_micros(runs, "end_time", "_zone_name", "_abbreviations", "end_micros", unique)
    return runs.select("pipeline_id", "start_micros", "end_micros")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(busy_rows(spark, folder), "pipeline_id", "start_micros", "end_micros")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    references = reduce(DataFrame.unionByName, [table(spark, folder, t).select(F.lit(t).alias("table_name"), "row_id", "execution_id", "exported_at") for t in REFERRING])
    return orphan_references(references, table(spark, folder, "pipelines_list").select("execution_id", "exported_at"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "row_id", "kind", "period")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans counted per table, period and kind."""
    return _orphans(spark, folder).groupBy("table_name", "period", "kind").agg(F.count("*").alias("n_references"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return parse_entries(table(spark, folder, "parsed_logs"), "log_id", {"key_lines": "lines", "error_message": "text"}, "exported_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, folder).select("log_id", "field_name", "start_pos", "n_lines", "utc_seconds", "severity", "component")


def p5_components(spark: SparkSession, folder: str) -> DataFrame:
    """Entries per component and severity."""
    return _entries(spark, folder).groupBy("component", "severity").agg(F.count("*").alias("n_entries"))


_ID = r"nullif(regexp_extract(execution_id, '^\s*0*([0-9]+?)(?:\.0)?\s*$', 1), '')"
_P4 = f"""WITH parents AS (SELECT {_ID} AS k, min(exported_at) AS first FROM pipelines_list GROUP BY 1),
refs AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, {_ID} AS k, exported_at FROM {t}" for t in REFERRING)}),
orphans AS (SELECT table_name, row_id, CASE WHEN parents.k IS NULL THEN 'missing' ELSE 'late' END AS kind, strftime(exported_at, '%Y-%m') AS period
FROM refs LEFT JOIN parents ON parents.k = refs.k WHERE refs.k IS NOT NULL AND (parents.k IS NULL OR first > exported_at)) """
#: Independent of the cascade: the zone is cut off first, then DuckDB's own list of formats reads the rest; abbreviations have fixed offsets in hours.
_ZONES = """z(abbr, hours) AS (VALUES ('Z', 0.0), ('UTC', 0.0), ('GMT', 0.0), ('PDT', -7.0), ('PST', -8.0), ('EDT', -4.0), ('EST', -5.0), ('CEST', 2.0), ('CET', 1.0), ('IST', 5.5), ('AEDT', 11.0), ('AEST', 10.0)),"""
_INSTANTS = r"""t AS (SELECT v.*, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\[[^\]]*\]$', '') AS x, zone_name FROM v LEFT JOIN programs ON regexp_replace(trim(pid), '^0+|\.0$', '', 'g') = CAST(programs.program_id AS VARCHAR)),
c AS (SELECT *, regexp_matches(x, '^\d+([.,]\d+)?(E\d+)?$') AS numeric, regexp_extract(x, '(?:[\d ])(Z|[A-Z]{3,5}|[+-]\d\d:?\d\d)$', 1) AS zone, rpad(substr(regexp_extract(x, ':\d\d[.,](\d+)', 1), 1, 6), 6, '0') AS fraction FROM t),
h AS (SELECT *, trim(regexp_replace(substr(x, 1, length(x) - length(zone)), '(:\d\d)[.,]\d+', '\1')) AS head FROM c),
l AS (SELECT *, try_strptime(head, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%Y%m%dT%H%M%S', '%m/%d/%Y %I:%M:%S %p', '%d.%m.%Y %H:%M:%S', '%a, %d %b %Y %H:%M:%S', '%b %d, %Y %I:%M:%S %p']) AS local,
CASE WHEN numeric THEN CASE WHEN contains(x, 'E') THEN CAST(regexp_replace(rpad(replace(split_part(x, 'E', 1), '.', ''), 20, '0'), '^(.{' || (1 + CAST(split_part(x, 'E', 2) AS INT)) || '})', '\1.') AS DECIMAL(38, 9)) ELSE CAST(replace(x, ',', '.') AS DECIMAL(38, 9)) END END AS number FROM h),
o AS (SELECT l.*, CASE WHEN regexp_matches(zone, '^[+-]') THEN (CAST(substr(zone, 2, 2) AS INT) * 60 + CAST(right(zone, 2) AS INT)) * CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END ELSE hours * 60 END AS minutes FROM l LEFT JOIN z ON abbr = zone),
u AS (SELECT *, CASE WHEN numeric THEN CAST(floor(number * CASE WHEN number < 1e11 THEN 1000000 WHEN number < 1e14 THEN 1000 WHEN number < 1e17 THEN 1 ELSE 0.001 END) AS BIGINT)
WHEN zone = '' THEN epoch_us(timezone(zone_name, local)) + CAST(fraction AS BIGINT) ELSE epoch_us(local) + CAST(fraction AS BIGINT) - CAST(minutes * 60000000 AS BIGINT) END AS utc_micros FROM o) """


def instants_sql(*columns: tuple[str, str]) -> str:
    """The opening of a statement that reads the columns (table, column) as instants ``u.utc_micros``."""
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, '{c}' AS field_name, {c} AS raw, CAST(program_id AS VARCHAR) AS pid FROM {t}" for t, c in columns)
    return f"WITH {_ZONES} v AS ({rows}),\n{_INSTANTS}"


_P1 = instants_sql(("pipelines_list", "deploy_start_time"), ("pipelines_list", "search_time"), ("predictions", "predicted_at"))
#: The heads of the programs in the tables, one pattern each, as [time, level or priority, component]; independent of the mined layouts.
_LV = "(?i:fatal|critical|crit|alert|emergency|emerg|panic|error|err|severe|warning|warn|information|info|notice|debug|trace|verbose|finest|finer|fine)"
_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
_HEADS = [
    (rf"^\[({_LV})\]", None, 1, None),
    (rf"^npm ({_LV})\b", None, 1, "'npm'"),
    (rf"^({_LV}) ({_ISO}) \[([^\]]*)\]", 2, 1, 3),
    (rf"^({_ISO}) - ([^ ]+) - ({_LV}) - ", 1, 3, 2),
    (rf"^({_ISO}) \| ({_LV}) \| ([^ ]+) \|", 1, 2, 3),
    (rf"^(\d\d\.\d\d\.\d{{4}} \d\d:\d\d:\d\d(?:[.,]\d+)?) \*({_LV})\* \[[^\]]*\] ([\w.$]+)", 1, 2, 3),
    (rf"^({_ISO}) +({_LV}) \d+ --- \[[^\]]*\] ([\w.$]+) *:", 1, 2, 3),
    (rf"^<(\d+)>\d+ ({_ISO}) [^ ]+ ([^ ]+) ", 2, 1, 3),
    (rf"^([A-Z][a-z][a-z] +\d+ \d\d:\d\d:\d\d) [^ ]+ ([^ \[]+)\[\d+\]: ({_LV}):", 1, 3, 2),
    (rf"^\[[A-Z][a-z][a-z] ([A-Z][a-z][a-z] +\d+ \d\d:\d\d:\d\d(?:\.\d+)? \d{{4}})\] \[([^:\]]+):({_LV})\]", 1, 3, 2),
]


def _head(pattern: str, *parts: int | str | None) -> str:
    quoted = pattern.replace("'", "''")
    picked = ", ".join("''" if p is None else p if isinstance(p, str) else f"regexp_extract(x, '{quoted}', {p})" for p in parts)
    return f"WHEN regexp_matches(x, '{quoted}') THEN [{picked}]"


_KEYED = rf"""WHEN starts_with(x, '{{') AND regexp_matches(x, '"(level|severity|lvl)"\s*:\s*"{_LV}"') THEN [regexp_extract(x, '"(?:ts|time|timestamp|@timestamp)"\s*:\s*"?([^",}}]+)', 1), regexp_extract(x, '"(?:level|severity|lvl)"\s*:\s*"({_LV})"', 1), regexp_extract(x, '"(?:logger|component|module)"\s*:\s*"([^"]*)"', 1)]
WHEN regexp_matches(x, '^(ts|level|lvl|severity|component|time)=') AND regexp_matches(x, '(^| )(level|lvl|severity)={_LV}( |$)') THEN [regexp_extract(x, '(?:^| )(?:ts|time)=([^ ]+)', 1), regexp_extract(x, '(?:^| )(?:level|lvl|severity)=({_LV})(?: |$)', 1), regexp_extract(x, '(?:^| )(?:component|logger|module)=([^ ]+)', 1)]"""
_P5 = rf"""WITH f AS (SELECT log_id, 'key_lines' AS field_name, key_lines AS a, exported_at FROM parsed_logs WHERE key_lines IS NOT NULL UNION ALL SELECT log_id, 'error_message', string_split(error_message, chr(10)), exported_at FROM parsed_logs WHERE error_message IS NOT NULL),
l AS (SELECT log_id, field_name, exported_at, len(a) AS n, unnest(a) AS raw, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos FROM f),
c AS (SELECT *, trim(regexp_replace(raw, '\x1b\[[0-9;?]*[A-Za-z]', '', 'g'), chr(32) || chr(9) || chr(13)) AS x FROM l),
m AS (SELECT *, CASE {_KEYED} {" ".join(_head(*h) for h in _HEADS)} END AS h FROM c),
e AS (SELECT log_id, field_name, pos AS start_pos, coalesce(lead(pos) OVER (PARTITION BY log_id, field_name ORDER BY pos), n) - pos AS n_lines, h[1] AS clock, lower(h[2]) AS lv, h[3] AS component, exported_at FROM m WHERE h IS NOT NULL),
t AS (SELECT *, CASE WHEN clock = '' THEN -1 WHEN regexp_matches(clock, '^\d{{10}}') THEN CAST(left(clock, 10) AS BIGINT)
WHEN regexp_matches(clock, '^\d{{4}}-') THEN epoch(try_strptime(replace(left(clock, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')) - CASE WHEN regexp_matches(clock, '[+-]\d\d:?\d\d$') THEN (CAST(replace(regexp_extract(clock, '([+-]\d\d):?(\d\d)$', 1), '+', '') AS INT) * 3600 + CASE WHEN regexp_matches(clock, '-\d\d:?\d\d$') THEN -1 ELSE 1 END * CAST(right(clock, 2) AS INT) * 60) ELSE 0 END
WHEN regexp_matches(clock, '^\d\d\.') THEN epoch(try_strptime(left(clock, 19), '%d.%m.%Y %H:%M:%S')) WHEN regexp_matches(clock, '\d{{4}}$') THEN epoch(try_strptime(regexp_replace(regexp_replace(clock, '\.\d+', ''), ' +', ' ', 'g'), '%b %d %H:%M:%S %Y'))
ELSE (SELECT max(epoch(d)) FROM (SELECT try_strptime(regexp_replace(clock, ' +', ' ', 'g') || ' ' || y, '%b %d %H:%M:%S %Y') AS d FROM (SELECT unnest(range(year(exported_at) - 8, year(exported_at) + 1)) AS y)) WHERE d <= exported_at) END AS s FROM e)
SELECT log_id, field_name, start_pos, n_lines, CAST(coalesce(s, -1) AS BIGINT) AS utc_seconds, CASE WHEN regexp_matches(lv, '^\d+$') THEN ['FATAL', 'FATAL', 'FATAL', 'ERROR', 'WARN', 'INFO', 'INFO', 'DEBUG'][CAST(lv AS INT) % 8 + 1] WHEN lv IN ('error', 'err', 'severe') THEN 'ERROR' WHEN starts_with(lv, 'warn') THEN 'WARN' WHEN lv IN ('info', 'information', 'notice') THEN 'INFO'
WHEN lv IN ('debug', 'trace', 'verbose', 'fine', 'finer', 'finest') THEN 'DEBUG' ELSE 'FATAL' END AS severity, component FROM t """
SQL = {
    "p5_found": _P5,
    "p5_components": f"SELECT component, severity, count(*) AS n_entries FROM ({_P5}) GROUP BY ALL",
    "p1_found": _P1 + r"""SELECT table_name, row_id, field_name, utc_micros FROM u WHERE utc_micros IS NOT NULL AND NOT CASE field_name WHEN 'deploy_start_time' THEN regexp_full_match(raw, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3} PDT')
WHEN 'search_time' THEN regexp_full_match(raw, '\d+\.\d{9}') ELSE regexp_full_match(raw, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00') END""",
    "p1_coverage": _P1 + "SELECT table_name, field_name, count(*) AS n_rows, count(raw) AS n_values, count(utc_micros) AS n_instants FROM u GROUP BY ALL",
    "p2_found": instants_sql(("pipelines_list", "deploy_start_time"), ("pipelines_list", "end_time")) + """, e AS (SELECT pipeline_id, s, e FROM (SELECT row_id, max(utc_micros) FILTER (field_name = 'deploy_start_time') AS s, max(utc_micros) FILTER (field_name = 'end_time') AS e FROM u GROUP BY row_id)
JOIN pipelines_list USING (row_id) WHERE pipeline_id IS NOT NULL AND e >= s),
n AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY pipeline_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY pipeline_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n),
p AS (SELECT pipeline_id, min(s) AS s, max(e) AS e FROM g GROUP BY pipeline_id, island),
f AS (SELECT *, lead(s) OVER (PARTITION BY pipeline_id ORDER BY s) AS following FROM p)
SELECT pipeline_id, 'period' AS kind, s AS start_micros, e AS end_micros FROM f UNION ALL SELECT pipeline_id, 'gap', e, following FROM f WHERE following IS NOT NULL""",
    "p4_found": _P4 + "SELECT * FROM orphans",
    "p4_report": _P4 + "SELECT table_name, period, kind, count(*) AS n_references FROM orphans GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p4_found, p4_report, p5_found, p5_components)}

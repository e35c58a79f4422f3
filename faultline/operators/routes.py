"""Retrieval routes and the texts they search with: filters over incident records, query variants, fusion of ranked lists."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a candidate's text, of a query variant, and of stored fields.
CANDIDATE_CHARACTERS, VARIANT_CHARACTERS = 1500, 2000


def is_prediction(pipeline: Column, error_type: Column, execution_id: Column) -> Column:
    """Whether an incident record stems from a risk prediction, by any of three marks; NULLs are no mark."""
    marks = (pipeline == "risk_analysis", error_type.startswith("risk_prediction_"), execution_id.startswith("risk-"))
    return F.coalesce(marks[0], F.lit(False)) | F.coalesce(marks[1], F.lit(False)) | F.coalesce(marks[2], F.lit(False))


def matching(rows: DataFrame, wanted: dict[str, str | None], wildcard: str = "All") -> DataFrame:
    """Rows that equal every wanted value; None, '' and the wildcard ask for nothing."""
    for column, value in wanted.items():
        if value and value != wildcard:
            rows = rows.where(F.col(column) == value)
    return rows


def relational_route(causes: DataFrame, asked: DataFrame) -> DataFrame:
    """Known causes for asked (query_id, step, error_type): equal steps, and types of which one holds the other.

    Both sides have step and error_type; what is NULL or '' on either side asks
    for nothing.  Every hit scores 0.6.  ``causes`` is aggregated, one row a
    known cause, so the inequality join stays between two small tables.
    """
    q = asked.select("query_id", F.col("step").alias("_s"), F.col("error_type").alias("_e"))
    free = lambda c: c.isNull() | (c == "")
    s, e, _s, _e = (F.col(c) for c in ("step", "error_type", "_s", "_e"))
    hit = (free(s) | free(_s) | (s == _s)) & (free(e) | free(_e) | F.contains(e, _e) | F.contains(_e, e))
    return causes.join(q, hit).drop("_s", "_e").withColumn("match_score", F.lit(0.6))


def pattern_route(patterns: DataFrame, asked: DataFrame) -> DataFrame:
    """Recurring (pipeline, step, n) patterns for asked (query_id, pipeline, step): equal steps, pipelines whose name holds the asked one; score n / 10, at most 1.

    What is NULL or '' on either side asks for nothing.  ``patterns`` is aggregated.
    """
    q = asked.select("query_id", F.col("pipeline").alias("_p"), F.col("step").alias("_s"))
    free = lambda c: c.isNull() | (c == "")
    p, s, _p, _s = (F.col(c) for c in ("pipeline", "step", "_p", "_s"))
    hit = (free(p) | free(_p) | F.contains(p, _p)) & (free(s) | free(_s) | (s == _s))
    return patterns.join(q, hit).drop("_p", "_s").withColumn("match_score", F.least(F.lit(1.0), F.col("n") / 10))


def known_causes(details: DataFrame) -> DataFrame:
    """(cause_key, error_type, detail, step, occurrence_count) of failures (step, error_type, error_message, errors); errors: type, detail.

    A missing package is one cause per message and counts how often it occurred.
    A deployment gives one cause per error of its list, keyed by type and the
    first 80 characters of the detail, each counted once.  Other failures have
    no known cause.  Aggregates combine before the shuffle.
    """
    packages = details.where("error_type = 'missing_npm_module'").select(F.concat(F.lit("missing_npm_module:"), F.coalesce("error_message", F.lit(""))).alias("cause_key"), "error_type", F.coalesce("error_message", F.lit("")).alias("detail"), "step")
    packages = packages.groupBy("cause_key").agg(F.min("error_type").alias("error_type"), F.min("detail").alias("detail"), F.min("step").alias("step"), F.count("*").alias("occurrence_count"))
    deploys = details.where("step = 'deploy' and not error_type <=> 'missing_npm_module'").select("step", F.explode("errors").alias("e")).where("e.type = 'missing_env_variable' or contains(e.detail, 'rewrite-onpremises')")
    keyed = deploys.select(F.concat_ws(":", "e.type", F.substring("e.detail", 1, 80)).alias("cause_key"), F.col("e.type").alias("error_type"), F.regexp_replace("e.detail", "^Undefined variable: ", "").alias("detail"), "step")
    once = keyed.groupBy("cause_key").agg(F.min("error_type").alias("error_type"), F.min("detail").alias("detail"), F.min("step").alias("step"), F.lit(1).cast("bigint").alias("occurrence_count"))
    return packages.unionByName(once)


def candidate_text(parts: Sequence[Column], most: int = CANDIDATE_CHARACTERS) -> Column:
    """The non-empty parts joined by blanks, cut to ``most`` characters (what a reranker is shown)."""
    return F.substring(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " "), 1, most)


def embedded_text(step: Column, error_type: Column, error: Column, lines: Column, cause: Column, fix: Column) -> Column:
    """The text an incident is embedded by; NULL parts are empty, at most five log lines."""
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = F.array_join(F.slice(F.coalesce(lines, F.array().cast("array<string>")), 1, 5), " | ")
    return F.concat(F.lit("step:"), text(step), F.lit(" error_type:"), text(error_type), F.lit("\nerror: "), text(error), F.lit("\nlog lines: "), shown, F.lit("\nroot cause: "), text(cause), F.lit("\nfix: "), text(fix))


def hypothetical_text(summary: Column, cause: Column) -> Column:
    """The text of an ideal incident record for a search by likeness, without a model: the cause, or else the summary, and a stock ending."""
    return F.concat(F.lit("Root cause: "), F.coalesce(F.nullif(cause, F.lit("")), summary, F.lit("")), F.lit("\nRecommended fix for the failed pipeline."))


def query_variant(query: Column, most: int = VARIANT_CHARACTERS) -> Column:
    """The variant of a query without a model: its first ``most`` characters; NULL for an empty one."""
    return F.nullif(F.substring(query, 1, most), F.lit(""))


_FENCE = re.compile(r"^```(?:json)?\s*([\s\S]+?)\s*```$")


def _closing(text: str) -> str:
    """What closes the brackets that ``text`` leaves open outside strings."""
    opened, inside, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{[":
            opened.append("}" if c == "{" else "]")
        elif not inside and c in "}]" and opened:
            opened.pop()
    return "".join(reversed(opened))


def _repaired(text: str | None) -> str | None:
    if text is None:
        return None
    text = text.strip()
    if m := _FENCE.match(text):
        text = m.group(1)
    cut = re.sub(r':\s*"(?:[^"\\]|\\.)*\\?$', ': ""', re.sub(r'([,\[{])\s*"(?:[^"\\]|\\.)*\\?$', lambda m: "" if m.group(1) == "," else m.group(1), text))
    cut = re.sub(r'[,{]\s*"(?:[^"\\]|\\.)*"\s*:?\s*$', lambda m: "{" if m.group()[0] == "{" else "", cut) if cut.count('"') % 2 == 0 and not text.endswith(("}", "]")) else cut
    for attempt in (text, text + _closing(text), cut + _closing(cut), cut.rstrip(", \n\t") + _closing(cut)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """A JSON text without its code fence and, if it was cut off, closed where it can be; NULL if no object can be made of it."""
    return texts.map(_repaired)

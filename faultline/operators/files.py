"""File-change analytics over (file, commit, author, time) records and repository paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Path pattern (any case), module and the step it tends to fail in; the first match counts.
MODULE_RULES = [
    (r"ui\.frontend/", "ui.frontend", "build"),
    (r"ui\.apps/", "ui.apps", "build"),
    (r"ui\.content/", "ui.content", "deploy"),
    (r"ui\.config/", "ui.config", "securityTest"),
    (r"dispatcher", "dispatcher", "deploy"),
    (r"\.conf$", "dispatcher", "deploy"),
    (r"rewrite-.*\.conf", "dispatcher", "deploy"),
    (r"pom\.xml$", "core", "build"),
    (r"package\.json$", "core", "build"),
    (r"securityTest", "security", "securityTest"),
]


def module_of_path(path: Column) -> tuple[Column, Column]:
    """Module and usual step of a path: the first matching rule, else 'other' and 'build'; NULL for NULL."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    module, step = F.when(path.isNull(), F.lit(None).cast("string")), F.when(path.isNull(), F.lit(None).cast("string"))
    for pattern, name, usual in MODULE_RULES:
        module, step = module.when(plain.rlike("(?i)" + pattern), name), step.when(plain.rlike("(?i)" + pattern), usual)
    return module.otherwise("other"), step.otherwise("build")


def changed_modules(paths: Column) -> Column:
    """The distinct modules of an array of paths, sorted, without 'other'; empty for NULL."""
    named = F.transform(paths, lambda p: module_of_path(p)[0])
    return F.coalesce(F.sort_array(F.array_distinct(F.filter(named, lambda m: m.isNotNull() & (m != "other")))), F.array().cast("array<string>"))


def module_steps(spark: SparkSession) -> DataFrame:
    """(module, step): the steps each module tends to fail in, once each."""
    return spark.createDataFrame(sorted({(m, s) for _, m, s in MODULE_RULES}), "module string, step string")


def suffix(path: Column) -> Column:
    """Lower-case file suffix with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def piped(text: Column) -> Column:
    """The non-blank parts of a text between pipes, trimmed; NULL for NULL."""
    return F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def top_level(path: Column) -> Column:
    """First component of a path."""
    return F.split(path, "/")[0]


def without_bulk(changes: DataFrame, commit: str, most_files: int, message: str | None = None, pattern: str | None = None) -> DataFrame:
    """Changes without those of commits that touch more than ``most_files`` files or whose message matches ``pattern``.

    The size of a commit is an aggregate joined back, so a commit with a third
    of all rows is never one task's window.
    """
    bulk = changes.groupBy(commit).agg(F.count("*").alias("_files")).where(F.col("_files") > most_files)
    kept = changes.join(bulk, commit, "left_anti")
    return kept.where(~F.coalesce(F.col(message).rlike(pattern), F.lit(False))) if message and pattern else kept


def hot_files(changes: DataFrame, file: str, author: str, time: str, tie: str, least: int, message: str | None = None) -> DataFrame:
    """Files changed at least ``least`` times: count, distinct authors and their sorted list, last change, who made it, and its ``message`` if one is named."""
    last = F.struct(time, tie)
    grouped = changes.groupBy(file).agg(
        F.count("*").alias("n_changes"), F.count_distinct(author).alias("n_authors"), F.sort_array(F.collect_set(author)).alias("authors"), F.max(time).alias("last_change"),
        F.max_by(author, last).alias("last_author"), *([F.max_by(message, last).alias("last_message")] if message else []),
    )
    return grouped.where(F.col("n_changes") >= least)


def author_ownership(changes: DataFrame, author: str, file: str, kind: str, time: str, top: int = 3, module: str | None = None) -> DataFrame:
    """Per author: files touched, last active, the ``top`` kinds as 'kind:n' by falling count, joined by commas, and the sorted ``modules`` if one is named.

    Two levels of aggregates: the second one sees one row per author and kind.
    """
    per_kind = changes.groupBy(author, kind).agg(F.count("*").alias("n"))
    ranked = per_kind.withColumn("r", F.row_number().over(Window.partitionBy(author).orderBy(F.desc("n"), kind))).where(F.col("r") <= top)
    names = ranked.groupBy(author).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", F.col(kind), F.col("n")).alias("t")))), lambda x: x["t"]), ",").alias("top_kinds"))
    modules = [F.sort_array(F.collect_set(module)).alias("modules")] if module else []
    files = changes.groupBy(author).agg(F.count_distinct(file).alias("n_files"), F.max(time).alias("last_active"), *modules)
    return files.join(names, author)


def parse_change_log(lines: DataFrame, log: str, position: str, line: str, header: str) -> DataFrame:
    """File lines of a change log with the fields of the header line above them: (log, position, line, header).

    ``header`` is the pattern of header lines.  Blank lines and lines before
    the first header are dropped.  A window per log carries the header down.
    """
    over = Window.partitionBy(log).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.col(line).rlike(header)
    filled = lines.withColumn("header", F.last(F.when(is_header, F.col(line)), ignorenulls=True).over(over))
    return filled.where(~is_header & F.col("header").isNotNull() & (F.trim(line) != ""))


def reference_join(texts: DataFrame, key: str, text: str, terms: DataFrame, owner: str, term: str, cap: int) -> DataFrame:
    """(owner, n_refs, refs): in how many texts any of an owner's terms occurs, case aside, and the first ``cap`` of their keys in order.

    A term matches anywhere inside a text, not only as a whole word; a text
    that holds several terms of one owner counts once.  NULL and blank terms
    find nothing; owners without a text give no row.  ``terms`` is the small
    side: every text is compared with every distinct term, and only (owner, key)
    pairs are shuffled; the keys are cut to ``cap`` before they meet per owner.
    """
    low = texts.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).where("_key is not null and _text is not null")
    wanted = terms.where(F.col(owner).isNotNull() & (F.trim(term) != "")).select(F.col(owner).alias("_owner"), F.lower(term).alias("_term")).distinct()
    pairs = low.join(wanted, F.contains("_text", "_term")).select("_owner", "_key").distinct()
    counts = pairs.groupBy("_owner").agg(F.count("*").alias("n_refs"))
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("_owner").orderBy("_key"))).where(F.col("_r") <= cap)
    refs = first.groupBy("_owner").agg(F.sort_array(F.collect_list("_key")).alias("refs"))
    return counts.join(refs, "_owner").select(F.col("_owner").alias(owner), "n_refs", "refs")

"""Log reduction: lines, masks, candidates, context blocks, weights and packing.

Lines are rows (log_id, line_no, line) with ``line_no`` from 0; all windows
are per log, so the largest group is one log, never the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that make a line a candidate, compared in lower case.
ERROR_WORDS = ["fatal", "panic", "error", "exit", "kill", "no such file", "err:", "failures:", "exception", "build failure", "npm err!", "compilation error", "fail:"]
#: Patterns of a sure failure.
FAILURE_PATTERNS = ["FAIL:", "Failures:", "BUILD FAILURE", "npm ERR!"]
#: Patterns (any case) that make a line a candidate in the logs of one step.
STEP_PATTERNS = {
    "build": [r"\[ERROR\]", "BUILD FAILURE", "Cannot find module", "Module not found", "npm ERR!", r"error TS\d+"],
    "securitytest": ["- Failed", "WARN -", "ERROR"],
    "deploy": ["ERROR", "FAILED", "Deployment failed"],
    "loadtest": ["FAILED", "ERROR", "AssertionError"],
    "codequality": ["FAILED", "Quality gate", "ERROR"],
}
CONTEXT_BEFORE, CONTEXT_AFTER, TAIL_SHARE = 4, 6, 0.85
#: Secrets and keys of storage accounts.
SECRET = r"(?i)(api[_-]?key|password|secret|token)\s*[=:]\s*\S+"
ACCOUNT_KEY = r"(?i)DefaultEndpointsProtocol=https;AccountKey=[^;]+"


def lines_of_arrays(logs: DataFrame, log_id: str, lines: str) -> DataFrame:
    """(log_id, line_no, line) of an array column; NULL lines stay, NULL and empty arrays give nothing."""
    return logs.select(F.col(log_id).alias("log_id"), F.posexplode(lines).alias("line_no", "line"))


def lines_of_texts(texts: DataFrame, log_id: str, text: str) -> DataFrame:
    r"""(log_id, line_no, line) of a text column: ``\r\n`` and ``\r`` count as ``\n``; one final newline opens no line."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n$", "")
    return texts.select(F.col(log_id).alias("log_id"), F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))


def mask_line(line: Column) -> Column:
    """Numbers, then UUIDs, then hexadecimal numbers replaced by marks; a UUID group of digits alone is a number first."""
    # Patterns and marks.
    out = F.regexp_replace(F.trim(line), r"\b[0-9]+\b", "<NUM>")
    out = F.regexp_replace(out, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>")
    return F.regexp_replace(out, r"(?i)0x[0-9a-f]+", "<HEX>")


def template_id(line: Column) -> Column:
    """Stable short id of a line's mask."""
    return F.substring(F.md5(mask_line(line)), 1, 12)


def redact(text: Column) -> Column:
    """Values of secrets, then keys of storage accounts, replaced by ``***``."""
    return F.regexp_replace(F.regexp_replace(text, SECRET, "$1=***"), ACCOUNT_KEY, "AccountKey=***")


def is_candidate_word(line: Column) -> Column:
    """Whether a line holds one of the error words."""
    low = F.lower(line)
    out = F.lit(False)
    for word in ERROR_WORDS:
        out = out | low.contains(word)
    return out


def is_step_match(step: Column, line: Column) -> Column:
    """Whether a line matches a pattern of its step (lower-case letters); a NULL or unknown step has none."""
    out = F.lit(False)
    for name, patterns in STEP_PATTERNS.items():
        out = out | (step.eqNullSafe(F.lit(name)) & line.rlike("(?i)" + "|".join(patterns)))
    return out


def is_failure(line: Column) -> Column:
    """Whether a line matches a sure failure pattern."""
    return line.rlike("(?i)" + "|".join(FAILURE_PATTERNS))


def candidates(lines: DataFrame, noise: DataFrame | None = None, least: int = 2, fallback: int = 20, step: str | None = None) -> DataFrame:
    """Lines with ``candidate`` (boolean), ``tail_score`` and ``template``.

    A non-blank line is a candidate if it has an error word, matches a pattern
    of its ``step`` (a column of ``lines``) or lies in the last part of its
    log, is no noise (``noise``: log_id, line_no), and is the first such line
    of its template.  A log with at most ``least`` candidates takes its last
    ``fallback`` lines besides, without noise.  Blank and NULL lines are
    dropped; the score counts only the others, noise too.
    """
    kept = lines.where(F.trim("line") != "").withColumn("template", template_id(F.col("line")))
    if noise is not None:
        marks = noise.select("log_id", "line_no").distinct().withColumn("noise", F.lit(True))
        kept = kept.join(marks, ["log_id", "line_no"], "left").withColumn("noise", F.coalesce("noise", F.lit(False)))
    else:
        kept = kept.withColumn("noise", F.lit(False))
    known = is_candidate_word(F.col("line"))
    if step is not None:
        known = known | is_step_match(F.col(step), F.col("line"))
    per_log = Window.partitionBy("log_id")
    pos = F.row_number().over(per_log.orderBy("line_no")) - 1
    n = F.count("*").over(per_log)
    scored = kept.withColumns({"pos": pos, "n": n}).withColumn("tail_score", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1))))
    matched = ~F.col("noise") & (known | (F.col("tail_score") >= TAIL_SHARE))
    scored = scored.withColumn("matched", matched)
    first = F.row_number().over(Window.partitionBy("log_id", "template", "matched").orderBy("line_no")) == 1
    chosen = scored.withColumn("first", F.col("matched") & first)
    few = F.sum(F.col("first").cast("int")).over(per_log) <= least
    late = ~F.col("noise") & (F.col("pos") >= F.col("n") - fallback)
    return chosen.withColumn("candidate", F.col("first") | (few & late)).select("log_id", "line_no", "line", "template", "tail_score", "candidate", F.col("n").alias("n_lines"))


def context_blocks(marked: DataFrame, before: int = CONTEXT_BEFORE, after: int = CONTEXT_AFTER) -> DataFrame:
    """(log_id, block_no, start, end): candidates widened by context and merged where they touch.

    ``marked``: log_id, line_no, candidate, and the log's last line number in
    ``last_line``.  Logs without candidates have no block.
    """
    spans = marked.where("candidate").select("log_id", F.greatest(F.col("line_no") - before, F.lit(0)).alias("start"), F.least(F.col("line_no") + after, F.col("last_line")).alias("end"), "line_no")
    over = Window.partitionBy("log_id").orderBy("start", "line_no")
    opens = F.coalesce(F.col("start") > F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    numbered = spans.withColumn("opens", opens.cast("int")).withColumn("block_no", F.sum("opens").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("log_id", "block_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def line_weights(marked: DataFrame, blocks: DataFrame, pool: int = 500) -> DataFrame:
    """(log_id, line_no, block_no, weight, tokens) of the lines inside blocks.

    A sure failure weighs 10; a header line 2 on top; a candidate 3 (1 in a
    pool of more than ``pool``, and then 1 more); every other line of a block
    whose heaviest line reaches the log's threshold at least 1.
    """
    per_log = Window.partitionBy("log_id")
    size = F.sum(F.col("candidate").cast("int")).over(per_log)
    base = F.when(F.col("candidate"), F.when(size <= pool, 3.0).otherwise(1.0)).otherwise(0.0)
    raw = F.when(is_failure(F.col("line")), 10.0).when(F.ltrim("line").startswith("#"), F.col("base") + 2).when(F.col("candidate") & (F.col("base") < 2), F.col("base") + 1).otherwise(F.col("base"))
    weighed = marked.withColumn("base", base).withColumn("w", raw)
    active, top = F.sum((F.col("w") >= 1).cast("int")).over(per_log), F.max("w").over(per_log)
    weighed = weighed.withColumn("theta", F.when((top == 1) | (active <= pool), 1.0).otherwise(3.0))
    inside = weighed.join(blocks, "log_id").where(F.col("line_no").between(F.col("start"), F.col("end")))
    heaviest = F.max("w").over(Window.partitionBy("log_id", "block_no"))
    weight = F.when((heaviest >= F.col("theta")) & (F.col("w") < 1), 1.0).otherwise(F.col("w"))
    tokens = F.greatest(F.lit(1), F.floor(F.length("line") / 4)).cast("bigint")
    return inside.select("log_id", "line_no", "block_no", weight.alias("weight"), tokens.alias("tokens"))


def block_density(weighed: DataFrame) -> DataFrame:
    """(log_id, block_no, n_lines, tokens, density): mean weight and tokens per block."""
    return weighed.groupBy("log_id", "block_no").agg(F.count("*").alias("n_lines"), F.sum("tokens").alias("tokens"), (F.sum("weight") / F.count("*")).alias("density"))


def pack_blocks(density: DataFrame, budget: int) -> DataFrame:
    """(log_id, block_no) of the blocks that fit the token budget, densest first.

    A block that does not fit is skipped and smaller ones go on; the densest
    block is taken if none fits.  Ties go to the earlier block.  One fold over
    each log's sorted blocks, JVM-side.
    """
    item = F.struct((-F.col("density")).alias("d"), F.col("block_no").alias("b"), F.col("tokens").alias("t"))
    ordered = density.groupBy("log_id").agg(F.sort_array(F.collect_list(item)).alias("blocks"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    fits = lambda acc, x: acc["used"] + x["t"] <= budget
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["t"]).alias("used"), F.concat(acc["taken"], F.array(x["b"].cast("bigint"))).alias("taken"))).otherwise(acc)
    taken = F.aggregate("blocks", start, step)["taken"]
    forced = F.when(F.size(taken) > 0, taken).otherwise(F.array(F.col("blocks")[0]["b"].cast("bigint")))
    return ordered.select("log_id", F.explode(forced).alias("block_no"))


def preceding_match(lines: DataFrame, target: str, wanted: str, within: int = 9) -> DataFrame:
    """Lines matching ``target`` with the nearest earlier line matching ``wanted`` among the ``within`` before it."""
    over = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(-within, -1)
    found = F.last(F.when(F.col("line").rlike(wanted), F.col("line")), ignorenulls=True).over(over)
    return lines.withColumn("cause", found).where(F.col("line").rlike(target))


def source_window(lines: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """(log_id, target, snippet): the target line and ``width`` lines around it, numbered from 1, the target marked ``>>>``.

    ``targets``: log_id, target (0-based).  Windows are clamped to the log.
    """
    near = lines.join(targets, "log_id").where(F.abs(F.col("line_no") - F.col("target")) <= width)
    text = F.format_string("%s %4d | %s", F.when(F.col("line_no") == F.col("target"), ">>>").otherwise("   "), F.col("line_no") + 1, F.col("line"))
    return near.groupBy("log_id", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", text.alias("s")))), lambda x: x["s"]), "\n").alias("snippet"))


def brace_sections(lines: DataFrame, opening: str, cap: int = 60, least: int = 5, opens: str = "{[", closes: str = "}]") -> DataFrame:
    """(log_id, first_line, last_line): from the first line matching ``opening`` until its braces close, at most ``cap`` lines.

    A section closes at its first line with no brace open, but never before it
    has ``least`` lines; one that does not close ends with the cap or the log.
    """
    opened = lines.where(F.col("line").rlike(opening)).groupBy("log_id").agg(F.min("line_no").alias("first_line"))
    count = lambda chars: F.length("line") - F.length(F.translate("line", chars, ""))
    body = lines.join(opened, "log_id").where((F.col("line_no") >= F.col("first_line")) & (F.col("line_no") < F.col("first_line") + cap))
    running = F.sum(count(opens) - count(closes)).over(Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    closed = F.min(F.when((F.col("depth") <= 0) & (F.col("line_no") - F.col("first_line") >= least - 1), F.col("line_no")))
    return body.withColumn("depth", running).groupBy("log_id").agg(F.min("first_line").alias("first_line"), F.coalesce(closed, F.max("line_no")).alias("last_line"))


def log_class(step: Column, text: Column) -> Column:
    """Error type of a step's log text: the first pattern of the step that matches, else the step's default."""
    # The patterns below.
    build = (
        F.when(text.rlike(r"Module not found: Error: Can't resolve '[^']+' in '[^']+'"), "missing_npm_module")
        .when(text.rlike(r"Failed to run task: '.+?' failed"), "npm_build_failed")
        .when(text.rlike(r"error TS[0-9]+: ."), "typescript_error")
        .when(text.rlike(r"COMPILATION ERROR|cannot find symbol|error: package .+? does not exist"), "java_compile_error")
        .when(text.contains("OutOfMemoryError"), "oom")
        .otherwise("build_failure")
    )
    deploy = (
        F.when(text.rlike(r"Config variables are not defined: \S+"), "missing_env_variable")
        .when(text.rlike(r"Syntax error on line [0-9]+ of [^\n:]+: ."), "apache_config_syntax_error")
        .otherwise("deploy_failure")
    )
    load = F.when(text.rlike(r"(?i)FAILED\s+.+?\s+threshold|p95\s*=\s*[0-9.]+ms"), "load_test_failure").otherwise("load_test_unknown")
    quality = F.when(text.rlike(r"[0-9]+\s+BLOCKER|(?i)coverage.*?[0-9.]+\s*%.*?required.*?[0-9.]+\s*%"), "code_quality_failure").otherwise("code_quality_unknown")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "no_log")
        .when(step == "build", build).when(step == "securitytest", "security_failure").when(step == "deploy", deploy).when(step == "loadtest", load).when(step == "codequality", quality)
        .otherwise("unparsed")
    )


def deploy_errors(logs: DataFrame, log_id: str, text: str) -> DataFrame:
    """(log_id, type, detail, file_path, line_no): undefined variables, then configuration syntax errors, in text order."""
    t = F.col(text)
    names = F.transform(F.regexp_extract_all(t, F.lit(r"Config variables are not defined: (\S+)"), F.lit(1)), lambda v: F.struct(F.lit("missing_env_variable").alias("type"), v.alias("detail"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_no")))
    pattern = r"Syntax error on line ([0-9]+) of ([^\n:]+): ([^\n]+)"
    found = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])
    syntax = F.transform(found, lambda x: F.struct(F.lit("apache_config_syntax_error").alias("type"), F.trim(x["c"]).alias("detail"), F.trim(x["b"]).alias("file_path"), x["a"].try_cast("int").alias("line_no")))
    return logs.select(F.col(log_id).alias("log_id"), F.explode(F.concat(names, syntax)).alias("e")).select("log_id", "e.*")


def key_lines(lines: DataFrame, patterns: list[str], most: int = 10) -> DataFrame:
    """(log_id, rank, line): the first ``most`` distinct trimmed lines that match a pattern, any case."""
    hit = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike("(?i)" + "|".join(patterns)))
    first = hit.groupBy("log_id", "line").agg(F.min("line_no").alias("line_no"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy("line_no"))).where(F.col("rank") <= most).select("log_id", "rank", "line")


def diff_churn(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, added, removed, hunks): lines of unified diffs inside texts; ``+++`` and ``---`` headers do not count."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return texts.select(key, (count(r"(?m)^\+") - count(r"(?m)^\+\+\+")).cast("bigint").alias("added"), (count(r"(?m)^-") - count(r"(?m)^---")).cast("bigint").alias("removed"), count(r"(?m)^@@ ").cast("bigint").alias("hunks"))


def diff_artifacts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sign, artifact): distinct artifacts on added or removed diff lines."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"(?m)^([+-])[ \t]*<artifactId>([^<\n]+)</artifactId>"), F.lit(1)).alias("sign"), F.regexp_extract_all(text, F.lit(r"(?m)^([+-])[ \t]*<artifactId>([^<\n]+)</artifactId>"), F.lit(2)).alias("artifact"))
    return texts.select(key, F.explode(F.array_distinct(found)).alias("x")).select(key, "x.sign", "x.artifact")


def env_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name): distinct environment names a text refers to."""
    t = F.col(text)
    # The ways a name is referred to, and the group that holds it.
    patterns = [(r"PUBLISH_[A-Z0-9_]+", 0), (r"AUTHOR_[A-Z0-9_]+", 0), (r"Config variables are not defined: (\S+)", 1), (r"\$\{([A-Z][A-Z0-9_]*)\}", 1), (r"os\.environ\[['\"]([A-Z][A-Z0-9_]*)['\"]\]", 1)]
    return texts.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(g)) for p, g in patterns])))).alias("name"))

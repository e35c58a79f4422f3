"""File-change queries; line items stand in for file changes: file = part, commit = order, author = supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import files as ops
from faultline.operators.executions import latest_by_key
from faultline.sources.tables import table

QUERIES, SQL = {}, {}

_LOG = """WITH changes AS (SELECT l_partkey AS file, l_orderkey AS commit, l_suppkey AS author, l_shipdate AS ts, l_returnflag AS kind, l_linestatus AS message FROM lineitem),
kept AS (SELECT * FROM changes ANTI JOIN (SELECT commit FROM changes GROUP BY commit HAVING count(*) > 6) USING (commit)) """


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("message"))


@query(_LOG + """SELECT file, count(*) AS n_changes, count(DISTINCT author) AS n_authors, max(ts) AS last_change, arg_max(author, (ts, author, message)) AS last_author, arg_max(message, (ts, author, message)) AS last_message, array_to_string(list_sort(list(DISTINCT author)), ',') AS authors
FROM kept GROUP BY file HAVING count(*) >= 25""")
def hot_files(spark, folder):
    changes = ops.without_bulk(_changes(spark, folder), "commit", 6).withColumn("tie", F.struct("author", "message"))
    return ops.hot_files(changes, "file", "author", "ts", "tie", 25, "message").withColumn("authors", F.array_join("authors", ","))


@query(_LOG + "SELECT file, commit, author, ts FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, commit DESC, author DESC) AS r FROM changes) WHERE r = 1")
def latest_per_file(spark, folder):
    changes = _changes(spark, folder)
    return latest_by_key(changes, "file", ["ts", "commit", "author"], ["commit", "author", "ts"]).select("file", "commit", "author", "ts")


@query(_LOG + """, k AS (SELECT author, kind, count(*) AS n FROM changes GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, kind) AS r FROM k),
t AS (SELECT author, string_agg(kind || ':' || n, ',' ORDER BY r) AS top_kinds FROM r WHERE r <= 2 GROUP BY author)
SELECT author, n_files, last_active, top_kinds, modules FROM (SELECT author, count(DISTINCT file) AS n_files, max(ts) AS last_active, string_agg(DISTINCT message, ',' ORDER BY message) AS modules FROM changes GROUP BY author) JOIN t USING (author)""")
def author_ownership(spark, folder):
    return ops.author_ownership(_changes(spark, folder), "author", "file", "kind", "ts", top=2, module="message").withColumn("modules", F.array_join("modules", ","))


@query(_LOG + """SELECT coalesce(kind, 'all') AS kind, coalesce(CAST(year(ts) AS VARCHAR), 'all') AS year, count(*) AS n FROM changes
GROUP BY GROUPING SETS ((kind), (year(ts)), ())""")
def file_summary_grouping_sets(spark, folder):
    rows = _changes(spark, folder).withColumn("y", F.year("ts").cast("string"))
    sets = rows.groupingSets([["kind"], ["y"], []], "kind", "y").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("y", F.lit("all")).alias("year"), "n")


@query(_LOG + """SELECT o_orderkey AS commit, count(DISTINCT file) AS n_hot FROM orders JOIN changes ON commit = o_orderkey
WHERE file IN (SELECT file FROM kept GROUP BY file HAVING count(*) >= 25) GROUP BY 1""")
def hot_intersect(spark, folder):
    commits = table(spark, folder, "orders").select(F.col("o_orderkey").alias("commit"))
    touched = _changes(spark, folder).join(hot_files(spark, folder).select("file"), "file", "left_semi").join(commits, "commit", "left_semi")
    return touched.groupBy("commit").agg(F.count_distinct("file").alias("n_hot"))


@query("SELECT p_partkey AS file FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_partkey IS NOT NULL)")
def deleted_anti(spark, folder):
    live = table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("file"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("file")).join(live, "file", "left_anti")


@query(_LOG + "SELECT commit, author, ts FROM changes WHERE author % 10 <> 0 ORDER BY ts DESC, commit DESC, author DESC LIMIT 1")
def latest_non_bot(spark, folder):
    return _changes(spark, folder).where("author % 10 <> 0").orderBy(F.desc("ts"), F.desc("commit"), F.desc("author")).select("commit", "author", "ts").limit(1)


_PATHS = """WITH paths AS (SELECT log_id, e.file_path AS path, e.line_no AS line_no FROM (SELECT log_id, unnest(errors) AS e FROM parsed_logs) WHERE e.file_path IS NOT NULL) """


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    exploded = table(spark, folder, "parsed_logs").select("log_id", F.explode("errors").alias("e"))
    return exploded.select("log_id", F.col("e.file_path").alias("path"), F.col("e.line_no").alias("line_no")).where("path is not null")


_MODULE = r"""CASE WHEN regexp_matches(path, '(?i)ui\.frontend/') THEN 'ui.frontend' WHEN regexp_matches(path, '(?i)ui\.apps/') THEN 'ui.apps' WHEN regexp_matches(path, '(?i)ui\.content/') THEN 'ui.content'
WHEN regexp_matches(path, '(?i)ui\.config/') THEN 'ui.config' WHEN regexp_matches(path, '(?i)dispatcher|\.conf$|rewrite-.*\.conf') THEN 'dispatcher' WHEN regexp_matches(path, '(?i)pom\.xml$|package\.json$') THEN 'core' WHEN contains(lower(path), 'securitytest') THEN 'security' ELSE 'other' END"""


@query(_PATHS + f"SELECT {_MODULE} AS module, count(*) AS n FROM paths GROUP BY 1")
def module_of_path(spark, folder):
    return _paths(spark, folder).groupBy(ops.module_of_path(F.col("path"))[0].alias("module")).agg(F.count("*").alias("n"))


@query(_PATHS + r"SELECT lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS suffix, split_part(path, '/', 2) AS top, count(*) AS n, count(line_no) AS n_lines FROM paths GROUP BY ALL")
def path_parts(spark, folder):
    paths = _paths(spark, folder).withColumns({"suffix": ops.suffix(F.col("path")), "top": ops.top_level(F.expr("substring(path, 2)"))})
    return paths.groupBy("suffix", "top").agg(F.count("*").alias("n"), F.count("line_no").alias("n_lines"))


@query(_PATHS + f"""SELECT log_id, array_to_string(list_sort(list(DISTINCT m)), ',') AS modules FROM (SELECT log_id, {_MODULE} AS m FROM paths) WHERE m <> 'other' GROUP BY log_id""")
def modules_of_files(spark, folder):
    """The sorted modules of each log's files."""
    logs = table(spark, folder, "parsed_logs").select("log_id", F.transform("errors", lambda e: e["file_path"]).alias("paths"))
    return logs.select("log_id", F.array_join(ops.changed_modules(F.col("paths")), ",").alias("modules")).where("modules <> ''")


@query(_PATHS + f"""SELECT step, count(*) AS n FROM (SELECT {_MODULE} AS module FROM paths) JOIN (VALUES ('ui.frontend', 'build'), ('ui.apps', 'build'), ('ui.content', 'deploy'), ('ui.config', 'securityTest'),
('dispatcher', 'deploy'), ('core', 'build'), ('security', 'securityTest')) AS d(module, step) USING (module) GROUP BY step""")
def steps_of_modules(spark, folder):
    """Files per step that their module tends to fail in."""
    modules = _paths(spark, folder).select(ops.module_of_path(F.col("path"))[0].alias("module"))
    return modules.join(ops.module_steps(spark), "module").groupBy("step").agg(F.count("*").alias("n"))


@query(_PATHS + """, n AS (SELECT DISTINCT program_name, lower(unnest(string_split(program_name, ' '))) AS term FROM programs),
h AS (SELECT DISTINCT program_name, path FROM paths JOIN n ON contains(lower(path), term) WHERE trim(term) <> '')
SELECT program_name, count(*) AS n_refs, array_to_string(list(path ORDER BY path)[1:20], ',') AS refs FROM h GROUP BY program_name""")
def contains_refs(spark, folder):
    """File paths that hold a fragment of a cause (here a word of a program's name), anywhere in the path: how many, and the first 20."""
    terms = table(spark, folder, "programs").select("program_name", F.explode(F.split("program_name", " ")).alias("term"))
    paths = _paths(spark, folder).select("path").distinct()
    return ops.reference_join(paths, "path", "path", terms, "program_name", "term", 20).withColumn("refs", F.array_join("refs", ","))


@query("""WITH n AS (SELECT DISTINCT program_name, lower(unnest(string_split(program_name, ' '))) AS term FROM programs),
h AS (SELECT DISTINCT program_name, doc_id FROM documents JOIN n ON contains(lower(text), term) WHERE trim(term) <> '')
SELECT program_name, count(*) AS n_refs, list(doc_id ORDER BY doc_id)[1:20] AS refs FROM h GROUP BY program_name""")
def contains_refs_substring(spark, folder):
    """Documents that hold any word of a program's name, also inside longer words: how many, and the first 20."""
    terms = table(spark, folder, "programs").select("program_name", F.explode(F.split("program_name", " ")).alias("term"))
    return ops.reference_join(table(spark, folder, "documents"), "doc_id", "text", terms, "program_name", "term", 20)


@query(r"""WITH l AS (SELECT log_id, generate_subscripts(key_lines, 1) AS pos, unnest(key_lines) AS line FROM parsed_logs),
f AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\[[A-Z]+\]') THEN line END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS header FROM l)
SELECT log_id, CAST(pos - 1 AS BIGINT) AS pos, md5(line) AS line_md5, md5(header) AS header_md5 FROM f
WHERE NOT regexp_matches(line, '^\[[A-Z]+\]') AND header IS NOT NULL AND trim(line) <> ''""")
def fill_down_header(spark, folder):
    lines = table(spark, folder, "parsed_logs").select("log_id", F.posexplode("key_lines").alias("pos", "line"))
    filled = ops.parse_change_log(lines, "log_id", "pos", "line", r"^\[[A-Z]+\]")
    return filled.select("log_id", F.col("pos").cast("bigint").alias("pos"), F.md5("line").alias("line_md5"), F.md5("header").alias("header_md5"))

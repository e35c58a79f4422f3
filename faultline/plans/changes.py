"""Repository and diff queries over files and diffs spelled out from the supplier table (one file, one diff a supplier)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import files as fs
from faultline.operators import repo
from faultline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


#: Text expressions that Spark and DuckDB read alike; {k} is the supplier's key.
_K = "CAST(s_suppkey AS STRING)"
_MOD = lambda n: f"CAST(s_suppkey % {n} AS STRING)"
_NL = " || chr(10) || "
_JAVA = f"'public class C' || {_K} || ' extends Base implements S' || {_MOD(7)} || ', T' || {_MOD(11)} || '<X> {{'{_NL}'  S' || {_MOD(13)} || ' s;'{_NL}'}}'"
_CONF = f"'Define A' || {_K} || ' x'{_NL}'use ${{A' || {_MOD(5)} || '}} ${{B' || {_MOD(3)} || '}} ${{ENV}}'"
_DIFF = _NL.join([
    "'diff --git a/pom.xml b/pom.xml'", "'+    <dependency>'", f"'+      <groupId>g' || {_MOD(5)} || '</groupId>'", f"'+      <artifactId>a' || {_MOD(9)} || '</artifactId>'", f"'+      <version>1.' || {_MOD(3)} || '</version>'",
    "'+    </dependency>'", f"'-  <module>m' || {_MOD(4)} || '</module>'", "'diff --git a/ui/package.json b/ui/package.json'", "'   \"dependencies\": {'", f"'+    \"p' || {_MOD(6)} || '\": \"^' || {_MOD(2)} || '.0\"'", "'   }'",
    "'+    \"q\": \"1\"'", "'diff --git a/x/CartInterface.java b/x/CartInterface.java'", f"'-  public void run' || {_MOD(8)} || '(int a);'", "'+  public void go(int a);'",
])
_POM = _NL.join(["'<project>'", "'<version>9-SNAPSHOT</version>'", "'<dependency>'", f"'<artifactId>a' || {_MOD(9)} || '</artifactId>'", f"'<version>1.' || CASE WHEN s_suppkey % 2 = 0 THEN '0-SNAPSHOT' ELSE '0' END || '</version>'", "'</dependency>'"])
_PACKAGE = f"'{{\"dependencies\": {{\"p' || {_MOD(6)} || '\": \"' || CASE WHEN s_suppkey % 3 = 0 THEN '*' ELSE '^1.0' END || '\"}}, \"scripts\": {{\"b\": \"tool --config ./c' || {_MOD(2)} || '.js\"}}}}'"
_XML = f"'<bundle name=\"org.acme.webdav' || {_MOD(2)} || '\"'{_NL}'  org.acme.webdav0 ' || CASE WHEN s_suppkey % 3 = 0 THEN 'Enabled' ELSE 'off' END{_NL}'/>'"


def _texts(spark: SparkSession, folder: str, path: str, text: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr("s_suppkey AS k", f"{path} AS path", f"{text} AS content")


def _ctes(path: str, text: str) -> str:
    """The same rows for DuckDB, and their lines."""
    return f"""WITH f AS (SELECT s_suppkey AS k, {path} AS path, {text} AS content FROM supplier),
l AS (SELECT k, path, CAST(generate_subscripts(p, 1) AS BIGINT) AS line_no, unnest(p) AS line FROM (SELECT k, path, string_split(content, chr(10)) AS p FROM f)) """


_JAVA_PATH, _CONF_PATH = f"'src/C' || {_K} || '.java'", f"'conf/' || {_K} || '.conf'"
_POM_PATH, _PACKAGE_PATH, _XML_PATH = f"'m' || {_K} || '/pom.xml'", f"'u' || {_K} || '/package.json'", f"'ui.config/' || {_K} || '.xml'"


@query(_ctes(_JAVA_PATH, _JAVA) + "SELECT n_nationkey AS nation, 'S' || n_nationkey AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM l WHERE regexp_matches(line, 'implements\\s.*\\bS' || n_nationkey || '\\b'))")
def unresolved_services(spark, folder):
    """Named services that no class implements."""
    uses = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.concat(F.lit("S"), F.col("n_nationkey")).alias("name"))
    return repo.unresolved_references(uses, _texts(spark, folder, _JAVA_PATH, _JAVA), "name").select("nation", "name")


@query(_ctes(_JAVA_PATH, _JAVA) + "SELECT 'S' || n_nationkey AS class_name, path FROM nation JOIN f ON regexp_matches(content, '\\bS' || n_nationkey || '\\b') WHERE path <> 'src/C' || n_nationkey || '.java'")
def class_callers(spark, folder):
    """Files that name a class, without its own."""
    classes = table(spark, folder, "nation").select(F.concat(F.lit("S"), F.col("n_nationkey")).alias("class_name"), F.format_string("src/C%d.java", F.col("n_nationkey")).alias("path"))
    return repo.callers(_texts(spark, folder, _JAVA_PATH, _JAVA), classes)


@query(_ctes(_CONF_PATH, _CONF) + r"""SELECT path, name, min(line_no) AS line_no FROM (SELECT path, line_no, unnest(regexp_extract_all(line, '\$\{(\w+)\}', 1)) AS name FROM l)
WHERE name <> 'ENV' AND name NOT IN (SELECT regexp_extract(line, '^Define (\w+) ', 1) FROM l) GROUP BY ALL""")
def undefined_names(spark, folder):
    return repo.undefined_variables(_texts(spark, folder, _CONF_PATH, _CONF)).withColumn("line_no", F.col("line_no").cast("bigint"))


_PARTS = _ctes("'d'", _DIFF) + r""", h AS (SELECT *, last_value(CASE WHEN starts_with(line, 'diff --git') THEN regexp_extract(line, ' b/(.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS file FROM l) """


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return repo.diff_files(_texts(spark, folder, "'d'", _DIFF), "k", "content")


@query(_PARTS + "SELECT k, file, CAST(count(*) AS BIGINT) AS n_lines FROM h GROUP BY ALL")
def diff_by_file(spark, folder):
    lines = F.size(F.split(F.regexp_replace("part", r"\n$", ""), "\n")).cast("bigint")
    return _parts(spark, folder).select("k", "file", lines.alias("n_lines"))


@query(_PARTS + r"""SELECT k, file, sign, package, version FROM (SELECT k, file, line[1] AS sign, regexp_extract(line, '"([^"]+)": "', 1) AS package, regexp_extract(line, ': "([^"]*)"', 1) AS version FROM h WHERE file = 'ui/package.json' AND regexp_matches(line, '^[+-] +"p'))""")
def diff_packages(spark, folder):
    """Packages changed inside the dependency sections of package files."""
    return repo.npm_changes(_parts(spark, folder), "k")


@query(_PARTS + """SELECT k, '+' AS sign, max(regexp_extract(line, '<groupId>(.*)</groupId>', 1)) AS group_id, max(regexp_extract(line, '<artifactId>(.*)</artifactId>', 1)) AS artifact_id, max(regexp_extract(line, '<version>(.*)</version>', 1)) AS version, CAST(NULL AS VARCHAR) AS scope FROM h WHERE file = 'pom.xml' GROUP BY k""")
def diff_dependencies(spark, folder):
    return repo.maven_dependencies(_parts(spark, folder), "k", "part")


@query(_PARTS + r"SELECT k, file, regexp_extract(line, '(\w+)\(', 1) AS method FROM h WHERE contains(lower(file), 'interface') AND regexp_matches(line, '^-.*public .*\(')")
def diff_removed_methods(spark, folder):
    return repo.removed_methods(_parts(spark, folder), "k", "file", "part")


@query(_PARTS + r"""SELECT DISTINCT * FROM (SELECT k, CASE line[1] WHEN '+' THEN 'artifact_added' ELSE 'artifact_removed' END AS kind, regexp_extract(line, '<artifactId>(.*)</artifactId>', 1) AS name FROM h WHERE regexp_matches(line, '^[+-].*<artifactId>')
UNION ALL SELECT k, CASE line[1] WHEN '+' THEN 'module_added' ELSE 'module_removed' END, regexp_extract(line, '<module>(.*)</module>', 1) FROM h WHERE regexp_matches(line, '^[+-].*<module>')
UNION ALL SELECT k, 'package_added', regexp_extract(line, '"(.*)": "', 1) FROM h WHERE regexp_matches(line, '^\+ .*"..+": "'))""")
def diff_signals(spark, folder):
    """Artifacts, modules and packages of whole diffs."""
    return repo.diff_entries(_texts(spark, folder, "'d'", _DIFF), "k", "content")


@query(_ctes(_POM_PATH, _POM) + "SELECT path, CAST(5 AS BIGINT) AS line_no, 'a' || (k % 9) AS artifact, '1.0-SNAPSHOT' AS version FROM f WHERE k % 2 = 0")
def snapshot_versions(spark, folder):
    return repo.snapshot_dependencies(_texts(spark, folder, _POM_PATH, _POM)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(_ctes(_PACKAGE_PATH, _PACKAGE) + "SELECT path, 'wildcard_version' AS kind, 'p' || (k % 6) AS name, '*' AS value FROM f WHERE k % 3 = 0 UNION ALL SELECT path, 'missing_config', 'b', './c' || (k % 2) || '.js' FROM f WHERE k % 2 = 1 OR k > 5")
def package_scan(spark, folder):
    """Wildcard versions and configurations that no file provides; the first five packages have c0.js."""
    there = table(spark, folder, "supplier").where("s_suppkey <= 5").selectExpr("s_suppkey AS k", f"'u' || {_K} || '/c0.js' AS path", "'' AS content")
    return repo.package_findings(_texts(spark, folder, _PACKAGE_PATH, _PACKAGE).unionByName(there))


@query(_ctes(_XML_PATH, _XML) + "SELECT path, line_no, 'org.acme.webdav0' AS name, 'off in production' AS reason FROM l WHERE contains(line, 'org.acme.webdav0') AND contains(line, 'Enabled')")
def switched_on(spark, folder):
    """Configuration lines that switch on what should be off."""
    return repo.risky_lines(_texts(spark, folder, _XML_PATH, _XML), {"org.acme.webdav0": "off in production"}).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("""WITH f AS (SELECT s_suppkey AS k, '/r' || (s_suppkey % 50) || '/x' || s_suppkey AS path FROM supplier), r AS (SELECT path, split_part(path, '/', 2) AS root, k FROM f)
SELECT a.root, a.path, b.path AS other_path FROM r a JOIN r b ON a.root = b.root AND a.path <> b.path WHERE a.k % 20 = 0""")
def root_conflicts(spark, folder):
    """Filters of a commit (every supplier whose key is divisible by 20) whose root another file of the repository has."""
    rows = table(spark, folder, "supplier").selectExpr("s_suppkey AS k", f"'/r' || {_MOD(50)} || '/x' || {_K} AS path").withColumn("root", repo.vault_root(F.col("path")))
    return repo.root_conflicts(rows.where("k % 20 = 0"), rows)


@query("""WITH t(query, term) AS (VALUES ('missing', 'removed from the registry'), ('missing', 'no space left'), ('network', 'retrying'), ('network', 'handshake'), ('none', '')), h AS (SELECT DISTINCT query, CAST(doc_id AS VARCHAR) AS path FROM documents JOIN t ON term <> '' AND contains(lower(text), term))
SELECT query, path FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY path) AS r FROM h) WHERE r <= 10""")
def error_term_search(spark, folder):
    """Texts found by the terms derived from a kind of error, each once."""
    terms = spark.createDataFrame([("missing", "removed from the Registry"), ("missing", "no space left"), ("network", "retrying"), ("network", "handshake"), ("none", "")], "query string, term string")
    texts = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return repo.term_search(texts, terms, "query", "term")


@query("""SELECT s_suppkey AS k, array_to_string(list_sort(list_distinct(['m' || (s_suppkey % 3), 'm' || (s_suppkey % 5), 'm1'])), ',') AS union_sorted,
array_to_string(CASE WHEN s_suppkey % 2 = s_suppkey % 3 THEN ['b', 'a' || (s_suppkey % 2), 'a'] ELSE ['b', 'a' || (s_suppkey % 2), 'a' || (s_suppkey % 3), 'a'] END, ',') AS union_ordered FROM supplier""")
def module_unions(spark, folder):
    """The sorted union of two module lists, and the union of two lists that keeps their order (first list first)."""
    m = lambda c, n: F.concat(F.lit(c), (F.col("s_suppkey") % n).cast("string"))
    rows = table(spark, folder, "supplier")
    return rows.select(
        F.col("s_suppkey").alias("k"), F.array_join(F.sort_array(F.array_union(F.array(m("m", 3), m("m", 5)), F.array(F.lit("m1")))), ",").alias("union_sorted"),
        F.array_join(F.array_union(F.array(F.lit("b"), m("a", 2)), F.array(m("a", 3), F.lit("a"), F.lit("b"))), ",").alias("union_ordered"),
    )


_ROLE = lambda p: f"coalesce(bool_or(regexp_matches(p, '(?i){p}')), false)"


@query(f"""SELECT log_id, {_ROLE('(^|/)pom[.]xml$|package[.]json$|package-lock[.]json$')} AS dependency, {_ROLE('[.](conf|vhost|vars|any)$')} AS config, {_ROLE('auth|acl|login|oauth|saml|security|password|token')} AS security,
{_ROLE('test|spec|/it/')} AS test, {_ROLE('(^|/)Jenkinsfile$|[.](yml|yaml)$|(^|/)Dockerfile$')} AS cicd, {_ROLE('[.](java|js|ts|jsx|tsx|groovy)$')} AS app
FROM (SELECT log_id, unnest(CASE WHEN len(errors) > 0 THEN list_transform(errors, lambda e: e.file_path) ELSE [NULL] END) AS p FROM parsed_logs) GROUP BY log_id""")
def file_roles(spark, folder):
    """Which kinds of files each log's errors name."""
    return table(spark, folder, "parsed_logs").select("log_id", repo.file_roles(F.transform("errors", lambda e: e["file_path"])).alias("r")).select("log_id", "r.*")


@query("""SELECT doc_id, list_filter(list_transform(string_split(source || ' | ' || coalesce(repo, '') || '|' || coalesce(step, ''), '|'), lambda x: trim(x)), lambda x: x <> '')[1] AS first_file,
CAST(len(list_filter(list_transform(string_split(source || ' | ' || coalesce(repo, '') || '|' || coalesce(step, ''), '|'), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_files FROM documents WHERE source IS NOT NULL""")
def piped_files(spark, folder):
    """Names recovered from one text that a pipe parts."""
    text = F.concat(F.col("source"), F.lit(" | "), F.coalesce("repo", F.lit("")), F.lit("|"), F.coalesce("step", F.lit("")))
    parts = fs.piped(text)
    return table(spark, folder, "documents").where("source is not null").select("doc_id", F.get(parts, F.lit(0)).alias("first_file"), F.size(parts).cast("bigint").alias("n_files"))

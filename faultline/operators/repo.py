"""Repository and diff scanning: files as rows (path, content), diffs as texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that the server's base installation defines.
BUILT_IN_NAMES = [
    "DISP_LOG_LEVEL", "REWRITE_LOG_LEVEL", "DISP_ID",
    "PUBLISH_IP", "PUBLISH_FQDN", "PUBLISH_DEFAULT_HOSTNAME", "PUBLISH_DOCROOT", "PUBLISH_PORT", "PUBLISH_FORCE_SSL", "PUBLISH_WHITELIST_ENABLED",
    "AUTHOR_IP", "AUTHOR_FQDN", "AUTHOR_DEFAULT_HOSTNAME", "AUTHOR_DOCROOT", "AUTHOR_PORT", "AUTHOR_FORCE_SSL", "AUTHOR_WHITELIST_ENABLED",
    "LIVECYCLE_IP", "LIVECYCLE_PORT", "LIVECYCLE_DOCROOT", "LIVECYCLE_DEFAULT_HOSTNAME", "LIVECYCLE_WHITELIST_ENABLED", "LIVECYCLE_FORCE_SSL",
    "EXPIRATION_TIME", "CRX_FILTER", "ENV",
]


def repo_lines(files: DataFrame) -> DataFrame:
    r"""(path, line_no, line) of files (path, content), numbered from 1; ``\r\n`` counts as one break; NULL contents give nothing."""
    plain = F.regexp_replace("content", "\r\n?", "\n")
    return files.select("path", F.posexplode(F.split(plain, "\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def undefined_variables(files: DataFrame, built_in: Sequence[str] = BUILT_IN_NAMES) -> DataFrame:
    """(path, name, line_no): first use per file of each ``${NAME}`` that no file defines and that is not built in."""
    lines = repo_lines(files)
    uses = lines.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\$\{(\w+)\}"), F.lit(1))).alias("name"))
    defined = lines.select(F.regexp_extract("line", r"^\s*(?:Define\s+|export\s+)?([A-Za-z_]\w*)(?:\s*=|\s+\S)", 1).alias("name")).where("name <> ''").distinct()
    return uses.where(~F.col("name").isin(list(built_in))).groupBy("path", "name").agg(F.min("line_no").alias("line_no")).join(defined, "name", "left_anti").select("path", "name", "line_no")


def unresolved_references(uses: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Rows of ``uses`` whose ``name`` stands after ``implements`` in no line of any file; NULL names are unresolved."""
    tails = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"implements\s([^{\n]*)"), F.lit(1))).alias("t"))
    implemented = tails.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias(name)).distinct()
    return uses.join(implemented, name, "left_anti")


def callers(files: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_name, path): other files that name a class as a whole word.  ``classes``: class_name, path of its own file.

    Files are cut into words and joined on equality; the word list of a file is made distinct before it is exploded.
    """
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("class_name"))
    own = classes.select("class_name", F.col("path").alias("_own"))
    return words.join(own, "class_name").where(F.col("path") != F.col("_own")).select("class_name", "path")


def duplicate_roots(filters: DataFrame) -> DataFrame:
    """(root, path, pos): second and later filters of each root, by position.  ``filters``: path, pos, root; NULL roots are none.

    The first filter of each root is an aggregate joined back, so a root with a third of all rows is no one task's window.
    """
    kept = filters.where("root is not null").select("root", "path", "pos")
    first = kept.groupBy("root").agg(F.min(F.struct("pos", "path")).alias("_first"))
    return kept.join(first, "root").where(~F.struct("pos", "path").eqNullSafe(F.col("_first"))).select("root", "path", "pos")


def package_findings(files: DataFrame) -> DataFrame:
    """(path, kind, name, value) of package.json files: wildcard versions and scripts whose ``--config`` file is missing; bad JSON has none."""
    parsed = files.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("j", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>"))
    none = F.create_map().cast("map<string,string>")
    deps = parsed.select("path", F.explode(F.array_union(F.map_entries(F.coalesce("j.dependencies", none)), F.map_entries(F.coalesce("j.devDependencies", none)))).alias("e"))
    wild = deps.where(F.col("e.value").isin("*", "latest", "next")).select("path", F.lit("wildcard_version").alias("kind"), F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    scripts = parsed.select("path", F.explode(F.map_entries(F.coalesce("j.scripts", none))).alias("e")).select("path", F.col("e.key").alias("name"), F.regexp_extract("e.value", r"--config[= ](\S+)", 1).alias("value")).where("value <> ''")
    base = F.regexp_replace("path", r"[^/]*$", "")
    there = files.select(F.col("path").alias("_there"))
    missing = scripts.withColumn("_there", F.concat(base, F.regexp_replace("value", r"^\./", ""))).join(there, "_there", "left_anti").select("path", F.lit("missing_config").alias("kind"), "name", "value")
    return wild.unionByName(missing)


def snapshot_dependencies(files: DataFrame) -> DataFrame:
    """(path, line_no, artifact, version): SNAPSHOT versions inside dependency blocks of pom.xml files."""
    lines = repo_lines(files.where(F.col("path").rlike(r"(^|/)pom\.xml$")))
    over = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.regexp_count("line", F.lit("<dependency>")) - F.regexp_count("line", F.lit("</dependency>"))).over(over)
    artifact = F.last(F.nullif(F.regexp_extract("line", r"<artifactId>([^<]+)</artifactId>", 1), F.lit("")), ignorenulls=True).over(over)
    found = lines.withColumns({"depth": depth, "artifact": artifact, "version": F.regexp_extract("line", r"<version>([^<]*-SNAPSHOT)</version>", 1)})
    return found.where("version <> '' and depth > 0").select("path", "line_no", "artifact", "version")


def nearby_directive(files: DataFrame, directive: str, context: str, within: int = 10) -> DataFrame:
    """(path, line_no, line): lines matching ``directive`` with a line matching ``context`` among the ``within`` before."""
    over = Window.partitionBy("path").orderBy("line_no").rowsBetween(-within, -1)
    near = F.max(F.col("line").rlike(context).cast("int")).over(over)
    return repo_lines(files).withColumn("near", near).where(F.col("line").rlike(directive) & (F.col("near") == 1)).select("path", "line_no", "line")


def search(files: DataFrame, text: str, most: int = 10) -> DataFrame:
    """The first ``most`` paths whose content holds ``text``, any case."""
    return files.where(F.contains(F.lower("content"), F.lit(text.lower()))).select("path").orderBy("path").limit(most)


def locate(errors: DataFrame, files: DataFrame, width: int = 15) -> DataFrame:
    """(key, path, line_no, snippet): source windows around errors (key, path, line_no), the line marked ``>>>``; errors elsewhere are dropped.

    A path matches by its end, so build-machine prefixes do not matter; the join is on the file name, then filtered.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    wanted = errors.select("key", F.col("path").alias("_wanted"), F.col("line_no").alias("_at"), name("path").alias("_name")).where("_at is not null")
    lines = repo_lines(files).withColumn("_name", name("path"))
    near = lines.join(wanted, "_name").where((F.col("path").endswith(F.col("_wanted")) | F.col("_wanted").endswith(F.col("path"))) & (F.abs(F.col("line_no") - F.col("_at")) <= width))
    text = F.format_string("%s %4d | %s", F.when(F.col("line_no") == F.col("_at"), ">>>").otherwise("   "), F.col("line_no"), F.col("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), "\n")
    return near.groupBy("key", "path", "_at").agg(joined.alias("snippet")).select("key", "path", F.col("_at").alias("line_no"), "snippet")


def diff_files(commits: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, file, part): unified diffs split by file; text before the first file header belongs to none."""
    parts = F.split(F.col(diff), r"(?m)^(?=diff --git a/)")
    rows = commits.select(key, F.explode(parts).alias("part")).where(F.col("part").startswith("diff --git a/"))
    return rows.select(key, F.regexp_extract("part", r"^diff --git a/(\S+) b/", 1).alias("file"), "part")


def npm_changes(parts: DataFrame, key: str) -> DataFrame:
    """(key, file, sign, package, version): changed entries inside the dependency sections of package.json diffs."""
    lines = parts.where(F.col("file").endswith("package.json")).select(key, "file", F.posexplode(F.split("part", "\n")).alias("p", "line"))
    over = Window.partitionBy(key, "file").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("line").rlike(r'"(?:devD|peerD|d)ependencies"\s*:\s*\{'), F.col("line").rlike(r"^[+\- ]?\s*\}")
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(over)
    inside = lines.withColumn("inside", F.coalesce(state, F.lit(False)))
    pattern = r'^([+-])\s*"([^"]+)"\s*:\s*"([^"]*)"'
    found = inside.where(F.col("inside") & F.col("line").rlike(pattern))
    return found.select(key, "file", *[F.regexp_extract("line", pattern, i).alias(n) for i, n in ((1, "sign"), (2, "package"), (3, "version"))])


#: Role of a file -> pattern of its path (any case).
FILE_ROLES = {
    "dependency": r"(^|/)pom\.xml$|package\.json$|package-lock\.json$", "config": r"\.(conf|vhost|vars|any)$", "security": "(auth|acl|login|oauth|saml|security|password|token)",
    "test": "(test|spec|/it/)", "cicd": r"(^|/)Jenkinsfile$|\.(yml|yaml)$|(^|/)Dockerfile$", "app": r"\.(java|js|ts|jsx|tsx|groovy)$",
}


def file_roles(paths: Column) -> Column:
    """Struct of flags over an array of paths: which kinds of files are among them; NULL paths count for none."""
    some = lambda p: F.coalesce(F.exists(paths, lambda x: F.coalesce(x.rlike("(?i)" + p), F.lit(False))), F.lit(False))
    return F.struct(*[some(p).alias(n) for n, p in FILE_ROLES.items()])


def security_nodes(lines: DataFrame) -> DataFrame:
    """(log_id, n, node, check, reason) of security logs: each failed check with its number, the node line above it, and the last warning before the next failure.

    A node is a non-blank line that, trimmed, starts with no dash and says none
    of Failed, Passed, WARN or INFO.
    """
    over = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.trim("line")
    is_node = (line != "") & ~line.startswith("-") & ~line.rlike("Failed|Passed|WARN|INFO")
    failed, warned = line.contains("- Failed"), line.startswith("WARN -")
    marked = lines.withColumns({"node": F.last(F.when(is_node, line), ignorenulls=True).over(over), "n": F.sum(F.when(failed, 1).otherwise(0)).over(over)}).where("n > 0")
    strip = lambda c, w: F.trim(F.replace(c, F.lit(w), F.lit("")))
    grouped = marked.groupBy("log_id", "n").agg(F.min_by(F.struct("node", strip(line, "- Failed").alias("check")), "line_no").alias("x"), F.max_by(F.when(warned, strip(line, "WARN -")), F.when(warned, F.col("line_no"))).alias("reason"))
    return grouped.select("log_id", "n", "x.node", "x.check", "reason")


def failed_on_all_nodes(checks: DataFrame) -> DataFrame:
    """(log_id, check): checks that failed on as many lines as their log has nodes."""
    nodes = checks.groupBy("log_id").agg(F.count_distinct("node").alias("nodes"))
    return checks.groupBy("log_id", "check").agg(F.count("*").alias("n")).join(nodes, "log_id").where("n = nodes").select("log_id", "check")


def root_conflicts(filters: DataFrame, others: DataFrame) -> DataFrame:
    """(root, path, other_path): filters whose root another file of the repository has too.  Both sides: path, root; the own file does not count."""
    theirs = others.where("root is not null").select("root", F.col("path").alias("other_path")).distinct()
    return filters.where("root is not null").select("root", "path").distinct().join(theirs, "root").where(F.col("path") != F.col("other_path"))


def vault_root(path: Column) -> Column:
    """The second component of a repository path; a path without slash is its own root."""
    return F.when(F.contains(path, F.lit("/")), F.split(path, "/")[1]).otherwise(path)


def maven_dependencies(parts: DataFrame, key: str, part: str) -> DataFrame:
    """(key, sign, group_id, artifact_id, version, scope): whole dependency blocks that a diff adds or removes; blocks without group or artifact are none."""
    block = F.explode(F.regexp_extract_all(F.col(part), F.lit(r"(?m)^([+-]\s*<dependency>\s*\n(?:(?!</dependency>)[^\n]*\n)*?\s*[+-]?\s*</dependency>)"), F.lit(1))).alias("b")
    field = lambda name: F.nullif(F.trim(F.regexp_extract("b", f"<{name}>([^<]+)</{name}>", 1)), F.lit("")).alias({"groupId": "group_id", "artifactId": "artifact_id"}.get(name, name))
    found = parts.select(F.col(key), block)
    return found.select(F.col(key), F.substring("b", 1, 1).alias("sign"), field("groupId"), field("artifactId"), field("version"), field("scope")).where("group_id is not null and artifact_id is not null")


def removed_methods(parts: DataFrame, key: str, file: str, part: str) -> DataFrame:
    """(key, file, method): public methods that a diff removes from interface files, in any order."""
    rows = parts.where(F.lower(F.col(file)).contains("interface")).select(F.col(key), F.col(file), F.explode(F.split(F.col(part), "\n")).alias("line"))
    gone = rows.where(F.col("line").startswith("-") & F.col("line").contains("public ") & F.col("line").contains("("))
    return gone.select(F.col(key), F.col(file), F.regexp_extract("line", r"(\w+)\s*\(", 1).alias("method")).where("method <> ''")


def diff_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name): distinct artifacts and modules that a diff adds or removes, and packages it adds."""
    kinds = {
        "artifact_added": r"(?m)^\+(?!\+\+).*<artifactId>([^<]+)</artifactId>", "artifact_removed": r"(?m)^-(?!--).*<artifactId>([^<]+)</artifactId>",
        "module_added": r"(?m)^\+(?!\+\+)\s*<module>([^<]+)</module>", "module_removed": r"(?m)^-(?!--)\s*<module>([^<]+)</module>", "package_added": r'(?m)^\+\s+"([^"@][^"]+)":\s+"',
    }
    named = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))
    found = F.flatten(F.array(*[named(k, p) for k, p in kinds.items()]))
    return texts.select(key, F.explode(F.array_distinct(found)).alias("x")).select(key, "x.kind", "x.name")


def risky_lines(files: DataFrame, names: dict[str, str], switches: str = "enabled|true|active") -> DataFrame:
    """(path, line_no, name, reason): lines that name one of ``names`` (-> reason) and look like switching it on."""
    lines = repo_lines(files)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("reason")) for n, r in names.items()])).alias("x")
    return lines.where(F.lower("line").rlike(switches)).select("path", "line_no", "line", pairs).where(F.contains("line", F.col("x.name"))).select("path", "line_no", "x.name", "x.reason")


def term_search(files: DataFrame, terms: DataFrame, query: str, term: str, most: int = 10) -> DataFrame:
    """(query, path): the first ``most`` paths whose content holds any of a query's terms, each path once.

    ``terms`` are the few terms derived from one kind of error each.  Every
    text is compared with every distinct term; paths are cut per query after
    an aggregate that makes them distinct.
    """
    wanted = terms.where(F.trim(term) != "").select(F.col(query).alias("_q"), F.lower(term).alias("_t")).distinct()
    hits = files.where("content is not null").join(wanted, F.contains(F.lower("content"), F.col("_t"))).select("_q", "path").distinct()
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("path"))).where(F.col("_r") <= most)
    return ranked.select(F.col("_q").alias(query), "path")

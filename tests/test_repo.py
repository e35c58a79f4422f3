from pyspark.sql import functions as F

from faultline.operators import repo, retrieval


def files(spark, content):
    return spark.createDataFrame([(*x, "clash") for x in content.items()], "path string, content string, line string")


def test_variables(spark, rows):
    df = files(spark, {"a.conf": "Define HOST x\nuse ${HOST} ${PORT}\r\n${PORT} ${PUBLISH_IP}", "b.vars": "PORTAL=1\n${PORTAL}", "c": None})
    assert rows(repo.undefined_variables(df)) == [("a.conf", "PORT", 2)]


def test_references_and_callers(spark, rows):
    df = files(spark, {"A.java": "class A implements Shop { }", "B.java": "interface X extends Base {} // Shop", "C.java": "uses Shops only"})
    uses = spark.createDataFrame([("Shop",), ("Cart",), (None,)], "name string")
    assert rows(repo.unresolved_references(uses, df, "name")) == [("Cart",), (None,)]
    many = files(spark, {"D.java": "class D<T> extends Base implements\tSvc, Other<Shop> {\n}"})
    wanted = spark.createDataFrame([("Svc",), ("Other",), ("Base",)], "name string")
    assert rows(repo.unresolved_references(wanted, many, "name")) == [("Base",)]
    assert rows(repo.callers(df, spark.createDataFrame([("Shop", "A.java")], "class_name string, path string"))) == [("Shop", "B.java")]


def test_roots(spark, rows):
    df = spark.createDataFrame([("p", 1, "/a"), ("q", 2, "/a"), ("r", 3, "/b"), ("s", 4, None)], "path string, pos int, root string")
    assert rows(repo.duplicate_roots(df)) == [("/a", "q", 2)]


def test_packages_and_poms(spark, rows):
    df = files(spark, {"ui/package.json": '{"dependencies": {"a": "*", "b": "1"}, "devDependencies": {"c": "latest"}, "scripts": {"x": "w --config ./gone.js", "y": "w --config there.js"}}', "ui/there.js": "", "package.json": "{bad", "pom.xml": "<version>9-SNAPSHOT</version>\n<dependency>\n<artifactId>k</artifactId>\n<version>1-SNAPSHOT</version>\n</dependency>"})
    assert rows(repo.package_findings(df)) == [("ui/package.json", "missing_config", "x", "./gone.js"), ("ui/package.json", "wildcard_version", "a", "*"), ("ui/package.json", "wildcard_version", "c", "latest")]
    assert rows(repo.snapshot_dependencies(df)) == [("pom.xml", 4, "k", "1-SNAPSHOT")]
    assert rows(repo.search(df, "SNAPSHOT")) == [("pom.xml",)]


def test_directive_and_locate(spark, rows):
    df = files(spark, {"src/a.conf": "<Directory /web>\nx\nAllowOverride All\n" + "\n" * 12 + "AllowOverride All"})
    assert rows(repo.nearby_directive(df, "AllowOverride All", "<Directory")) == [("src/a.conf", 3, "AllowOverride All")]
    errors = spark.createDataFrame([(1, "/build/src/a.conf", 2), (2, "b.conf", 1), (3, "a.conf", None)], "key int, path string, line_no int")
    assert rows(repo.locate(errors, df, 1)) == [(1, "src/a.conf", 2, "       1 | <Directory /web>\n>>>    2 | x\n       3 | AllowOverride All")]


def test_diffs(spark, rows):
    diff = 'title\ndiff --git a/package.json b/package.json\n   "dependencies": {\n-    "a": "1"\n+    "a": "2"\n   }\n+  "name": "x"\ndiff --git a/x.java b/x.java\n+y'
    parts = repo.diff_files(spark.createDataFrame([(1, diff), (2, None), (3, "")], "id int, d string"), "id", "d")
    assert rows(parts.select("id", "file")) == [(1, "package.json"), (1, "x.java")]
    assert rows(repo.npm_changes(parts, "id").select("sign", "package", "version")) == [("+", "a", "2"), ("-", "a", "1")]
    flags = spark.createDataFrame([(["core/pom.xml", "it.tests/A.java"],), ([],), (None,)], "p array<string>").select(repo.file_roles(F.col("p")).alias("r")).select("r.*")
    assert [tuple(r) for r in flags.collect()] == [(True, False, False, True, False, True), (False,) * 6, (False,) * 6]


def test_security_log(spark, rows):
    texts = ["node one", "c1 - Failed", "WARN - old", "WARN - open", "c2 - Failed", "node two", "c1 - Failed", " - INFO"]
    df = spark.createDataFrame([("L", i, t) for i, t in enumerate(texts)], "log_id string, line_no int, line string")
    checks = repo.security_nodes(df)
    assert rows(checks) == [("L", 1, "node one", "c1", "open"), ("L", 2, "node one", "c2", None), ("L", 3, "node two", "c1", None)]
    assert rows(repo.failed_on_all_nodes(checks)) == [("L", "c1")]


def test_incidents(spark, rows):
    df = spark.createDataFrame([(1, 1, "build", "disk is full on node"), (1, 2, "build", "disk is full on nodes"), (1, 3, "deploy", "disk is full on node"), (1, 4, "build", None), (2, 1, None, "x")], "q int, rank int, step string, cause string").withColumn("fix", F.lit("clean the disk"))
    assert rows(retrieval.distinct_incidents(df.withColumn("fix", F.concat("fix", F.lit("abcdefgh").substr(F.col("rank"), F.lit(9)), F.repeat(F.col("rank").cast("string"), F.lit(40)))), "q", "rank", "step", "cause", "fix").select("q", "rank")) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]
    assert rows(retrieval.distinct_incidents(df, "q", "rank", "step", "cause", "fix").select("q", "rank")) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    ids = spark.createDataFrame([("12",), ("risk-ab12-build",), ("report:x:3",), (None,)], "i string")
    assert [r[0] for r in ids.select(retrieval.incident_source(F.col("i"))).collect()] == ["execution", "prediction", "report", "other"]
    assert spark.range(1).select(retrieval.sentences(F.lit("Short. This one is long enough to stay! And so is this other one."))).first()[0] == ["This one is long enough to stay!", "And so is this other one."]


def test_noise(spark, rows):
    lines = spark.createDataFrame([("started worker for pool alpha at noon",), ("worker for pool alpha",), ("something else entirely here",), ("",), (None,)], "line string")
    templates = spark.createDataFrame([("worker for pool alpha at noon",), ("short",), (None,)], "template string")
    assert rows(retrieval.noise_lines(lines, "line", templates, "template")) == [("started worker for pool alpha at noon",), ("worker for pool alpha",)]

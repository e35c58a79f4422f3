import json

from pyspark.sql import functions as F

from faultline.operators import repo, retrieval, routes


def test_prediction_marks(spark):
    df = spark.createDataFrame([("risk_analysis", None, None), (None, "risk_prediction_x", None), ("p", "e", "risk-1"), ("p", "e", "1"), (None, None, None)], "p string, e string, x string")
    assert [r[0] for r in df.select(routes.is_prediction(F.col("p"), F.col("e"), F.col("x"))).collect()] == [True, True, True, False, False]


def test_wildcards(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "c string, d string")
    assert routes.matching(df, {"c": "All", "d": ""}).count() == 2 and routes.matching(df, {"c": "b", "d": None}).count() == 1


def test_relational_and_pattern_routes(spark, rows):
    causes = spark.createDataFrame([("deploy", "missing_env"), (None, "oom"), ("build", None)], "step string, error_type string")
    asked = spark.createDataFrame([(1, "deploy", "missing_env_variable"), (2, "build", "oom"), (3, "", "")], "query_id int, step string, error_type string")
    found = routes.relational_route(causes, asked)
    assert rows(found.select("query_id", "step", "error_type")) == [(1, "deploy", "missing_env"), (2, "build", None), (2, None, "oom"), (3, "build", None), (3, "deploy", "missing_env"), (3, None, "oom")]
    patterns = spark.createDataFrame([("site-dev", "build", 4), ("prod", "build", 40), (None, None, 1)], "pipeline string, step string, n int")
    asked = spark.createDataFrame([(1, "dev", "build"), (2, None, "deploy")], "query_id int, pipeline string, step string")
    assert rows(routes.pattern_route(patterns, asked).select("query_id", "n", "match_score")) == [(1, 1, 0.1), (1, 4, 0.4), (2, 1, 0.1)]


def test_known_causes(spark, rows):
    error = [("missing_env_variable", "Undefined variable: A"), ("other", "see rewrite-onpremises"), ("other", "no")]
    df = spark.createDataFrame([("build", "missing_npm_module", "m", []), ("build", "missing_npm_module", "m", None), ("deploy", "x", None, error), ("deploy", None, None, error[:1]), (None, None, None, None)], "step string, error_type string, error_message string, errors array<struct<type:string,detail:string>>")
    assert rows(routes.known_causes(df).select("error_type", "detail", "occurrence_count")) == [("missing_env_variable", "A", 1), ("missing_npm_module", "m", 2), ("other", "see rewrite-onpremises", 1)]


def test_texts(spark):
    df = spark.createDataFrame([("a", None, ["x", "y"]), (None, None, None)], "s string, e string, l array<string>")
    got = df.select(routes.candidate_text([F.col("s"), F.col("e"), F.lit("z")], 2), routes.embedded_text(F.col("s"), F.col("e"), F.col("e"), F.col("l"), F.col("e"), F.col("e")), routes.hypothetical_text(F.col("s"), F.col("e")), routes.query_variant(F.col("s"))).collect()
    assert tuple(got[0]) == ("a ", "step:a error_type:\nerror: \nlog lines: x | y\nroot cause: \nfix: ", "Root cause: a\nRecommended fix for the failed pipeline.", "a")
    assert got[1][0] == "z" and got[1][3] is None


def test_json_repair(spark):
    texts = ['{"a": 1}', '```json\n{"a": [1, 2]}\n```', '{"a": 1, "b": [1, {"c": 2', '{"a": "cut of', '{"a": 1, "b', '{"a": 1, "b": "x", ', "no json", None, '{"a": "brace } in \\" text"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] and json.loads(r[1]) for r in df.select("i", routes.repaired_json("t")).orderBy("i").collect()]
    assert got == [{"a": 1}, {"a": [1, 2]}, {"a": 1, "b": [1, {"c": 2}]}, {"a": ""}, {"a": 1}, {"a": 1, "b": "x"}, None, None, {"a": 'brace } in " text'}]


def test_fusion_per_query(spark, rows):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, k string, rank bigint")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (2, "x", 1)], "q int, k string, rank bigint")
    assert rows(retrieval.merge_per_query([a, b], "q", "k", 1)) == [(1, "x", 0, 1), (1, "z", 1, 1), (2, "x", 1, 1)]


def test_diff_blocks(spark, rows):
    part = "diff --git a/pom.xml b/pom.xml\n+    <dependency>\n+      <groupId>g</groupId>\n+      <artifactId>a</artifactId>\n+    </dependency>\n-<dependency>\n-<artifactId>lone</artifactId>\n-</dependency>\n"
    df = spark.createDataFrame([(1, "XInterface.java", part), (2, "XInterface.java", "-  public int f(int a);\n+  public int g();\n-  private h();"), (3, "X.java", "-  public int f();"), (4, None, None)], "k int, file string, part string")
    assert rows(repo.maven_dependencies(df, "k", "part")) == [(1, "+", "g", "a", None, None)]
    assert rows(repo.removed_methods(df, "k", "file", "part").select("k", "method")) == [(2, "f")]
    assert rows(repo.diff_entries(df.where("k = 1"), "k", "part").select("kind", "name")) == [("artifact_added", "a"), ("artifact_removed", "lone")]
    assert [r[0] for r in spark.createDataFrame([("/a/b",), ("c",), (None,)], "p string").select(repo.vault_root(F.col("p"))).collect()] == ["a", "c", None]

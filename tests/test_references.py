"""Substring references."""

from faultline.operators import files


def test_reference_join_inside_words(spark):
    texts = spark.createDataFrame([(3, "see canyon.idx"), (1, "CANYON-7 and coral-thicket"), (2, "präfix/übung eins"), (4, "none"), (5, None), (1, "canyon again")], "k int, t string")
    terms = spark.createDataFrame([("a", "Canyon"), ("a", "thicket"), ("b", "Übung eins"), ("c", " "), ("c", None), ("d", "absent")], "o string, w string")
    got = {r["o"]: (r["n_refs"], r["refs"]) for r in files.reference_join(texts, "k", "t", terms, "o", "w", 20).collect()}
    assert got == {"a": (2, [1, 3]), "b": (1, [2])}


def test_reference_join_caps_keys_not_count(spark):
    texts = spark.range(50).selectExpr("id as k", "'xanvilx' as t")
    got = files.reference_join(texts, "k", "t", spark.createDataFrame([("a", "ANVIL")], "o string, w string"), "o", "w", 20).collect()
    assert [(r["n_refs"], r["refs"]) for r in got] == [(50, list(range(20)))]

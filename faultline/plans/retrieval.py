"""Retrieval, similarity, template and prediction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number_long
from faultline.functions.instants import add_utc_micros
from faultline.operators import drain
from faultline.operators import executions as ex
from faultline.operators import loglines
from faultline.operators import retrieval as ops
from faultline.operators.timenorm import with_zones
from faultline.plans.executions import _EID, VIEWS
from faultline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def bm25_sql(asked: str, k: int) -> str:
    """Okapi scores of ``asked`` (query_id, query_text) against all documents, the best ``k``."""
    return rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_./\-:]+') AS t FROM documents WHERE text IS NOT NULL),
len AS (SELECT doc_id, len(t) AS dl FROM t), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, tot GROUP BY term, n),
fl AS (SELECT avg(idf) * 0.25 AS floor FROM idf),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-zA-Z0-9_./\-:]+')) AS term FROM ({asked})) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(qf * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM q JOIN post USING (term) JOIN idf USING (term) JOIN len USING (doc_id), tot, fl GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


@query(bm25_sql("SELECT item_id AS query_id, item_text AS query_text FROM eval_items WHERE item_id % 20 = 0", 10))
def bm25_topk(spark, folder):
    """Queries: every item whose id is divisible by 20, against all documents."""
    return ops.bm25_topk(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items").where("item_id % 20 = 0"), "item_id", "item_text", 10)


def knn_sql(condition: str, floor: str, k: int) -> str:
    return f"""SELECT query_id, rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0 {condition}) {floor}) WHERE rank <= {k}"""


@query(knn_sql("", "", 5))
def knn_topk(spark, folder):
    """Queries: every vector whose id is divisible by 20, against all vectors."""
    vectors = table(spark, folder, "embeddings")
    return ops.knn_topk(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), 5)


@query(knn_sql("AND (b.label = 3 OR b.label = 7)", "WHERE similarity >= 0.1", 5))
def knn_filtered(spark, folder):
    """The same over the rows of two labels, with a floor."""
    vectors = table(spark, folder, "embeddings")
    return ops.knn_topk(vectors.where("label = 3 or label = 7"), "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), 5, least=0.1)


@query("""WITH m AS (SELECT label, d, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY d) AS c FROM m GROUP BY label)
SELECT CAST(a.label AS BIGINT) AS label_a, CAST(b.label AS BIGINT) AS label_b, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM c a JOIN c b ON a.label < b.label""")
def centroid_similarity(spark, folder):
    """Cosine between the centroids of labels; the number of labels is fixed, the rows are aggregated first."""
    c = ops.centroids(table(spark, folder, "embeddings"), "label", "embedding")
    a, b = c.select(F.col("label").alias("label_a"), F.col("centroid").alias("ca")), c.select(F.col("label").alias("label_b"), F.col("centroid").alias("cb"))
    return a.join(b, F.col("label_a") < F.col("label_b")).select(F.col("label_a").cast("bigint").alias("label_a"), F.col("label_b").cast("bigint").alias("label_b"), F.round(ops.cosine(F.col("ca"), F.col("cb")), 6).alias("similarity"))


@query()
def pca_2d(spark, folder):
    return ops.principal_components(table(spark, folder, "embeddings"), "vec_id", "embedding", 2)


@query("SELECT CAST(0 AS DOUBLE) AS mean_1, CAST(0 AS DOUBLE) AS mean_2, CAST(0 AS DOUBLE) AS covariance, true AS in_order, true AS shares_fit")
def pca_moments(spark, folder):
    """What principal components must hold: centred, uncorrelated, the first the wider, and variances in the shares stated."""
    vectors = table(spark, folder, "embeddings")
    shares = ops.principal_axes(vectors, "embedding", 2)[2].tolist()
    pc = ops.principal_components(vectors, "vec_id", "embedding", 2).select(F.col("pc")[0].alias("a"), F.col("pc")[1].alias("b"))
    zero = lambda c: F.round(F.abs(c), 6)
    ratio = F.abs(F.var_pop("b") / F.var_pop("a") - shares[1] / shares[0]) < 1e-6
    return pc.agg(zero(F.avg("a")).alias("mean_1"), zero(F.avg("b")).alias("mean_2"), zero(F.covar_pop("a", "b")).alias("covariance"), (F.var_pop("a") >= F.var_pop("b")).alias("in_order"), ratio.alias("shares_fit"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) ELSE 0.0 END, 6) AS jaccard
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def jaccard_neighbours(spark, folder):
    """Word-set similarity of each document and the one with the next id."""
    words = table(spark, folder, "documents").where("text is not null").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("t"))
    following = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return words.join(following, "doc_id").select("doc_id", F.round(ops.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("""WITH r AS (SELECT doc_id, 0 AS route, -n_chars AS pos FROM documents WHERE step = 'build' UNION ALL SELECT doc_id, 1, -n_chars FROM documents WHERE source = 'runbook'
UNION ALL SELECT doc_id, 2, n_chars FROM documents), k AS (SELECT doc_id, min(route) AS route, arg_min(pos, (route, pos)) AS pos FROM r GROUP BY doc_id)
SELECT doc_id, CAST(route AS BIGINT) AS route, rank FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY pos, doc_id) AS rank FROM k) WHERE rank <= 10""")
def hybrid_union(spark, folder):
    docs = table(spark, folder, "documents")
    size = F.col("n_chars")
    return ops.merge_routes([(docs.where("step = 'build'"), [-size]), (docs.where("source = 'runbook'"), [-size]), (docs, [size])], "doc_id", 10)


@query("""SELECT row_id, CASE WHEN confidence <> 0 THEN CAST(confidence AS DOUBLE) WHEN len(top_factors) <> 0 THEN CAST(len(top_factors) AS DOUBLE) WHEN len(modules_at_risk) <> 0 THEN CAST(len(modules_at_risk) AS DOUBLE) ELSE 0.0 END AS score FROM predictions""")
def fallback_rank(spark, folder):
    scores = [F.col("confidence"), F.when(F.col("top_factors").isNotNull(), F.size("top_factors")), F.when(F.col("modules_at_risk").isNotNull(), F.size("modules_at_risk"))]
    return table(spark, folder, "predictions").select("row_id", ops.first_truthy(*scores).alias("score"))


def _near(a: int, b: int) -> str:
    """Whether parts ``a`` and ``b`` are there and too similar."""
    return f"coalesce(CASE WHEN len(t{a}) > 0 AND len(t{b}) > 0 THEN len(list_intersect(t{a}, t{b})) / len(list_distinct(t{a} || t{b})) ELSE 0.0 END >= 0.8, false)"


@query(rf"""WITH p AS (SELECT log_id, nullif(trim(error_message), '') AS p1, nullif(trim(error_type), '') AS p2, nullif(trim(module), '') AS p3, nullif(trim(step), '') AS p4 FROM parsed_logs),
w AS (SELECT *, {", ".join(f"list_distinct(regexp_extract_all(lower(p{i}), '[{chr(92)}p{{L}}{chr(92)}p{{N}}_]+')) AS t{i}" for i in range(1, 5))} FROM p),
a AS (SELECT *, p1 IS NOT NULL AS k1, p2 IS NOT NULL AND NOT (p1 IS NOT NULL AND {_near(1, 2)}) AS k2 FROM w), b AS (SELECT *, p3 IS NOT NULL AND NOT (k1 AND {_near(1, 3)}) AND NOT (k2 AND {_near(2, 3)}) AS k3 FROM a),
c AS (SELECT *, p4 IS NOT NULL AND NOT (k1 AND {_near(1, 4)}) AND NOT (k2 AND {_near(2, 4)}) AND NOT (k3 AND {_near(3, 4)}) AS k4 FROM b)
SELECT log_id, concat_ws(' ', CASE WHEN k1 THEN p1 END, CASE WHEN k2 THEN p2 END, CASE WHEN k3 THEN p3 END, CASE WHEN k4 THEN p4 END)[1:12000] AS search_text FROM c""")
def normalised_query(spark, folder):
    """Search text of each parsed log: message, type, module and step, near-equal parts once."""
    logs = table(spark, folder, "parsed_logs")
    return logs.select("log_id", ops.normalised_query([F.col("error_message"), F.col("error_type"), F.col("module"), F.col("step")]).alias("search_text"))


@query()
def drain_templates(spark, folder):
    """Templates per canonical step of all parsed logs, failed ones too; ``success_templates`` has those of success logs."""
    logs = table(spark, folder, "parsed_logs").withColumn("s", F.regexp_replace(F.lower("step"), "[^a-z0-9]", ""))
    lines = logs.select("s", F.explode("key_lines").alias("line"))
    return drain.mine(lines, "s", "line")


def pipeline_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per execution: eid, pipeline (lower-case name), status and start of its latest export."""
    exported = table(spark, folder, "pipelines_list").withColumns({"eid": whole_number_long(F.col("execution_id")), "pipeline": F.nullif(F.lower(F.trim("pipeline_name")), F.lit(""))})
    last = ex.latest_by_key(exported, "eid", ["exported_at", "row_id"], ["pipeline", "status", "program_id", "deploy_start_time"])
    zoned, unique = with_zones(last, "program_id", table(spark, folder, "programs"))
    timed = add_utc_micros(zoned, "deploy_start_time", "_zone_name", "_abbreviations", "started", unique)
    return timed.select("eid", "pipeline", F.upper(F.trim("status")).alias("status"), "started")


@query()
def success_templates(spark, folder):
    """Templates of the last three usable logs among the newest nine finished executions, per pipeline and step."""
    logs = table(spark, folder, "parsed_logs").select("log_id", whole_number_long(F.col("execution_id")).alias("eid"), F.regexp_replace(F.lower("step"), "[^a-z0-9]", "").alias("step"), F.array_join("key_lines", "\n").alias("text"))
    chosen = ex.success_logs(pipeline_runs(spark, folder), logs, "pipeline", "eid", "started", "step", "log_id", "text")
    lines = chosen.select(F.concat_ws("\u0001", "pipeline", "step").alias("key"), F.explode(F.split("text", "\n")).alias("line"))
    key = F.split("key", "\u0001")
    return drain.mine(lines, "key", "line").select(key[0].alias("pipeline"), key[1].alias("step"), "template", "n")


@query("""SELECT label, n, CAST(floor(avg_norm * 100) AS BIGINT) AS mean_norm FROM (SELECT CAST(label AS BIGINT) AS label, count(*) AS n, avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS avg_norm
FROM embeddings GROUP BY label HAVING count(*) >= 2)""")
def recurring_labels(spark, folder):
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    grouped = table(spark, folder, "embeddings").groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"), F.avg(norm).alias("m"))
    return grouped.where("n >= 2").select("label", "n", F.floor(F.col("m") * 100).alias("mean_norm"))


@query("""SELECT id, row_id, upper(trim(status)) AS status, lower(predicted_risk) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exported_at DESC NULLS LAST, row_id DESC) AS r FROM predictions WHERE id IS NOT NULL) WHERE r = 1""")
def predictions_latest(spark, folder):
    last = ex.latest_by_key(table(spark, folder, "predictions").withColumn("row", F.col("row_id")), "id", ["exported_at", "row_id"], ["row", "status", "predicted_risk"])
    return last.select("id", F.col("row").alias("row_id"), F.upper(F.trim("status")).alias("status"), F.lower("predicted_risk").alias("risk"))


@query("SELECT row_id, 'pred_' || substr(sha256(concat_ws(':', program_id, commit_sha, coalesce(execution_id, ''))), 1, 12) AS content_id FROM predictions")
def prediction_id(spark, folder):
    key = F.concat_ws(":", "program_id", "commit_sha", F.coalesce("execution_id", F.lit("")))
    return table(spark, folder, "predictions").select("row_id", F.concat(F.lit("pred_"), F.substring(F.sha2(key, 256), 1, 12)).alias("content_id"))


@query("""SELECT count(*) AS total, count(*) FILTER (correct IS NOT NULL) AS resolved, count(*) FILTER (correct) AS right_ones, round(100.0 * count(*) FILTER (correct) / nullif(count(*) FILTER (correct IS NOT NULL), 0), 1) AS accuracy,
count(*) FILTER (correct IS NULL) AS pending, count(*) FILTER (actual_failed_step IS NOT NULL AND lower(trim(actual_failed_step)) = lower(trim(predicted_step))) AS right_steps FROM predictions""")
def prediction_accuracy(spark, folder):
    rows = table(spark, folder, "predictions")
    resolved, right = F.count("correct"), F.count_if(F.col("correct"))
    return rows.agg(
        F.count("*").alias("total"), resolved.alias("resolved"), right.alias("right_ones"), F.round(100 * right / F.when(resolved > 0, resolved), 1).alias("accuracy"), F.count_if(F.col("correct").isNull()).alias("pending"),
        F.count_if(F.lower(F.trim("actual_failed_step")) == F.lower(F.trim("predicted_step"))).alias("right_steps"),
    )


@query(VIEWS + f"""SELECT p.row_id, p.eid, runs.status AS actual_status, coalesce(steps.step, '') AS actual_step FROM (SELECT row_id, {_EID} AS eid FROM predictions) p
JOIN runs ON runs.eid = p.eid LEFT JOIN steps ON steps.eid = p.eid WHERE runs.status <> 'RUNNING'""")
def prediction_outcomes(spark, folder):
    """Predictions with the outcome of their execution: an inner join for the status, a left join for the step."""
    asked = table(spark, folder, "predictions").select("row_id", whole_number_long(F.col("execution_id")).alias("eid"))
    runs = ex.executions(table(spark, folder, "pipelines_list")).where("status <> 'RUNNING'").select("eid", F.col("status").alias("actual_status"))
    steps = ex.failed_steps(table(spark, folder, "first_failed_steps"))
    return asked.join(runs, "eid").join(steps, "eid", "left").select("row_id", "eid", "actual_status", F.coalesce("step", F.lit("")).alias("actual_step"))


@query("""SELECT collection, count(*) AS n FROM (SELECT 'failure' AS collection FROM documents WHERE source IN ('failure_memory', 'runbook') UNION ALL SELECT 'scan' FROM documents WHERE source = 'scan_finding') GROUP BY 1""")
def memory_stats(spark, folder):
    kind = F.when(F.col("source").isin("failure_memory", "runbook"), "failure").when(F.col("source") == "scan_finding", "scan")
    return table(spark, folder, "documents").withColumn("collection", kind).where("collection is not null").groupBy("collection").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, regexp_extract(text, 'revision r([0-9]+)', 1) AS revision FROM documents WHERE regexp_matches(text, 'revision r[0-9]+')")
def revision_in_text(spark, folder):
    """The first revision a text names."""
    return table(spark, folder, "documents").where(F.col("text").rlike("revision r[0-9]+")).select("doc_id", F.regexp_extract("text", "revision r([0-9]+)", 1).alias("revision"))


@query(r"""SELECT mask, count(DISTINCT log_id) AS n_logs FROM (SELECT log_id, regexp_replace(regexp_replace(regexp_replace(trim(line), '\b[0-9]+\b', '<NUM>', 'g'), '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<UUID>', 'g'), '(?i)0x[0-9a-f]+', '<HEX>', 'g') AS mask
FROM (SELECT log_id, unnest(key_lines) AS line FROM parsed_logs) WHERE trim(line) <> '') GROUP BY mask HAVING count(DISTINCT log_id) > 1""")
def hot_templates(spark, folder):
    """Line masks seen in more than one log, with how many of them."""
    lines = loglines.lines_of_arrays(table(spark, folder, "parsed_logs"), "log_id", "key_lines").where(F.trim("line") != "")
    return lines.groupBy(loglines.mask_line(F.col("line")).alias("mask")).agg(F.count_distinct("log_id").alias("n_logs")).where("n_logs > 1")

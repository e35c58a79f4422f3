"""Queries of retrieval routes, known causes, prediction accuracy and stored texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.ids import whole_number_long
from faultline.operators import executions as ex
from faultline.operators import retrieval, routes
from faultline.plans.executions import VIEWS
from faultline.plans.retrieval import bm25_sql, knn_sql
from faultline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Incident records: one per parsed log, with the prediction's shape for the third of them whose execution id ends in 0 to 3."""
    logs = table(spark, folder, "parsed_logs")
    plain = F.regexp_replace(F.lower("step"), "[^a-z0-9]", "")
    return logs.select("log_id", F.nullif(plain, F.lit("")).alias("step"), "error_type", F.nullif(F.trim("error_message"), F.lit("")).alias("error_message"), "module", "errors", "key_lines", "execution_id")


_INCIDENTS = """WITH i AS (SELECT log_id, nullif(regexp_replace(lower(step), '[^a-z0-9]', '', 'g'), '') AS step, error_type, nullif(trim(error_message), '') AS error_message, module, errors, key_lines, execution_id FROM parsed_logs) """


@query("""SELECT row_id, coalesce(pipeline_name = 'risk_analysis', false) OR coalesce(starts_with(predicted_step, 'risk_prediction_'), false) OR coalesce(starts_with(execution_id, 'risk-'), false) AS excluded FROM predictions""")
def prediction_records(spark, folder):
    """Which records stem from a risk prediction, by any of three columns."""
    return table(spark, folder, "predictions").select("row_id", routes.is_prediction(F.col("pipeline_name"), F.col("predicted_step"), F.col("execution_id")).alias("excluded"))


@query("SELECT count(*) FILTER (lower(predicted_risk) = 'high') AS n_high, count(*) FILTER (lower(predicted_risk) = 'medium') AS n_medium, count(*) FILTER (lower(predicted_risk) = 'low') AS n_low FROM predictions")
def risk_counts(spark, folder):
    """Records per severity in one pass."""
    risk = F.lower("predicted_risk")
    return table(spark, folder, "predictions").agg(*[F.count_if(risk == r).alias(f"n_{r}") for r in ("high", "medium", "low")])


@query("SELECT doc_id FROM documents WHERE step = 'build' AND lang = 'en'")
def filtered_records(spark, folder):
    """Records that meet all filters set; the wildcard sets none."""
    return routes.matching(table(spark, folder, "documents"), {"step": "build", "lang": "en", "repo": "All", "source": None}).select("doc_id")


@query("SELECT log_id, error_message[1:80] AS shown, array_to_string(list_transform(key_lines[1:3], lambda x: x[1:40]), chr(10)) AS shown_lines FROM parsed_logs")
def record_snapshots(spark, folder):
    """Short forms of records: cut texts, the first lines of lists."""
    lines = F.transform(F.slice("key_lines", 1, 3), lambda x: F.substring(x, 1, 40))
    return table(spark, folder, "parsed_logs").select("log_id", F.substring("error_message", 1, 80).alias("shown"), F.array_join(lines, "\n").alias("shown_lines"))


@query(VIEWS + """SELECT failed.eid FROM failed JOIN shares ON shares.eid = failed.eid WHERE step IS NOT NULL AND NOT EXISTS (SELECT 1 FROM predictions p WHERE regexp_matches(p.execution_id, '^\\s*0*' || failed.eid || '(\\.0)?\\s*$')) ORDER BY failed.eid DESC LIMIT 20""")
def eligible_for_ingest(spark, folder):
    """The 20 newest failed executions with step and share that the store lacks."""
    failed = ex.failed_executions(ex.executions(table(spark, folder, "pipelines_list")), ex.failed_steps(table(spark, folder, "first_failed_steps"))).where("step is not null")
    stored = table(spark, folder, "predictions").select(whole_number_long(F.col("execution_id")).alias("eid")).where("eid is not null")
    shares = ex.share_map(table(spark, folder, "share_names")).select("eid")
    return failed.join(shares, "eid", "left_semi").join(stored, "eid", "left_anti").select("eid").orderBy(F.desc("eid")).limit(20)


_CAUSES = _INCIDENTS + """, d AS (SELECT step, unnest(errors) AS e FROM i WHERE step = 'deploy' AND error_type IS DISTINCT FROM 'missing_npm_module'),
known AS (SELECT 'missing_npm_module:' || coalesce(error_message, '') AS cause_key, min(error_type) AS error_type, min(coalesce(error_message, '')) AS detail, min(step) AS step, count(*) AS occurrence_count FROM i WHERE error_type = 'missing_npm_module' GROUP BY 1
UNION ALL SELECT e.type || ':' || e.detail[1:80], min(e.type), min(regexp_replace(e.detail, '^Undefined variable: ', '')), min(step), 1 FROM d WHERE e.type = 'missing_env_variable' OR contains(e.detail, 'rewrite-onpremises') GROUP BY 1) """


@query(_CAUSES + "SELECT * FROM known")
def known_causes(spark, folder):
    """Known causes of failures with how often they occurred."""
    return routes.known_causes(_incidents(spark, folder))


@query(_CAUSES + """, q AS (SELECT DISTINCT coalesce(step, '') || '/' || coalesce(error_type, '') AS query_id, step AS s, error_type AS t FROM i)
SELECT query_id, cause_key, CAST(0.6 AS DOUBLE) AS match_score FROM known JOIN q ON (coalesce(step, '') = '' OR coalesce(s, '') = '' OR step = s) AND (coalesce(error_type, '') = '' OR coalesce(t, '') = '' OR contains(error_type, t) OR contains(t, error_type))""")
def relational_hits(spark, folder):
    """Known causes for each kind of failure (step and type) there is."""
    incidents = _incidents(spark, folder)
    asked = incidents.select("step", "error_type").distinct().withColumn("query_id", F.concat(F.coalesce("step", F.lit("")), F.lit("/"), F.coalesce("error_type", F.lit(""))))
    return routes.relational_route(routes.known_causes(incidents), asked).select("query_id", "cause_key", "match_score")


@query(VIEWS + """, pat AS (SELECT lower(pipeline_name) AS pipeline, step, count(*) AS n FROM failed GROUP BY ALL), q AS (SELECT DISTINCT step || '?' AS query_id, step AS s FROM steps WHERE step IS NOT NULL)
SELECT query_id, pipeline, step, n, least(1.0, n / 10.0) AS match_score FROM pat JOIN q ON (coalesce(pipeline, '') = '' OR contains(pipeline, 'dev')) AND (coalesce(step, '') = '' OR step = s)""")
def pattern_hits(spark, folder):
    """Recurring failures of pipelines whose name holds 'dev', for each step."""
    failed = ex.failed_executions(ex.executions(table(spark, folder, "pipelines_list")), ex.failed_steps(table(spark, folder, "first_failed_steps")))
    patterns = failed.groupBy(F.lower("pipeline_name").alias("pipeline"), "step").agg(F.count("*").alias("n"))
    asked = ex.failed_steps(table(spark, folder, "first_failed_steps")).where("step is not null").select("step").distinct().select("step", F.concat("step", F.lit("?")).alias("query_id"), F.lit("dev").alias("pipeline"))
    return routes.pattern_route(patterns, asked).select("query_id", "pipeline", "step", "n", "match_score")


@query("""WITH r AS (SELECT lower(predicted_risk) AS risk, lower(trim(predicted_step)) AS guess, upper(trim(actual_status)) AS status, lower(trim(actual_failed_step)) AS step, correct FROM predictions), s AS (SELECT * FROM r WHERE status IS NOT NULL AND status <> '')
SELECT count(*) AS total, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) * 100.0 / nullif(count(*), 0), 1) AS accuracy_pct, count(*) FILTER (risk IN ('high', 'medium') AND status = 'FINISHED') AS false_positives,
count(*) FILTER (risk = 'low' AND status IN ('FAILED', 'ERROR')) AS false_negatives, round(count(*) FILTER (risk IN ('high', 'medium') AND status = 'FINISHED') * 100.0 / nullif(count(*), 0), 1) AS fp_rate_pct,
round(count(*) FILTER (risk = 'low' AND status IN ('FAILED', 'ERROR')) * 100.0 / nullif(count(*), 0), 1) AS fn_rate_pct,
round(count(*) FILTER (status IN ('FAILED', 'ERROR') AND guess = step) * 100.0 / nullif(count(*) FILTER (status IN ('FAILED', 'ERROR')), 0), 1) AS step_accuracy_pct, (SELECT count(*) FROM r WHERE status IS NULL OR status = '') AS pending FROM s""")
def accuracy_stats(spark, folder):
    """Accuracy, false alarms, misses, their rates, steps foretold among real failures, and what is pending; one pass."""
    rows = table(spark, folder, "predictions").select(F.lower("predicted_risk").alias("risk"), F.lower(F.trim("predicted_step")).alias("guess"), F.upper(F.trim("actual_status")).alias("status"), F.lower(F.trim("actual_failed_step")).alias("step"), "correct")
    done = F.coalesce(F.col("status") != "", F.lit(False))
    failed = F.col("status").isin("FAILED", "ERROR")
    n = lambda c: F.count_if(done & c)
    total = F.count_if(done)
    share = lambda c, of=total: F.round(n(c) * 100 / F.when(of > 0, of), 1)
    alarm, miss = F.col("risk").isin("high", "medium") & (F.col("status") == "FINISHED"), (F.col("risk") == "low") & failed
    return rows.agg(
        total.alias("total"), n(F.col("correct")).alias("n_correct"), share(F.col("correct")).alias("accuracy_pct"), n(alarm).alias("false_positives"), n(miss).alias("false_negatives"), share(alarm).alias("fp_rate_pct"), share(miss).alias("fn_rate_pct"),
        share(failed & (F.col("guess") == F.col("step")), n(failed)).alias("step_accuracy_pct"), F.count_if(~done).alias("pending"),
    )


@query(VIEWS + """, l AS (SELECT * FROM failed WHERE status IN ('FAILED', 'ERROR') ORDER BY eid DESC LIMIT 200), c AS (SELECT step, count(*) AS n FROM l WHERE step IS NOT NULL GROUP BY step)
SELECT (SELECT step FROM c ORDER BY n DESC, step LIMIT 1) AS dominant_step, count(*) FILTER (step IN ('deploy', 'securitytest')) AS n_environment, count(*) FILTER (step IN ('build', 'codequality')) AS n_code, count(*) AS n FROM l""")
def recent_dominant_step(spark, folder):
    """Among the last 200 failures: the commonest step, and how many lie with the environment or with the code."""
    failed = ex.failed_executions(ex.executions(table(spark, folder, "pipelines_list")), ex.failed_steps(table(spark, folder, "first_failed_steps"))).where("status in ('FAILED', 'ERROR')")
    last = failed.select("eid", "step").orderBy(F.desc("eid")).limit(200)
    counts = last.groupBy("step").agg(F.count("*").alias("n"))
    top = F.min_by("step", F.when(F.col("step").isNotNull(), F.struct(-F.col("n"), F.col("step"))))
    some = lambda *steps: F.coalesce(F.sum(F.when(F.col("step").isin(*steps), F.col("n"))), F.lit(0))
    return counts.agg(top.alias("dominant_step"), some("deploy", "securitytest").alias("n_environment"), some("build", "codequality").alias("n_code"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT source, coalesce(step, '') AS step, count(*) AS n FROM documents GROUP BY ALL")
def memory_breakdown(spark, folder):
    """Stored texts by collection and step."""
    return table(spark, folder, "documents").groupBy("source", F.coalesce("step", F.lit("")).alias("step")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT pipeline_name, list(confidence ORDER BY confidence DESC) AS c FROM predictions WHERE lower(predicted_risk) = 'high' AND confidence IS NOT NULL GROUP BY 1)
SELECT pipeline_name, CAST(floor(list_sum(c[1:3]) / len(c[1:3])) AS BIGINT) AS top3_mean FROM t""")
def top3_confidence(spark, folder):
    """Per pipeline the mean of its three highest confidences among high risks, cut to a whole number."""
    high = table(spark, folder, "predictions").where("lower(predicted_risk) = 'high' and confidence is not null").select("pipeline_name", "confidence", "row_id")
    ranked = high.withColumn("r", F.row_number().over(Window.partitionBy("pipeline_name").orderBy(F.desc("confidence"), "row_id"))).where("r <= 3")
    return ranked.groupBy("pipeline_name").agg(F.floor(F.sum("confidence") / F.count("*")).alias("top3_mean"))


@query(r"""WITH s AS (SELECT row_id, try_cast(regexp_replace(deploy_start_time, '\s*(PDT|PST|UTC|GMT)$', '') AS TIMESTAMP) AS a, try_cast(regexp_replace(end_time, '\s*(PDT|PST|UTC|GMT)$', '') AS TIMESTAMP) AS z, upper(trim(status)) AS status, exported_at AS now FROM pipelines_list
WHERE regexp_matches(deploy_start_time, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3} (PDT|PST|UTC|GMT)$') AND (end_time IS NULL OR regexp_matches(end_time, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3} (PDT|PST|UTC|GMT)$')))
SELECT row_id, epoch_us(a) AS start_micros, round(CAST(epoch_us(CASE WHEN status = 'RUNNING' THEN now ELSE z END) - epoch_us(a) AS DOUBLE) / 60000000, 2) AS minutes FROM s WHERE a IS NOT NULL""")
def zone_stripped_durations(spark, folder):
    """Starts with their zone stripped and read as UTC, and minutes to the end, for running executions to the export."""
    usual = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3} (PDT|PST|UTC|GMT)$"
    rows = table(spark, folder, "pipelines_list").where(F.col("deploy_start_time").rlike(usual) & (F.col("end_time").isNull() | F.col("end_time").rlike(usual)))
    start, end = ex.zone_stripped(F.col("deploy_start_time")), ex.zone_stripped(F.col("end_time"))
    return rows.select("row_id", F.unix_micros(start).alias("start_micros"), ex.duration_minutes(start, end, F.upper(F.trim("status")) == "RUNNING", F.col("exported_at").cast("timestamp")).alias("minutes")).where("start_micros is not null")


@query(_INCIDENTS + """SELECT log_id, md5(list_aggregate(list_filter([error_type, error_message, module, step], lambda x: x IS NOT NULL AND x <> ''), 'string_agg', ' ')[1:1500]) AS candidate_md5,
md5('step:' || coalesce(step, '') || ' error_type:' || coalesce(error_type, '') || chr(10) || 'error: ' || coalesce(error_message, '') || chr(10) || 'log lines: ' || coalesce(array_to_string(key_lines[1:5], ' | '), '') || chr(10) || 'root cause: ' || coalesce(module, '') || chr(10) || 'fix: ') AS embedded_md5 FROM i""")
def record_texts(spark, folder):
    """Texts of incidents as a reranker and an embedding see them."""
    rows = _incidents(spark, folder)
    c = [F.col(x) for x in ("error_type", "error_message", "module", "step")]
    embedded = routes.embedded_text(c[3], c[0], c[1], F.col("key_lines"), c[2], F.lit(""))
    return rows.select("log_id", F.md5(F.nullif(routes.candidate_text(c), F.lit(""))).alias("candidate_md5"), F.md5(embedded).alias("embedded_md5"))


@query("""SELECT k, json_extract_string(good, '$.a') AS a, json_extract_string(good, '$.b[0]') AS b FROM (SELECT s_suppkey AS k, '{"a": "x' || s_suppkey || '", "b": ["y' || (s_suppkey % 3) || '"]}' AS good FROM supplier)""")
def repaired_objects(spark, folder):
    """JSON objects in code fences, some cut off after their first list element, closed again."""
    head = F.concat(F.lit('{"a": "x'), F.col("s_suppkey").cast("string"), F.lit('", "b": ["y'), (F.col("s_suppkey") % 3).cast("string"), F.lit('"'))
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("```json\n"), head, F.lit("]}\n```"))).otherwise(head)
    fixed = routes.repaired_json(text)
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), fixed.alias("j"))
    return rows.select("k", F.get_json_object("j", "$.a").alias("a"), F.get_json_object("j", "$.b[0]").alias("b"))


_ASKED = """SELECT item_id * 2 AS query_id, item_text[1:2000] AS query_text FROM eval_items WHERE item_id % 20 = 0
UNION ALL SELECT item_id * 2 + 1, 'Root cause: ' || item_text || chr(10) || 'Recommended fix for the failed pipeline.' FROM eval_items WHERE item_id % 20 = 0"""


@query(f"""WITH h AS ({bm25_sql(_ASKED, 20)}), v AS ({knn_sql("AND q.vec_id IN (SELECT item_id FROM eval_items)", "", 20)}),
m AS (SELECT d.doc_id AS query_doc, b.doc_id, row_number() OVER (PARTITION BY i.item_id ORDER BY b.n_chars DESC, b.doc_id) AS rank, i.item_id FROM eval_items i JOIN documents b ON b.step = i.step LEFT JOIN (SELECT 0 AS doc_id) d ON true WHERE i.item_id % 20 = 0 AND b.source = 'runbook'),
r AS (SELECT query_id // 2 AS query_id, doc_id, CASE WHEN query_id % 2 = 0 THEN 0 ELSE 2 END AS route, rank FROM h UNION ALL SELECT query_id, vec_id, 1, rank FROM v UNION ALL SELECT item_id, doc_id, 3, rank FROM m WHERE rank <= 10),
k AS (SELECT query_id, doc_id, min((route, rank)) AS p FROM r GROUP BY ALL)
SELECT query_id, doc_id, CAST(p[1] AS BIGINT) AS route, CAST(row_number() OVER (PARTITION BY query_id, p[1] ORDER BY p[2], doc_id) AS BIGINT) AS rank FROM k""")
def hybrid_retrieval(spark, folder):
    """Four routes for every item whose id is divisible by 20: BM25, nearest vectors, BM25 of a hypothetical record, texts of the same step; each text under its first route."""
    items = table(spark, folder, "eval_items").where("item_id % 20 = 0")
    docs, vectors = table(spark, folder, "documents"), table(spark, folder, "embeddings")
    base = items.select((F.col("item_id") * 2).alias("q"), routes.query_variant(F.col("item_text")).alias("t"))
    likely = items.select((F.col("item_id") * 2 + 1).alias("q"), routes.hypothetical_text(F.lit(None), F.col("item_text")).alias("t"))
    words = retrieval.bm25_topk(docs, "doc_id", "text", base.unionByName(likely), "q", "t", 20)
    near = retrieval.knn_topk(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0").join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), 20)
    scoped = retrieval.scoped_route(docs.where("source = 'runbook'"), "doc_id", "step", [F.desc("n_chars"), F.col("doc_id")], items, "item_id", "step", 10)
    return retrieval.merge_per_query([
        words.where("query_id % 2 = 0").select((F.col("query_id") / 2).cast("bigint").alias("query_id"), "doc_id", "rank"), near.select("query_id", F.col("vec_id").alias("doc_id"), "rank"),
        words.where("query_id % 2 = 1").select(F.expr("query_id div 2").alias("query_id"), "doc_id", "rank"), scoped,
    ], "query_id", "doc_id", 60)

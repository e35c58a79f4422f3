"""Retrieval over documents and vectors: BM25, nearest neighbours, route fusion, similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import cut_lineage, work_folder

TERM = r"[a-zA-Z0-9_./\-:]+"
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query vectors that a task holds at once, and rows it compares them with.
QUERY_BLOCK, ROWS_AT_ONCE = 1024, 20_000


def terms(text: Column) -> Column:
    """Lower-case query and document terms, repeated as often as they occur; NULL for NULL."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def bm25_topk(documents: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of each query with a positive Okapi score.

    Scores are rounded to 6 digits, ties go to the smaller document id; a term
    of more than half of all documents weighs ``EPSILON`` times the mean idf;
    repeated query terms count as often.  NULL texts are in no corpus.

    Document frequencies, the number of documents and their mean length come
    from one pass with a partial count before the shuffle (a mark that is no
    term stands for the document itself); postings are built only for terms
    that a query holds (a semi join), so the rest of the vocabulary is never
    shuffled with its documents.  Action: that first pass, kept in the
    checkpoint folder as one row a term.
    """
    texts = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    marked = texts.select("dl", F.explode(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("term"))
    frequencies = cut_lineage(marked.groupBy("term").agg(F.count("*").alias("df"), F.avg(F.when(F.col("term") == "", F.col("dl"))).alias("avgdl")))
    totals = frequencies.where("term = ''").select(F.col("df").alias("n_docs"), "avgdl")
    idf = frequencies.where("term <> ''").select("term", "df").join(F.broadcast(totals)).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = idf.agg((F.avg("idf") * EPSILON).alias("floor"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    wanted = asked.select("term").distinct()
    weights = idf.join(wanted, "term", "left_semi").join(F.broadcast(floor)).select("term", "avgdl", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    postings = texts.select("doc_id", "dl", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    hits = postings.join(weights, "term")
    impact = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.select("term", "doc_id", impact.alias("w")).join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qf")), 6).alias("score")).where("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def _vector_blocks(path: str, block: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Keys and vectors of a Parquet folder in the shared folder, at most ``block`` rows at a time."""
    system, root = fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
    for entry in sorted(e.path for e in system.get_file_info(fs.FileSelector(root)) if e.path.endswith(".parquet")):
        with system.open_input_file(entry) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=block):
                yield np.array(batch.column("key").to_pylist()), [np.asarray(v, np.float64) for v in batch.column("v").to_pylist()]


def _by_size(keys: np.ndarray, vectors: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of each dimension; zero vectors are dropped."""
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        matrix = np.stack([v for v in vectors if len(v) == size]).astype(np.float64)
        lengths = np.linalg.norm(matrix, axis=1)
        whole = np.isfinite(lengths) & (lengths > 0)
        if whole.any():
            yield keys[sizes == size][whole], matrix[whole] / lengths[whole, None]


def knn_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, least: float = -1.0, block: int = QUERY_BLOCK, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(query_id, rank, key, similarity): the ``k`` nearest other rows of each query row by cosine, exactly.

    NULL, empty and zero vectors are left out; only vectors of one dimension
    are compared.  Similarities are rounded to 6 digits; those below ``least``
    do not count; ties go to the smaller key.

    One pass over all rows whatever the number of queries: these are written
    to the shared folder, never collected, and each task reads them ``block``
    at a time against up to ``rows_at_once`` of its rows, so its memory is
    bounded; it sends on at most ``k`` rows a query.  Action: that write.
    """
    prepared = lambda df: df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v")).where(F.col("key").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    rows, path = prepared(vectors), work_folder(vectors.sparkSession, "queries")
    prepared(queries).write.parquet(path)

    def nearest(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(frames)
        parts = {m.shape[1]: (names, m) for names, m in _by_size(held["key"].to_numpy(), held["v"].to_list())}
        for names, asked in _vector_blocks(path, block):
            for queried, matrix in _by_size(names, asked):
                if matrix.shape[1] not in parts:
                    continue
                keys, base = parts[matrix.shape[1]]
                scores = np.round(matrix @ base.T, 6)
                scores[queried[:, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, axis=1)
                q, c = np.nonzero(best >= max(least, -1.0))
                yield pd.DataFrame({"query_id": queried[q], "key": keys[order[q, c]], "similarity": best[q, c]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames, n = [], 0
        for batch in batches:
            frames.append(batch)
            n += len(batch)
            if n >= rows_at_once:
                yield from nearest(frames)
                frames, n = [], 0
        if n:
            yield from nearest(frames)

    kind = dict(rows.dtypes)["key"]
    found = rows.mapInPandas(search, f"query_id {kind}, key {kind}, similarity double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("key").alias(key), "similarity")


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the mean vector per group, built by aggregates per dimension."""
    tall = vectors.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("d", "x"))
    means = tall.groupBy(group, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / F.greatest(size, F.lit(1e-300))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0.0 if either is NULL or empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).otherwise(0.0)


def merge_routes(routes: Sequence[tuple[DataFrame, Sequence[Column]]], key: str, cap: int) -> DataFrame:
    """(key, route, rank): candidates of several ordered routes, each key once, at most ``cap`` a route.

    The earlier route keeps a key; a key that an earlier route kept does not
    use up a later route's cap.  Each route brings a total order.
    """
    stacked = None
    for number, (rows, order) in enumerate(routes):
        part = rows.select(F.col(key), F.lit(number).alias("route"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("pos"))
        stacked = part if stacked is None else stacked.unionByName(part)
    kept = stacked.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("route", "pos")).alias("x")).select(key, "x.*")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("route").orderBy("pos", key)))
    return ranked.where(F.col("rank") <= cap).select(key, F.col("route").cast("bigint").alias("route"), F.col("rank").cast("bigint").alias("rank"))


def scoped_route(rows: DataFrame, key: str, scope: str, order: Sequence[Column], asked: DataFrame, query: str, asked_scope: str, k: int) -> DataFrame:
    """(query_id, key, rank): the first ``k`` rows of each query's scope.  The rows are cut per scope first, so a scope with a third of all rows is ``k`` rows in the join."""
    best = rows.where(F.col(scope).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)
    wanted = asked.select(F.col(query).alias("query_id"), F.col(asked_scope).alias("_scope"))
    return best.select(key, F.col(scope).alias("_scope"), "rank").join(wanted, "_scope").select("query_id", key, "rank")


def merge_per_query(routes: Sequence[DataFrame], query: str, key: str, cap: int) -> DataFrame:
    """(query, key, route, rank): ranked lists of several routes fused per query, each key under its earliest route, at most ``cap`` a route.

    Each route has query, key and rank; routes are top-k lists, so a query's group is small.
    """
    stacked = None
    for number, rows in enumerate(routes):
        part = rows.select(query, key, F.struct(F.lit(number).cast("bigint").alias("route"), F.col("rank").cast("bigint").alias("rank")).alias("p"))
        stacked = part if stacked is None else stacked.unionByName(part)
    kept = stacked.where(F.col(key).isNotNull()).groupBy(query, key).agg(F.min("p").alias("p"))
    ranked = kept.select(query, key, F.col("p.route").alias("route"), F.row_number().over(Window.partitionBy(query, "p.route").orderBy("p.rank", key)).cast("bigint").alias("rank"))
    return ranked.where(F.col("rank") <= cap)


def first_truthy(*scores: Column) -> Column:
    """The first score that is neither NULL nor 0, else 0.0."""
    return F.coalesce(*[F.when((s != 0) & ~F.isnan(s.cast("double")), s.cast("double")) for s in scores], F.lit(0.0))


def normalised_query(parts: Sequence[Column], most: float = 0.8, most_tokens: int = 3000) -> Column:
    """Parts joined by blanks, leaving out each that is too similar (Jaccard of word sets) to one kept before, cut to about ``most_tokens`` tokens (four characters each)."""
    split = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    given = F.filter(F.array(*[F.trim(p) for p in parts]), lambda t: t.isNotNull() & (t != ""))
    step = lambda kept, t: F.when(F.exists(kept, lambda o: jaccard(split(o), split(t)) >= most), kept).otherwise(F.concat(kept, F.array(t)))
    return F.substring(F.array_join(F.aggregate(given, F.array().cast("array<string>"), step), " "), 1, 4 * most_tokens)


def principal_axes(vectors: DataFrame, vector: str, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, the first ``k`` principal axes (as columns) and the share of the variance each explains; None without rows.

    Action: one pass sums the vectors and their outer products (a matrix of
    dimension squared, whatever the number of rows).
    """
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, outer = 0, None, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                n, total, outer = n + len(x), x.sum(0) + (0 if total is None else total), x.T @ x + (0 if outer is None else outer)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "outer": [outer.ravel().tolist()]})

    parts = rows.mapInPandas(moments, "n bigint, total array<double>, outer array<double>")
    sums = parts.select("n", F.posexplode(F.concat("total", "outer")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not sums:
        return None
    size = int((np.sqrt(1 + 4 * len(sums)) - 1) / 2)
    values, n = np.array([r["x"] for r in sums]), sums[0]["n"]
    mean = values[:size] / n
    variances, axes = np.linalg.eigh(values[size:].reshape(size, size) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    total = variances.sum()
    return mean, axes, variances[::-1][:k] / total if total > 0 else np.zeros(min(k, size))


def principal_components(vectors: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, pc): centred projections on the first ``k`` principal axes (see ``principal_axes``); NULL and empty vectors are left out."""
    rows = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    if (found := principal_axes(vectors, vector, k)) is None:
        return rows.select(key, F.col("v").alias("pc")).limit(0)
    mean, axes, _ = found

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["v"].to_numpy()) if len(batch) else np.zeros((0, len(mean)))
            yield pd.DataFrame({key: batch[key], "pc": ((x - mean) @ axes).tolist()})

    return rows.mapInPandas(project, f"{key} {dict(rows.dtypes)[key]}, pc array<double>")


def _kept_ranks(steps: list, causes: list, fixes: list, ranks: list, most: float, width: int | None) -> list[int]:
    """Ranks that stay when, in rank order, each item too like a kept one is dropped."""
    kept: list[tuple] = []

    def alike(a: str, b: str) -> bool:
        m = SequenceMatcher(None, a, b)
        return (not a and not b) or (m.real_quick_ratio() > most and m.quick_ratio() > most and m.ratio() > most)

    for rank, step, cause, fix in sorted(zip(ranks, steps, causes, fixes, strict=True)):
        item = (step, (cause or "").lower()[:width], (fix or "").lower()[:width], rank)
        if not any(k[0] == item[0] and alike(k[1], item[1]) and alike(k[2], item[2]) for k in kept):
            kept.append(item)
    return [k[3] for k in kept]


def distinct_incidents(hits: DataFrame, group: str, rank: str, step: str, cause: str, fix: str, most: float = 0.65, width: int | None = 200) -> DataFrame:
    """Hits without near copies: in rank order, one is dropped if a kept one has the same step and both its cause and its fix are too similar.

    Similar is a match ratio over ``most`` of the lower-case texts, of which the
    first ``width`` characters count (short fields; None compares whole texts).
    Two empty texts are alike; NULL is empty; equal NULL steps are the same.
    ``hits`` are short ranked lists (top-k results) per ``group``, so a list is
    one row of a Pandas UDF.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def kept(steps: pd.Series, causes: pd.Series, fixes: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([_kept_ranks(*map(list, x), most, width) for x in zip(steps, causes, fixes, ranks, strict=True)])

    text = lambda c: F.collect_list(F.coalesce(F.col(c).cast("string"), F.lit("")))
    listed = hits.groupBy(group).agg(text(step).alias("s"), text(cause).alias("c"), text(fix).alias("f"), F.collect_list(F.col(rank).cast("bigint")).alias("r"))
    ranks = listed.select(group, F.explode(kept("s", "c", "f", "r")).alias(rank))
    return hits.join(ranks, [group, rank], "left_semi")


def incident_source(execution_id: Column) -> Column:
    """Where an incident record came from, by the shape of its id."""
    return F.when(execution_id.rlike(r"^\d+$"), "execution").when(execution_id.rlike(r"^risk-[0-9a-f]+-\w+$"), "prediction").when(execution_id.rlike(r"^report:.+:\d+$"), "report").otherwise("other")


def sentences(text: Column, shortest: int = 20, most: int = 10) -> Column:
    """The first ``most`` sentences of more than ``shortest`` characters."""
    return F.slice(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > shortest), 1, most)


def _held(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(x, y): texts ``x`` of ``inner`` that lie inside texts ``y`` of ``outer``; both distinct.

    A text inside another shares every word that it holds with a non-letter on
    both sides; pairs meet by the one of them that the fewest outer texts have,
    so a common word brings none together.  Texts without such a word are
    compared as they are.
    """
    words, whole = r"[A-Za-z]+", r"(?<=[^A-Za-z])[A-Za-z]+(?=[^A-Za-z])"
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    outer_words = outer.select("y", F.explode(found("y", words)).alias("w"))
    counts = outer_words.groupBy("w").agg(F.count("*").alias("n"))
    keyed = inner.select("x", F.explode(found("x", whole)).alias("w")).join(counts, "w", "left")
    rarest = keyed.groupBy("x").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))
    by_word = rarest.join(outer_words, "w").where(F.contains("y", "x")).select("x", "y")
    plain = inner.where(F.size(found("x", whole)) == 0).join(outer, F.contains("y", "x")).select("x", "y")
    return by_word.unionByName(plain)


def noise_lines(lines: DataFrame, line: str, templates: DataFrame, template: str, shortest: int = 20) -> DataFrame:
    """Lines that equal a template, hold one of more than ``shortest`` characters, or lie inside one and are longer than that; both masked.

    ``templates`` is a set of one pipeline's templates.  Distinct lines and
    templates are compared (see ``_held``), exactly; lines then follow by an
    equi-join.  NULL and empty lines and templates are no noise.
    """
    kept = lines.where(F.length(line) > 0)
    texts = kept.select(F.col(line).alias("t")).distinct()
    known = templates.select(F.col(template).alias("k")).where(F.length("k") > 0).distinct()
    long = lambda c: F.length(c) > shortest
    equal = texts.join(known, F.col("t") == F.col("k"), "left_semi")
    holds = _held(known.where(long("k")).select(F.col("k").alias("x")), texts.select(F.col("t").alias("y"))).select(F.col("y").alias("t"))
    inside = _held(texts.where(long("t")).select(F.col("t").alias("x")), known.select(F.col("k").alias("y"))).select(F.col("x").alias("t"))
    noise = equal.unionByName(holds).unionByName(inside).distinct().withColumnRenamed("t", "_noise")
    return kept.join(noise, F.col(line) == F.col("_noise"), "left_semi")


def template_noise(lines: DataFrame, line: str, templates: DataFrame, template: str, keys: Sequence[str], shortest: int = 20) -> DataFrame:
    """Lines that equal a template of their ``keys``, hold one of more than ``shortest`` characters, or lie inside one and are longer than that.

    Both sides are masked.  Lines meet the templates of their own keys alone
    (a few logs' worth) by an equi-join and are compared with each as
    substrings, so no match is lost.  NULL keys and blank lines are no noise.
    """
    known = templates.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(template).alias("_t")).where(F.trim("_t") != "").distinct()
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    text = F.col(line)
    match = (text == F.col("_t")) | ((F.length("_t") > shortest) & F.contains(text, F.col("_t"))) | ((F.length(text) > shortest) & F.contains(F.col("_t"), text))
    return lines.where(F.trim(text) != "").join(known, same & match, "left_semi")

"""Retrieve and rank: cosine candidates, five-signal hybrid score, heuristics, rerank and selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import query_signal, strings, verb_intent
from ..functions.text import normalize_terms, overlap_score, sigmoid, strip, truncate_code, vector_norm
from ..plans.session import ship

WEIGHTS = {"vector": 0.50, "keyword": 0.18, "symbol": 0.12, "intent": 0.12, "structural": 0.08}
ROUTE_HINTS = "create post api endpoint route".split()
NOISE = "seed_data migration_script test_script script".split()
FACTORS = {"intent": 1.2, "route": 1.3, "noise": 0.7}
OVER_FETCH = 12
#: Bytes of query vectors that are sent to all executors at once; larger batches go in blocks.
QUERY_BYTES = 32 << 20
#: Pairs scored at once in a task.
SCORED = 1 << 22


def _blocks(queries: DataFrame, dimension: int) -> Iterator[DataFrame]:
    blocks = max(1, -(-queries.count() * dimension * 8 // QUERY_BYTES))
    for b in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """The k vectors of the highest raw cosine for each query: (query_id, chunk_id, raw_score, hit_rank).

    queries: query_id, query_vector; vectors: chunk_id, vector; ``scope`` names a column of both that must be equal.
    Vectors of another size are an error of the caller, see ``check_dimension``; null and zero vectors match nothing.
    A task normalises its vectors once, multiplies them with the matrix of queries and keeps k for each query, so k rows for each
    query and task are shuffled; scores are rounded to 12 digits, so that equal vectors tie whatever their place in a block."""
    spark = queries.sparkSession
    ship(spark)
    first = queries.select(F.size("query_vector").alias("n")).first()
    id_type, chunk_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    kind = f"query_id {id_type}, chunk_id {chunk_type}, raw_score double"
    out = spark.createDataFrame([], kind)
    for part in _blocks(queries, first.n) if first else ():
        rows = part.select("query_id", "query_vector", *([scope] if scope else [])).where("query_vector IS NOT NULL").collect()  # at most QUERY_BYTES
        matrix = np.array([r.query_vector for r in rows], np.float64).reshape(len(rows), -1)
        norms = np.linalg.norm(matrix, axis=1)
        keep = np.flatnonzero(norms > 0)
        shared = spark.sparkContext.broadcast((matrix[keep] / norms[keep, None], [rows[i].query_id for i in keep], np.array([rows[i][scope] for i in keep], object) if scope else None))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pandas as pd

            q, ids, scopes = shared.value
            best = np.full((len(ids), 0), -np.inf)
            names = np.empty((len(ids), 0), object)
            for pdf in batches:
                pdf = pdf[pdf["vector"].notna()]
                step = max(16, SCORED // max(1, len(ids)))
                for lo in range(0, len(pdf) if ids else 0, step):
                    some = pdf.iloc[lo : lo + step]
                    x = np.array(some["vector"].tolist(), np.float64)
                    size = np.linalg.norm(x, axis=1)
                    x = x[size > 0] / size[size > 0, None]
                    chunk = some["chunk_id"].to_numpy(object)[size > 0]
                    score = np.round(q @ x.T, 12)
                    if scopes is not None:
                        score[scopes[:, None] != some[scope].to_numpy(object)[size > 0]] = -np.inf
                    best, names = np.hstack([best, score]), np.hstack([names, np.tile(chunk, (len(ids), 1))])
                    if best.shape[1] > k:
                        at = _first(best, names, k)
                        best, names = np.take_along_axis(best, at, 1), np.take_along_axis(names, at, 1)
            i, j = np.nonzero(best > -np.inf)
            yield pd.DataFrame({"query_id": [ids[x] for x in i], "chunk_id": names[i, j], "raw_score": best[i, j]})

        out = out.unionByName(vectors.select("chunk_id", "vector", *([scope] if scope else [])).mapInPandas(run, kind))
    w = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "chunk_id")
    return out.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k)


def _first(best: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties by name."""
    edge = -np.partition(-best, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(best), k), np.int64)
    for r in range(len(best)):
        at = np.flatnonzero(best[r] >= edge[r])  # k and what ties with the last of them
        out[r] = at if len(at) == k else at[np.lexsort((names[r, at], -best[r, at]))[:k]]
    return out


def dimensions(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy(F.size("vector").alias("dimension")).agg(F.count("*").alias("n"))


def intent_score(intents: Column, route_intent: Column, route_method: Column) -> Column:
    own = F.array_distinct(F.array_compact(F.array(F.lower(route_intent), F.lower(route_method), verb_intent(route_method))))
    return F.when((F.size(intents) == 0) | (F.size(own) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(intents, own)) / F.size(intents))


def with_signals(queries: DataFrame) -> DataFrame:
    """Adds a query's signal and terms, once for each query and not for each candidate."""
    return queries.withColumn("_s", query_signal(F.col("query"))).withColumn("_q", normalize_terms(F.col("query")))


def hybrid_score(df: DataFrame) -> DataFrame:
    """Adds the five signals and ``total`` to rows of query, raw_score and a chunk's columns."""
    signal = df if "_q" in df.columns else with_signals(df)
    structural = F.concat(F.col("structural_terms"), F.array_compact(F.array(F.lower("route_method"), F.lower("route_intent"))), normalize_terms(F.col("route_resource")))
    out = (signal.withColumn("vector_score", vector_norm(F.col("raw_score")))
           .withColumn("keyword_score", overlap_score(F.col("_q"), F.col("keywords")))
           .withColumn("symbol_score", overlap_score(F.col("_q"), F.col("symbol_terms")))
           .withColumn("intent_score", intent_score(F.col("_s.intents"), F.col("route_intent"), F.col("route_method")))
           .withColumn("structural_score", overlap_score(F.col("_s.structural_terms"), structural)))
    total = sum((F.col(f"{k}_score") * w for k, w in list(WEIGHTS.items())[1:]), F.col("vector_score") * WEIGHTS["vector"])
    return out.withColumn("total", total)


def is_route(method: Column, tags: Column, kind: Column) -> Column:
    return (F.coalesce(method, F.lit("")) != "") | F.array_contains(tags, "route_handler") | F.coalesce(kind == "route", F.lit(False))


def route_boost(terms: Column, method: Column, tags: Column, kind: Column) -> Column:
    """Whether a query of route words meets a route."""
    return F.arrays_overlap(terms, strings(ROUTE_HINTS)) & is_route(method, tags, kind)


def noise_penalty(tags: Column) -> Column:
    return F.arrays_overlap(tags, strings(NOISE))


def heuristics(df: DataFrame, factors: dict[str, float] = FACTORS) -> DataFrame:
    """Adds matched_intents, matched_keywords, reasons, multiplier and score; needs the columns of hybrid_score."""
    f = {k: max(0.1, v) for k, v in factors.items()}
    intents = F.array_sort(F.array_intersect(F.transform("_s.intents", lambda i: F.concat(i, F.lit("_resource"))), F.col("intent_tags")))
    own = F.concat(F.col("keywords"), F.col("symbol_terms"), F.col("structural_terms"), F.array_compact(F.array(F.lower("route_method"))), normalize_terms(F.col("route_resource")))
    route, noise = route_boost(F.col("_q"), F.col("route_method"), F.col("intent_tags"), F.col("symbol_kind")), noise_penalty(F.col("intent_tags"))
    df = df.withColumn("matched_intents", intents).withColumn("matched_keywords", F.slice(F.array_sort(F.array_intersect("_q", own)), 1, 8))
    hit = F.size("matched_intents") > 0
    reasons = F.array_compact(F.array(F.when(hit, F.concat(F.lit("intent match: "), F.array_join("matched_intents", ", "))), F.when(route, F.lit("route handler boost")), F.when(noise, F.lit("noise/script penalty"))))
    multiplier = F.when(hit, f["intent"]).otherwise(1.0) * F.when(route, f["route"]).otherwise(1.0) * F.when(noise, f["noise"]).otherwise(1.0)
    return df.withColumn("reasons", reasons).withColumn("multiplier", multiplier).withColumn("score", F.col("total") * F.col("multiplier"))


def rank(df: DataFrame, k: int) -> DataFrame:
    """The first k of each query by score, vector score, having a symbol, fewer tokens, and hit order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("vector_score"), F.desc((F.coalesce(F.col("symbol"), F.lit("")) != "").cast("int")), "tokens", "hit_rank")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, top_k: int = 8) -> DataFrame:
    """Candidates, scores, heuristics, rank.  The candidate cut comes before scoring, as the normalised score is not monotone."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must lie between 1 and 50")
    hits = vector_topk(queries, vectors, OVER_FETCH * top_k)
    rows = hits.join(with_signals(queries).select("query_id", "query", "_s", "_q"), "query_id").join(chunks, "chunk_id")
    return rank(heuristics(hybrid_score(rows)), top_k)


def explain(df: DataFrame) -> DataFrame:
    """Adds ``explanation``.  Rows are at most top_k a query, so an Arrow function may format them: Spark rounds halves up, Python to even."""

    @F.udf("string", useArrow=True)
    def text(v, k, s, i, t, reasons):
        parts = [f"{n}={x:.3f}" for n, x in zip(("semantic", "keyword", "symbol", "intent", "structural"), (v, k, s, i, t), strict=True)]
        return "; ".join(parts + ([f"heuristics={', '.join(reasons)}"] if reasons is not None and len(reasons) else []))

    return df.withColumn("explanation", text("vector_score", "keyword_score", "symbol_score", "intent_score", "structural_score", "reasons"))


def local_rerank(matches: DataFrame, raw: str, max_candidates: int = 10) -> DataFrame:
    """0.7 score + 0.3 sigmoid(raw) for the first ranks, which are sorted anew; the rest keep their order behind."""
    head = F.col("rank") <= min(10, max_candidates)
    df = matches.withColumn("score", F.when(head, 0.7 * F.col("score") + 0.3 * sigmoid(F.col(raw))).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.col("rank") > min(10, max_candidates), F.when(head, -F.col("score")).otherwise(0.0), "rank")
    return df.withColumn("rank", F.row_number().over(w))


def rerank_text(summary: str = "description") -> Column:
    return F.concat_ws("\n", F.concat(F.lit("File: "), F.col("file_path")), F.concat(F.lit("Symbol: "), F.col("symbol")), F.col(summary), F.left("text", F.lit(1200)))


def confidence_gate(matches: DataFrame, threshold: float) -> DataFrame:
    """Queries whose best match by hybrid order reaches the vector threshold."""
    return matches.where((F.col("rank") == 1) & (F.col("vector_score") >= threshold)).select("query_id")


def candidates_json(matches: DataFrame, limit: int = 10) -> DataFrame:
    cols = ["rank", "file_path", "start_line", "end_line", "symbol", "score", "vector_score", "keyword_score", "symbol_score"]
    item = F.struct(*cols, truncate_code(F.col("text"), 1800).alias("snippet"))
    return matches.where(F.col("rank") <= limit).groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("candidates"))


def selection(matches: DataFrame) -> DataFrame:
    return matches.where("rank = 1").select("query_id", F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.lit("Top semantic match").alias("reason"), F.lit("vector").alias("source"))


def select_by_answer(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """An answer (query_id, file, line, reason) joined to the first candidate of its file whose lines hold it, else to the file's best at its start."""
    j = answers.where((strip(F.col("file")) != "") & (F.col("line") > 0) & (strip(F.col("reason")) != "")).join(candidates.withColumnRenamed("file_path", "file"), ["query_id", "file"])
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    w = Window.partitionBy("query_id").orderBy(F.desc(inside), F.when(inside, F.col("rank")), F.desc("score"), "rank")
    best = j.withColumn("_in", inside).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select("query_id", "file", F.when(F.col("_in"), F.col("line")).otherwise(F.col("start_line")).alias("line"), strip(F.col("reason")).alias("reason"), F.lit("llm").alias("source"))


Scorer = Callable[[str, list[str]], list[float]]

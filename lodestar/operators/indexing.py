"""Incremental index: change detection, upserts and deletes as joins, caches, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_files(files: DataFrame, known: DataFrame, rebuild: bool = False) -> DataFrame:
    """Files that are new or whose hash differs; all of them on a rebuild."""
    return files if rebuild else files.join(known.select("repo_path", "file_path", "content_hash"), ["repo_path", "file_path", "content_hash"], "left_anti")


def deleted_files(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(files.select("repo_path", "file_path"), ["repo_path", "file_path"], "left_anti").select("repo_path", "file_path")


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows without a new one, and the new ones; within a batch the last by ``order`` holds."""
    new = last_of(new, keys, order).drop(order) if order else new
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def cache_split(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows found in the cache with its columns, rows still to compute)."""
    return wanted.join(cache, keys), wanted.join(cache.select(*keys), keys, "left_anti")


def add_column(df: DataFrame, name: str, kind: str, default) -> DataFrame:
    """Additive migration: a missing column with its default."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def status(files: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    f = files.groupBy("repo_path").agg(F.count("*").alias("files"))
    c = chunks.groupBy("repo_path").agg(F.count("*").alias("chunks"))
    return f.join(c, "repo_path", "full").join(meta.select("repo_path", "last_indexed_at"), "repo_path", "full").fillna(0, ["files", "chunks"])


def index_stats(files: DataFrame, changed: DataFrame, gone: DataFrame, chunks: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(files, "files_scanned").crossJoin(one(changed, "files_indexed")).crossJoin(one(gone, "files_deleted")).crossJoin(one(chunks, "chunks_indexed"))


def apply_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    s = summaries.select("chunk_id", F.col("summary").alias("_s"))
    return chunks.join(s, "chunk_id", "left").withColumn("llm_summary", F.coalesce("_s", "llm_summary")).drop("_s")


def latency_percentiles(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, p95 and p99; percentile p is element int(n p) of the sorted values, counted from one."""
    w = Window.partitionBy(*by).orderBy(value)
    r = runs.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    at = lambda p: F.max(F.when(F.col("_i") == F.greatest(F.lit(1), F.floor(F.col("_n") * p)), F.col(value)))
    return r.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def ensure_dimension(vectors: DataFrame, size: int, recreate: bool = False) -> tuple[DataFrame, bool]:
    """(vectors, whether the collection was made anew): one of another size, or one to recreate, is emptied."""
    other = vectors.where(F.size("vector") != size).limit(1).count() > 0
    return (vectors.limit(0), True) if recreate or other else (vectors, False)


def zipped(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors, strictly: one without the other is an error when the rows are read."""
    c, v = chunks.withColumn("_c", F.lit(True)), vectors.withColumn("_v", F.lit(True))
    both = c.join(v, key, "full")
    fit = F.when(F.col("_c") & F.col("_v"), True).otherwise(F.raise_error(F.concat(F.lit("chunks and vectors differ at "), F.col(key).cast("string"))))
    return both.where(fit).drop("_c", "_v")


def upsert_vectors(index: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The index (chunk_id, vector and payload) with the chunks' rows put in or replaced; a chunk's last row holds."""
    new = zipped(chunks, vectors).select(*index.columns)
    return upsert(index, new, ["chunk_id"])


def delete_vectors(index: DataFrame, ids: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The index without the given chunks, or without those of the given (repo_path, file_path)."""
    out = index if ids is None else delete(index, ids, ["chunk_id"])
    return out if paths is None else delete(out, paths, ["repo_path", "file_path"])

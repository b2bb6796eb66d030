"""The facade: index, query and status of repositories over Parquet tables."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import chunking, embedding, indexing, search, symbols
from ..sources.repo import read_repo
from .settings import Settings

FILES = "repo_path string, file_path string, content_hash string, last_indexed_at timestamp"
META = "repo_path string, last_indexed_at timestamp"
CHUNKS = ("chunk_id string, repo_path string, file_path string, language string, start_line int, end_line int, symbol string, symbol_kind string, description string, text string, content_hash string, "
          "tokens int, keywords array<string>, symbol_terms array<string>, route_method string, route_path string, route_intent string, route_resource string, intent_tags array<string>, structural_terms array<string>, llm_summary string")
VECTORS = "repo_path string, chunk_id string, vector array<float>"
EMBEDDINGS = "content_hash string, model string, vector array<float>"
SUMMARIES = "summary_key string, model string, summary string"
SCHEMAS = {"files": FILES, "chunks": CHUNKS, "vectors": VECTORS, "embeddings": EMBEDDINGS, "meta": META, "summaries": SUMMARIES}


class EngineError(Exception):
    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(message)
        self.code, self.status = code, status


class Tables:
    """Versioned tables in any Hadoop file system: a write makes the folder of the next version, which counts once its
    commit mark is there; nothing that is read is overwritten.  ``KEPT`` versions stay for readers that began before."""

    KEPT = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.root))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self, name: str) -> list[str]:
        folder = f"{self.root}/{name}"
        if not self._fs.exists(self._at(folder)):
            return []
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))
        return [f"{folder}/{v}" for v in found if self._fs.exists(self._at(f"{folder}/{v}/_SUCCESS"))]

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.parquet(versions[-1])
        for f in self.spark.createDataFrame([], SCHEMAS[name]).schema:  # additive migration
            df = indexing.add_column(df, f.name, f.dataType.simpleString(), None)
        return df

    def write(self, name: str, df: DataFrame) -> None:
        versions = self._versions(name)
        number = int(versions[-1].rpartition("/v")[2].partition("-")[0]) + 1 if versions else 0
        cols = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        df.select(*cols).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/{name}/v{number:012d}-{uuid.uuid4().hex}")
        for old in versions[: 1 - self.KEPT]:
            self._fs.delete(self._at(old), True)


class Engine:
    """index(path), query(path, text), status(path).  Models are injected; the default embedder needs none."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder: embedding.Embedder | None = None,
                 rewriter: Callable | None = None, reranker: Callable[[str, list[str]], list[float]] | None = None,
                 selector: Callable[[str, str], dict] | None = None, summarizer: Callable[[str], str] | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.tables, self.embedder = Tables(spark, root), embedder or embedding.HashingEmbedder(self.settings.dimension)
        self.rewriter, self.reranker, self.selector, self.summarizer = rewriter, reranker, selector, summarizer
        self.errors: list[str] = []

    @staticmethod
    def _repo(path: str) -> str:
        full = os.path.abspath(os.path.expanduser(path))
        if not os.path.isdir(full):
            raise EngineError("INVALID_REPO", f"not a folder: {path}")
        return full

    def index(self, path: str, rebuild: bool = False) -> dict:
        """Refresh a repository.  Tables are written chunks, vectors, files: the file hashes are the commit mark."""
        began, repo, s = time.perf_counter(), self._repo(path), self.settings
        files = read_repo(self.spark, repo).cache()
        known = self.tables.read("files")
        own = known.where(F.col("repo_path") == repo)
        readable = files.where("text IS NOT NULL")
        changed, gone = indexing.changed_files(readable, own, rebuild), indexing.deleted_files(files, own)
        touched = changed.select("repo_path", "file_path").unionByName(gone)
        new = chunking.chunk_files(symbols.with_symbols(changed), s.min_tokens, s.max_tokens, s.target_tokens)
        new = self._summarized(indexing.last_of(new, ["repo_path", "chunk_id"], "start_line")).cache()
        chunks = self.tables.read("chunks")
        stale = chunks.join(touched.distinct(), ["repo_path", "file_path"], "left_semi").select("repo_path", "chunk_id")
        if rebuild:
            stale = chunks.where(F.col("repo_path") == repo).select("repo_path", "chunk_id")
        fresh = self._embedded(new)
        keys = ["repo_path", "chunk_id"]
        stats = indexing.index_stats(files, changed, gone, new).first().asDict()
        old = self.tables.read("vectors")
        kept, anew = indexing.ensure_dimension(old.where(F.col("repo_path") == repo), self.dimension(), rebuild)
        if anew and not rebuild and old.where(F.col("repo_path") == repo).limit(1).count():
            return self.index(path, rebuild=True)  # vectors of another model: all are made anew
        vectors = old.where(F.col("repo_path") != repo).unionByName(indexing.delete(kept, stale, keys))
        self.tables.write("vectors", indexing.upsert(vectors, fresh, keys))
        self.tables.write("chunks", indexing.upsert(indexing.delete(chunks, stale, keys), new, keys))
        now = F.current_timestamp()
        stamped = changed.select("repo_path", "file_path", "content_hash", now.alias("last_indexed_at"))
        self.tables.write("files", indexing.upsert(indexing.delete(known, gone, ["repo_path", "file_path"]), stamped, ["repo_path", "file_path"]))
        self.tables.write("meta", indexing.upsert(self.tables.read("meta"), self.spark.range(1).select(F.lit(repo).alias("repo_path"), now.alias("last_indexed_at")), ["repo_path"]))
        files.unpersist(), new.unpersist()
        return stats | {"repo_path": repo, "errors": self.errors, "duration_ms": int(1000 * (time.perf_counter() - began))}

    def _summarized(self, chunks: DataFrame) -> DataFrame:
        """Index-time summaries by an injected callable, kept by (model, chunk, text); a failure leaves the chunk without one."""
        if self.summarizer is None or not self.settings.summaries_enabled:
            return chunks
        call, limit = self.summarizer, self.settings.summary_chars
        from ..functions.text import clean_summary, summary_key

        keyed = chunks.withColumn("summary_key", summary_key(F.lit("model"), F.col("chunk_id"), F.col("content_hash"), F.col("text")))
        found, missing = indexing.cache_split(keyed.select("chunk_id", "summary_key", "text"), self.tables.read("summaries").select("summary_key", "summary"), ["summary_key"])

        def run(pdfs):
            for pdf in pdfs:
                def one(t):
                    try:
                        return call(t), None
                    except Exception as e:  # the chunk goes without a summary; index() returns the first errors
                        return None, f"summarizer: {e}"
                pdf["summary"], pdf["error"] = zip(*map(one, pdf["text"]), strict=True) if len(pdf) else ([], [])
                yield pdf

        tried = missing.mapInPandas(run, "chunk_id string, summary_key string, text string, summary string, error string").withColumn("summary", clean_summary(F.col("summary"), limit)).cache()
        self.errors = [r.error for r in tried.where("error IS NOT NULL").select("error").limit(10).collect()]
        made = tried.where("summary IS NOT NULL")
        self.tables.write("summaries", indexing.upsert(self.tables.read("summaries"), made.select("summary_key", F.lit("model").alias("model"), "summary").dropDuplicates(["summary_key"]), ["summary_key"]))
        return indexing.apply_summaries(chunks, found.select("chunk_id", "summary").unionByName(made.select("chunk_id", "summary")))

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """Vectors of chunks; texts seen before under the same model come from the cache."""
        model = getattr(self.embedder, "model", "custom")
        texts = chunks.select("repo_path", "chunk_id", chunking.embedding_text().alias("t")).withColumn("content_hash", content_hash(F.col("t"))).withColumn("model", F.lit(model))
        cache = self.tables.read("embeddings")
        _, missing = indexing.cache_split(texts.select("content_hash", "model", "t").dropDuplicates(["content_hash"]), cache, ["content_hash", "model"])
        made = embedding.embed(missing, "t", "vector", self.embedder, self.settings.batch).select("content_hash", "model", "vector")
        self.tables.write("embeddings", indexing.upsert(cache, made, ["content_hash", "model"]))
        return texts.join(self.tables.read("embeddings"), ["content_hash", "model"]).select("repo_path", "chunk_id", "vector")

    def dimension(self) -> int:
        return len(embedding.embed_query("x", self.embedder))

    def check_dimension(self, vectors: DataFrame, size: int) -> None:
        other = search.dimensions(vectors).where(F.col("dimension") != size).take(1)
        if other:
            raise EngineError("INDEX_DIMENSION_MISMATCH", f"the index has vectors of {other[0].dimension}, the model makes {size}", 409)

    def query(self, path: str, text: str, top_k: int | None = None) -> dict:
        """Ranked matches, one selection, and how the query was rewritten."""
        if not text:
            raise EngineError("INVALID_QUERY", "an empty query")
        began, repo, s = time.perf_counter(), self._repo(path), self.settings
        k = s.top_k if top_k is None else top_k
        asked, changed, _ = self.rewriter(text) if self.rewriter else (text, False, None)
        vector, errors = embedding.embed_query(asked, self.embedder), []
        queries = self.spark.createDataFrame([(0, asked, vector)], "query_id long, query string, query_vector array<float>")
        chunks, vectors = (self.tables.read(t).where(F.col("repo_path") == repo) for t in ("chunks", "vectors"))
        self.check_dimension(vectors, len(vector))
        found = search.explain(search.search(queries, chunks, vectors.drop("repo_path"), k)).orderBy("rank")
        rows = [r.asDict() for r in found.collect()]
        reranked = False
        if self.reranker and len(rows) > 1:
            try:
                n = min(s.rerank_candidates, 10, len(rows))
                raw = self.reranker(asked, [f"{r['file_path']}\n{r['description']}" for r in rows[:n]])
                scored = self.spark.createDataFrame([(0, r["rank"], float(x)) for r, x in zip(rows[:n], raw, strict=True)], "query_id long, rank int, raw double")
                order = search.local_rerank(self.spark.createDataFrame([(0, r["rank"], r["chunk_id"], float(r["score"])) for r in rows], "query_id long, rank int, chunk_id string, score double").join(scored, ["query_id", "rank"], "left"), "raw", n)
                by = {r["chunk_id"]: r for r in rows}
                rows = [by[r.chunk_id] | {"rank": r["rank"], "score": r.score} for r in order.orderBy("rank").collect()]
                reranked = True
            except Exception as e:  # the order of the scores holds; the error goes with the result
                errors.append(f"reranker: {e}")
        selection = {"file": rows[0]["file_path"], "line": rows[0]["start_line"], "reason": "Top semantic match", "source": "vector"} if rows else None
        if self.selector and s.selector_enabled and rows and rows[0]["vector_score"] < s.threshold:
            try:
                selection = self._selected(self.selector(asked, str([(r["file_path"], r["start_line"], r["end_line"]) for r in rows[:10]])), rows[:10]) or selection
            except Exception as e:  # the first match holds; the error goes with the result
                errors.append(f"selector: {e}")
        return {"query": text, "rewritten_query": asked if changed else None, "results": rows, "selection": selection, "reranked": reranked, "errors": errors, "duration_ms": int(1000 * (time.perf_counter() - began))}

    def _selected(self, answer: dict, rows: list[dict]) -> dict | None:
        answers = self.spark.createDataFrame([(0, answer["file"], answer["line"], answer["reason"])], "query_id long, file string, line int, reason string")
        cands = self.spark.createDataFrame([(0, r["file_path"], r["start_line"], r["end_line"], float(r["score"]), r["rank"]) for r in rows], "query_id long, file_path string, start_line int, end_line int, score double, rank int")
        got = search.select_by_answer(answers, cands).collect()
        return got[0].asDict() if got else None

    def status(self, path: str) -> dict:
        repo = self._repo(path)
        own = lambda t: self.tables.read(t).where(F.col("repo_path") == repo)
        row = indexing.status(own("files"), own("chunks"), own("meta")).first()
        return {"repo_path": repo, "files": row.files if row else 0, "chunks": row.chunks if row else 0, "last_indexed_at": row.last_indexed_at if row else None, "healthy": row is not None}

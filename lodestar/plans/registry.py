"""Registered queries of the search engine over the driver's tables, each with the SQL that gives the same rows.

The tables hold almost no code, so corpora are derived: documents as chunks of files, pages as
route calls, embeddings as vectors, and hashes of documents as the state of an earlier index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as T
from ..operators import chunking, embedding, indexing, search, symbols
from ..sources import repo
from .session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Derived corpora, in both languages.
def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return d.select("doc_id", F.lit("corpus").alias("repo_path"), path.alias("file_path"), "text", "lang")


CHUNKS = "chunks AS (SELECT doc_id, 'corpus' AS repo_path, source || '/' || doc_id::VARCHAR || '.' || lang AS file_path, text, lang FROM documents)"


def route_code(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "pages")
    verb = F.get(S.strings("get post put delete patch".split()), F.pmod("page_id", F.lit(5)).cast("int"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    return p.select("page_id", F.concat(F.lit("router."), verb, F.lit("('"), path, F.lit("', handler)")).alias("code"), path.alias("path"), F.upper(verb).alias("verb"))


ROUTES = """routes AS (SELECT page_id, v, p AS path, 'router.' || v || '(''' || p || ''', handler)' AS code FROM (
  SELECT page_id, (['get','post','put','delete','patch'])[(page_id % 5 + 1)::INT] AS v, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM pages))"""


def known_files(spark: SparkSession, sf: str) -> DataFrame:
    d = doc_chunks(spark, sf).where("doc_id % 11 <> 0")
    return d.select("repo_path", "file_path", T.content_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))).alias("content_hash"))


KNOWN = f"{CHUNKS}, known AS (SELECT repo_path, file_path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '~' ELSE text END) AS content_hash FROM chunks WHERE doc_id % 11 <> 0)"


def current_files(spark: SparkSession, sf: str) -> DataFrame:
    """What a scan finds now: a thirteenth of the files is gone."""
    return doc_chunks(spark, sf).where("doc_id % 13 <> 0").select("doc_id", "repo_path", "file_path", T.content_hash(F.col("text")).alias("content_hash"))


CURRENT = f"{KNOWN}, files AS (SELECT doc_id, repo_path, file_path, sha256(text) AS content_hash FROM chunks WHERE doc_id % 13 <> 0)"

# SQL pieces.
TERMS = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z_][a-z0-9_]*'), lambda x: len(x) > 1)"
TOKENS = lambda c: f"len(regexp_extract_all({c}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|\\S'))"
SING = lambda c: f"CASE WHEN {c} LIKE '%ies' AND length({c}) > 4 THEN left({c}, length({c}) - 3) || 'y' WHEN {c} LIKE '%s' AND {c} NOT LIKE '%ss' AND length({c}) > 3 THEN left({c}, length({c}) - 1) ELSE {c} END"
SEGMENTS = lambda c: f"list_filter(string_split(regexp_replace({c}, '^https?://[^/]*', ''), '/'), lambda s: s <> '' AND s NOT LIKE ':%' AND NOT (s LIKE '{{%' AND s LIKE '%}}'))"
LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
COS = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
SETS = lambda *cs: "list_sort(list_distinct(list_filter(" + " || ".join(cs) + ", lambda x: x IS NOT NULL)))"


# Text kernel.
@query(f"SELECT doc_id, {TOKENS('text')}::INT AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, array_to_string({TERMS('text')}, ' ') AS terms FROM documents")
def normalize_terms(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(T.normalize_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT w, {SING('w')} AS singular FROM (SELECT DISTINCT unnest({TERMS('p_name || chr(32) || p_type')}) AS w FROM part)")
def singularize(spark, sf):
    w = t(spark, sf, "part").select(F.explode(T.normalize_terms(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).distinct()
    return w.select("w", T.singularize(F.col("w")).alias("singular"))


@query("SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS joined FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def split_lines(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", T.split_lines(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("joined"))


@query(f"SELECT page_id, array_to_string({SEGMENTS('url')}, '|') AS segments FROM pages")
def path_segments(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.array_join(T.path_segments(F.col("url")), "|").alias("segments"))


@query(f"WITH {CHUNKS} SELECT f, CASE regexp_extract(lower(f), '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' END AS language FROM (SELECT file_path || (['.py','.JS','.jsx','.ts','.tsx','.md'])[(doc_id % 6 + 1)::INT] AS f FROM chunks)")
def detect_language(spark, sf):
    ext = F.get(S.strings([".py", ".JS", ".jsx", ".ts", ".tsx", ".md"]), (F.col("doc_id") % 6).cast("int"))
    return doc_chunks(spark, sf).select(F.concat("file_path", ext).alias("f")).withColumn("language", T.detect_language(F.col("f")))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CASE WHEN length(c) <= 400 THEN c ELSE rtrim(left(c, 397)) || '...' END AS summary FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def clean_summary(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.clean_summary(F.col("text"), 400).alias("summary"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1800 THEN text ELSE left(text, 1800) || chr(10) || '... [truncated]' END AS code FROM documents")
def truncate_code(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.truncate_code(F.col("text"), 1800).alias("code"))


@query("SELECT conv_id, turn, CASE WHEN length(c) <= 220 THEN c ELSE rtrim(left(c, 217)) || '...' END AS rewrite FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM conversations)")
def clean_rewrite(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", T.clean_rewrite(F.concat(F.lit('"'), T.collapse(F.col("text")), F.lit('"'))).alias("rewrite"))


ORACLE_SQL["clean_rewrite"] = "SELECT conv_id, turn, CASE WHEN length(c) <= 220 THEN c ELSE rtrim(left(c, 217)) || '...' END AS rewrite FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM conversations)"


@query("SELECT event_id, props AS object FROM events")
def json_salvage(spark, sf):
    raw = F.concat(F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Here:\n```json\n").otherwise("so "), "props", F.when(F.col("event_id") % 3 == 1, "\n```").otherwise(""))
    return t(spark, sf, "events").select("event_id", T.json_salvage(raw).alias("object"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query FROM conversations")
def rewrite_parse(spark, sf):
    q = T.collapse(F.col("text"))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(q.alias("query"))), F.lit("\n```"))).otherwise(F.concat(q, F.lit("\nsecond line")))
    return t(spark, sf, "conversations").select("conv_id", "turn", T.rewrite_parse(raw).alias("query"))


@query(f"WITH {CHUNKS} SELECT doc_id, sha256(file_path || '|1|' || (doc_id % 90 + 1)::VARCHAR || '|' || text) AS chunk_id FROM chunks")
def chunk_id(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", T.chunk_id(F.col("file_path"), F.lit(1), F.col("doc_id") % 90 + 1, F.col("text")).alias("chunk_id"))


@query(f"WITH {CHUNKS} SELECT doc_id, sha256('m|' || CASE WHEN doc_id % 2 = 0 THEN file_path ELSE '' END || '|' || text) AS summary_key FROM chunks")
def summary_key(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", T.summary_key(F.lit("m"), F.when(F.col("doc_id") % 2 == 0, F.col("file_path")), F.col("text")).alias("summary_key"))


@query("SELECT item_id, CASE WHEN text LIKE 'passage: %' THEN text ELSE 'passage: ' || text END AS p, 'query: ' || text AS q, 'Represent this sentence for searching relevant passages: ' || text AS b FROM benchmark")
def embed_prefix(spark, sf):
    c = F.col("text")
    return t(spark, sf, "benchmark").select("item_id", T.embed_prefix(c, "intfloat/e5-base", False).alias("p"), T.embed_prefix(c, "intfloat/e5-base", True).alias("q"), T.embed_prefix(c, "BAAI/bge-small", True).alias("b"))


@query("SELECT event_id, round(1 / (1 + exp(-(value / 100))), 9) AS s FROM events")
def sigmoid(spark, sf):
    return t(spark, sf, "events").select("event_id", F.round(T.sigmoid(F.col("value") / 100), 9).alias("s"))


# Signals.
@query(f"WITH {ROUTES} SELECT page_id, upper(v) AS method, path, CASE v WHEN 'post' THEN 'create' WHEN 'get' THEN 'read' WHEN 'delete' THEN 'delete' ELSE 'update' END AS intent, {SING('r')} AS resource FROM (SELECT *, ({TERMS(f'coalesce(({SEGMENTS(chr(112)+chr(97)+chr(116)+chr(104))})[1], chr(32))')})[1] AS r FROM routes)")
def route_signal(spark, sf):
    s = S.route_signal(F.col("code"), F.lit(None).cast("string"))
    return route_code(spark, sf).select("page_id", s.alias("s")).select("page_id", "s.method", "s.path", "s.intent", "s.resource")


@query(f"WITH {ROUTES} SELECT page_id, v AS verb, path FROM routes")
def route_js(spark, sf):
    return route_code(spark, sf).select("page_id", F.regexp_extract("code", S.ROUTE_JS, 1).alias("verb"), F.regexp_extract("code", S.ROUTE_JS, 2).alias("path"))


@query(f"WITH {ROUTES} SELECT page_id, v AS verb, path FROM routes")
def route_py(spark, sf):
    code = F.concat(F.lit("@x"), F.substring_index(F.col("code"), "router.", -1))
    return route_code(spark, sf).select("page_id", F.regexp_extract(code, S.ROUTE_PY, 1).alias("verb"), F.regexp_extract(code, S.ROUTE_PY, 2).alias("path"))


@query("SELECT doc_id, nullif(regexp_extract(lower(text || CASE WHEN doc_id % 3 = 0 THEN ' Delete it' ELSE '' END), '\\b(get|post|put|delete|patch)\\b', 1), '') AS verb FROM documents")
def route_generic(spark, sf):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Delete it").otherwise(""))
    return t(spark, sf, "documents").select("doc_id", T.nonempty(F.lower(F.regexp_extract(text, S.ROUTE_GENERIC, 1))).alias("verb"))


@query(f"WITH {ROUTES} SELECT page_id, {SING('r')} AS resource FROM (SELECT page_id, ({TERMS(f'coalesce(({SEGMENTS(chr(112)+chr(97)+chr(116)+chr(104))})[1], chr(32))')})[1] AS r FROM routes)")
def route_resource(spark, sf):
    return route_code(spark, sf).select("page_id", S.first_resource(F.col("path")).alias("resource"))


@query(f"SELECT p_partkey, {SING('r')} AS resource FROM (SELECT p_partkey, list_filter({TERMS(chr(39)+'create '+chr(39)+' || p_name')}, lambda x: NOT list_contains({LIST(S.SYMBOL_SKIP)}, x))[1] AS r FROM part)")
def symbol_resource(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.symbol_resource(F.concat(F.lit("create "), "p_name")).alias("resource"))


_QTEXT = "text || (['', ' create post', ' update the user', ' delete api route', ' find scores'])[(turn % 5 + 1)::INT]"
_INTENTS = ", ".join(f"CASE WHEN list_has_any(q, {LIST(w)}) THEN '{i}' END" for i, w in S.QUERY_ALIASES.items())


def _user_queries(spark, sf):
    extra = F.get(S.strings(["", " create post", " update the user", " delete api route", " find scores"]), (F.col("turn") % 5).cast("int"))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", extra).alias("query"))


@query(f"""WITH a AS (SELECT conv_id, turn, {TERMS(_QTEXT)} AS q FROM conversations),
b AS (SELECT *, list_filter(list_sort(list_distinct(q)), lambda x: list_contains({LIST(S.VERB_INTENT)}, x)) AS m, {SETS('[' + _INTENTS + ']')} AS i FROM a)
SELECT conv_id, turn, array_to_string(m, ' ') AS methods, array_to_string(i, ' ') AS intents, array_to_string({SETS(f'list_filter(q, lambda x: NOT list_contains({LIST(S.STOP_TERMS)}, x))', 'm', 'i')}, ' ') AS terms FROM b""")
def query_signal(spark, sf):
    s = _user_queries(spark, sf).withColumn("s", S.query_signal(F.col("query")))
    return s.select("conv_id", "turn", *[F.array_join(f"s.{a}", " ").alias(b) for a, b in (("methods", "methods"), ("intents", "intents"), ("structural_terms", "terms"))])


_PATHS = "(['', 'tests/', 'db/seeds/', 'migrations/', 'Scripts/'])[(doc_id % 5 + 1)::INT] || file_path"


def _paths() -> Column:
    return F.concat(F.get(S.strings(["", "tests/", "db/seeds/", "migrations/", "Scripts/"]), (F.col("doc_id") % 5).cast("int")), "file_path")


@query(f"""WITH {CHUNKS} SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(p, 'seed') THEN 'seed_data' END, CASE WHEN contains(p, 'migration') THEN 'migration_script' END,
 CASE WHEN contains(lower(p), 'test') OR contains(lower(p), 'spec') THEN 'test_script' END, CASE WHEN contains(lower(p), 'script') THEN 'script' END], lambda x: x IS NOT NULL), ' ') AS tags FROM (SELECT doc_id, {_PATHS} AS p FROM chunks)""")
def noise_tags(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", F.array_join(S.noise_tags(_paths()), " ").alias("tags"))


_TAGS = ", ".join(f"CASE WHEN list_has_any(w, {LIST(words)}) OR i = '{k}' THEN '{k}_resource' END" for k, words in S.INDEX_HINTS.items())


@query(f"""WITH {ROUTES}, a AS (SELECT page_id, {TERMS("'app/' || page_id::VARCHAR || '.js' || chr(10) || chr(10) || code")} AS w, CASE v WHEN 'post' THEN 'create' WHEN 'get' THEN 'read' WHEN 'delete' THEN 'delete' ELSE 'update' END AS i FROM routes)
SELECT page_id, array_to_string({SETS(f"[{_TAGS}, CASE WHEN list_has_any(w, {LIST(S.LOGGING)}) THEN 'logging' END, CASE WHEN list_has_any(w, {LIST(S.ANALYTICS)}) THEN 'analytics' END, 'route_handler']")}, ' ') AS tags FROM a""")
def intent_tags(spark, sf):
    m = S.intent_metadata(F.concat(F.lit("app/"), F.col("page_id").cast("string"), F.lit(".js")), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("code"))
    return route_code(spark, sf).select("page_id", F.array_join(m["tags"], " ").alias("tags"))


@query(f"SELECT page_id, {', '.join(f'list_has_any(w, {LIST(w)}) AS hint_{k}' for k, w in S.INDEX_HINTS.items())} FROM (WITH {ROUTES} SELECT page_id, {TERMS('code')} AS w FROM routes)")
def intent_hint_match(spark, sf):
    w = T.normalize_terms(F.col("code"))
    return route_code(spark, sf).select("page_id", *[F.arrays_overlap(w, S.strings(words)).alias(f"hint_{k}") for k, words in S.INDEX_HINTS.items()])


# Search.
def _vectors(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _queries(spark, sf):
    b = t(spark, sf, "benchmark")
    return b.join(t(spark, sf, "embeddings"), F.col("vec_id") == 499 - F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vector"))


_HITS = lambda k: f"""hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS hit_rank FROM (
  SELECT b.item_id AS query_id, b.text AS query, v.vec_id AS chunk_id, {COS} AS raw FROM benchmark b JOIN embeddings q ON q.vec_id = 499 - b.item_id CROSS JOIN embeddings v)) WHERE hit_rank <= {k})"""  # noqa: E731


@query(f"WITH {_HITS(96)} SELECT query_id, chunk_id, hit_rank::INT AS hit_rank, round(raw, 6) AS raw_score FROM hits")
def vector_topk(spark, sf):
    return search.vector_topk(_queries(spark, sf), _vectors(spark, sf), 96).withColumn("raw_score", F.round("raw_score", 6))


@query("SELECT vec_id, round(CASE WHEN s BETWEEN 0 AND 1 THEN s ELSE greatest(0, least(1, (s + 1) / 2)) END, 6) AS s FROM (SELECT vec_id, embedding[1]::DOUBLE * 5 AS s FROM embeddings)")
def vector_norm(spark, sf):
    s = F.element_at("embedding", 1).cast("double") * 5
    return t(spark, sf, "embeddings").select("vec_id", F.round(T.vector_norm(s), 6).alias("s"))


@query("""SELECT 'same size' AS c, false AS recreated, (SELECT count(*) FROM embeddings) AS n UNION ALL SELECT 'other size', true, 0 UNION ALL SELECT 'asked for', true, 0
UNION ALL SELECT 'found ' || len(embedding)::VARCHAR, false, count(*) FROM embeddings GROUP BY len(embedding)""")
def vector_dim_guard(spark, sf):
    """What the guard makes of a collection: kept, or emptied where the size is another or it is asked for; and the sizes found."""
    v, rows = _vectors(spark, sf), None
    for name, size, anew in (("same size", 64, False), ("other size", 32, False), ("asked for", 64, True)):
        kept, recreated = indexing.ensure_dimension(v, size, anew)
        row = kept.agg(F.count("*").alias("n")).select(F.lit(name).alias("c"), F.lit(recreated).alias("recreated"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows.unionByName(search.dimensions(v).select(F.concat(F.lit("found "), F.col("dimension").cast("string")).alias("c"), F.lit(False).alias("recreated"), "n"))


@query("SELECT count(*) AS n FROM embeddings")
def vector_count(spark, sf):
    return _vectors(spark, sf).agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT d.doc_id, list_distinct({TERMS('b.text')}) AS q, list_distinct({TERMS('d.text')}) AS w FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, round(CASE WHEN len(q) = 0 OR len(w) = 0 THEN 0 ELSE len(list_intersect(q, w)) / len(q) END, 9) AS s FROM a""")
def overlap_score(spark, sf):
    d, b = t(spark, sf, "documents"), t(spark, sf, "benchmark").withColumnRenamed("text", "q")
    return d.join(b, F.col("item_id") == F.col("doc_id") % b.count()).select("doc_id", F.round(T.overlap_score(T.normalize_terms(F.col("q")), T.normalize_terms(F.col("text"))), 9).alias("s"))


_INTENT_SQL = f"""a AS (SELECT conv_id, turn, {TERMS(_QTEXT)} AS q, (['GET','POST','PUT','DELETE','PATCH'])[(conv_id % 5 + 1)::INT] AS m FROM conversations),
b AS (SELECT conv_id, turn, {SETS('[' + _INTENTS + ']')} AS i, list_distinct([lower(m), CASE m WHEN 'POST' THEN 'create' WHEN 'GET' THEN 'read' WHEN 'DELETE' THEN 'delete' ELSE 'update' END]) AS own FROM a)"""


@query(f"WITH {_INTENT_SQL} SELECT conv_id, turn, round(CASE WHEN len(i) = 0 THEN 0 ELSE len(list_intersect(i, own)) / len(i) END, 9) AS s FROM b")
def intent_score(spark, sf):
    m = F.get(S.strings("GET POST PUT DELETE PATCH".split()), (F.col("conv_id") % 5).cast("int"))
    return _user_queries(spark, sf).select("conv_id", "turn", F.round(search.intent_score(S.query_signal(F.col("query"))["intents"], F.lit(None).cast("string"), m), 9).alias("s"))


def _chunk_rows(spark, sf):
    """Documents as chunks with vectors' ids, some of them routes, some noise."""
    d = t(spark, sf, "documents")
    method = F.get(F.array(F.lit(None).cast("string"), F.lit("POST"), F.lit("GET")), (F.col("doc_id") % 3).cast("int"))
    terms = T.normalize_terms(F.col("text"))
    tags = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 1, F.lit("create_resource")), F.when(F.col("doc_id") % 5 == 0, F.lit("script"))))
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.lit(1).alias("start_line"), (F.col("doc_id") % 50 + 1).cast("int").alias("end_line"),
                    F.when(F.col("doc_id") % 2 == 0, F.lit("fn")).alias("symbol"), F.lit("function").alias("symbol_kind"), "text", T.estimate_tokens(F.col("text")).alias("tokens"), terms.alias("keywords"), F.slice(terms, 1, 20).alias("symbol_terms"),
                    method.alias("route_method"), S.verb_intent(method).alias("route_intent"), F.lit("posts").alias("route_resource"), F.slice(terms, 1, 5).alias("structural_terms"), tags.alias("intent_tags"))


def _searched(spark, sf, k=8):
    q = _queries(spark, sf).withColumn("query", F.concat("query", F.when(F.col("query_id") % 2 == 0, " create the post").otherwise("")))
    return search.search(q, _chunk_rows(spark, sf), _vectors(spark, sf), k)


_OVER = lambda q, w: f"CASE WHEN len({q}) = 0 OR len({w}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({q}), list_distinct({w}))) / len(list_distinct({q})) END"
_SEARCH = f"""WITH {_HITS(96)},
c AS (SELECT doc_id, source || '/' || doc_id::VARCHAR AS file_path, {TOKENS('text')} AS tokens, {TERMS('text')} AS w, ([NULL, 'POST', 'GET'])[(doc_id % 3 + 1)::INT] AS method FROM documents),
j AS (SELECT h.query_id, h.chunk_id, h.hit_rank, h.raw, c.file_path, c.tokens, c.w, c.method, CASE method WHEN 'POST' THEN 'create' WHEN 'GET' THEN 'read' END AS mi,
  {TERMS("h.query || CASE WHEN h.query_id % 2 = 0 THEN ' create the post' ELSE '' END")} AS q FROM hits h JOIN c ON c.doc_id = h.chunk_id),
s AS (SELECT *, {SETS('[' + _INTENTS + ']')} AS i FROM j),
u AS (SELECT *, CASE WHEN raw BETWEEN 0 AND 1 THEN raw ELSE greatest(0, least(1, (raw + 1) / 2)) END AS vector_score, {_OVER('q', 'w')} AS keyword_score, {_OVER('q', 'w[:20]')} AS symbol_score,
  CASE WHEN len(i) = 0 OR method IS NULL THEN 0 ELSE len(list_filter(i, lambda x: x = mi)) / len(i) END AS intent_score,
  {SETS(f'list_filter(q, lambda x: NOT list_contains({LIST(S.STOP_TERMS)}, x))', f'list_filter(q, lambda x: list_contains({LIST(S.VERB_INTENT)}, x))', 'i')} AS st FROM s),
x AS (SELECT *, {_OVER('st', "(w[:5] || list_filter([lower(method), mi, 'posts'], lambda z: z IS NOT NULL))")} AS structural_score FROM u),
y AS (SELECT *, 0.5::DOUBLE * vector_score + 0.18::DOUBLE * keyword_score + 0.12::DOUBLE * symbol_score + 0.12::DOUBLE * intent_score + 0.08::DOUBLE * structural_score AS total,
  CASE WHEN list_contains(i, 'create') AND chunk_id % 3 = 1 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN list_has_any(q, {LIST(search.ROUTE_HINTS)}) AND method IS NOT NULL THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN chunk_id % 5 = 0 THEN 0.7::DOUBLE ELSE 1 END AS multiplier,
  list_sort(list_filter(list_distinct(q), lambda z: list_contains(w, z) OR z = 'posts' OR z = lower(coalesce(method, ''))))[:8] AS matched FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total * multiplier DESC, vector_score DESC, (chunk_id % 2 = 0)::INT DESC, tokens, hit_rank) AS rank FROM y)"""


@query(f"{_SEARCH} SELECT query_id, rank::INT AS rank, chunk_id, file_path, round(total * multiplier, 6) AS score, round(vector_score, 6) AS vector_score, array_to_string(matched, ' ') AS matched_keywords FROM r WHERE rank <= 8")
def search_(spark, sf):
    r = _searched(spark, sf)
    return r.select("query_id", "rank", "chunk_id", "file_path", F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), F.array_join("matched_keywords", " ").alias("matched_keywords"))


QUERIES["search"], ORACLE_SQL["search"] = QUERIES.pop("search_"), ORACLE_SQL.pop("search_")


@query(f"{_SEARCH} SELECT query_id, chunk_id, round(vector_score, 6) AS v, round(keyword_score, 6) AS k, round(symbol_score, 6) AS s, round(intent_score, 6) AS i, round(structural_score, 6) AS t, round(total, 6) AS total FROM r WHERE rank <= 50")
def hybrid_score(spark, sf):
    hits = search.vector_topk(_queries(spark, sf), _vectors(spark, sf), 96)
    q = _queries(spark, sf).withColumn("query", F.concat("query", F.when(F.col("query_id") % 2 == 0, " create the post").otherwise("")))
    rows = search.heuristics(search.hybrid_score(hits.join(search.with_signals(q).select("query_id", "query", "_s", "_q"), "query_id").join(_chunk_rows(spark, sf), "chunk_id")))
    names = {"v": "vector_score", "k": "keyword_score", "s": "symbol_score", "i": "intent_score", "t": "structural_score", "total": "total"}
    return search.rank(rows, 50).select("query_id", "chunk_id", *[F.round(c, 6).alias(a) for a, c in names.items()])


@query(f"{_SEARCH} SELECT query_id, chunk_id, round(multiplier, 6) AS multiplier FROM r WHERE rank <= 8")
def heuristic_multiplier(spark, sf):
    return _searched(spark, sf).select("query_id", "chunk_id", F.round("multiplier", 6).alias("multiplier"))


@query(f"{_SEARCH} SELECT query_id, chunk_id, array_to_string(matched, ' ') AS matched_keywords FROM r WHERE rank <= 8")
def matched_keywords(spark, sf):
    return _searched(spark, sf).select("query_id", "chunk_id", F.array_join("matched_keywords", " ").alias("matched_keywords"))


@query(f"{_SEARCH} SELECT query_id, chunk_id, CASE WHEN list_contains(i, 'create') AND chunk_id % 3 = 1 THEN 'create_resource' ELSE '' END AS matched_intents FROM r WHERE rank <= 8")
def matched_intents(spark, sf):
    return _searched(spark, sf).select("query_id", "chunk_id", F.array_join("matched_intents", " ").alias("matched_intents"))


@query(f"{_SEARCH} SELECT query_id, chunk_id, concat_ws('; ', CASE WHEN list_contains(i, 'create') AND chunk_id % 3 = 1 THEN 'intent match: create_resource' END, CASE WHEN list_has_any(q, {LIST(search.ROUTE_HINTS)}) AND method IS NOT NULL THEN 'route handler boost' END, CASE WHEN chunk_id % 5 = 0 THEN 'noise/script penalty' END) AS reasons FROM r WHERE rank <= 8")
def heuristics(spark, sf):
    return _searched(spark, sf).select("query_id", "chunk_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"{_SEARCH} SELECT query_id, rank::INT AS rank, chunk_id FROM r WHERE rank <= 20")
def hybrid_topk(spark, sf):
    # The candidates are those of eight results; of these the first twenty.
    hits = search.vector_topk(_queries(spark, sf), _vectors(spark, sf), 96)
    q = _queries(spark, sf).withColumn("query", F.concat("query", F.when(F.col("query_id") % 2 == 0, " create the post").otherwise("")))
    rows = search.heuristics(search.hybrid_score(hits.join(search.with_signals(q).select("query_id", "query", "_s", "_q"), "query_id").join(_chunk_rows(spark, sf), "chunk_id")))
    return search.rank(rows, 20).select("query_id", "rank", "chunk_id")


@query(f"{_SEARCH} SELECT query_id, file_path AS file, 1 AS line, 'Top semantic match' AS reason, 'vector' AS source FROM r WHERE rank = 1")
def selection(spark, sf):
    return search.selection(_searched(spark, sf))


@query(f"{_SEARCH} SELECT query_id FROM r WHERE rank = 1 AND vector_score >= 0.3")
def confidence_gate(spark, sf):
    return search.confidence_gate(_searched(spark, sf), 0.3)


@query(f"{_SEARCH}, z AS (SELECT query_id, chunk_id, rank, CASE WHEN rank <= 5 THEN 0.7::DOUBLE * total * multiplier + 0.3::DOUBLE * (1 / (1 + exp(-((chunk_id % 7) - 3)::DOUBLE))) ELSE total * multiplier END AS s FROM r WHERE rank <= 8) SELECT query_id, chunk_id, round(s, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY rank > 5, CASE WHEN rank <= 5 THEN -s ELSE 0 END, rank))::INT AS rank FROM z")
def local_rerank(spark, sf):
    m = _searched(spark, sf).withColumn("raw", (F.col("chunk_id") % 7 - 3).cast("double"))
    return search.local_rerank(m, "raw", 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_SEARCH}, a AS (SELECT DISTINCT query_id, first_value(file_path) OVER (PARTITION BY query_id ORDER BY rank DESC) AS file, (query_id % 60 + 1)::INT AS line FROM r WHERE rank <= 8) SELECT a.query_id, a.file, CASE WHEN a.line <= r.chunk_id % 50 + 1 THEN a.line ELSE 1 END AS line, 'because' AS reason, 'llm' AS source FROM a JOIN r ON r.query_id = a.query_id AND r.file_path = a.file AND r.rank <= 8")
def selection_range_join(spark, sf):
    m = _searched(spark, sf)
    last = m.groupBy("query_id").agg(F.max_by("file_path", "rank").alias("file"))
    answers = last.select("query_id", "file", (F.col("query_id") % 60 + 1).cast("int").alias("line"), F.lit(" because ").alias("reason"))
    return search.select_by_answer(answers, m)


@query(f"{_SEARCH} SELECT query_id, count(*) AS n, min(rank)::INT AS first FROM r WHERE rank <= 8 GROUP BY query_id")
def llm_candidates(spark, sf):
    return _searched(spark, sf).where("rank <= 10").groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"))


@query(f"{_SEARCH} SELECT r.query_id, r.rank::INT AS rank, r.file_path, (r.chunk_id % 50 + 1)::INT AS end_line, CASE WHEN r.chunk_id % 2 = 0 THEN 'fn' END AS symbol, round(total * multiplier, 6) AS score, CASE WHEN length(text) <= 1800 THEN text ELSE left(text, 1800) || chr(10) || '... [truncated]' END AS snippet FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 8")
def candidates_json(spark, sf):
    """The JSON text of each query's candidates, read back."""
    j = search.candidates_json(_searched(spark, sf).withColumn("score", F.round("score", 6)))
    item = "array<struct<rank:int,file_path:string,end_line:int,symbol:string,score:double,snippet:string>>"
    return j.select("query_id", F.explode(F.from_json("candidates", item)).alias("c")).select("query_id", "c.*")


@query(f"""{_SEARCH} SELECT query_id, rank::INT AS rank, concat_ws('; ', format('semantic={{:.3f}}', vector_score::DOUBLE), format('keyword={{:.3f}}', keyword_score::DOUBLE), format('symbol={{:.3f}}', symbol_score::DOUBLE),
  format('intent={{:.3f}}', intent_score::DOUBLE), format('structural={{:.3f}}', structural_score::DOUBLE), 'heuristics=' || nullif(concat_ws(', ', CASE WHEN list_contains(i, 'create') AND chunk_id % 3 = 1 THEN 'intent match: create_resource' END,
  CASE WHEN list_has_any(q, {LIST(search.ROUTE_HINTS)}) AND method IS NOT NULL THEN 'route handler boost' END, CASE WHEN chunk_id % 5 = 0 THEN 'noise/script penalty' END), '')) AS explanation FROM r WHERE rank <= 8""")
def explanation(spark, sf):
    return search.explain(_searched(spark, sf)).select("query_id", "rank", "explanation")


@query(f"{_SEARCH} SELECT query_id, chunk_id, (list_has_any(q, {LIST(search.ROUTE_HINTS)}) AND method IS NOT NULL) AS boosted FROM r WHERE rank <= 8")
def route_boost(spark, sf):
    r = _searched(spark, sf)
    return r.select("query_id", "chunk_id", search.route_boost(F.col("_q"), F.col("route_method"), F.col("intent_tags"), F.col("symbol_kind")).alias("boosted"))


@query(f"WITH {CHUNKS} SELECT doc_id, (contains(p, 'seed') OR contains(p, 'migration') OR contains(lower(p), 'test') OR contains(lower(p), 'spec') OR contains(lower(p), 'script')) AS noisy FROM (SELECT doc_id, {_PATHS} AS p FROM chunks)")
def noise_penalty(spark, sf):
    return doc_chunks(spark, sf).select("doc_id", search.noise_penalty(S.noise_tags(_paths())).alias("noisy"))


@query(f"{_SEARCH} SELECT query_id, r.chunk_id, rank::INT AS rank, concat_ws(chr(10), 'File: ' || file_path, CASE WHEN chunk_id % 2 = 0 THEN 'Symbol: fn' END, 'd', left(text, 1200)) AS t FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 8")
def rerank_text(spark, sf):
    r = _searched(spark, sf).withColumn("description", F.lit("d"))
    return r.select("query_id", "chunk_id", "rank", search.rerank_text().alias("t"))


@query(f"{_SEARCH} SELECT query_id, rank::INT AS rank, file_path, round(total * multiplier, 6) AS score FROM r WHERE rank <= 8")
def result_projection(spark, sf):
    return _searched(spark, sf).select("query_id", "rank", "file_path", F.round("score", 6).alias("score"))


@query(f"{_SEARCH} SELECT query_id, count(*) AS n FROM r GROUP BY query_id")
def hits_join_chunks(spark, sf):
    return search.vector_topk(_queries(spark, sf), _vectors(spark, sf), 96).join(_chunk_rows(spark, sf), "chunk_id").groupBy("query_id").agg(F.count("*").alias("n"))


# Chunking.
@query(f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS lines FROM documents WHERE text <> ''),
z AS (SELECT doc_id, lines, list_transform(lines, lambda x: {TOKENS('x')}) AS n FROM l),
f(doc_id, i, s, cur, part) AS (
  SELECT doc_id, 0, 0, 0::BIGINT, NULL::INT[] FROM z
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN c2 >= 80 THEN i + 1 ELSE s2 END, CASE WHEN c2 >= 80 THEN 0 ELSE c2 END, CASE WHEN cut THEN [s, i] ELSE [] END || CASE WHEN c2 >= 80 THEN [s2, i + 1] ELSE [] END
  FROM (SELECT *, CASE WHEN cut THEN x ELSE cur + x END AS c2, CASE WHEN cut THEN i ELSE s END AS s2 FROM (
    SELECT f.doc_id, i, s, cur, n[i + 1] AS x, (i > s AND cur + n[i + 1] > 50 AND cur >= 20) AS cut FROM f JOIN z USING (doc_id) WHERE i < len(n)))),
p AS (SELECT doc_id, part[1] AS s, part[2] AS e FROM f WHERE len(part) >= 2 UNION ALL SELECT doc_id, part[3], part[4] FROM f WHERE len(part) = 4
  UNION ALL SELECT f.doc_id, s, i FROM f JOIN z USING (doc_id) WHERE i = len(n) AND i > s)
SELECT doc_id, (s + 1)::INT AS start_line, e::INT AS end_line, sha256(array_to_string(lines[s + 1 : e], chr(10))) AS part FROM p JOIN z USING (doc_id)""")
def line_packer(spark, sf):
    d = t(spark, sf, "documents").where("text <> ''").select("doc_id", F.explode(chunking.pack_lines(F.col("text"), 20, 50, 80)).alias("p"))
    return d.select("doc_id", "p.start_line", "p.end_line", F.sha2("p.text", 256).alias("part"))


def _files(spark, sf, each: int | None = None):
    """Documents as files with symbols: two halves, or one for ``each`` lines."""
    ship(spark)
    d = doc_chunks(spark, sf).where("text IS NOT NULL").withColumn("_k", F.size(F.split("text", "\n", -1)))
    step = F.greatest(F.lit(1), F.floor(F.col("_k") / 2)).cast("int") if each is None else F.lit(each)
    count = F.lit(2) if each is None else F.ceil(F.col("_k") / each).cast("int")
    last = lambda i: F.when(i == count, F.col("_k")).otherwise(i * step)
    sym = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(F.lit("function").alias("kind"), F.concat(F.lit("s"), i.cast("string")).alias("name"), ((i - 1) * step + 1).cast("int").alias("start_line"), last(i).cast("int").alias("end_line"), F.lit("").alias("text")))
    return d.select("repo_path", "file_path", F.lit("python").alias("language"), "text", T.content_hash(F.col("text")).alias("content_hash"), sym.alias("symbols"))


# The folds in SQL.  Every step is a relation (id: file and draft, f: file, symbol, kind, s, e, t: text).
_TEXTS = f"""{CHUNKS}, src AS (SELECT file_path AS f, len(string_split(text, chr(10))) AS k, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) END AS lines FROM chunks WHERE text IS NOT NULL)"""
_STRIPPED = r"regexp_replace(regexp_replace({}, '^[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ''), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '')"


def _slices_sql(each: int | None = None) -> str:
    step, count = ("greatest(1, k // 2)", "2") if each is None else (str(each), f"ceil(k / {each})::INT")
    return f"""sym AS (SELECT f, lines, i, ((i - 1) * {step} + 1) AS s, CASE WHEN i = {count} THEN k ELSE i * {step} END AS e0 FROM (SELECT *, unnest(range(1, {count} + 1)) AS i FROM src)),
slices AS (SELECT f || '|' || i AS id, f, 's' || i AS symbol, 'function' AS kind, s, e, t FROM (SELECT *, {_STRIPPED.format("array_to_string(lines[s:e], chr(10))")} AS t FROM (SELECT *, greatest(s, e0) AS e FROM sym)) WHERE t <> '')"""


def _split_sql(src: str, name: str, low: int, target: int, high: int) -> str:
    """Drafts of ``src`` over ``high`` tokens in parts."""
    return f"""{name}_z AS (SELECT *, list_transform(l, lambda x: {TOKENS('x')}) AS n FROM (SELECT *, string_split(t, chr(10)) AS l, {TOKENS('t')} AS tokens FROM {src}) WHERE tokens > {high}),
{name}_f(id, i, s, cur, part) AS (
  SELECT id, 0, 0, 0::BIGINT, NULL::INT[] FROM {name}_z
  UNION ALL
  SELECT id, i + 1, CASE WHEN c2 >= {high} THEN i + 1 ELSE s2 END, CASE WHEN c2 >= {high} THEN 0 ELSE c2 END, CASE WHEN cut THEN [s, i] ELSE [] END || CASE WHEN c2 >= {high} THEN [s2, i + 1] ELSE [] END
  FROM (SELECT *, CASE WHEN cut THEN x ELSE cur + x END AS c2, CASE WHEN cut THEN i ELSE s END AS s2 FROM (
    SELECT a.id, i, a.s, cur, n[i + 1] AS x, (i > a.s AND cur + n[i + 1] > {target} AND cur >= {low}) AS cut FROM {name}_f a JOIN {name}_z z USING (id) WHERE i < len(n)))),
{name}_p AS (SELECT id, part[1] AS p, part[2] AS q FROM {name}_f WHERE len(part) >= 2 UNION ALL SELECT id, part[3], part[4] FROM {name}_f WHERE len(part) = 4
  UNION ALL SELECT a.id, a.s, i FROM {name}_f a JOIN {name}_z z USING (id) WHERE i = len(n) AND i > a.s),
{name} AS (SELECT id || '|' || p AS id, f, symbol, kind, s + p AS s, s + q - 1 AS e, array_to_string(l[p + 1 : q], chr(10)) AS t FROM {name}_p JOIN {name}_z USING (id)
  UNION ALL SELECT id, f, symbol, kind, s, e, t FROM {src} WHERE {TOKENS('t')} <= {high})"""


def _small_sql(src: str, name: str, low: int, high: int, gap: int = 40) -> str:
    """Neighbouring drafts under ``low`` tokens joined while they fit."""
    return f"""{name}_z AS (SELECT f, list(t ORDER BY s, e) AS t, list({TOKENS('t')} ORDER BY s, e) AS n, list(s ORDER BY s, e) AS s, list(e ORDER BY s, e) AS e, list(symbol ORDER BY s, e) AS y, list(kind ORDER BY s, e) AS k FROM {src} GROUP BY f),
{name}_f(f, i, h, cur, part) AS (
  SELECT f, 0, 0, 0::BIGINT, NULL::INT[] FROM {name}_z
  UNION ALL
  SELECT f, i + 1, CASE WHEN x >= {low} THEN i + 1 WHEN flush THEN i ELSE h END, CASE WHEN x >= {low} THEN 0 WHEN flush THEN x ELSE cur + x END,
    CASE WHEN flush THEN [h, i] ELSE [] END || CASE WHEN x >= {low} THEN [i, i + 1] ELSE [] END
  FROM (SELECT *, i > h AND (x >= {low} OR cur + x > {high} OR d > {gap}) AS flush FROM (
    SELECT a.f, i, h, cur, n[i + 1] AS x, CASE WHEN i > 0 THEN z.s[i + 1] - z.e[i] ELSE 0 END AS d FROM {name}_f a JOIN {name}_z z USING (f) WHERE i < len(n)))),
{name}_p AS (SELECT f, part[1] AS p, part[2] AS q FROM {name}_f WHERE len(part) >= 2 UNION ALL SELECT f, part[3], part[4] FROM {name}_f WHERE len(part) = 4
  UNION ALL SELECT a.f, h, i FROM {name}_f a JOIN {name}_z z USING (f) WHERE i = len(n) AND i > h),
{name} AS (SELECT f, p, CASE WHEN q = p + 1 THEN y[q] END AS symbol, CASE WHEN q = p + 1 THEN k[q] ELSE 'major_block' END AS kind, s[p + 1] AS s, e[q] AS e, array_to_string(t[p + 1 : q], chr(10) || chr(10)) AS t FROM {name}_p JOIN {name}_z USING (f))"""


def _tail_sql(src: str, name: str, low: int, high: int) -> str:
    """A small last draft joined to the one before it."""
    return f"""{name}_z AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p DESC) AS back, lead(t) OVER (PARTITION BY f ORDER BY p) AS t2, lead(e) OVER (PARTITION BY f ORDER BY p) AS e2 FROM {src}),
{name}_y AS (SELECT f FROM {name}_z WHERE back = 2 AND {TOKENS('t2')} < {low} AND {TOKENS('t')} + {TOKENS('t2')} <= {high}),
{name} AS (SELECT f, p, symbol, kind, s, CASE WHEN back = 2 AND y.f IS NOT NULL THEN e2 ELSE e END AS e, CASE WHEN back = 2 AND y.f IS NOT NULL THEN t || chr(10) || chr(10) || t2 ELSE t END AS t
  FROM {name}_z z LEFT JOIN {name}_y y USING (f) WHERE NOT (back = 1 AND y.f IS NOT NULL))"""


_DRAFT_COLUMNS = f"f AS file_path, s::INT AS start_line, e::INT AS end_line, symbol, kind AS symbol_kind, {TOKENS('t')}::INT AS tokens, sha256(t) AS part"


def _draft_rows(drafts: DataFrame) -> DataFrame:
    return drafts.select("file_path", "start_line", "end_line", "symbol", "symbol_kind", T.estimate_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("part"))


@query(f"WITH {_TEXTS}, {_slices_sql()} SELECT {_DRAFT_COLUMNS} FROM slices")
def symbol_slices(spark, sf):
    return _draft_rows(chunking.draft_files(_files(spark, sf), steps=("slices",)))


_FALLBACK = "whole AS (SELECT f AS id, f, NULL::VARCHAR AS symbol, 'major_block' AS kind, 1 AS s, len(lines) AS e, array_to_string(lines, chr(10)) AS t FROM src WHERE len(lines) > 0)"


@query(f"WITH RECURSIVE {_TEXTS}, {_FALLBACK}, {_split_sql('whole', 'parts', 40, 80, 120)} SELECT {_DRAFT_COLUMNS} FROM parts")
def file_fallback(spark, sf):
    return _draft_rows(chunking.draft_files(_files(spark, sf).withColumn("symbols", F.slice("symbols", 1, 0)), 40, 120, 80, steps=("slices", "fallback")))


@query(f"WITH RECURSIVE {_TEXTS}, {_slices_sql()}, {_split_sql('slices', 'parts', 40, 80, 120)} SELECT {_DRAFT_COLUMNS} FROM parts")
def split_large(spark, sf):
    return _draft_rows(chunking.draft_files(_files(spark, sf), 40, 120, 80, steps=("slices", "split")))


@query(f"WITH RECURSIVE {_TEXTS}, {_slices_sql(1)}, {_small_sql('slices', 'joined', 60, 200)} SELECT {_DRAFT_COLUMNS} FROM joined")
def merge_small(spark, sf):
    return _draft_rows(chunking.draft_files(_files(spark, sf, 1), 60, 200, 120, steps=("slices", "small")))


@query(f"WITH RECURSIVE {_TEXTS}, {_slices_sql(1)}, {_small_sql('slices', 'joined', 60, 200)}, {_tail_sql('joined', 'done', 60, 200)} SELECT {_DRAFT_COLUMNS} FROM done")
def merge_tail(spark, sf):
    return _draft_rows(chunking.draft_files(_files(spark, sf, 1), 60, 200, 120, steps=("slices", "small", "tail")))


_ENRICHED = f"""g AS (SELECT *, {TERMS("concat_ws(chr(10), f, coalesce(symbol, ''), left(t, 8000))")} AS w, {TERMS("coalesce(symbol, '')")} AS own, {TERMS('f')} AS pt,
  nullif(lower(regexp_extract(t, '(?i)\\b(get|post|put|delete|patch)\\b', 1)), '') AS v FROM done),
h AS (SELECT *, CASE v WHEN 'post' THEN 'create' WHEN 'get' THEN 'read' WHEN 'delete' THEN 'delete' WHEN 'put' THEN 'update' WHEN 'patch' THEN 'update' END AS i, CASE WHEN v IS NOT NULL THEN {SING(f'(list_filter(own, lambda x: NOT list_contains({LIST(S.SYMBOL_SKIP)}, x)))[1]')} END AS r FROM g),
j AS (SELECT *, {SETS(f"[{_TAGS}, CASE WHEN list_has_any(w, {LIST(S.LOGGING)}) THEN 'logging' END, CASE WHEN list_has_any(w, {LIST(S.ANALYTICS)}) THEN 'analytics' END, CASE WHEN v IS NOT NULL THEN 'route_handler' END]")} AS tags,
  {SETS('w', "CASE WHEN v IS NOT NULL THEN [v, i, r] || own ELSE []::VARCHAR[] END", 'pt')} AS st FROM h),
l AS (SELECT *, {_STRIPPED.format("left(" + _STRIPPED.format("string_split(" + _STRIPPED.format('t') + ", chr(10))[1]") + ", 120)")} AS head,
  coalesce(' Intent: ' || i || ' resource. HTTP method: ' || upper(v) || '.' || coalesce(' Resource: ' || r || '.', ''), '') || CASE WHEN len(tags) > 0 THEN ' Tags: ' || array_to_string(tags, ', ') || '.' ELSE '' END AS more FROM j),
m AS (SELECT *, {_STRIPPED.format("CASE WHEN symbol IS NOT NULL AND kind = 'function' THEN 'Function ' || symbol || ' in ' || f || '. Starts with: ' || head || more ELSE 'Major code block in ' || f || ' (lines ' || s::VARCHAR || '-' || e::VARCHAR || '). Starts with: ' || head || more END")} AS description FROM l)"""


@query(f"""WITH RECURSIVE {_TEXTS}, {_slices_sql()}, {_split_sql('slices', 'parts', 200, 500, 800)}, {_small_sql('parts', 'joined', 200, 800)}, {_tail_sql('joined', 'done', 200, 800)}, {_ENRICHED}
SELECT f AS file_path, 'python' AS language, s::INT AS start_line, e::INT AS end_line, symbol, kind AS symbol_kind, sha256(f || '|' || s::VARCHAR || '|' || e::VARCHAR || '|' || t) AS chunk_id, {TOKENS('t')}::INT AS tokens, description,
  array_to_string({TERMS("concat_ws(chr(10), description, left(t, 4000), 'Intent: ' || i, 'HTTP method: ' || upper(v), 'Resource: ' || r)")}, ' ') AS keywords, array_to_string({SETS('own', 'st')}, ' ') AS symbol_terms, array_to_string(st, ' ') AS structural_terms,
  array_to_string(tags, ' ') AS intent_tags, upper(v) AS route_method, i AS route_intent, r AS route_resource, NULL::VARCHAR AS route_path FROM m""")
def build_chunks(spark, sf):
    c = chunking.chunk_files(_files(spark, sf)).drop("text", "repo_path", "content_hash", "llm_summary")
    return c.select(*[F.array_join(x, " ").alias(x) if kind.startswith("array") else x for x, kind in c.dtypes])


def _drafts(spark, sf):
    return route_code(spark, sf).select("page_id", F.concat(F.lit("app/"), F.col("page_id").cast("string"), F.lit(".js")).alias("file_path"), F.lit("route").alias("symbol_kind"), F.lit(None).cast("string").alias("symbol"),
                                        F.col("code").alias("text"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))


_DRAFT = f"""WITH {ROUTES}, a AS (SELECT page_id, 'app/' || page_id::VARCHAR || '.js' AS f, code, path, upper(v) AS m, v, CASE v WHEN 'post' THEN 'create' WHEN 'get' THEN 'read' WHEN 'delete' THEN 'delete' ELSE 'update' END AS i FROM routes),
b0 AS (SELECT *, {TERMS("f || chr(10) || chr(10) || code")} AS w, ({TERMS(f"coalesce(({SEGMENTS('path')})[1], chr(32))")})[1] AS r0, flatten(list_transform({SEGMENTS('path')}, lambda s: {TERMS('s')})) AS seg FROM a),
b AS (SELECT *, {SING('r0')} AS r FROM b0),
c AS (SELECT *, {SETS(f"[{_TAGS}, CASE WHEN list_has_any(w, {LIST(S.LOGGING)}) THEN 'logging' END, CASE WHEN list_has_any(w, {LIST(S.ANALYTICS)}) THEN 'analytics' END, 'route_handler']")} AS tags,
  {SETS('w', '[v, i, r]', 'seg', TERMS('f'))} AS st FROM b),
d AS (SELECT *, 'Route handler unnamed route in ' || f || '. Starts with: ' || left(code, 120) || ' Intent: ' || i || ' resource. HTTP method: ' || m || '.' || coalesce(' Resource: ' || r || '.', '') || ' Path: ' || path || '. Tags: ' || array_to_string(tags, ', ') || '.' AS description FROM c)"""


@query(f"{_DRAFT} SELECT page_id, description FROM d")
def describe_chunk(spark, sf):
    return chunking.enrich(_drafts(spark, sf)).select("page_id", "description")


@query(f"{_DRAFT} SELECT page_id, array_to_string(st, ' ') AS symbol_terms FROM d")
def symbol_terms(spark, sf):
    return chunking.enrich(_drafts(spark, sf)).select("page_id", F.array_join("symbol_terms", " ").alias("symbol_terms"))


@query(f"{_DRAFT} SELECT page_id, array_to_string({TERMS("concat_ws(chr(10), description, left(code, 4000), 'Intent: ' || i, 'HTTP method: ' || m, 'Resource: ' || r, 'Path: ' || path)")}, ' ') AS keywords FROM d")
def chunk_keywords(spark, sf):
    return chunking.enrich(_drafts(spark, sf)).select("page_id", F.array_join("keywords", " ").alias("keywords"))


@query(f"{_DRAFT} SELECT page_id, concat_ws(chr(10), 'File: ' || f, 'Symbol: anonymous', 'Type: route', 'Intent: ' || array_to_string(tags, ', '), '', 'Summary:', description) || chr(10) || chr(10) || 'HTTP Metadata' || chr(10) || 'Method: ' || m || chr(10) || 'Route: ' || path AS t FROM d")
def embedding_text(spark, sf):
    return chunking.enrich(_drafts(spark, sf)).select("page_id", chunking.embedding_text().alias("t"))


@query(f"WITH {ROUTES} SELECT page_id, upper(v) || ' ' || path AS name FROM routes")
def route_name(spark, sf):
    return route_code(spark, sf).select("page_id", symbols.route_name(F.col("code")).alias("name"))


@query(f"WITH {ROUTES} SELECT page_id FROM routes WHERE page_id % 3 <> 0")
def route_call_filter(spark, sf):
    code = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("code", "'/", "'")).otherwise(F.col("code"))
    return route_code(spark, sf).where(symbols.route_call(code)).select("page_id")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_orderkey % 50 AS s, l_orderkey % 50 + l_quantity::INT AS e FROM lineitem WHERE l_linenumber <= 3), k AS (SELECT l_orderkey AS o, l_orderkey % 50 AS s, l_orderkey % 50 + l_quantity::INT AS e FROM lineitem WHERE l_linenumber > 3)
SELECT l_orderkey, l_linenumber FROM b WHERE e - s + 1 >= 15 AND NOT EXISTS (SELECT 1 FROM k WHERE o = l_orderkey AND k.s <= b.s AND b.e <= k.e)""")
def major_blocks(spark, sf):
    i = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_path"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 50).alias("start_line"), (F.col("l_orderkey") % 50 + F.col("l_quantity").cast("int")).alias("end_line"))
    return symbols.major_blocks(i.where("l_linenumber <= 3"), i.where("l_linenumber > 3")).select("l_orderkey", "l_linenumber")


# Incremental index.
@query(f"WITH {CURRENT} SELECT f.file_path, f.content_hash FROM files f LEFT JOIN known k USING (repo_path, file_path) WHERE k.content_hash IS DISTINCT FROM f.content_hash")
def changed_files(spark, sf):
    return indexing.changed_files(current_files(spark, sf), known_files(spark, sf)).select("file_path", "content_hash")


@query(f"WITH {CURRENT} SELECT file_path FROM known WHERE file_path NOT IN (SELECT file_path FROM files)")
def deleted_files(spark, sf):
    return indexing.deleted_files(current_files(spark, sf), known_files(spark, sf)).select("file_path")


@query(f"WITH {KNOWN} SELECT file_path, content_hash FROM known WHERE repo_path = 'corpus'")
def known_hashes(spark, sf):
    return known_files(spark, sf).where("repo_path = 'corpus'").select("file_path", "content_hash")


@query("SELECT 'r/' || lang AS repo_path, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def repo_filter(spark, sf):
    """The rows of two repositories out of all."""
    files = t(spark, sf, "documents").select(F.concat(F.lit("r/"), "lang").alias("repo_path"), "doc_id")
    return files.where(F.col("repo_path").isin("r/en", "r/fr")).groupBy("repo_path").agg(F.count("*").alias("n"))


@query(f"WITH {CURRENT} SELECT file_path, content_hash FROM files UNION ALL SELECT file_path, content_hash FROM known WHERE file_path NOT IN (SELECT file_path FROM files)")
def upsert_files(spark, sf):
    new = current_files(spark, sf).select("repo_path", "file_path", "content_hash")
    return indexing.upsert(known_files(spark, sf), new, ["repo_path", "file_path"]).select("file_path", "content_hash")


@query(f"WITH {CURRENT} SELECT file_path, content_hash FROM known WHERE file_path IN (SELECT file_path FROM files)")
def delete_files(spark, sf):
    k = known_files(spark, sf)
    return indexing.delete(k, indexing.deleted_files(current_files(spark, sf), k), ["repo_path", "file_path"]).select("file_path", "content_hash")


@query("SELECT o_custkey AS chunk_id, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def upsert_chunks(spark, sf):
    old = t(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_id"), F.lit(-1).cast("long").alias("version"))
    new = t(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("version"), F.col("o_orderkey").alias("at"))
    return indexing.upsert(old, new, ["chunk_id"], "at")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)")
def delete_chunks(spark, sf):
    gone = t(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return indexing.delete(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)")
def lookup_chunks(spark, sf):
    ids = t(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return indexing.lookup(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ids, "l_orderkey")


@query(f"WITH {CHUNKS} SELECT doc_id, sha256(text) AS chunk_id FROM chunks WHERE file_path LIKE 'src1/%'")
def chunk_ids_for_file(spark, sf):
    return doc_chunks(spark, sf).where(F.col("file_path").startswith("src1/")).select("doc_id", T.content_hash(F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, sha256(text) AS k, v IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT DISTINCT sha256(text) AS k2, 1 AS v FROM documents WHERE doc_id % 2 = 0) ON k2 = sha256(text)")
def embedding_cache(spark, sf):
    """Which texts are in the cache and which are still to embed."""
    d = t(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("k"))
    found, missing = indexing.cache_split(d, d.where("doc_id % 2 = 0").select("k").distinct(), ["k"])
    return found.withColumn("hit", F.lit(True)).unionByName(missing.withColumn("hit", F.lit(False)))


@query("SELECT sha256('m|' || doc_id::VARCHAR || '|' || text) AS summary_key, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE 'made' END AS summary FROM documents")
def summary_cache(spark, sf):
    """The cache after the missing summaries are made and stored."""
    keyed = t(spark, sf, "documents").select("doc_id", T.summary_key(F.lit("m"), F.col("doc_id").cast("string"), F.col("text")).alias("summary_key"))
    cache = keyed.where("doc_id % 3 = 0").select("summary_key", F.lit("kept").alias("summary"))
    _, missing = indexing.cache_split(keyed, cache, ["summary_key"])
    return indexing.upsert(cache, missing.select("summary_key", F.lit("made").alias("summary")), ["summary_key"])


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'none' ELSE 'label ' || quality::VARCHAR END AS llm_summary FROM documents LEFT JOIN labels USING (doc_id)")
def apply_summaries(spark, sf):
    c = t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("none").alias("llm_summary"))
    s = t(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("summary"))
    return indexing.apply_summaries(c, s).withColumnRenamed("chunk_id", "doc_id")


@query("SELECT source AS repo_path, count(DISTINCT lang) AS files, count(*) AS chunks FROM documents GROUP BY 1")
def status(spark, sf):
    d = t(spark, sf, "documents").withColumnRenamed("source", "repo_path")
    meta = d.select("repo_path").distinct().withColumn("last_indexed_at", F.current_timestamp())
    return indexing.status(d.select("repo_path", "lang").distinct(), d, meta).drop("last_indexed_at")


@query(f"WITH {CURRENT} SELECT (SELECT count(*) FROM files) AS files_scanned, (SELECT count(*) FROM files f LEFT JOIN known k USING (repo_path, file_path) WHERE k.content_hash IS DISTINCT FROM f.content_hash) AS files_indexed, (SELECT count(*) FROM known WHERE file_path NOT IN (SELECT file_path FROM files)) AS files_deleted, (SELECT count(*) FROM chunks) AS chunks_indexed")
def index_stats(spark, sf):
    f, k = current_files(spark, sf), known_files(spark, sf)
    return indexing.index_stats(f, indexing.changed_files(f, k), indexing.deleted_files(f, k), doc_chunks(spark, sf))


@query("""WITH o AS (SELECT c_nationkey AS repo_path, max(c_custkey) AS last FROM customer WHERE c_nationkey < 15 GROUP BY 1), n AS (SELECT c_nationkey AS repo_path, -max(c_custkey) AS last FROM customer WHERE c_nationkey >= 10 GROUP BY 1)
SELECT repo_path, coalesce(n.last, o.last) AS last FROM o FULL JOIN n USING (repo_path)""")
def repo_meta(spark, sf):
    """Old rows, some replaced by the last of several new ones."""
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("repo_path"), F.col("c_custkey").alias("last"))
    old = c.where("repo_path < 15").groupBy("repo_path").agg(F.max("last").alias("last"))
    new = c.where("repo_path >= 10").select("repo_path", (-F.col("last")).alias("last"), F.col("last").alias("at"))
    return indexing.upsert(old, new, ["repo_path"], "at")


@query("SELECT n_name, 'x' AS route_method FROM nation")
def schema_evolution(spark, sf):
    return indexing.add_column(t(spark, sf, "nation").select("n_name"), "route_method", "string", "x")


def _vector_index(spark, sf):
    v = t(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), F.lit("corpus").alias("repo_path"), F.concat(F.lit("f/"), (F.col("vec_id") % 20).cast("string")).alias("file_path"), F.col("embedding").alias("vector"))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'new/' || vec_id::VARCHAR ELSE 'f/' || (vec_id % 20)::VARCHAR END AS file_path, round(CASE WHEN vec_id % 2 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def vector_upsert(spark, sf):
    """A third of the vectors is there; every second one is put in or replaced, with its payload."""
    all_ = _vector_index(spark, sf)
    new = all_.where("chunk_id % 2 = 0")
    chunks = new.select("chunk_id", "repo_path", F.concat(F.lit("new/"), F.col("chunk_id").cast("string")).alias("file_path"))
    vectors = new.select("chunk_id", F.transform("vector", lambda x: -x).alias("vector"))
    out = indexing.upsert_vectors(all_.where("chunk_id % 3 = 0"), chunks, vectors)
    return out.select("chunk_id", "file_path", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 20 NOT IN (3, 7) AND vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def vector_delete(spark, sf):
    """Vectors go by chunk and by the file of their payload."""
    gone = t(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("chunk_id"))
    paths = spark.createDataFrame([("corpus", "f/3"), ("corpus", "f/7"), ("other", "f/1")], "repo_path string, file_path string")
    return indexing.delete_vectors(_vector_index(spark, sf), gone, paths).select("chunk_id")


@query("SELECT event_type, round(avg(value), 6) AS mean, median(value) AS p50, max(value) FILTER (i = greatest(1, floor(n * 0.95))) AS p95, max(value) FILTER (i = greatest(1, floor(n * 0.99))) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def latency_percentiles(spark, sf):
    return indexing.latency_percentiles(t(spark, sf, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, round(sum(value), 4) AS ms FROM events GROUP BY 1")
def latency_sum(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("ms"))


@query("SELECT p FROM (SELECT (['', '.git/', 'node_modules/', 'a/__pycache__/', 'b/.c/'])[(doc_id % 5 + 1)::INT] || source || '/' || CASE WHEN doc_id % 7 = 0 THEN '.x' ELSE 'x' END || doc_id::VARCHAR AS p, doc_id FROM documents) WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0")
def repo_scan_denylist(spark, sf):
    head = F.get(S.strings(["", ".git/", "node_modules/", "a/__pycache__/", "b/.c/"]), (F.col("doc_id") % 5).cast("int"))
    p = F.concat(head, "source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, ".x").otherwise("x"), F.col("doc_id").cast("string"))
    return t(spark, sf, "documents").select(p.alias("p")).where(~repo.denied(F.col("p")))


@query()
def embed(spark, sf):
    ship(spark)
    return embedding.embed(t(spark, sf, "benchmark"), "text", "vector", embedding.HashingEmbedder())


@query()
def repo_scan(spark, sf):
    """The package's own source, scanned by the data source."""
    import os

    ship(spark)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return repo.read_repo(spark, root).select("file_path", "language", "content_hash")


@query()
def extract_symbols(spark, sf):
    import os

    ship(spark)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = symbols.with_symbols(repo.read_repo(spark, root).where("text IS NOT NULL").select("file_path", "language", "text"))
    return found.select("file_path", F.explode("symbols").alias("s")).select("file_path", "s.kind", "s.name", "s.start_line", "s.end_line")


_IGNORE = "*.log\n!keep.log\n/src1/\nsub/**/deep\n"


@query("""SELECT p FROM (SELECT source || '/' || (['a.py', 'x.log', 'keep.log', 'sub/q/deep/a.py', 'sub/deep/b.py', 'z/sub/q/deep/a.py'])[(doc_id % 6 + 1)::INT] || CASE WHEN doc_id % 6 = 0 THEN doc_id::VARCHAR ELSE '' END AS p FROM documents)
WHERE NOT starts_with(p, 'src1/') AND NOT (ends_with(p, '.log') AND NOT ends_with(p, '/keep.log')) AND NOT regexp_matches(p, '^sub/(.*/)?deep(/|$)')""")
def repo_scan_gitignore(spark, sf):
    """Paths that the root's ignore file leaves."""
    tail = F.get(S.strings(["a.py", "x.log", "keep.log", "sub/q/deep/a.py", "sub/deep/b.py", "z/sub/q/deep/a.py"]), (F.col("doc_id") % 6).cast("int"))
    p = F.concat("source", F.lit("/"), tail, F.when(F.col("doc_id") % 6 == 0, F.col("doc_id").cast("string")).otherwise(""))
    return t(spark, sf, "documents").select(p.alias("p")).where(~repo.IgnoreRules(_IGNORE).ignored(F.col("p")))


@query("SELECT doc_id, sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) || 'end' || chr(10)) AS content_hash FROM documents")
def file_read(spark, sf):
    """File contents with bad bytes and foreign line ends as text."""
    ship(spark)
    raw = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("0D0AFF")), F.lit("end").cast("binary"), F.unhex(F.lit("C30D")))
    return t(spark, sf, "documents").select("doc_id", T.content_hash(repo.file_text(raw)).alias("content_hash"))


def _parsed(spark, sf, language: str, code: Column) -> DataFrame:
    ship(spark)
    files = route_code(spark, sf).select("page_id", F.lit(language).alias("language"), code.alias("text"))
    found = symbols.with_symbols(files).select("page_id", F.explode("symbols").alias("s"))
    return found.select("page_id", "s.kind", "s.name", "s.start_line", "s.end_line")


@query(f"""WITH {ROUTES}, r AS (SELECT page_id, page_id::VARCHAR AS p FROM routes)
SELECT page_id, 'route' AS kind, 'view_' || p AS name, 1 AS start_line, 3 AS end_line FROM r UNION ALL SELECT page_id, 'route', NULL, 1, 1 FROM r UNION ALL SELECT page_id, 'function', 'view_' || p, 2, 3 FROM r
UNION ALL SELECT page_id, 'class', 'Model' || p, 5, 7 FROM r UNION ALL SELECT page_id, 'handler', 'on_handler', 6, 7 FROM r UNION ALL SELECT page_id, 'major_block', NULL, 8, 24 FROM r
UNION ALL SELECT page_id, 'major_block', NULL, 25, 41 FROM r UNION ALL SELECT page_id, 'function', 'cached', 26, 41 FROM r""")
def symbols_python(spark, sf):
    i = F.col("page_id").cast("string")
    body = "".join(f"\n    x{k} = {k}" for k in range(15))
    code = F.concat(F.lit("@app."), F.lower("verb"), F.lit("('"), "path", F.lit("')\ndef view_"), i, F.lit("():\n    return 1\n\nclass Model"), i, F.lit(":\n    def on_handler(self):\n        pass\n"),
                    F.lit("if True:\n    a = 1" + body + "\n"), F.lit("@cache\ndef cached():" + body + "\n"), F.lit("TABLE = [" + "\n 1," * 20 + "\n]\n"))
    return _parsed(spark, sf, "python", code)


@query(f"""WITH {ROUTES}, r AS (SELECT page_id, page_id::VARCHAR AS p, upper(v) || ' ' || path AS n FROM routes)
SELECT page_id, 'route' AS kind, n AS name, 1 AS start_line, 3 AS end_line FROM r UNION ALL SELECT page_id, 'class', 'A' || p, 5, 7 FROM r UNION ALL SELECT page_id, 'function', 'm', 6, 6 FROM r
UNION ALL SELECT page_id, 'function', 'f' || p, 8, 10 FROM r UNION ALL SELECT page_id, 'handler', 'onCallback', 11, 11 FROM r""")
def symbols_js(spark, sf):
    i = F.col("page_id").cast("string")
    code = F.concat(F.lit("router."), F.lower("verb"), F.lit("('"), "path", F.lit("', (q) => {\n  done();\n});\n\nclass A"), i, F.lit(" {\n  m() { return 1; }\n}\nfunction f"), i, F.lit("() {\n  return `}`; // }\n}\nconst onCallback = (x) => x + 1;\n"))
    return _parsed(spark, sf, "javascript", code)


@query("SELECT event_id, round_even(value / 7, 6) AS v FROM events")
def round6(spark, sf):
    return t(spark, sf, "events").select("event_id", T.round6(F.col("value") / 7).alias("v"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || 'last' AS t FROM conversations")
def strip_fence(spark, sf):
    fenced = F.concat(F.lit("\n```json\n"), T.collapse(F.col("text")), F.lit("  \nlast \n```\n"))
    return t(spark, sf, "conversations").select("conv_id", "turn", T.strip_fence(fenced).alias("t"))


@query("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN text WHEN length(c) <= 220 THEN c ELSE rtrim(left(c, 217)) || '...' END AS rewritten, item_id % 5 <> 0 AND (CASE WHEN length(c) <= 220 THEN c ELSE rtrim(left(c, 217)) || '...' END) <> text AS changed FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' again' AS c FROM benchmark)")
def rewrite(spark, sf):
    """Queries through a rewriter whose model repeats them, and fails on every fifth: that one stays as it is."""
    from .models import Rewriter, TextClient

    ship(spark)

    def run(pdfs):
        def model(_: str, prompt: str) -> str:
            number, _, text = prompt.partition("|")
            if int(number) % 5 == 0:
                raise ValueError("no model")
            return f'  "{text} \n again"  '

        ask = Rewriter(TextClient(model, "m", timeout=30), prompt="")
        for pdf in pdfs:
            got = [ask(f"{i}|{x}") for i, x in zip(pdf["item_id"], pdf["text"], strict=True)]
            pdf["rewritten"] = [x if c else old for (x, c, _), old in zip(got, pdf["text"], strict=True)]
            pdf["changed"] = [c and x != old for (x, c, _), old in zip(got, pdf["text"], strict=True)]
            yield pdf[["item_id", "rewritten", "changed"]]

    return t(spark, sf, "benchmark").select("item_id", "text").mapInPandas(run, "item_id long, rewritten string, changed boolean")

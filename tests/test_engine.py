import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import chunking, indexing, search
from lodestar.operators.symbols import parse_symbols, route_name_of
from lodestar.plans import registry
from lodestar.plans.engine import Engine, EngineError, Tables
from lodestar.plans.models import ModelError, Rewriter, TextClient, parse_object
from lodestar.plans.settings import Settings
from lodestar.sources.repo import IgnoreRules, read_text, walk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["estimate_tokens", "query_signal", "intent_tags", "line_packer", "search", "changed_files", "upsert_chunks", "major_blocks", "selection_range_join", "symbol_slices", "split_large", "merge_small", "merge_tail", "file_fallback", "build_chunks", "candidates_json", "explanation",
                                  "vector_upsert", "vector_delete", "vector_dim_guard", "repo_scan_gitignore", "file_read", "symbols_python", "symbols_js", "rewrite", "round6", "strip_fence"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "lineitem documents embeddings pages benchmark orders customer conversations events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    x, y = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    cols = sorted(y.columns)
    assert sorted(x.columns) == cols
    key = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    assert len(x) == len(y) and key(x.astype(str)) == key(y.astype(str))


def test_packer_fold_equals_python(spark):
    texts = ["", "a", "a b c\n" * 40, "x " * 300, "\n\n a\n", "w w w w\n\nv v v v v v\n" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", chunking.pack_lines(F.col("t"), 5, 12, 20).alias("p"))
    for r in df.collect():
        assert [(p.text, p.start_line, p.end_line) for p in r.p] == chunking.split_text(texts[r.i], 1, 5, 12, 20)


def test_vector_norm_is_not_monotone(spark):
    got = spark.createDataFrame([(-0.02,), (0.3,), (1.0,), (-1.5,)], "s double").select(T.vector_norm(F.col("s")).alias("v")).collect()
    assert [round(r.v, 2) for r in got] == [0.49, 0.3, 1.0, 0.0]


def test_merge_keeps_symbol_of_single_parts():
    d = [{"symbol": "a", "kind": "function", "text": "x " * 5, "start": 1, "end": 2}, {"symbol": "b", "kind": "function", "text": "y " * 5, "start": 3, "end": 4}]
    one = chunking.merge_small(d, 8, 50)
    assert len(one) == 1 and one[0]["symbol"] is None and one[0]["kind"] == "major_block"
    assert chunking.merge_small(d[:1], 8, 50) == d[:1]


def test_symbols_overlap():
    py = parse_symbols("python", "@app.get('/a')\ndef f():\n    pass\nclass C:\n    def on_handler(self): pass\n")
    assert {(s[0], s[1]) for s in py} >= {("route", "f"), ("function", "f"), ("class", "C"), ("handler", "on_handler")}
    js = parse_symbols("javascript", "router.post('/x', (q) => {\n a();\n});\nclass A {\n  m() { return 1; }\n}\n// function no() {}\n")
    assert {(s[0], s[1]) for s in js} >= {("route", "POST /x"), ("class", "A"), ("function", "m")} and not any(s[1] == "no" for s in js)
    assert parse_symbols("python", "def broken(:\n  x\n")[0][1] == "broken"


def test_walk_and_ignore(tmp_path):
    for p in ("src/main.py", "src/__init__.py", "node_modules/x.js", "out/nested.py", "skip.py", ".hidden/a.py", "README.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"a\r\nb\xff\n")
    (tmp_path / ".gitignore").write_text("out/\nskip.py\n")
    assert sorted(r for _, r in walk(str(tmp_path))) == ["src/__init__.py", "src/main.py"]
    assert read_text(str(tmp_path / "src/main.py")) == "a\nb\n"
    rules = IgnoreRules("*.log\n!keep.log\n/a/**/b\n")
    assert rules.ignores("x/y.log", False) and not rules.ignores("keep.log", False) and rules.ignores("a/q/r/b", False) and not rules.ignores("z/a/b", False)


def test_engine_refreshes(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    (repo / "a.py").write_text("@app.post('/posts')\ndef create_post():\n    return 1\n")
    (repo / "b.py").write_text("def other():\n    return 2\n")
    e = Engine(spark, str(tmp_path / "idx"))
    assert e.index(str(repo))["files_indexed"] == 2
    (repo / "b.py").unlink()
    assert {k: v for k, v in e.index(str(repo)).items() if k in ("files_indexed", "files_deleted")} == {"files_indexed": 0, "files_deleted": 1}
    got = e.query(str(repo), "where is the endpoint to create a post")
    assert got["selection"]["file"] == "a.py" and e.status(str(repo))["files"] == 1
    with pytest.raises(EngineError):
        e.index(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        e.query(str(repo), "x", 51)


def test_engine_survives_its_models(spark, tmp_path):
    """Errors of the models come with the result; an index of another size is refused, and made anew by the next refresh."""
    repo = tmp_path / "r"
    repo.mkdir()
    for n in ("a", "b"):
        (repo / f"{n}.py").write_text(f"def {n}_one():\n    return 1\n")

    def broken(*_):
        raise RuntimeError("down")

    from lodestar.operators.embedding import HashingEmbedder

    e = Engine(spark, str(tmp_path / "idx"), reranker=broken, selector=broken)
    e.index(str(repo))
    got = e.query(str(repo), "one")
    assert got["selection"]["source"] == "vector" and not got["reranked"] and any("down" in x for x in got["errors"])
    other = Engine(spark, str(tmp_path / "idx"), embedder=HashingEmbedder(32, "other"))
    with pytest.raises(EngineError) as err:
        other.query(str(repo), "one")
    assert err.value.status == 409
    other.index(str(repo))
    assert other.query(str(repo), "one")["results"]


def test_tables_keep_versions(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    assert t.read("meta").count() == 0
    for k in range(5):
        t.write("meta", spark.createDataFrame([(str(i), None) for i in range(k)], "repo_path string, last_indexed_at timestamp"))
    assert t.read("meta").count() == 4 and len(t._versions("meta")) == 3


def test_strict_zip(spark):
    chunks, vectors = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, file_path string"), spark.createDataFrame([(1, [1.0])], "chunk_id long, vector array<double>")
    with pytest.raises(Exception, match="chunks and vectors differ at 2"):
        indexing.zipped(chunks, vectors).collect()
    assert indexing.zipped(chunks.where("chunk_id = 1"), vectors).count() == 1


def test_topk_ties_and_scope(spark):
    """Equal vectors tie by name; null and zero vectors match nothing; a scope holds queries to their own rows."""
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 6 else [0.0, 1.0] if i < 8 else [0.0, 0.0], "x" if i % 2 else "y") for i in range(9)] + [(99, None, "x")], "chunk_id long, vector array<double>, repo string").repartition(3)
    q = spark.createDataFrame([(0, [2.0, 0.0], "x"), (1, [0.0, 0.5], "y"), (2, None, "x")], "query_id long, query_vector array<double>, repo string")
    got = {(r.query_id, r.hit_rank): (r.chunk_id, r.raw_score) for r in search.vector_topk(q.drop("repo"), v.drop("repo"), 4).collect()}
    assert [got[0, k][0] for k in range(1, 5)] == [0, 1, 2, 3] and got[1, 1] == (6, 1.0) and all(i != 2 for i, _ in got)
    own = {(r.query_id, r.hit_rank): r.chunk_id for r in search.vector_topk(q, v, 2, "repo").collect()}
    assert (own[0, 1], own[0, 2], own[1, 1]) == (1, 3, 6)


def test_major_blocks_and_route_names():
    """Golden rows: what begins at a decorator or is another statement, and names with and without a path."""
    body = "".join(f"\n    x{i} = {i}" for i in range(16))
    rows = {(s[0], s[1], s[2]) for s in parse_symbols("python", f"import a\n@cache\ndef f():{body}\nT = [{chr(10).join('1,' for _ in range(20))}]\nwhile True:{body}\n")}
    assert {r for r in rows if r[0] == "major_block"} == {("major_block", None, 2), ("major_block", None, 40)}
    assert [route_name_of(x) for x in ("app.get2('/a(b)', f)", "x.use(f)", "f('/a')", "r.post( \"/p\")")] == ["GET2 /a(b)", "USE", None, "POST /p"]


def test_settings_clamp():
    s = Settings.from_env(env={"LODESTAR_THRESHOLD": "1.7", "LODESTAR_TIMEOUT": "0", "LODESTAR_CACHE_SIZE": "-4", "LODESTAR_TOP_K": "x", "LODESTAR_PROVIDER": "other", "LODESTAR_RERANK_ENABLED": "Yes"})
    assert (s.threshold, s.timeout, s.cache_size, s.top_k, s.provider, s.rerank_enabled) == (1.0, 0.1, 1, 8, "gemini", True)


def test_models():
    calls = []
    c = TextClient(lambda m, p: calls.append(p) or "```json\n{\"a\": 1}\n```", "m")
    assert c.complete_json("x")[0] == {"a": 1} and c.complete_json("x")[0] == {"a": 1} and len(calls) == 1
    with pytest.raises(ModelError):
        parse_object("none")
    assert Rewriter(TextClient(lambda m, p: '"new  query"', "m"))("q")[:2] == ("new query", True)
    assert Rewriter(None)("q") == ("q", False, None)


def test_client_keeps_answers_only():
    """Failures, empty answers and late ones are errors and not kept; a late call is told so."""
    told = []

    def call(model, prompt, cancelled):
        if prompt == "slow":
            told.append(cancelled.wait(5))
        if prompt == "bad" and len(told) < 3:
            told.append("bad")
            raise ValueError("no")
        return "" if prompt == "empty" else f"{model}:{prompt}"

    c = TextClient(call, "m", timeout=0.2, takes_cancel=True, cache_size=1)
    for prompt in ("slow", "empty", "bad"):
        with pytest.raises(ModelError):
            c.complete(prompt)
    told += ["bad"] * 3
    assert c.complete("bad")[0] == "m:bad" and c.complete("x", "n")[0] == "n:x" and len(c.memory.rows) == 1
    assert TextClient(lambda m, p: "t", "m", clock=iter([1.0, 1.5]).__next__).complete("x") == ("t", 500)

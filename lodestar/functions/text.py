"""Text kernel: scalar functions as Column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it.
_WS = r"[\s\x1c-\x1f]"
TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s\x1c-\x1f]"
TERM = r"[a-z_][a-z0-9_]*"
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx"}


def no_strings() -> Column:
    return F.array().cast("array<string>")


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def estimate_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)))


def normalize_terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), F.lit(1))
    return F.filter(found, lambda x: F.length(x) > 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+$", "")


def split_lines(text: Column) -> Column:
    """Lines by every Unicode line end, without an empty last one."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def singularize(w: Column) -> Column:
    n = F.length(w)
    return (F.when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
            .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.left(w, n - 1)).otherwise(w))


def path_segments(path: Column) -> Column:
    bare = F.regexp_replace(strip(path), r"^https?://[^/]*", "")
    return F.filter(F.split(bare, "/"), lambda s: (s != "") & ~s.startswith(":") & ~(s.startswith("{") & s.endswith("}")))


def detect_language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    suffix = F.regexp_extract(F.lower(path), r"[^/.]\.([a-z]+)$", 1)
    for k, v in LANGUAGES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?U){_WS}+", " "))


def clean_summary(text: Column, limit: int) -> Column:
    c = collapse(text)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(limit - 3))), F.lit("...")))


def truncate_code(text: Column, limit: int, mark: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit(mark)))


def clean_rewrite(text: Column) -> Column:
    c = collapse(text)
    c = F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), strip(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    return F.when(F.length(c) <= 220, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(217))), F.lit("...")))


def strip_fence(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```$", "")
    return strip(F.array_join(F.transform(F.split(body, "\n"), lambda s: F.rtrim(s)), "\n"))


def json_salvage(text: Column) -> Column:
    """The first that parses to an object: the text itself, a fenced block, the outermost braces."""
    tries = (strip(text), F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.coalesce(*[F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t) for t in tries])


def rewrite_parse(text: Column) -> Column:
    bare = strip_fence(text)
    value = F.get_json_object(F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare), "$.query")
    first = F.regexp_replace(strip(F.get(F.split(bare, "\n"), F.lit(0))), '^"|"$', "")
    return F.coalesce(nonempty(strip(value)), first)


def prefix_of(model: str, query: bool) -> str:
    """Prefixes of the e5 and bge model families."""
    m = model.lower()
    if query and "bge" in m:
        return "Represent this sentence for searching relevant passages: "
    return ("query: " if query else "passage: ") if "e5" in m else ""


def embed_prefix(text: Column, model: str, query: bool) -> Column:
    """The text with its model's prefix, put on once."""
    prefix = prefix_of(model, query)
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text)) if prefix else text


def round6(x: Column) -> Column:
    """Six decimals, halves to even."""
    return F.bround(x, 6)


def chunk_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, start.cast("string"), end.cast("string"), text), 256)


def summary_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def vector_norm(s: Column) -> Column:
    """[0, 1] stays; all else becomes (s + 1) / 2, clamped.  Not monotone, and meant so."""
    return F.when(s.between(0, 1), s).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s + 1) / 2)))


def overlap_score(query: Column, terms: Column) -> Column:
    q = F.array_distinct(query)
    return F.when((F.size(q) == 0) | (F.size(terms) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, terms)) / F.size(q))


def register(spark) -> None:
    """The scalar functions that callers can use in SQL, inlined by the optimizer."""
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS INT RETURN size(regexp_extract_all(t, r'({TOKEN})', 1))")
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION normalize_terms(t STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(coalesce(t, '')), r'({TERM})', 1), x -> length(x) > 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(s DOUBLE) RETURNS DOUBLE RETURN CASE WHEN s BETWEEN 0 AND 1 THEN s ELSE greatest(0D, least(1D, (s + 1) / 2)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION overlap_score(q ARRAY<STRING>, c ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(q) = 0 OR size(c) = 0 THEN 0D ELSE size(array_intersect(q, c)) / size(array_distinct(q)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION singularize(w STRING) RETURNS STRING RETURN CASE WHEN endswith(w, 'ies') AND length(w) > 4 THEN concat(left(w, length(w) - 3), 'y') WHEN endswith(w, 's') AND NOT endswith(w, 'ss') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END")

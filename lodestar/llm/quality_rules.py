"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined results: a null text has no words and fails the base rule; an empty table gives an empty
result; repeated rows are judged each on their own; other columns are ignored.  The statistics
cover whole texts.  Windows of three words are compared by 64-bit hashes of their words together
with their position, sorted per document, so the work is n log n in the words of one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from he his in is it of on or that the this to was were with you "
    "au aux avec dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con del el es esta los lo no para su sus una y "
    "als auch auf das dem den der die ein eine er für ich ist mit nicht sich sie und von wie zu"
).split()


@dataclass(frozen=True)
class Rule:
    """Passes where low <= stat <= high; a None bound is open."""

    stat: str
    low: float | None = None
    high: float | None = None


#: The production table.  A text that passes the base rule is kept if every rule passes.
RULES = (
    Rule("n_words", 50, 2_000_000),
    Rule("mean_word_chars", 1.5, 30),
    Rule("symbol_ratio", None, 0.15),
    Rule("upper_ratio", None, 0.35),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.34),
    Rule("bullet_ratio", None, 0.9),
    Rule("ellipsis_ratio", None, 0.4),
)

_SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """Binds a value once, so that a lambda beneath does not evaluate it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeats(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice: sort (hash, index), mark equal neighbours, measure the union."""
    none = F.array().cast("array<int>")

    def marked(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["i"])

    def covered(at: Column) -> Column:
        nxt = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(2147483647)))
        return F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(
            F.aggregate(F.zip_with(at, nxt, lambda p, q: F.least(q - p, F.lit(3))), F.lit(0).cast("long"), lambda t, x: t + x))

    grams = _let(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    at = _let(F.sort_array(grams), marked)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.coalesce(at, none)), covered))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, in one projection over the scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("_t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("_w"))
    size = lambda c: F.size(c).cast("long")
    lines = F.filter(F.split("_t", "\n", -1), lambda s: F.translate(s, _SPACE, "") != "")
    count = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    return base.select(
        "doc_id",
        size("_w").alias("n_words"),
        F.length(F.translate("_t", _SPACE, "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeats(F.col("_w")).alias("n_repeat_words"),
        size(lines).alias("n_lines"),
        size(F.filter(lines, lambda s: F.ltrim(s).rlike(r"^[-*•]\s"))).alias("n_bullets"),
        size(F.filter(lines, lambda s: F.rtrim(s).rlike(r"(\.\.\.|…)$"))).alias("n_ellipsis"),
        size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ").alias("n_upper"),
    )


def compile_rules(rules=RULES) -> Column:
    """The table as one boolean expression over ratios of the statistics."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    stats = {
        "n_words": F.col("n_words"), "mean_word_chars": F.col("word_chars") / words, "symbol_ratio": F.col("n_symbols") / words,
        "upper_ratio": F.col("n_upper") / F.greatest("word_chars", F.lit(1)), "stop_ratio": F.col("n_stop") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines, "bullet_ratio": F.col("n_bullets") / lines, "ellipsis_ratio": F.col("n_ellipsis") / lines,
    }
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (stats[r.stat] >= r.low)
        if r.high is not None:
            out = out & (stats[r.stat] <= r.high)
    return out


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every document with its statistics, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def oracle_sql() -> str:
    """DuckDB SQL for the same rows; the window count compares the words themselves, not hashes."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bound = {"n_words": "n_words", "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)",
             "upper_ratio": "n_upper / greatest(word_chars, 1)", "stop_ratio": "n_stop / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
             "bullet_ratio": "n_bullets / greatest(n_lines, 1)", "ellipsis_ratio": "n_ellipsis / greatest(n_lines, 1)"}
    rules = " AND ".join(f"{bound[r.stat]} {op} {v}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM d) GROUP BY rid),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(list_filter(l, lambda s: regexp_matches(ltrim(s, ' '), '^[-*•]\s')))::BIGINT AS n_bullets,
    len(list_filter(l, lambda s: regexp_matches(rtrim(s, ' '), '(\.\.\.|…)$')))::BIGINT AS n_ellipsis,
    len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
    (length(t) - length(regexp_replace(t, '[A-ZÄÖÜÉÈÊÀÇÑÓÍÁÚ]', '', 'g')))::BIGINT AS n_upper
  FROM t LEFT JOIN p USING (rid)),
j AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT *, (NOT base_failed AND {rules}) AS kept FROM j"""

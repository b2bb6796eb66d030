"""Chunking: symbol slices, the greedy line packer, merging of small parts, and chunk metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import intent_metadata, sorted_set
from ..functions.text import chunk_id, collapse, estimate_tokens, normalize_terms, split_lines, strip

MIN_TOKENS, MAX_TOKENS, TARGET_TOKENS, MAX_GAP = 200, 800, 500, 40
PART = "array<struct<text:string,start_line:int,end_line:int>>"
_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+|\S")


def tokens_of(text: str) -> int:
    return len(_TOKEN.findall(text))


def pack_lines(text: Column, low: int, target: int, high: int, first_line: int = 1) -> Column:
    """Contiguous parts of a text as one fold over its lines.

    A line closes the part before it if that has ``low`` tokens and would pass ``target``; a part of ``high`` closes at once."""
    lines = split_lines(text)
    sizes = F.transform(lines, estimate_tokens)
    cuts = F.aggregate(
        sizes, F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("out"), F.lit(0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("n")),
        lambda a, x: _fold(a, x, low, target, high),
        lambda a: F.when(a["i"] > a["s"], F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["i"].alias("e"))))).otherwise(a["out"]))
    return F.get(F.transform(F.array(F.struct(lines.alias("l"), cuts.alias("c"))), lambda v: F.transform(
        v["c"], lambda c: F.struct(F.array_join(F.slice(v["l"], c["s"] + 1, c["e"] - c["s"]), "\n").alias("text"), (c["s"] + first_line).alias("start_line"), (c["e"] + first_line - 1).alias("end_line")))), F.lit(0))


def _fold(a: Column, x: Column, low: int, target: int, high: int) -> Column:
    before = (a["i"] > a["s"]) & (a["n"] + x > target) & (a["n"] >= low)
    n = F.when(before, x).otherwise(a["n"] + x)
    s = F.when(before, a["i"]).otherwise(a["s"])
    i = a["i"] + 1
    after = n >= high
    part = lambda p, q: F.array(F.struct(p.alias("s"), q.alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    out = F.concat(a["out"], F.when(before, part(a["s"], a["i"])).otherwise(none), F.when(after, part(s, i)).otherwise(none))
    return F.struct(out.alias("out"), F.when(after, i).otherwise(s).alias("s"), i.alias("i"), F.when(after, F.lit(0)).otherwise(n).alias("n"))


Draft = dict


def split_text(text: str, first: int, low: int, target: int, high: int) -> list[tuple[str, int, int]]:
    """The line packer over Python strings, for drafts inside a file's task."""
    out, lines, n, start = [], [], 0, first
    for i, line in enumerate(text.splitlines()):
        size = tokens_of(line)
        if lines and n + size > target and n >= low:
            out.append(("\n".join(lines), start, first + i - 1))
            lines, n, start = [], 0, first + i
        lines.append(line)
        n += size
        if n >= high:
            out.append(("\n".join(lines), start, first + i))
            lines, n, start = [], 0, first + i + 1
    if lines:
        out.append(("\n".join(lines), start, start + len(lines) - 1))
    return out


def slices_of(content: str, symbols: list[Draft]) -> list[Draft]:
    """The stripped lines of each symbol, in order of lines; empty ones go."""
    lines, out = content.splitlines(), []
    for s in sorted(symbols, key=lambda s: (s["start_line"], s["end_line"])):
        start = max(1, s["start_line"])
        end = max(start, s["end_line"])
        text = "\n".join(lines[start - 1 : end]).strip()
        if text:
            out.append({"symbol": s["name"], "kind": s["kind"], "text": text, "start": start, "end": end})
    return out


def fallback_of(content: str, low: int, target: int, high: int) -> list[Draft]:
    """The whole file, in parts if it is large."""
    lines = content.splitlines()
    whole = "\n".join(lines)
    parts = [] if not lines else [(whole, 1, len(lines))] if tokens_of(whole) <= high else split_text(whole, 1, low, target, high)
    return [{"symbol": None, "kind": "major_block", "text": t, "start": s, "end": e} for t, s, e in parts]


def split_large(drafts: list[Draft], low: int, target: int, high: int) -> list[Draft]:
    """Drafts of over ``high`` tokens in parts that keep symbol and kind."""
    return [p for d in drafts for p in ([d] if tokens_of(d["text"]) <= high else [d | {"text": t, "start": s, "end": e} for t, s, e in split_text(d["text"], d["start"], low, target, high)])]


def merge_small(drafts: list[Draft], low: int, high: int, gap: int = MAX_GAP) -> list[Draft]:
    """Neighbouring drafts under ``low`` tokens are joined while they fit; a small last one joins its neighbour."""
    out: list[Draft] = []
    held: list[Draft] = []

    def joined(parts: list[Draft]) -> str:
        return "\n\n".join(p["text"] for p in parts)

    def release() -> None:
        if len(held) == 1:
            out.append(held[0])
        elif held:
            out.append({"symbol": None, "kind": "major_block", "text": joined(held), "start": held[0]["start"], "end": held[-1]["end"]})
        held.clear()

    for d in sorted(drafts, key=lambda d: (d["start"], d["end"])):
        size = tokens_of(d["text"])
        if size >= low:
            release()
            out.append(d)
            continue
        if held and not (tokens_of(joined(held)) + size <= high and d["start"] - held[-1]["end"] <= gap):
            release()
        held.append(d)
    release()
    return out


def merge_tail(drafts: list[Draft], low: int, high: int) -> list[Draft]:
    """A last draft under ``low`` tokens joins the one before it if both fit; that one's symbol and kind hold, and the last one's end."""
    if len(drafts) > 1 and tokens_of(drafts[-1]["text"]) < low:
        both = drafts[-2]["text"] + "\n\n" + drafts[-1]["text"]
        if tokens_of(both) <= high:
            return [*drafts[:-2], drafts[-2] | {"text": both, "end": drafts[-1]["end"]}]
    return drafts


STEPS = ("slices", "fallback", "split", "small", "tail")


def draft_files(files: DataFrame, low: int = MIN_TOKENS, high: int = MAX_TOKENS, target: int = TARGET_TOKENS, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """files(repo_path, file_path, language, text, content_hash, symbols) to drafts by the named steps.

    The folds are sequential within one file, so each file is one row of an Arrow batch."""

    def drafts(text: str, symbols: list[Draft]) -> list[Draft]:
        out = slices_of(text, symbols) if "slices" in steps else []
        if not out and "fallback" in steps:
            out = fallback_of(text, low, target, high)
        out = split_large(out, low, target, high) if "split" in steps else out
        out = merge_small(out, low, high) if "small" in steps else out
        return merge_tail(out, low, high) if "tail" in steps else out

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                symbols = [{"kind": s["kind"], "name": s["name"], "start_line": s["start_line"], "end_line": s["end_line"]} for s in (f.symbols if f.symbols is not None else [])]
                for d in drafts(f.text, symbols):
                    rows.append((f.repo_path, f.file_path, f.language, f.content_hash, d["start"], d["end"], d["symbol"], d["kind"], d["text"]))
            yield pd.DataFrame(rows, columns=["repo_path", "file_path", "language", "content_hash", "start_line", "end_line", "symbol", "symbol_kind", "text"])

    return files.select("repo_path", "file_path", "language", "text", "content_hash", "symbols").mapInPandas(
        run, "repo_path string, file_path string, language string, content_hash string, start_line int, end_line int, symbol string, symbol_kind string, text string")


def chunk_files(files: DataFrame, low: int = MIN_TOKENS, high: int = MAX_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """files(repo_path, file_path, language, text, content_hash, symbols) to chunk rows with all metadata."""
    return enrich(draft_files(files, low, high, target))


def describe() -> Column:
    """The description of a draft with its intent columns."""
    c = F.col
    first = F.left(strip(F.get(split_lines(strip(c("text"))), F.lit(0))), F.lit(120))
    route = F.when(c("route_method").isNotNull(), F.concat(
        F.lit(" Intent: "), F.coalesce(c("route_intent"), F.lit("unknown")), F.lit(" resource. HTTP method: "), c("route_method"), F.lit("."),
        F.coalesce(F.concat(F.lit(" Resource: "), c("route_resource"), F.lit(".")), F.lit("")), F.coalesce(F.concat(F.lit(" Path: "), c("route_path"), F.lit(".")), F.lit("")))).otherwise("")
    tags = F.when(F.size("intent_tags") > 0, F.concat(F.lit(" Tags: "), F.array_join("intent_tags", ", "), F.lit("."))).otherwise("")
    tail = F.concat(F.lit(" in "), c("file_path"), F.lit(". Starts with: "), F.coalesce(first, F.lit("")), route, tags)
    named = c("symbol").isNotNull() & (c("symbol") != "")
    kind = c("symbol_kind")
    block = F.concat(F.lit("Major code block in "), c("file_path"), F.lit(" (lines "), c("start_line").cast("string"), F.lit("-"), c("end_line").cast("string"), F.lit("). Starts with: "), F.coalesce(first, F.lit("")), route, tags)
    name = lambda word, other: F.concat(F.lit(word + " "), F.when(named, c("symbol")).otherwise(other), tail)
    return strip(F.when((kind == "class") & named, name("Class", "")).when(kind == "route", name("Route handler", "unnamed route"))
                 .when(kind == "handler", name("Handler", "anonymous handler")).when((kind == "function") & named, name("Function", "")).otherwise(block))


def keywords() -> Column:
    c = F.col
    line = lambda label, v: F.concat(F.lit(label + ": "), v)
    route = F.when(c("route_method").isNotNull(), F.concat_ws("\n", line("Intent", c("route_intent")), line("HTTP method", c("route_method")), line("Resource", c("route_resource")), line("Path", c("route_path"))))
    return normalize_terms(F.concat_ws("\n", c("description"), F.left("text", F.lit(4000)), route))


def enrich(drafts: DataFrame) -> DataFrame:
    """Intent, route, terms, description, keywords, tokens and id of each draft; all JVM-side."""
    df = drafts.withColumn("_m", intent_metadata(F.col("file_path"), F.col("symbol_kind"), F.col("symbol"), F.col("text")))
    df = df.select("*", F.col("_m.tags").alias("intent_tags"), *[F.col(f"_m.route.{k}").alias(f"route_{k}") for k in ("method", "path", "intent", "resource")],
                   sorted_set(F.col("_m.structural_terms"), normalize_terms(F.col("file_path"))).alias("structural_terms")).drop("_m")
    df = df.withColumn("symbol_terms", sorted_set(normalize_terms(F.col("symbol")), F.col("structural_terms"))).withColumn("description", describe())
    return df.withColumn("keywords", keywords()).withColumn("tokens", estimate_tokens(F.col("text"))).withColumn("llm_summary", F.lit(None).cast("string")).withColumn(
        "chunk_id", chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("text")))


def embedding_text() -> Column:
    c = F.col
    summary = F.when(F.coalesce(collapse(c("llm_summary")), F.lit("")) != "", c("llm_summary")).otherwise(c("description"))
    head = F.concat_ws("\n", F.concat(F.lit("File: "), c("file_path")), F.concat(F.lit("Symbol: "), F.coalesce(c("symbol"), F.lit("anonymous"))), F.concat(F.lit("Type: "), F.coalesce(c("symbol_kind"), F.lit("block"))),
                       F.concat(F.lit("Intent: "), F.array_join("intent_tags", ", ")), F.lit(""), F.lit("Summary:"), summary)
    route = F.when(c("route_method").isNotNull() | c("route_path").isNotNull(), F.concat_ws("\n", F.lit("\n\nHTTP Metadata"), F.concat(F.lit("Method: "), F.coalesce(c("route_method"), F.lit("unknown"))), F.concat(F.lit("Route: "), F.coalesce(c("route_path"), F.lit("unknown")))))
    return F.concat(head, F.coalesce(route, F.lit("")))

"""Symbol extraction: the syntax tree for Python, a brace scanner for JavaScript and TypeScript.

Kinds: function, handler, class, route, major_block.  Symbols overlap: a class and its methods,
a decorated function and the calls in its body are all reported.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "array<struct<kind:string,name:string,start_line:int,end_line:int,text:string>>"
# The patterns of route calls, path arguments, handler names and route names.
ROUTE_CALL = re.compile(r"\.(get|post|put|delete|patch|route|use)\s*\(", re.I)
PATH_ARG = re.compile(r"""\(\s*['"]/[^'")]*['"]""")
HANDLER = re.compile(r"handler|callback", re.I)
ROUTE_VERB = r"\.([A-Za-z_][A-Za-z0-9_]*)\s*\("
ROUTE_PATH = r"""\(\s*['"](/[^'"]*)['"]"""
MAJOR_LINES = 15


def route_name_of(text: str) -> str | None:
    """The first called member, in capitals, and the first path argument, if there is one."""
    verb, path = re.search(ROUTE_VERB, text), re.search(ROUTE_PATH, text)
    return " ".join(x for x in (verb[1].upper(), path[1].rstrip() if path else "") if x) if verb else None


def route_name(text: Column) -> Column:
    verb, path = F.regexp_extract(text, ROUTE_VERB, 1), F.regexp_extract(text, ROUTE_PATH, 1)
    return F.when(verb != "", F.rtrim(F.concat(F.upper(verb), F.lit(" "), path)))


def route_call(text: Column) -> Column:
    return text.rlike("(?i)" + ROUTE_CALL.pattern) & text.rlike(PATH_ARG.pattern)


def function_kind(name: str | None) -> str:
    return "handler" if name and HANDLER.search(name) else "function"


def python_symbols(content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return _python_by_indent(content)
    lines, out = content.split("\n"), []
    text = lambda s, e: "\n".join(lines[s - 1 : e])
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else function_kind(node.name)
            out.append((kind, node.name, node.lineno, node.end_lineno, text(node.lineno, node.end_lineno)))
            if node.decorator_list:
                start = min(d.lineno for d in node.decorator_list)
                whole = text(start, node.end_lineno)
                if ROUTE_CALL.search(whole) or "@app" in whole:
                    named = re.search(r"def\s+([A-Za-z_][A-Za-z0-9_]*)", whole)
                    out.append(("route", named[1] if named else None, start, node.end_lineno, whole))
        elif isinstance(node, ast.Call):
            call = ast.get_source_segment(content, node) or ""
            if ROUTE_CALL.search(call) and PATH_ARG.search(call):
                out.append(("route", None, node.lineno, node.end_lineno, call))
    plain = (ast.Import, ast.ImportFrom, ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign)
    # A decorated definition begins at its first decorator, so that no symbol contains it unless it is a route.
    spans = [(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]), n.end_lineno) for n in tree.body if not isinstance(n, plain)]
    return out + _major(spans, out, lines)


def _python_by_indent(content: str) -> list[tuple]:
    """For files that do not parse: definitions and the lines indented beneath them."""
    lines, out = content.split("\n"), []
    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", line)
        if m:
            end = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j
            out.append(("class" if m[2] == "class" else function_kind(m[3]), m[3], i + 1, end + 1, "\n".join(lines[i : end + 1])))
    return out


_JS = re.compile(r"""(?P<cls>\bclass\s+(?P<cname>[A-Za-z_$][\w$]*))|(?P<fn>\b(?:async\s+)?function\s*\*?\s*(?P<fname>[A-Za-z_$][\w$]*)\s*\()"""
                 r"""|(?P<var>\b(?:const|let|var)\s+(?P<vname>[A-Za-z_$][\w$]*)[^=;\n]*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>))"""
                 r"""|(?P<call>[A-Za-z_$][\w$.]*\.(?:get|post|put|delete|patch|route|use)\s*\(\s*['"]/)"""
                 r"""|(?P<meth>^[ \t]+(?:(?:async|static|public|private|protected|get|set)\s+)*(?P<mname>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::[^{;]+)?\{)""", re.M | re.I)
_KEYWORDS = frozenset("if for while switch catch function return with else do try".split())


def _blank(src: str) -> str:
    """Comments and the insides of strings as spaces, of the same length."""
    def hide(m: re.Match) -> str:
        s = m[0]
        return re.sub(r"[^\n]", " ", s) if s[0] == "/" else s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]

    return re.sub(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`""", hide, src, flags=re.S)


def _close(code: str, at: int) -> int:
    """End of the bracket that opens at ``at``."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] in "({[":
            depth += 1
        elif code[i] in ")}]":
            depth -= 1
            if not depth:
                return i + 1
    return len(code)


def js_symbols(content: str) -> list[tuple]:
    code, out = _blank(content), []
    line = lambda i: content.count("\n", 0, i) + 1

    def add(kind: str, name: str | None, start: int, end: int) -> None:
        out.append((kind, name, line(start), line(max(start, end - 1)), content[start:end]))

    for m in _JS.finditer(content):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if code[at] == " ":
            continue  # inside a comment or a string
        if m["call"]:
            end = _close(code, m.end() - len(m[0]) + m[0].rindex("("))
            text = content[at:end]
            if ROUTE_CALL.search(text) and PATH_ARG.search(text):
                add("route", route_name_of(text), at, end)
            continue
        if m["meth"] and m["mname"] in _KEYWORDS:
            continue
        brace = m.end() - 1 if m["meth"] else code.find("{", m.end() if not m["fn"] else _close(code, m.end() - 1))
        if m["var"] and (brace < 0 or ";" in code[m.end() : brace]):
            stop = [i for i in (code.find(";", m.end()), code.find("\n", m.end())) if i >= 0]
            end = min(stop) if stop else len(code)
        else:
            end = _close(code, brace) if brace >= 0 else m.end()
        name = m["cname"] or m["fname"] or m["vname"] or m["mname"]
        add("class" if m["cls"] else function_kind(name), name, at, end)
    spans, depth, start = [], 0, None
    for i, c in enumerate(code):  # top-level blocks of other statements
        if c in "({[":
            start = i if not depth else start
            depth += 1
        elif c in ")}]" and depth:
            depth -= 1
            if not depth and c == "}" and start is not None:
                head = code[code.rfind("\n", 0, start) + 1 : start]
                if not re.match(r"\s*(?:import|export\s+(?:const|let|var)|const|let|var)\b|\s*[\w$.]+\s*\(", head):
                    spans.append((line(start), line(i)))
    return out + _major(spans, out, content.split("\n"))


def _major(spans: list[tuple[int, int]], taken: list[tuple], lines: list[str]) -> list[tuple]:
    """Long top-level blocks that no other symbol contains."""
    out = []
    for s, e in spans:
        if e - s + 1 >= MAJOR_LINES and not any(t[2] <= s and e <= t[3] for t in taken + out):
            out.append(("major_block", None, s, e, "\n".join(lines[s - 1 : e])))
    return out


PARSERS = {"python": python_symbols, "javascript": js_symbols, "typescript": js_symbols, "tsx": js_symbols}


def parse_symbols(language: str | None, content: str) -> list[tuple]:
    """Distinct by (kind, name, lines), the first kept, in order of lines and kind."""
    seen: dict = {}
    for s in PARSERS.get(language or "", lambda _: [])(content or ""):
        seen.setdefault(s[:4], s)
    return sorted(seen.values(), key=lambda s: (s[2], s[3], s[0]))


def with_symbols(files: DataFrame) -> DataFrame:
    """Adds ``symbols`` to rows of language and text."""
    names = ("kind", "name", "start_line", "end_line", "text")

    def run(pdfs: Iterator) -> Iterator:
        for pdf in pdfs:
            pdf["symbols"] = [[dict(zip(names, s, strict=True)) for s in parse_symbols(lang, text)] for lang, text in zip(pdf["language"], pdf["text"], strict=True)]
            yield pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{fields}, symbols {SYMBOLS}")


def major_blocks(blocks: DataFrame, symbols: DataFrame, least: int = MAJOR_LINES) -> DataFrame:
    """Long blocks that no symbol of their file contains: an anti-join on file and range."""
    b, s = blocks.alias("b"), symbols.alias("s")
    inside = (F.col("b.file_path") == F.col("s.file_path")) & (F.col("s.start_line") <= F.col("b.start_line")) & (F.col("b.end_line") <= F.col("s.end_line"))
    return b.where(F.col("b.end_line") - F.col("b.start_line") + 1 >= least).join(s, inside, "left_anti")

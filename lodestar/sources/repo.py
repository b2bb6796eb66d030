"""Repository source: a walk that prunes before it descends, as a Python data source and as a DataFrame."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import LANGUAGES, content_hash

#: Folders and files that are never read (fixed values).
SKIP_DIRS = frozenset("node_modules dist build __pycache__".split())


def skipped(parts: tuple[str, ...]) -> bool:
    return any(p.startswith(".") or p in SKIP_DIRS for p in parts[:-1]) or parts[-1].startswith(".")


class IgnoreRules:
    """The root .gitignore as anchored expressions; the last that matches decides."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dir, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            body = self.translate(line.removeprefix("\\"))
            self.rules.append((re.compile(f"^{'' if anchored else '(?:.*/)?'}{body}{'/' if only_dir else '(?:/|$)'}"), keep))

    @staticmethod
    def translate(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            elif glob[i] == "[" and "]" in glob[i + 1 :]:
                end = glob.index("]", i + 1)
                out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, i = out + re.escape(glob[i]), i + 1
        return out

    def ignored(self, path: Column) -> Column:
        """Whether a path, or a folder above it, is ignored."""
        parts = F.split(path, "/")
        places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < F.size(parts), "/").otherwise("")))

        def verdict(p: Column) -> Column:
            out = F.lit(False)
            for rule, keep in self.rules:
                out = F.when(p.rlike(rule.pattern), not keep).otherwise(out)
            return out

        return F.exists(places, verdict)

    def ignores(self, relative: str, is_dir: bool) -> bool:
        verdict = False
        for rule, keep in self.rules:
            if rule.match(relative + "/" if is_dir else relative):
                verdict = not keep
        return verdict


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.lower().rpartition(".")[2]) if "." in path.rpartition("/")[2] else None


def walk(root: str) -> Iterator[tuple[str, str]]:
    """(path, relative path) of the supported files."""
    base = Path(root)
    ignore = base / ".gitignore"
    rules = IgnoreRules(ignore.read_text(errors="ignore") if ignore.is_file() else "")
    for folder, dirs, files in os.walk(base):
        at = os.path.relpath(folder, base)
        rel = lambda n, at=at: n if at == "." else f"{at}/{n}"
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in SKIP_DIRS and not rules.ignores(rel(d), True)]
        for n in files:
            if not n.startswith(".") and language_of(n) and not rules.ignores(rel(n), False):
                yield os.path.join(folder, n), rel(n)


def read_text(path: str) -> str | None:
    """UTF-8 without bad bytes, with line ends as newlines; None if it cannot be read."""
    try:
        data = Path(path).read_bytes()
    except OSError:
        return None
    return decoded(data)


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def file_text(content: Column) -> Column:
    """A column of file contents as text; no built-in function leaves bad bytes out."""
    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else decoded(bytes(b)))

    return text(content)


class _Part(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("filesPerPartition", 200))

    def partitions(self) -> list[InputPartition]:
        paths = sorted(walk(self.root), key=lambda p: p[1])
        return [_Part(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, rel in partition.paths:
            yield os.path.abspath(self.root), rel, language_of(rel), read_text(path)


class RepoSource(DataSource):
    """``spark.read.format("source_repo").load(path)``: one row for each source file; text is null if a file cannot be read."""

    @classmethod
    def name(cls) -> str:
        return "source_repo"

    def schema(self) -> str:
        return "repo_path string, file_path string, language string, text string"

    def reader(self, schema) -> DataSourceReader:
        return RepoReader(self.options)


def read_repo(spark: SparkSession, path: str, files_per_partition: int = 200) -> DataFrame:
    """The files of a repository with their content hashes."""
    spark.dataSource.register(RepoSource)
    df = spark.read.format("source_repo").option("filesPerPartition", files_per_partition).load(path)
    return df.withColumn("content_hash", content_hash(F.col("text")))


def denied(path: Column) -> Column:
    """The deny-list over a path column."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIP_DIRS)) | F.element_at(parts, -1).startswith(".")

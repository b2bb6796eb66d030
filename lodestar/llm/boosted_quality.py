"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed per document; a bounded sample of labelled training rows
(``max_train``, those with the smallest id hashes) is fitted on the driver: features are cut
into quantile bins, and each tree grows level by level from gradient histograms.  The trees are
flattened into arrays, and a batch of documents walks all of them with numpy.  Labels, lang, source
and doc_id are never inputs.

Defined results: a null or empty text has all statistics zero and a score like any other; repeated
rows get equal scores; without any training row the score is 0.5; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, fold, labelled_sample, ship

FEATURES = (
    "n_words n_chars mean_word long_words short_words upper digit symbol punct bang space non_ascii pipe unique top_word "
    "same_next window_repeats n_lines dup_lines short_lines line_words hashes entropy stops end_marks"
).split()
_STOPS = frozenset(b"the of and to in a is that it for on was be with as by at de la le et les des en un une que el y los der die und das ein zu mit".split())


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    size = float(len(text))
    lens = np.fromiter(map(len, words), np.int64, n)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    if n >= 3:
        pairs = ids[:-1] * len(codes) + ids[1:]
        if len(codes) >= 2_000_000:  # where three would not fit into 64 bits, pairs are numbered anew
            pairs = np.unique(pairs, return_inverse=True)[1]
        grams = np.sort(pairs[:-1] * len(codes) + ids[2:])
        repeats = 1 - (1 + int((grams[1:] != grams[:-1]).sum())) / len(grams)
    else:
        repeats = 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = hist[hist > 0] / size
    return [
        math.log1p(n), math.log1p(size), float(lens.mean()), float((lens > 12).mean()), float((lens < 3).mean()),
        hist[65:91].sum() / size, hist[48:58].sum() / size, hist[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 123, 125, 126]].sum() / n,
        hist[[33, 44, 46, 58, 59, 63]].sum() / n, hist[33] / n, hist[[9, 10, 11, 12, 13, 32]].sum() / size, hist[128:].sum() / size, hist[124] / n,
        len(codes) / n, float(counts.max()) / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, repeats,
        math.log1p(len(lines)), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), math.log1p(n / len(lines)),
        hist[35] / n, float(-(p * np.log2(p)).sum()), sum(int(counts[codes[w]]) for w in _STOPS if w in codes) / n, sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


@dataclass
class Forest:
    """Trees of one depth, flattened: node i of a tree has children 2i+1 and 2i+2; leaves are the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 5.0, least: float = 3.0) -> Forest:
    """Second-order boosting of the log loss; splits by gain over gradient histograms, ties to the first feature and bin."""
    inner, d = 2**depth - 1, x.shape[1]
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    p = y.mean() if len(y) else 0.5
    if not len(y) or p in (0, 1):
        return Forest(feature[:0], threshold[:0], leaf[:0], 0.0 if not len(y) else (4.0 if p else -4.0), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = code + np.arange(d) * bins
    bias = math.log(p / (1 - p))
    raw = np.full(len(y), bias)
    for k in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * bins) + flat).ravel()
            shape = (width, d, bins)
            gh = [np.bincount(at, np.repeat(v, d), width * d * bins).reshape(shape).cumsum(2) for v in (g, h)]
            gl, hl = gh
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for m in range(width):
                j, b = divmod(int(best[m]), bins)
                if gain[m, j, b] > 1e-6:
                    feature[k, first + m], threshold[k, first + m] = j, cuts[j][b]
            f = feature[k, node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > threshold[k, node])
        at = node - inner
        leaf[k] = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        raw += leaf[k][at]
    return Forest(feature, threshold, leaf, bias, depth)


def _features(batches: Iterator[pa.RecordBatch], then) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
        yield then(b, x)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, held: int = 1, max_train: int = 12_000) -> Forest:
    """Fit on at most max_train labelled rows outside the held-out fold."""
    ship(docs.sparkSession)

    def run(batches):
        return _features(batches, lambda b, x: pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"]))

    rows = labelled_sample(docs, labels, label, mod, held, max_train).select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    rows.sort()
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float))


def score(docs: DataFrame, forest: Forest, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)

    def run(batches):
        def out(b, x):
            s = forest.score(x)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return _features(batches, out)

    rows = docs_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(mod) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents the classifier accepts, with all their columns."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            x = np.array([statistics(t or b"") for t in texts]).reshape(len(texts), len(FEATURES))
            yield b.filter(pa.array(forest.score(x) >= 0.5)).select(names)

    return docs.mapInArrow(run, schema)

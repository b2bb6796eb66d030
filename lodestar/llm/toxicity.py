"""Toxicity: Levenshtein automata over a lexicon trie, and context windows round each hit.

The lexicon is learned from a bounded sample of labelled training rows (``max_train``, those with
the smallest id hashes): whole words of any length and word stems (trie nodes, of ``STEM_FROM`` to ``STEM_TO`` letters)
whose share of toxic documents is high by a smoothed log-odds.  It is broadcast, so it keeps the ``bound`` most telling terms
and the 5 ``bound`` most frequent clean words of the sample.  A word is looked up by intersecting its Levenshtein automaton
(distance 1, from ``FUZZY_FROM`` letters on) with the trie; words known from clean training text never match
by approximation.  Each hit is weighed by its context window: quotation marks, reporting verbs and
negated or described uses point to quotation, address in the second person and further hits to
abuse.  A logistic model over the sums gives the score.  Labels, lang, source and doc_id are
never inputs.

Defined results: a null or empty text has no hits and the model's lowest scores; repeated rows get
equal scores; without training rows the lexicon is empty and all scores are equal; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, fold, labelled_sample, ship

_TOKEN = re.compile(r"[^\W_]+(?:[@$!0-9*][^\W_]+)*|[\"“”„«»‘’]")
_QUOTES = frozenset("\"“”„«»‘’")
#: Small closed lists (fixed values): reporting words, and address in the second person.
REPORTING = frozenset("said says say called calls wrote writes quoted quote reported claims claimed word term dit appelé écrit dijo llamó escribió sagte schrieb nannte".split())
ADDRESS = frozenset("you your youre tu toi vous ton votre du dich dein ihr tú usted vos".split())
_LEET = str.maketrans("@$!013457", "asioieast")
WINDOW, FUZZY_FROM, STEM_FROM, STEM_TO = 6, 5, 4, 8


def fold_word(w: str) -> str:
    """Lower case, with look-alike signs as letters unless the word is a number."""
    w = w.lower()
    return w if w.isdigit() or w.isalpha() else w.translate(_LEET).replace("*", "")


class Trie:
    """Nodes are dicts of children; "" marks the end of a whole word, "*" that of a stem."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root: dict = {}
        for end, terms in (("", words), ("*", stems)):
            for term, weight in sorted(terms.items()):
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node[end] = (term, weight)

    def exact(self, word: str) -> float:
        """Weight of the word itself or of its longest stem; 0 if neither is in the lexicon."""
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "*" in node:
                best = node["*"][1]
        return node[""][1] if "" in node else best

    def within_one(self, word: str) -> float:
        """Best weight among whole words at distance 1: the automaton of ``word`` walks the trie.

        A state is (letters read, edits used); its moves are match, insert, delete, substitute and transpose."""
        best, n, todo = 0.0, len(word), [(self.root, 0, 0)]
        while todo:
            node, i, edits = todo.pop()
            if "" in node and len(node[""][0]) >= FUZZY_FROM and n - i <= 1 - edits:
                best = max(best, node[""][1])
            for c, child in node.items():
                if len(c) != 1 or c == "*":
                    continue
                if i < n and word[i] == c:
                    todo.append((child, i + 1, edits))
                if not edits:
                    todo.append((child, i, 1))
                    if i < n and word[i] != c:
                        todo.append((child, i + 1, 1))
                    if i + 1 < n and word[i + 1] == c and word[i] in child:
                        todo.append((child[word[i]], i + 2, 1))
            if not edits and i < n:
                todo.append((node, i + 1, 1))
        return best


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset = frozenset()

    def __post_init__(self):
        self.trie, self.seen = Trie(self.words, self.stems), {}
        fuzzy = [w for w in self.words if len(w) >= FUZZY_FROM]
        # One edit leaves the first or the second half whole: a word without either cannot match.
        self.heads = {w[: len(w) // 2] for w in fuzzy}
        self.tails = {w[len(w) // 2 :] for w in fuzzy}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.lengths = {n + k for n in map(len, fuzzy) for k in (-1, 0, 1)}

    def __getstate__(self):
        return self.words, self.stems, self.clean

    def __setstate__(self, state):
        self.words, self.stems, self.clean = state
        self.__post_init__()

    def weight(self, word: str) -> tuple[float, bool]:
        """(weight, by approximation) of a folded word."""
        hit = self.seen.get(word)
        if hit is None:
            hit = (self.trie.exact(word), False)
            if not hit[0] and len(word) in self.lengths and len(word) >= FUZZY_FROM - 1 and word not in self.clean and (
                any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes) or self._swapped(word)):
                hit = (self.trie.within_one(word), True)
            if len(self.seen) < 400_000:
                self.seen[word] = hit
        return hit

    def _swapped(self, word: str) -> bool:
        """A transposition across the middle touches both halves."""
        for k in self.head_sizes:
            if k and k < len(word) and word[: k - 1] + word[k] in self.heads:
                return True
        return False


FEATURES = ("abuse", "quoted", "fuzzy", "density", "best", "any", "addressed")


def features(text: str, lex: Lexicon) -> list[float]:
    """Sums over the hits of one whole text, each weighed by its context window."""
    tokens = _TOKEN.findall(text)
    hits = []
    for i, t in enumerate(tokens):
        if len(t) > 2:
            w, fuzzy = lex.weight(fold_word(t))
            if w:
                hits.append((i, w, fuzzy))
    if not hits:
        return [0.0] * len(FEATURES)
    abuse = quoted = fuzzies = addressed = best = 0.0
    for k, (i, w, fuzzy) in enumerate(hits):
        around = [t.lower() for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + WINDOW + 1]
        marks = any(t in _QUOTES for t in before) and any(t in _QUOTES for t in after)
        quote = min(1.0, 0.6 * marks + 0.3 * any(t in REPORTING for t in around))
        near = (k > 0 and i - hits[k - 1][0] <= WINDOW) + (k + 1 < len(hits) and hits[k + 1][0] - i <= WINDOW)
        you = any(t in ADDRESS for t in around)
        worth = (0.7 if fuzzy else 1.0) * min(w, 4.0) / 4.0
        abuse += worth * (1 - quote) * (1 + 0.25 * near + 0.25 * you)
        quoted += worth * quote
        fuzzies += fuzzy
        addressed += you
        best = max(best, worth * (1 - quote))
    n = max(1, len(tokens))
    return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzies), math.sqrt(abuse / n), best, float(best >= 0.5), math.log1p(addressed)]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def learn_lexicon(sample: DataFrame, least: int = 4, odds: float = 2.5, bound: int = 20_000) -> Lexicon:
    """Terms of the sample by class, counted in documents; rows are summed per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                words = {fold_word(t) for t in _TOKEN.findall(text.decode("utf-8", "replace")) if len(t) > 2}
                counts.update((w, 0, y) for w in words)
                counts.update((s, 1, y) for s in {w[:k] for w in words for k in range(STEM_FROM, min(len(w), STEM_TO + 1))})
                counts["", 2, y] += 1
                if len(counts) > 400_000:
                    yield pack(counts)
                    counts = Counter()
        yield pack(counts)

    def pack(c: Counter) -> pa.RecordBatch:
        k = list(c)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.int32()), pa.array([x[2] for x in k], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "kind", "y", "n"])

    sums = sample.select("text", "y").mapInArrow(run, "term string, kind int, y int, n long").groupBy("kind", "term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg")).cache()
    total = sums.where("kind = 2").first()
    if total is None or not total.pos or not total.neg:
        return Lexicon()
    log_odds = F.log((F.col("pos") + 0.5) / (total.pos + 1.0)) - F.log((F.col("neg") + 0.5) / (total.neg + 1.0))
    terms = sums.where(f"kind < 2 AND pos >= {least}").withColumn("odds", log_odds).where(F.col("odds") >= odds).orderBy(F.desc("odds"), F.desc("pos"), "kind", "term").limit(bound).collect()
    clean = sums.where("kind = 0 AND neg >= 2").orderBy(F.desc("neg"), "term").limit(5 * bound).select("term").collect()
    sums.unpersist()
    # A stem stands only if it says more than its best word: several words share it and it is as telling as they are.
    words = {r.term: r.odds for r in terms if r.kind == 0}
    best: dict[str, int] = {}
    for r in terms:
        if r.kind == 0:
            for k in range(STEM_FROM, min(len(r.term), STEM_TO) + 1):
                best[r.term[:k]] = max(best.get(r.term[:k], 0), r.pos)
    stems = {r.term: r.odds for r in terms if r.kind == 1 and r.pos >= 2 * least and r.pos > 1.5 * best.get(r.term, 0)}
    short = {s for s in stems if not any(s[:k] in stems for k in range(STEM_FROM, len(s)))}
    return Lexicon(words, {s: stems[s] for s in short}, frozenset(r.term for r in clean) - set(words))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps."""
    if not len(y):
        return np.zeros(len(FEATURES)), 0.0
    a = np.column_stack([x, np.ones(len(x))])
    w, reg = np.zeros(a.shape[1]), np.diag([l2] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + reg, a.T @ (y - p) - reg @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _rows(batches: Iterator[pa.RecordBatch], lex: Lexicon, then) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        yield then(b, np.array([features(t.decode("utf-8", "replace"), lex) for t in texts]).reshape(len(texts), len(FEATURES)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, held: int = 0, max_train: int = 20_000) -> Model:
    """Lexicon and weights from at most max_train labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, mod, held, max_train)
    lex = learn_lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        return _rows(batches, shared.value, lambda b, x: pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"]))

    rows = sorted(sample.select("y", "text").mapInArrow(run, "y int, x array<double>").collect())
    w, bias = fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float))
    return Model(lex, w, bias)


def score(docs: DataFrame, model: Model, mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        def out(b, x):
            s = shared.value.score(x)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return _rows(batches, shared.value.lexicon, out)

    scored = docs_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(mod) == held, F.lit(False)).alias("held_out"), "score", "predicted")

"""Quality rules: base limits, then gradient-boosted trees over document statistics.

The trees are fitted here (logistic loss, histograms, monotonic constraints on chosen statistics) on at most
``MAX_LABELLED`` labelled rows, flattened into numpy node arrays and scored for blocks of documents at once. A document
is kept if it passes the base limits and the trees give it at least ``keep_at``.

Null text: no words, so ``base_failed`` holds. Repeated rows are judged alike; null ids and extra columns do not matter.
Without labels, or with one label value only, the trees are a constant that keeps what passes the base limits, unless all
labels say 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .labelled import MAX_LABELLED, training_rows
from .words import SPACES, Words, blocks, mix, segment_sums

WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features, and the direction in which each may move the score (0: any).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "shout_share": -1, "distinct_share": 0, "words_per_line": 0, "same_as_last_share": -1,
}


def repeated_words(words: Words, k: int = WINDOW) -> np.ndarray:
    """Per text: words that lie in a run of ``k`` words found twice or more in that text."""
    codes, owner = words.codes, words.owner()
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(len(words), dtype=np.int64)
    inside = np.flatnonzero(owner[:n] == owner[k - 1 :])
    key = mix(owner.astype(np.uint64) + np.uint64(1))
    key = key[inside]
    for i in range(k):
        key = mix(key ^ (codes[inside + i].astype(np.uint64) + np.uint64(i << 40)))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = inside[order[same]], inside[order[same + 1]]
    equal = owner[a] == owner[b]
    for i in range(k):
        equal &= codes[a + i] == codes[b + i]
    if not equal.all():  # two different runs share a hash: compare the runs themselves
        rows = np.stack([owner[inside], *(codes[inside + i] for i in range(k))], axis=1)
        _, where, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = inside[count[where.ravel()] > 1]
    else:
        twice = np.concatenate([a, b])
    mark = np.zeros(len(codes) + 1, dtype=np.int64)
    found = np.unique(twice)
    np.add.at(mark, found, 1)
    np.add.at(mark, found + k, -1)
    return words.per_text(np.cumsum(mark[:-1]) > 0)


def statistics(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics and the feature matrix of a block of texts."""
    w = Words(texts)
    n = w.sizes

    def total(per_word: pa.Array) -> np.ndarray:
        return w.per_text(per_word.to_numpy(zero_copy_only=False).astype(np.int64)[w.codes])

    chars = total(pc.utf8_length(w.distinct))
    symbols = total(pc.count_substring_regex(w.distinct, "[#*$%&|<>]"))
    upper = total(pc.count_substring_regex(w.distinct, r"\p{Lu}"))
    shout = total(pc.count_substring_regex(w.distinct, "[!?]"))
    lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
    n_lines = np.array([len(x) for x in lines], dtype=np.int64)
    dup_lines = n_lines - np.array([len(set(x)) for x in lines], dtype=np.int64)
    repeat = repeated_words(w)
    owner = w.owner()
    first = np.unique(owner.astype(np.int64) * max(len(w.distinct), 1) + w.codes) // max(len(w.distinct), 1)
    distinct = np.bincount(first, minlength=len(w))
    last = np.zeros(len(w.codes), dtype=bool)
    if len(last) > 1:
        last[1:] = (w.codes[1:] == w.codes[:-1]) & (owner[1:] == owner[:-1])
    base = dict(zip(BASE, (n, chars, symbols, dup_lines, repeat)))
    some, some_chars, some_lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    features = [
        np.log1p(n), chars / some, symbols / some_chars, dup_lines / some_lines, repeat / some,
        upper / some_chars, shout / some_chars, distinct / some, n / some_lines, segment_sums(last.astype(np.int64), w.bounds) / some,
    ]
    return base, np.stack(features, axis=1).astype(np.float64)


@dataclass
class Trees:
    """Trees in flat node arrays: feature < 0 marks a leaf; rows with value <= threshold go left."""

    prior: float
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, go, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 10, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting for 0/1 labels; ``monotone[f]`` of +1 or -1 keeps the score monotonic in feature f."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.999
    trees = Trees(float(np.log(mean / (1 - mean))))
    if len(y) == 0 or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    feature, threshold, left, right, value = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    score = np.full(len(y), trees.prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        root = node()
        trees.roots.append(root)
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[at] = float(np.clip(g / (h + ridge), low, high)) * rate
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    cg = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                    ch = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                    cn = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    lv, rv = np.clip(cg / (ch + ridge), low, high), np.clip((g - cg) / (h - ch + ridge), low, high)
                    gain = cg**2 / (ch + ridge) + (g - cg) ** 2 / (h - ch + ridge) - g * g / (h + ridge)
                    ok = (cn >= least) & (len(rows) - cn >= least)
                    if monotone[f]:
                        ok &= (rv - lv) * monotone[f] >= 0
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, lv[k], rv[k]))
            if best[1] is None:
                score[rows] += value[at]
                continue
            f, k, lv, rv = best[1]
            feature[at], threshold[at], left[at], right[at] = f, float(edges[f][k]), node(), node()
            goes = binned[rows, f] <= k
            middle = (lv + rv) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
            todo += [(left[at], rows[goes], level + 1, *bounds[0]), (right[at], rows[~goes], level + 1, *bounds[1])]
    for name, a, t in (("feature", feature, np.int32), ("threshold", threshold, float), ("left", left, np.int32), ("right", right, np.int32), ("value", value, float)):
        setattr(trees, name, np.array(a, dtype=t))
    return trees


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Trees:
    """Trees for labels.quality. Only the features of at most ``max_rows`` rows reach the driver."""

    def features(it):
        for b in it:
            texts = b.column(1)
            for first, some in blocks(texts):
                _, x = statistics(some)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(some)), b.column(2).slice(first, len(some)), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"]
                )

    rows = training_rows(docs, labels, "quality", max_rows).mapInArrow(features, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(len(y), len(FEATURES))
    return fit_trees(x, y, list(FEATURES.values()))


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def judge(docs: DataFrame, trees: Trees, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the trees' score for every row."""

    def run(it):
        for b in it:
            texts = b.column(1)
            for first, some in blocks(texts):
                base, x = statistics(some)
                failed, score = base_failed(base), trees.probability(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(some)), *(pa.array(base[c].astype(np.int64)) for c in BASE), pa.array(failed), pa.array(~failed & (score >= keep_at)), pa.array(score)],
                    names=["doc_id", *BASE, "base_failed", "kept", "score"],
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def keep_documents(docs: DataFrame, trees: Trees, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    at = docs.columns.index("text")

    def run(it):
        for b in it:
            texts = b.column(at)
            for first, some in blocks(texts):
                base, x = statistics(some)
                yield b.slice(first, len(some)).filter(pa.array(~base_failed(base) & (trees.probability(x) >= keep_at)))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read_table(spark, sf_dir, "labels")))

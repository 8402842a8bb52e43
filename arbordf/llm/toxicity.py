"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

* Token scores: log-odds of toxic against other labelled documents. Tokens stand in a tree: below the root the prefixes of
  ``SHORTEST`` to ``LONGEST`` characters, below these the whole token. A node's share of toxic documents (each document
  counts once per token below the node) has a Dirichlet prior of weight ``PRIOR`` around its parent's share, so a token
  never seen scores as its longest seen prefix, and one without any as the root: 0. Every token has its signed log-odds,
  less ``DRIFT``.
* Of a word's several places in a text the k-th scores a k-th of a positive score: the odds count documents, not places.
* Segments: the linear-time scan for all maximal scoring segments (Ruzzo and Tompa) finds every passage whose score no
  extension or shortening raises.
* Calibration: the best segment of a clean text of n tokens stays below s with chance ``exp(-k * n * exp(-rate * s))``.
  Both parameters are fitted by maximum likelihood on clean labelled rows, each scored by odds from the other half of the
  labelled rows; rows up to the ``CENSORED`` quantile count as "at most that", so the law fits the tail. A segment is
  significant if the chance of its score in clean text is below ``P_AT``. A document's evidence sums the log-chances of
  its significant segments (of its best one if none is), and a logistic curve fitted on labelled rows turns evidence
  into a score from 0 to 1.

Null and empty texts hold no segment. Without labels of both kinds every score is the share of label 1 (0 without any).
Repeated rows score alike; extra columns are ignored; words of any length are tokens like others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .labelled import MAX_LABELLED, held_out, training_rows
from .words import Words, blocks, hash_strings, mix

#: Nodes sent out at most (16 bytes each), most seen first; a node left out scores as its parent.
MAX_NODES = 500_000
SHORTEST, LONGEST = 3, 8
PRIOR, DRIFT, P_AT, CENSORED = 20.0, 1.0, 0.01, 0.8
_COUNTS = ["n1a", "n0a", "n1b", "n0b"]  # label 1 and 0 in either half


def tokens_of(words: Words) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens (words without case and without marks at their ends), and the token of every word in order."""
    plain = pc.replace_substring_regex(pc.utf8_lower(words.distinct), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").dictionary_encode()
    return plain.dictionary, plain.indices.to_numpy()[words.codes]


def tree_nodes(tokens: pa.Array) -> np.ndarray:
    """Hashes of each token's nodes, a row per level: its prefixes, then the whole token; 0 where it has none."""
    sizes = pc.utf8_length(tokens).to_numpy(zero_copy_only=False)
    chars = np.array(tokens.to_pylist(), dtype=f"U{LONGEST}").view(np.uint32).reshape(len(tokens), LONGEST).astype(np.uint64)
    h, levels = np.zeros(len(tokens), dtype=np.uint64), []
    for k in range(LONGEST):
        h = mix(h ^ (chars[:, k] + np.uint64((k + 1) << 32)))
        if k + 1 >= SHORTEST:
            levels.append(np.where(sizes > k, h, 0))
    whole = mix(hash_strings(tokens) + np.uint64(1))
    return np.stack([*levels, np.where(sizes > 0, whole, 0)])


def parents_of(nodes: np.ndarray) -> np.ndarray:
    """The parent of each node, as ``tree_nodes`` lays them out: the last one above that is not 0; the root is 0."""
    out, above = np.zeros_like(nodes), np.zeros(nodes.shape[1], dtype=np.uint64)
    for i, level in enumerate(nodes):
        out[i] = above
        above = np.where(level != 0, level, above)
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by one scan."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    before = np.concatenate([[0.0], np.cumsum(scores)])
    lows: list[float] = []
    highs: list[float] = []
    spans: list[list[int]] = []
    links: list[int] = []  # the nearest earlier candidate with a lower left sum, or -1
    for i in positive.tolist():
        low, high, start = before[i], before[i + 1], i
        j = len(spans) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = links[j]
            if j < 0 or highs[j] >= high:
                break
            # the candidate from j on has a higher right sum now: join
            low, start = lows[j], spans[j][0]
            del lows[j:], highs[j:], spans[j:], links[j:]
            j = len(spans) - 1
        lows.append(low)
        highs.append(high)
        spans.append([start, i + 1])
        links.append(j)
    return [(a, b, float(h - w)) for (a, b), h, w in zip(spans, highs, lows)]


def log_odds(parent: np.ndarray, level: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """Log-odds against the root of each node of a table sorted by node; the root is node 0, first."""
    share = np.full(len(parent), (n1[0] + 0.5) / (n1[0] + n0[0] + 1))
    for k in range(1, int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        share[own] = (n1[own] + PRIOR * share[parent[own]]) / (n1[own] + n0[own] + PRIOR)
    logit = np.log(share) - np.log1p(-share)
    return logit - logit[0]


def extreme_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(k, rate) of the greatest likelihood: ``P(best <= s) = exp(-k * n * exp(-rate * s))``, the lower part censored."""
    if not len(best):
        return 1.0, 1.0
    n, edge = np.maximum(n, 1).astype(float), float(np.quantile(best, CENSORED))
    above = best > edge
    if not above.any():
        return 0.5 / n.sum(), max(1.0, 1.0 / max(edge, 1e-9))
    x, rates = best[above], np.geomspace(0.02, 50, 2000)
    mass = np.array([(n[above] * np.exp(-r * x)).sum() + (n[~above] * np.exp(-r * edge)).sum() for r in rates])
    k = len(x) / mass
    at = int((len(x) * np.log(k * rates) - rates * x.sum()).argmax())
    return float(k[at]), float(rates[at])


@dataclass
class Model:
    nodes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    k: float = 1.0
    rate: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def token_scores(self, tokens: pa.Array) -> np.ndarray:
        """Log-odds of the deepest known node of each token."""
        out = np.zeros(len(tokens))
        if not len(self.nodes) or not len(tokens):
            return out
        for level in tree_nodes(tokens):
            at = np.minimum(np.searchsorted(self.nodes, level), len(self.nodes) - 1)
            known = (self.nodes[at] == level) & (level != 0)
            out[known] = self.weights[at[known]]
        return out

    def word_scores(self, words: Words) -> np.ndarray:
        """Score of every word of a block."""
        tokens, codes = tokens_of(words)
        scores = (self.token_scores(tokens) - DRIFT)[codes]
        up = np.flatnonzero(scores > 0)
        key = words.owner()[up].astype(np.int64) * max(len(tokens), 1) + codes[up]
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        place = np.arange(len(up)) - np.repeat(begins, np.diff(begins, append=len(up)))
        scores[up[order]] /= place + 1
        return scores

    def segments(self, words: Words) -> list[list[tuple[int, int, float]]]:
        scores, bounds = self.word_scores(words), words.bounds.tolist()
        return [maximal_segments(scores[a:z]) for a, z in zip(bounds, bounds[1:])]

    def tail(self, score: float, n: int) -> float:
        """log of the chance that clean text of n tokens holds a segment of at least this score."""
        x = self.k * max(n, 1) * np.exp(-min(self.rate * score, 600.0))
        return float(np.log(-np.expm1(-x))) if x > 1e-12 else float(np.log(x)) if x > 0 else -1e3

    def evidence(self, scores: list[float], n: int) -> tuple[float, int]:
        """Summed -log chances of the significant segments (of the best one if none is), and their number."""
        tails = [self.tail(s, n) for s in scores]
        found = [-t for t in tails if t < np.log(P_AT)]
        return float(sum(found) if found else -min(tails, default=0.0)), len(found)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -30, 30)))


def _text_blocks(it):
    for b in it:
        texts = b.column(1)
        for first, some in blocks(texts):
            yield b.slice(first, len(some)), some


def _counted(it):
    """Per node of a block: documents of either label and half that hold a token below it, added over tokens."""
    for b, some in _text_blocks(it):
        w = Words(some)
        tokens, codes = tokens_of(w)
        held = np.unique(w.owner().astype(np.int64) * max(len(tokens), 1) + codes)
        doc, token = held // max(len(tokens), 1), held % max(len(tokens), 1)
        column = 2 * np.array(b.column(3).to_pylist(), dtype=np.int64) + (1 - np.array(b.column(2).to_pylist(), dtype=np.int64))
        per_token = np.stack([np.bincount(token[column[doc] == c], minlength=len(tokens)) for c in range(4)])
        nodes = tree_nodes(tokens) if len(tokens) else np.zeros((LONGEST - SHORTEST + 2, 0), dtype=np.uint64)
        parts = [(np.zeros(1, np.uint64), np.zeros(1, np.uint64), 0, per_token.sum(axis=1, keepdims=True))]
        for k, (level, above) in enumerate(zip(nodes, parents_of(nodes)), 1):
            own = np.flatnonzero(level)
            node, first, place = np.unique(level[own], return_index=True, return_inverse=True)
            parts.append((node, above[own][first], k, np.stack([np.bincount(place, n[own], len(node)) for n in per_token])))
        for node, above, k, n in parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), pa.array(above.view(np.int64)), pa.array(np.full(len(node), k, np.int32)), *(pa.array(x.astype(np.int64)) for x in n)],
                names=["node", "parent", "level", *_COUNTS],
            )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """Log-odds from document counts added up by Spark; calibration from one small row per labelled document."""
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    rows = training_rows(docs, labels, "toxic", max_rows).select("doc_id", "text", "y", half)
    counts = rows.mapInArrow(_counted, "node long, parent long, level int, " + ", ".join(f"{c} long" for c in _COUNTS))
    counts = counts.groupBy("node").agg(F.min("parent").alias("parent"), F.min("level").alias("level"), *(F.sum(c).alias(c) for c in _COUNTS))
    total = sum(F.col(c) for c in _COUNTS)
    top = counts.filter((total > 1) | (F.col("node") == 0)).orderBy(F.desc(total), "level", "node").limit(MAX_NODES).toArrow()
    node = top.column("node").to_numpy().view(np.uint64)
    order = np.argsort(node)
    node, level = node[order], top.column("level").to_numpy()[order]
    n1a, n0a, n1b, n0b = (top.column(c).to_numpy()[order].astype(float) for c in _COUNTS)
    if not len(node) or not (n1a + n1b)[0] or not (n0a + n0b)[0]:
        return Model(offset=30.0 if len(node) and (n1a + n1b)[0] else -30.0)
    # a parent is seen as often as its child at least and comes before it, so that it is there
    parent = np.searchsorted(node, top.column("parent").to_numpy().view(np.uint64)[order])
    model = Model(node, log_odds(parent, level, n1a + n1b, n0a + n0b))
    halves = docs.sparkSession.sparkContext.broadcast([Model(node, log_odds(parent, level, n1, n0)) for n1, n0 in ((n1b, n0b), (n1a, n0a))])

    def best(it):
        for b, some in _text_blocks(it):
            w = Words(some)
            first, second = (m.segments(w) for m in halves.value)
            found = [second[i] if h else first[i] for i, h in enumerate(b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(w.sizes.astype(np.int64)), pa.array([[s for _, _, s in f] for f in found], pa.list_(pa.float64()))], names=["doc_id", "y", "n", "scores"]
            )

    seen = rows.mapInArrow(best, "doc_id long, y int, n long, scores array<double>").toArrow().sort_by("doc_id")
    y, n = seen.column("y").to_numpy().astype(float), seen.column("n").to_numpy()
    scores = seen.column("scores").to_pylist()
    highest = np.array([max(s, default=0.0) for s in scores])
    model.k, model.rate = extreme_law(highest[y == 0], n[y == 0])
    evidence = np.array([model.evidence(s, k)[0] for s, k in zip(scores, n)])
    model.slope, model.offset = _logistic(np.log1p(evidence), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps; the slope is kept at 0 or more."""
    w = np.array([0.0, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (y - p) - ridge * w)
    return max(float(w[0]), 0.0), float(w[1])


def _mapped(docs: DataFrame, model: Model, rows, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_NODES nodes

    def run(it):
        for b, some in _text_blocks(it):
            yield rows(sent.value, b, some)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_passages (significant toxic passages), evidence and score of every row."""

    def rows(model, b, some):
        w = Words(some)
        got = [model.evidence([s for _, _, s in found], int(k)) for found, k in zip(model.segments(w), w.sizes)]
        e = np.array([x for x, _ in got])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([k for _, k in got], pa.int64()), pa.array(e), pa.array(model.score(e))], names=["doc_id", "n_passages", "evidence", "score"])

    return _mapped(docs, model, rows, "doc_id long, n_passages long, evidence double, score double")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant toxic passage: doc_id, first word, words, segment score, log chance and the passage's text."""

    def rows(model, b, some):
        out = []
        for d, text, found in zip(b.column(0).to_pylist(), some, model.segments(Words(some))):
            words = text.encode().split()
            for a, z, s in found:
                t = model.tail(s, len(words))
                if t < np.log(P_AT):
                    out.append((d, a, z - a, s, t, b" ".join(words[a:z]).decode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
        names = ["doc_id", "first_word", "words", "segment_score", "log_chance", "passage"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return _mapped(docs, model, rows, "doc_id long, first_word long, words long, segment_score double, log_chance double, passage string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")

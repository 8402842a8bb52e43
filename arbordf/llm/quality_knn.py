"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms of a document are hashed: each word without case, the word's shape (runs of capitals, small letters, digits
and marks), and pairs of equal neighbours. Counts are damped (log), weighted by rarity among the labelled rows, projected
on the leading singular directions of the labelled rows and normalised. At most ``MAX_NEIGHBOURS`` labelled vectors are
broadcast; every document is compared with all of them by blocked matrix products (exact cosines), and the labels of its
``k`` nearest vote with their cosine as weight.

Null and empty texts have no direction: they get the share of label 1 among the labelled rows, as does everything when
no row is labelled (0.5 then). Ties among neighbours go to the smaller doc_id. Repeated rows score alike; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .labelled import held_out, training_rows
from .words import Words, blocks, hash_strings

#: Labelled vectors that vote: the bound of the broadcast (4 bytes x DIMENSIONS each).
MAX_NEIGHBOURS = 6_000
DIMENSIONS = 48
WORD_BUCKETS, SHAPE_BUCKETS = 1024, 512
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + 1


def _shapes(words: pa.Array) -> pa.Array:
    for pattern, to in ((r"\p{Lu}{2,}", "X"), (r"\p{Lu}", "x"), (r"[\p{L}\p{M}]+", "x"), (r"\p{N}+", "0"), (r"xx+", "x")):
        words = pc.replace_substring_regex(words, pattern, to)
    return words


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed terms, a row per text."""
    w = Words(texts)
    n, codes, owner = len(w), w.codes, w.owner()
    word_at = (hash_strings(pc.utf8_lower(w.distinct)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    shape_at = (hash_strings(_shapes(w.distinct)) % np.uint64(SHAPE_BUCKETS)).astype(np.int64) + WORD_BUCKETS
    at = owner * TERMS
    twice = np.zeros(0, dtype=np.int64)
    if len(codes) > 1:
        twice = at[1:][(word_at[codes[1:]] == word_at[codes[:-1]]) & (owner[1:] == owner[:-1])] + TERMS - 1
    return np.bincount(np.concatenate([at + word_at[codes], at + shape_at[codes], twice]), minlength=n * TERMS).reshape(n, TERMS)


def _small(texts: list[str], rows: int = 256):
    """Blocks of few texts: a block's matrix holds ``rows`` x TERMS numbers."""
    for first, some in blocks(texts):
        for i in range(0, len(some), rows):
            yield first + i, some[i : i + rows]


@dataclass
class Space:
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    k: int
    prior: float

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        v = (np.log1p(counts).astype(np.float32) * self.weight) @ self.basis
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def vote(self, v: np.ndarray) -> np.ndarray:
        out = np.full(len(v), self.prior)
        if not len(self.y):
            return out
        real = v.any(axis=1)
        cos = v[real] @ self.vectors.T
        k = min(self.k, len(self.y))
        # ties by position (ascending doc_id): compare cosines rounded to what single precision can tell
        rank = np.round(cos.astype(np.float64), 6) - np.arange(len(self.y)) * 1e-12
        near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        voted = np.divide((weight * self.y[near]).sum(axis=1), total, out=np.full(len(total), self.prior), where=total > 0)
        out[real] = np.clip(voted, 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_NEIGHBOURS, k: int = 24, dimensions: int = DIMENSIONS) -> Space:
    """The space and its labelled vectors. The driver gets at most ``max_rows`` x TERMS counts, as sparse rows."""

    def counts(it):
        for b in it:
            texts = b.column(1)
            for first, some in _small(texts):
                c = term_counts(some)
                rows = [np.flatnonzero(r) for r in c]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(some)), b.column(2).slice(first, len(some)),
                        pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([c[i, r].astype("<u4").tobytes() for i, r in enumerate(rows)], pa.binary()),
                    ],
                    names=["doc_id", "y", "at", "n"],
                )

    rows = training_rows(docs, labels, "quality", max_rows).mapInArrow(counts, "doc_id long, y int, at binary, n binary").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.zeros((len(y), TERMS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(rows.column("at").to_pylist(), rows.column("n").to_pylist())):
        x[i, np.frombuffer(at, "<u2")] = np.log1p(np.frombuffer(n, "<u4"))
    weight = np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x *= weight
    size = np.linalg.norm(x, axis=1, keepdims=True)
    np.divide(x, size, out=x, where=size > 0)
    # leading singular directions by subspace iteration from a fixed start
    basis = np.random.default_rng(7).standard_normal((TERMS, dimensions)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    space = Space(weight, basis.astype(np.float32), np.empty((0, dimensions), np.float32), y, k, float(y.mean()) if len(y) else 0.5)
    v = x @ space.basis
    size = np.linalg.norm(v, axis=1, keepdims=True)
    space.vectors = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    return space


def _scored(docs: DataFrame, space: Space, emit, schema):
    """Apply ``emit(batch slice, scores)`` to every row; the fitted space goes out once as a broadcast variable."""
    sent, at = docs.sparkSession.sparkContext.broadcast(space), docs.columns.index("text")

    def run(it):
        space = sent.value
        for b in it:
            texts = b.column(at)
            for first, some in _small(texts):
                yield emit(b.slice(first, len(some)), space.vote(space.vectors_of(term_counts(some))))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id and score of every row."""
    return _scored(docs.select("doc_id", "text"), space, lambda b, s: pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"]), "doc_id long, score double")


def keep_documents(docs: DataFrame, space: Space, keep_at: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep_at``, all columns as they were."""
    return _scored(docs, space, lambda b, s: b.filter(pa.array(s >= keep_at)), docs.schema)


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

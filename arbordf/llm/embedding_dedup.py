"""Embedding near-duplicates by a pivot-permutation index.

* Equal vectors of a label become one class first, so a group of copies is one vector, however large.
* Every class vector is described by its ``prefix`` nearest of a bounded sample of reference points (pivots), in order
  of nearness. The number of pivots grows with the root of the number of vectors (``MAX_PIVOTS`` at most), so lists stay
  short; pivots are a sample of at most that many rows, the index holds every row.
* Pivots are kept apart, but ``LEAST_PIVOTS`` of a length stay where the sample has as many (see ``spread``). The prefix
  grows until ``PROBED`` of made pairs at the least cosine share enough pivots (see ``fitting_prefix``), up to all
  pivots: then every pair of the length is verified.
* Inverted lists (label, pivot) are cut into blocks of about ``BLOCK`` vectors; every pair of blocks of a list is one
  small group of rows, so no list is gathered whole. Within a group, pairs that share at least ``shared`` pivots (all, if
  the length has fewer) are verified by their cosine in double precision. A pair is counted in the list of its smallest common pivot only.
* A group returns per vector how many others it links to, and one link to the smallest member of each linked set: never
  more rows than it read.

Vectors that are null, empty, zero, hold null or non-finite components, or have no label link with nothing; vectors of
different lengths are not compared. Lengths after the ``MAX_LENGTHS`` most frequent have one list each, of all their
vectors: every pair is verified. Rows with the same vec_id are one vector per distinct embedding and take its class.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .components import connected_components

MAX_PIVOTS, MAX_LENGTHS, BLOCK = 1 << 15, 64, 256
#: Pivots are less alike than this.
PIVOT_COSINE = 0.7
#: Bytes of all pivots together, dealt evenly to the lengths that have some: the bound of what is broadcast.
PIVOT_BYTES = 64 << 20
#: Separations tried in turn while fewer pivots than this stay.
LEAST_PIVOTS, WIDER = 32, (0.8, 0.9, 0.95, 0.98)
#: Share of made pairs at the least cosine that the index must hold, and their number.
PROBED, PROBES = 0.99, 512


def _unit(rows: list, dim: int) -> np.ndarray:
    v = np.array(rows, dtype=np.float64).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def apart(rows: np.ndarray, most: float) -> np.ndarray:
    """Rows, first come first, of which no two have a cosine of ``most`` or more.

    Pivots lying in one group of near copies would be ordered by noise alone: the members of that group would then
    share no prefix.
    """
    kept = np.empty((0, rows.shape[1]))
    for i in range(0, len(rows), 512):
        part = rows[i : i + 512]
        if len(kept):
            part = part[(part @ kept.T).max(axis=1) < most]
        near, chosen = part @ part.T >= most, []
        for j in range(len(part)):
            if not near[j, chosen].any():
                chosen.append(j)
        kept = np.concatenate([kept, part[chosen]])
    return kept


def spread(rows: np.ndarray) -> np.ndarray:
    """Pivots of unit ``rows``: apart by ``PIVOT_COSINE``, or by less where vectors lie in a narrow cone."""
    kept = apart(rows, PIVOT_COSINE)
    for most in WIDER:
        if len(kept) >= min(LEAST_PIVOTS, len(rows)):
            break
        kept = apart(rows, most)
    return kept


def _nearest(unit: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots of each row, nearest first."""
    cos = unit @ pivots.T
    top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, axis=1), axis=1, kind="stable"), axis=1)


def fitting_prefix(rows: np.ndarray, pivots: np.ndarray, least: float, prefix: int, shared: int) -> int:
    """``prefix``, doubled until ``PROBED`` of the probes share ``shared`` of it, or it holds all pivots.

    A probe is a row and its turn by the angle of ``least`` towards the difference of two others: the farthest pair that
    links, in a direction in which the rows differ.
    """
    pick = np.random.default_rng(0).integers(0, len(rows), (3, PROBES))
    a, d = rows[pick[0]], rows[pick[1]] - rows[pick[2]]
    d = d - (d * a).sum(axis=1, keepdims=True) * a
    size = np.linalg.norm(d, axis=1)
    a, d = a[size > 1e-6], d[size > 1e-6] / size[size > 1e-6, None]
    b = least * a + math.sqrt(max(1 - least * least, 0)) * d
    while prefix < len(pivots) and len(a):
        found = 0
        for i in range(0, len(a), 64):
            x, y = _nearest(a[i : i + 64], pivots, prefix), _nearest(b[i : i + 64], pivots, prefix)
            found += sum(len(np.intersect1d(p, q)) >= shared for p, q in zip(x, y))
        if found >= PROBED * len(a):
            break
        prefix *= 2
    return prefix


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows that can link, with the digest of their embedding."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    # adding 0 turns -0 into 0, so equal vectors have equal digests
    digest = F.md5(F.concat_ws(",", F.transform(e, lambda x: F.hex(F.xxhash64(x + F.lit(0).cast("float"))))))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select("vec_id", "label", F.size(e).alias("dim"), digest.alias("digest"), "embedding")


def describe(classes: DataFrame, pivots: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """Add ``near``: the nearest pivots of each class vector, nearest first. ``pivots`` holds unit rows and the prefix
    per length; a length without them has one constant pivot."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(it):
        for b in it:
            dims, rows = np.array(b.column("dim").to_pylist(), dtype=np.int64), b.column("embedding").to_pylist()
            near: list = [None] * len(rows)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                if dim not in sent.value:
                    for j in own.tolist():
                        near[j] = np.zeros(1, dtype=np.int32)
                    continue
                p, prefix = sent.value[dim]
                k = min(prefix, len(p))
                for i in range(0, len(own), 512):
                    part = own[i : i + 512]
                    for j, t in zip(part.tolist(), _nearest(_unit([rows[j] for j in part], dim), p, k)):
                        near[j] = t.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], names=[*b.schema.names, "near"])

    return classes.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in classes.dtypes)}, near array<int>")


def _pairs(vec: np.ndarray, near: list, left: np.ndarray, right: np.ndarray, pivot: int, shared: int, least: float):
    """Linked (i, j) of rows ``left`` x ``right`` that belong to this pivot's list."""
    values, where = np.unique(np.concatenate(near), return_inverse=True)
    holds = np.zeros((len(near), len(values)), dtype=np.float32)
    holds[np.repeat(np.arange(len(near)), [len(x) for x in near]), where] = 1
    before = values < pivot
    # all vectors of a length hold equally many pivots
    ok = holds[left] @ holds[right].T >= min(shared, len(near[0]))
    ok &= holds[left][:, before] @ holds[right][:, before].T == 0
    ok &= vec[left] @ vec[right].T >= least
    i, j = np.nonzero(ok)
    return left[i], right[j]


def link_blocks(described: DataFrame, least: float, shared: int, block: int = BLOCK) -> DataFrame:
    """Rows (node, links, low): vectors linked to ``node`` found in a group, and the smallest node of its linked set."""
    posted = described.select("node", "label", "dim", "m", "near", "embedding", F.explode("near").alias("pivot"))
    parts = posted.groupBy("label", "dim", "pivot").agg(F.count("*").alias("size")).filter("size > 1")
    parts = parts.select("label", "dim", "pivot", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (
        posted.join(parts, ["label", "dim", "pivot"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("label", "dim", "pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "m", "near", "embedding")
    )
    keys = ["label", "dim", "pivot", "lo", "hi"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "own", "node")

    def group(key, rows):
        vec, own = _unit([r[3] for r in rows], key[1]), np.array([r[0] for r in rows])
        node, m, near = np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64), [np.array(r[4]) for r in rows]
        if key[3] == key[4]:
            every = np.arange(len(rows))
            i, j = _pairs(vec, near, every, every, key[2], shared, least)
            i, j = i[i < j], j[i < j]
        else:
            i, j = _pairs(vec, near, np.flatnonzero(own == key[3]), np.flatnonzero(own == key[4]), key[2], shared, least)
        if not len(i):
            return None
        links = np.bincount(i, m[j], len(rows)) + np.bincount(j, m[i], len(rows))
        low = node.copy()
        while True:  # smallest node of each linked set within the group
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some])], names=["node", "links", "low"])

    def run(it):
        key, rows = None, []
        for b in it:
            cols = [b.column(c).to_pylist() for c in (*keys, "own", "node", "m", "embedding", "near")]
            for values in zip(*cols):
                if values[:5] != key:
                    if len(rows) > 1 and (out := group(key, rows)) is not None:
                        yield out
                    key, rows = values[:5], []
                rows.append(values[5:])
        if len(rows) > 1 and (out := group(key, rows)) is not None:
            yield out

    return dealt.mapInArrow(run, "node long, links long, low long")


def near_duplicates(vectors: DataFrame, least: float = 0.93, prefix: int = 8, shared: int = 2, per_root: float = 6.0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (see the module's notes).

    Pivots: ``per_root`` times the root of the number of class vectors, from 32 to ``MAX_PIVOTS`` and ``PIVOT_BYTES`` in all,
    by hash of vec_id.
    """
    valid = materialize(valid_vectors(vectors), "vectors")
    same = ["label", "dim", "digest"]
    classes = valid.groupBy(*same).agg(F.min(F.struct("vec_id", "embedding")).alias("c"), F.count("*").alias("m"))
    # two embeddings under one vec_id: nodes are told apart by class, components join them again through vec_id
    classes = classes.select(F.col("c.vec_id").alias("node"), "label", "dim", "m", F.col("c.embedding").alias("embedding"), "digest")
    classes = materialize(classes, "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MAX_LENGTHS).collect()}
    pivots = {}
    for dim, n in sizes.items():
        wanted = int(min(max(per_root * math.sqrt(n), 32), MAX_PIVOTS, max(PIVOT_BYTES // (8 * dim * len(sizes)), LEAST_PIVOTS)))
        rows = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("node", "digest")).limit(wanted).select("embedding").toArrow().column(0).to_pylist()
        sample = _unit(rows, dim)
        chosen = spread(sample)
        pivots[dim] = chosen, fitting_prefix(sample, chosen, least, prefix, shared)
    described = materialize(describe(classes, pivots), "described")
    found = materialize(link_blocks(described, least, shared), "found")
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        classes.select(*same, "node", "m").join(counted, "node", "left").join(groups, "node", "left")
        .select(*same, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = valid.select("vec_id", *same).join(placed, same).select("vec_id", "n_links", "component_id")
    alone = vectors.select("vec_id").exceptAll(valid.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))

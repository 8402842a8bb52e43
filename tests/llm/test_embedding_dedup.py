"""The pivot index where vectors are near each other, against brute force."""

import math

import numpy as np

from arbordf.llm import embedding_dedup


def collected(spark, rows):
    table = [(i, np.asarray(e, np.float32).tolist(), 0, False, 5) for i, e in enumerate(rows)]
    docs = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, kept boolean, node int")
    return {r["vec_id"]: r for r in embedding_dedup.near_duplicates(docs).collect()}


def found(spark, rows):
    return {k: r["n_links"] for k, r in collected(spark, rows).items()}


def test_groups_equal_brute_force(spark):
    """n_links, component_id and kept, copies and chains among them."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((30, 24))
    rows = [c + s * rng.standard_normal(24) for c in centres for s in (0.0, 0.0, 0.1, 0.2, 0.3)]
    v = np.asarray(rows, np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.93
    low = np.arange(len(rows))
    while True:
        new = np.array([low[near[i]].min() for i in range(len(rows))])
        if (new == low).all():
            break
        low = new
    got = collected(spark, rows)
    assert [got[i]["n_links"] for i in range(len(rows))] == (near.sum(axis=1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(rows))] == low.tolist()
    assert [got[i]["kept"] for i in range(len(rows))] == (low == np.arange(len(rows))).tolist()


def test_one_vec_id_with_two_vectors(spark):
    table = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.05], 0), (3, [0.05, 1.0], 0), (4, [-1.0, 0.0], 0), (4, [-1.0, 0.0], 0)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == 6 and {(r["vec_id"], r["component_id"]) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def brute(rows):
    v = np.asarray(rows, np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return (v @ v.T >= 0.93).sum(axis=1) - 1


def test_two_near_vectors(spark):
    assert found(spark, [[1.0, 0.0, 0.0], [0.95, math.sqrt(1 - 0.95**2), 0.0]]) == {0: 1, 1: 1}


def test_narrow_cone(spark):
    rng = np.random.default_rng(1)
    rest = rng.standard_normal((1000, 64))
    rows = rest / np.linalg.norm(rest, axis=1, keepdims=True) * math.sqrt(0.13)
    rows[:, 0] += math.sqrt(0.87)
    turn = rng.standard_normal((1000, 64))
    near = rows + turn / np.linalg.norm(turn, axis=1, keepdims=True) * rng.uniform(0.05, 0.3, (1000, 1))
    rows = np.concatenate([rows, near])
    want, got = brute(rows), found(spark, rows)
    assert want.sum() > 1500
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_more_lengths_than_have_pivots(spark):
    rows = [e for dim in range(2, 70) for e in ([1.0] * dim, [1.0] * (dim - 1) + [1.1], [-1.0] + [1.0] * (dim - 1))]
    want = {}
    for i, a in enumerate(rows):
        same = [np.array(b) for j, b in enumerate(rows) if j != i and len(b) == len(a)]
        want[i] = sum(float(b @ a / np.linalg.norm(a) / np.linalg.norm(b)) >= 0.93 for b in same)
    assert found(spark, rows) == want

import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from arbordf.llm import packing
from arbordf.llm.packing import RoomTree, best_fit_decreasing
from arbordf.llm.segments import PartEncoder


def place(runs):
    out = {}
    for length, rank, n, first, per, offset in runs:
        for i in range(n):
            out[length, rank + i] = (first + i // per, offset + i % per * length)
    return out


def one_by_one(lengths, window):
    """Windows' fills after best-fit decreasing, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(window - n)
    return Counter(room)


def test_runs_equal_piecewise_packing():
    rng = random.Random(1)
    for _ in range(200):
        window = rng.choice([8, 16, 31, 64])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 120))]
        counts = Counter(lengths)
        spots = place(best_fit_decreasing(counts, window))
        assert set(spots) == {(n, r) for n, c in counts.items() for r in range(c)}
        per_window = {}
        for (n, _), (w, off) in spots.items():
            per_window.setdefault(w, []).append((off, n))
        for parts in per_window.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= window
        assert Counter(window - sum(n for _, n in p) for p in per_window.values()) == one_by_one(lengths, window)


def test_tightest_room():
    t = RoomTree(10)
    assert t.tightest(0) is None
    for r in (3, 7, 10):
        t.set(r, True)
    assert [t.tightest(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    t.set(7, False)
    assert t.tightest(4) == 10


def test_few_bytes_are_encoded_at_once(spark, monkeypatch):
    """What a worker of the pipeline holds while it cuts is bounded: 1 MB of texts at once, whatever the batch holds."""
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, sizes = [f"{i} " * 30_000 for i in range(10, 60)], []

    def split(some):
        sizes.append(sum(map(len, some)))
        parts = [t.split() for t in some]
        return pa.array([w for p in parts for w in p], pa.large_string()), np.cumsum([0, *map(len, parts)])

    encoder = PartEncoder(split, lambda parts: [np.array([int(p)], "<u4").tobytes() for p in parts])
    monkeypatch.setattr(packing, "library_encoder", lambda path: encoder)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    ran = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: ran.append(f))
    monkeypatch.setattr(packing, "materialize", lambda df, tag: df)
    monkeypatch.setattr(packing, "pack_pieces", lambda pieces, window: pieces)
    corpus_pipeline.pack(spark, docs, "")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [r for b in ran[0](iter([batch])) for r in b.to_pylist()]
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) <= 1 << 20
    want = []
    for d, t in enumerate(texts):
        ids = np.array([*map(int, t.split()), 1], "<u4")
        want += [(d, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    assert [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got] == want

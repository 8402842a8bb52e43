"""Passages that hold cycles of words or no blanks."""

import random

import pytest

from arbordf.llm import substring_dedup


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def share_seen(first, second, passage):
    """Share of the bytes of ``passage`` in ``second`` that lie in chunks of ``first``."""
    seen, raw = set(), [first.encode(), second.encode()]
    text, start, end, _ = substring_dedup.chunk_bounds(raw)
    low = raw[1].index(passage.encode())
    high, found = low + len(passage.encode()), 0
    for t, a, z in zip(text.tolist(), start.tolist(), end.tolist()):
        assert z > a and raw[t][a:z].decode()
        if t and raw[1][a:z] in seen:
            found += max(min(z, high) - max(a, low), 0)
        elif not t:
            seen.add(raw[0][a:z])
    return found / (high - low)


@pytest.mark.parametrize("cycle", ["la", "la li", "la li lo", "la li lo lu"])
def test_cycles_in_other_contexts(cycle):
    rng = random.Random(1)
    for _ in range(20):
        passage = " ".join([cycle] * (120 // len(cycle.split())))
        assert share_seen(f"{prose(rng, 40)} {passage} {prose(rng, 40)}", f"{prose(rng, 31)} {passage} {prose(rng, 40)}", passage) > 0.7


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x4F00))), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
def test_text_without_blanks(letters):
    rng = random.Random(2)

    def run(n):
        return "".join(rng.choice(letters) for _ in range(n))

    for _ in range(20):
        passage = run(1000)
        assert share_seen(run(300) + passage + run(200), run(211) + passage + run(200), passage) > 0.7


def test_passages_of_both_kinds(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4F00)]
    line, cycle = "".join(rng.choice(letters) for _ in range(500)), " ".join(["la li"] * 60)
    rows = [(1, "".join(rng.choice(letters) for _ in range(90)) + line), (2, line), (3, f"{prose(rng, 40)} {cycle} {prose(rng, 40)}"), (4, f"{prose(rng, 40)} {cycle} {prose(rng, 40)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs)
    assert {2, 4} <= {r["doc_id"] for r in found.collect()}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs, found).collect()}
    assert left[1] == rows[0][1] and len(left[2]) < 150 and left[4].count("la li") < 20


def brute(rows, least_words, least_bytes):
    """Passages by a plain walk over the texts in order; a text is (doc_id, text)."""
    from pyspark.sql import functions as F  # noqa: F401

    seen, out = {}, set()
    for key, (d, text) in rows:
        raw = text.encode()
        _, start, end, words = substring_dedup.chunk_bounds([raw])
        run = []
        for i, (a, z, n) in enumerate(zip(start.tolist(), end.tolist(), words.tolist())):
            first = seen.setdefault(raw[a:z], (d, key, i))
            if first != (d, key, i):
                run.append((a, z, n))
                continue
            out |= passage(d, key, run, least_words, least_bytes)
            run = []
        out |= passage(d, key, run, least_words, least_bytes)
    return out


def passage(d, key, run, least_words, least_bytes):
    words, size = sum(r[2] for r in run), sum(r[1] - r[0] for r in run)
    return {(d, key, run[0][0], run[-1][1], words, len(run))} if run and (words >= least_words or size >= least_bytes) else set()


@pytest.mark.parametrize("least", [(15, 200), (1, 1)])
def test_passages_equal_a_plain_walk(spark, edge_docs, least):
    from pyspark.sql import functions as F

    keyed = edge_docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("k"), "text").distinct()
    rows = sorted((r["doc_id"], r["k"], r["text"]) for r in keyed.collect())
    found = substring_dedup.repeated_passages(edge_docs, *least)
    got = {(r["doc_id"], r["text_key"], r["start"], r["end"], r["words"], r["chunks"]) for r in found.collect()}
    assert got == brute([(k, (d, t)) for d, k, t in rows], *least) and got


def test_one_doc_id_with_unlike_texts(spark):
    """Nulls and other texts under the id of a repeated passage."""
    rng = random.Random(5)
    passage = prose(rng, 90)
    texts = [(1, passage), (2, f"é{prose(rng, 40)} {passage} {prose(rng, 30)}"), (2, None), (2, "漢" * 300), (2, f"é{prose(rng, 35)}"), (None, passage), (3, ""), (1, passage), (4, passage)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, text_key int, n_chars int").repartition(3)
    left = substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).collect()
    assert len(left) == len(texts)
    kept = sorted(((r["doc_id"], r["text"]) for r in left), key=str)
    same = [x for x in texts if x[0] not in (2, 4) or x[1] in (None, "漢" * 300, texts[4][1])]
    assert all(x in kept for x in same) and kept.count((1, passage)) == 2
    cut = [t for d, t in kept if d == 2 and t and t.startswith("é") and t != texts[4][1]]
    assert len(cut) == 1 and len(cut[0]) < len(texts[1][1]) - 300 and [t for d, t in kept if d == 4] == [""]
    assert all(r["n_chars"] == len(r["text"]) for r in left if r["text"] is not None) and all(r["text_key"] == 1 for r in left)

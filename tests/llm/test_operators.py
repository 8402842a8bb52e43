"""Operators against brute force on small tables, and their edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arbordf.llm import bpe_tree, embedding_dedup, ngram_join, packing, quality_knn, quality_rules, substring_dedup, token_planes, toxicity, url_lists
from arbordf.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint32)
    for kind, n in (("byte", 4), ("bit", 32)):
        planes = token_planes.to_planes(ids, kind)
        assert len(planes) == n and (token_planes.from_planes(planes, 1000) == ids).all()
    assert len(token_planes.from_planes(token_planes.to_planes(ids[:0]), 0)) == 0


def test_crc_join():
    a, b = b"some bytes", bytes(range(256)) * 5
    assert token_planes.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_planes.crc32_join(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.fixture(scope="session")
def special_docs(spark, edge_docs):
    """The edge cases, and texts with strings of special tokens."""
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>y  \n", "<|endoftext|><|endoftext|>", "<| endoftext|>"]
    more = spark.createDataFrame([(50 + i, t, "en", 1.5, True, 7, 3) for i, t in enumerate(texts)], edge_docs.schema)
    return edge_docs.unionByName(more)


def by_library(docs, name):
    """Sorted (doc_id, ids with the end id) by the library's plain call."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    rows = [(d, np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")) for d, text in pairs(docs)]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_token_store(spark, special_docs, tmp_path, chunk):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_planes.write_store(special_docs, f"file://{tmp_path}/s", path, chunk_ids=chunk, plane="bit" if chunk == 64 else "byte")
    got = [(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_planes.read_documents(spark, f"file://{tmp_path}/s").collect()]
    want = by_library(special_docs, "word_bpe_49k.json")
    assert Counter(g[1:] for g in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    got.sort()
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    assert [g[1] for g in got] == [d for d, _ in want]
    total = sum(len(x) for _, x in want)
    every = token_planes.read_ids(spark, f"file://{tmp_path}/s", 0, total)
    assert len(every) == total
    assert (token_planes.read_ids(spark, f"file://{tmp_path}/s", 100, 50) == every[100:150]).all()


def test_chunks_are_decoded_once(spark, special_docs, tmp_path, monkeypatch):
    read, seen = token_planes._read_pieces, tmp_path / "seen"

    def counting(it):
        for b in it:
            with open(seen, "a") as f:
                f.write("x" * len(b))
            yield from read(iter([b]))

    token_planes.write_store(special_docs, f"file://{tmp_path}/s", public_tokenizers.path("word_bpe_49k.json"), chunk_ids=4096)
    monkeypatch.setattr(token_planes, "_read_pieces", counting)
    assert token_planes.read_documents(spark, f"file://{tmp_path}/s").count() == special_docs.count()
    assert len(seen.read_text()) == token_planes.open_chunks(spark, f"file://{tmp_path}/s").count() > 4


def test_packed_pieces_equal_library(special_docs):
    rows = packing.pack_documents(special_docs, public_tokenizers.path("byte_bpe_50k.json"), 256).collect()
    want = Counter()
    for d, ids in by_library(special_docs, "byte_bpe_50k.json"):
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want[d, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


def test_empty_tables(spark, no_docs, tmp_path):
    token_planes.write_store(no_docs, f"file://{tmp_path}/e", public_tokenizers.path("word_bpe_49k.json"))
    assert token_planes.read_documents(spark, f"file://{tmp_path}/e").count() == 0
    assert packing.pack_documents(no_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert ngram_join.jaccard_groups(no_docs).count() == 0
    assert substring_dedup.repeated_passages(no_docs).count() == 0
    assert bpe_tree.text_digests(no_docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(no_docs, quality_rules.fit(no_docs, none)).count() == 0
    assert quality_knn.score(no_docs, quality_knn.fit(no_docs, none)).count() == 0
    assert toxicity.score(no_docs, toxicity.fit(no_docs, none)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(vectors).count() == 0


def test_packing_covers_every_id(edge_docs):
    rows = packing.pack_documents(edge_docs, public_tokenizers.path("byte_bpe_50k.json"), 256).collect()
    by_window = {}
    for r in rows:
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_window.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def brute_groups(rows, k, percent):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(low))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, []).append(s)
    up = {d: d for d in sets if d is not None}
    for a in up:
        for b in up:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        low_, high = sorted((up[a], up[b]))
                        up = {d: low_ if c == high else c for d, c in up.items()}
    return up


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_groups(edge_docs, k, percent):
    got = ngram_join.jaccard_groups(edge_docs, k, percent).collect()
    expected = brute_groups(pairs(edge_docs), k, percent)
    assert len(got) == edge_docs.count()
    assert all(r["component_id"] == expected.get(r["doc_id"]) for r in got)
    sizes = Counter()
    for d, t in pairs(edge_docs):
        n = len(WORD.findall(t or ""))
        words = WORD.findall((t or "").lower())
        sizes[d, len({tuple(words[i : i + k]) for i in range(n - k + 1)}) if n >= k else int(n > 0)] += 1
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    assert expected[2] == 0 and expected[7] == 6 and expected[4] == 4


def test_occurrence_search_equals_counts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
        q = np.unique(rng.integers(0, 40, 30).astype(np.uint64))
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 70 * len(np.union1d(q, s))]
        assert ngram_join.occurrence_search(q, sets, 70) == want
    lists = ngram_join.Inverted([*sets, sets[0][:0]])
    assert [lists.search(s, 100)[0] for s in sets] == [min(j for j in range(12) if np.array_equal(sets[j], s)) for s in sets]
    assert lists.search(sets[0][:0], 70) == [] and ngram_join.Inverted([]).search(sets[0], 70) == []


def test_sketches_lose_no_link(spark):
    """Linked pairs always stay, whatever their sketch sizes; most pairs that are not linked go."""
    rng, percent = np.random.default_rng(8), 80
    sets = []
    for n in [1, 2, 3, 60, 64, 65, 70, 128, 140, 500, 1020, 1030, 3000] * 2:
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for keep in (1.0, 0.97, 0.9, 0.85, 0.6):
            kept = base[rng.random(n) < keep]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, int(n * rng.random() * (1 - keep)), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    classes = spark.createDataFrame([(i, len(s), ngram_join.sketch(s).tolist()) for i, s in enumerate(sets)], "node long, n long, sketch array<long>")
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    linked = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))}
    left = {tuple(r) for r in ngram_join.possible(spark.createDataFrame(pairs, "a long, b long"), classes, percent).collect()}
    assert linked and len({len(ngram_join.sketch(sets[a])) == len(ngram_join.sketch(sets[b])) for a, b in linked}) == 2
    assert linked <= left and len(left) < 3 * len(linked)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (9, 5), (7, 7), (200, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3, 200: 3}


def test_repeated_passages(edge_docs):
    found = substring_dedup.repeated_passages(edge_docs)
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 10}
    kept = {(r["doc_id"], r["text"]) for r in substring_dedup.remove_passages(edge_docs, found).collect()}
    text = dict(pairs(edge_docs.filter("doc_id < 12")))
    left = dict(x for x in kept if x[0] is not None and x[0] < 12)
    assert all(left[d] == text[d] for d in (0, 3, 4, 5, 6, 7, 8, 9, 11))
    assert len(left[1]) < 5 and len(left[10]) < len(text[10]) - 200
    assert substring_dedup.remove_passages(edge_docs, found).columns == edge_docs.columns


def test_chunks_resist_insertions():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, 5).astype(np.uint8)) for _ in range(400)]
    a, b = b" ".join(words), b" ".join([*words[:50], b"inserted", *words[50:]])

    def texts(raw):
        _, start, end, _ = substring_dedup.chunk_bounds([raw])
        return [raw[x:y] for x, y in zip(start, end)]

    assert len(set(texts(a)) ^ set(texts(b))) <= 6
    assert b" ".join(texts(a)) == a


def test_statistics_equal_brute_force(edge_docs):
    texts = [t or "" for _, t in pairs(edge_docs)] + ["a b c d e a b c d e x", "x\nx\n\n y \n", "#$ <|> é ü"]
    base, _ = quality_rules.statistics(texts)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        runs = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        inside = {p for j in range(len(w) - 4) if runs[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert tuple(int(base[c][i]) for c in quality_rules.BASE) == want


def test_trees_are_monotonic():
    rng = np.random.default_rng(3)
    x = rng.random((600, 2))
    y = (x[:, 0] + 0.1 * rng.standard_normal(600) > 0.5).astype(float)
    trees = quality_rules.fit_trees(x, y, [1, 0])
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5)], axis=1)
    assert (np.diff(trees.probability(grid)) >= -1e-12).all()
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.85


def accuracy(scored, labels, column, at):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = [r for r in scored.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return np.mean([(r["score"] >= at) == truth[r["doc_id"]] for r in rows])


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    assert accuracy(quality_knn.score(docs, quality_knn.fit(docs, labels)), labels, "quality", 0.3) > 0.95
    model = toxicity.fit(docs, labels)
    assert accuracy(toxicity.score(docs, model), labels, "toxic", 0.5) > 0.95
    assert any("fiend" in r["passage"] for r in toxicity.passages(docs, model).collect())
    judged = quality_rules.judge(docs, quality_rules.fit(docs, labels))
    assert accuracy(judged, labels, "quality", 0.5) > 0.95


def test_models_on_edge_cases(edge_docs, labelled):
    docs, labels = labelled
    n = edge_docs.count()
    for scored in (quality_knn.score(edge_docs, quality_knn.fit(docs, labels)), toxicity.score(edge_docs, toxicity.fit(docs, labels))):
        rows = scored.collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    trees = quality_rules.fit(docs, labels)
    assert quality_rules.judge(edge_docs, trees).count() == n
    assert quality_rules.keep_documents(edge_docs, trees).columns == edge_docs.columns


def best_segments(scores):
    """All maximal scoring segments by their recursive definition."""
    if not len(scores):
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return best_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in best_segments(scores[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(8)
    for _ in range(100):
        s = rng.integers(-50, 40, 14) / 7 + rng.random(14) * 1e-3
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(s)]
        assert sorted(got) == sorted(best_segments(s.tolist()))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(6):
        centre = rng.standard_normal(16)
        for _ in range(25):
            rows.append(((centre + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), g % 2))
    rows += [(rng.standard_normal(16).astype(np.float32).tolist(), 0) for _ in range(50)] + [rows[0], rows[0]]
    rows += [(None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0, None], 0), ([1.0] * 16, None), ([], 0)]
    table = [(i, e, y) for i, (e, y) in enumerate(rows)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(e, float), y) for i, e, y in table if y is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = {i: set() for i, _, _ in table}
    for i, a, y in ok:
        for j, b, z in ok:
            if i != j and y == z and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i].add(j)
    assert len(got) == len(table)
    want, have = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert 0.9 * want <= have <= want
    assert got[0]["n_links"] >= 2 and got[0]["kept"] and not got[200]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(202, 208))


def url_verdicts(spark, entries, captures, **how):
    listed = spark.createDataFrame(entries, "pattern string, action string, effective string")
    seen = spark.createDataFrame(captures, "key int, url string, fetched string")
    return sorted((r["key"], r["n_active"], r["pattern"], r["verdict"]) for r in url_lists.filter_captures(seen.withColumn("pattern", seen.url), listed, **how).collect())


def test_url_lists(spark):
    entries = [("a.com", "block", "2024-01-01"), ("a.com", "remove", "2024-03-01"), ("x.A.com", "allow", "2024-02-01"), ("a.com/p", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("A.com/Ads/", "block", "2024-01-01"), ("a.com/p/q", "allow", "2024-01-01"), ("a.com", "shrug", "2023-01-01")]
    captures = [
        (1, "http://A.com/q", "2024-01-15"), (2, "http://a.com/q", "2024-03-01"), (3, "http://x.a.com/", "2024-02-10"), (4, "http://x.a.com/", "2024-01-10"), (5, "http://a.com/p?x", "2025-01-01"),
        (6, None, "2024-01-15"), (7, "nonsense", "2024-01-15"), (8, "http://a.com", None), (9, "http://a.com/Ads/x", "2025-01-01"), (10, "http://a.com/ads/x", "2025-01-01"), (11, "http://me:pw@a.com:80/p/q/r", "2024-01-02"),
        (12, "http://evil.com/@a.com", "2024-01-15"), (13, "http://a.com/pq", "2025-01-01"), (13, "http://a.com/pq", "2025-01-01"), (14, "http://ba.com/", "2024-01-15"),
    ]
    want = [
        (1, 1, "a.com", "block"), (2, 0, None, "none"), (3, 2, "x.a.com", "allow"), (4, 1, "a.com", "block"), (5, 1, "a.com/p", "block"), (6, 0, None, "none"), (7, 0, None, "none"), (8, 0, None, "none"),
        (9, 1, "a.com/Ads", "block"), (10, 0, None, "none"), (11, 3, "a.com/p/q", "allow"), (12, 0, None, "none"), (13, 0, None, "none"), (13, 0, None, "none"), (14, 0, None, "none"),
    ]
    assert url_verdicts(spark, entries, captures) == want
    assert url_verdicts(spark, [], captures) == [(k, 0, None, "none") for k, *_ in want]
    assert url_verdicts(spark, entries, []) == []


def test_url_filter_runs_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.com/x", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = url_lists.op3_url_lists(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_ids_do_not_pass_the_bound_of_labelled_rows(spark):
    from arbordf.llm.labelled import training_rows

    docs = spark.createDataFrame([(i, f"{i} {j % 2}" if i else None) for i in range(40) for j in range(6)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    got = [tuple(r) for r in training_rows(docs, labels, "quality", 20).collect()]
    assert len(got) == len({i for i, _, _ in got}) == 20 and all(y == i % 2 for i, _, y in got)
    assert sorted(got) == sorted(map(tuple, training_rows(docs.repartition(3), labels, "quality", 20).collect()))

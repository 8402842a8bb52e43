"""The pipeline's stages against plain versions over a small corpus, and on odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
from test_operators import WORD, brute_groups, pairs  # noqa: E402

from arbordf.llm import quality_knn, quality_rules, substring_dedup  # noqa: E402
from arbordf.llm.common import read_table  # noqa: E402


def plain_base(t):
    w = WORD.findall(t)
    runs = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    inside = {p for j in range(len(w) - 4) if runs[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
    return len(w) < 10 or 100 * len(inside) > 20 * len(w)


def plain_trees(trees, x):
    """Probability by walking every tree from its root."""
    total = trees.prior
    for at in trees.roots:
        while trees.feature[at] >= 0:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def plain_rules(rows, trees):
    return [(d, t) for d, t in rows if not plain_base(t or "") and plain_trees(trees, quality_rules.statistics([t or ""])[1][0]) >= 0.5]


def plain_vote(text, space):
    """Score of one text by all cosines, one after another."""
    counts = quality_knn.term_counts([text])[0]
    v = (np.log1p(counts).astype(np.float32) * space.weight) @ space.basis
    size = np.linalg.norm(v)
    if not size:
        return space.prior
    cos = [float(np.dot(v / size, x)) for x in space.vectors]
    near = sorted(range(len(cos)), key=lambda i: (-round(cos[i], 6), i))[: space.k]
    weight = [max(cos[i], 0.0) ** 4 for i in near]
    return sum(w * space.y[i] for w, i in zip(weight, near)) / sum(weight) if sum(weight) else space.prior


def plain_terms(text):
    """Counts of hashed terms by dictionaries: words without case, shapes, equal neighbours."""
    import pyarrow as pa

    from arbordf.llm.words import hash_strings

    def bucket(x, n):
        return int(hash_strings(pa.array([x], pa.large_string()))[0] % np.uint64(n))

    out, last = Counter(), None
    for w in WORD.findall(text):
        word = bucket(w.lower(), quality_knn.WORD_BUCKETS)
        shape = quality_knn._shapes(pa.array([w], pa.large_string()))[0].as_py()
        out[word] += 1
        out[quality_knn.WORD_BUCKETS + bucket(shape, quality_knn.SHAPE_BUCKETS)] += 1
        out[quality_knn.TERMS - 1] += word == last
        last = word
    return +out


def plain_cut(rows):
    """Texts without repeated passages; (doc_id, text) rows with one text per doc_id."""
    seen, out = set(), []
    for d, t in sorted(rows):
        raw = t.encode()
        _, start, end, words = substring_dedup.chunk_bounds([raw])
        spans, run = [], []
        for a, z, n in [*zip(start.tolist(), end.tolist(), words.tolist()), (0, 0, None)]:
            if n is not None and raw[a:z] in seen:
                run.append((a, z, n))
                continue
            if run and (sum(x[2] for x in run) >= 15 or sum(x[1] - x[0] for x in run) >= 200):
                spans.append((run[0][0], run[-1][1]))
            run = []
            seen.add(raw[a:z])
        kept, last = b"", 0
        for a, z in spans:
            kept, last = kept + raw[last:a], z
        out.append((d, (kept + raw[last:]).decode()))
    return out


@pytest.fixture(scope="module")
def corpus(spark, labelled, tmp_path_factory):
    """Labelled texts, copies, a shared passage, odd rows; tables in a folder."""
    docs, labels = labelled
    folder, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(8)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(80))
    more = [(2000 + i, f"{' '.join(rng.choice(words) for _ in range(40))} {passage} {' '.join(rng.choice(words) for _ in range(50))}") for i in range(6)]
    more += [(3000, None), (3001, ""), (3002, " \n"), (3003, "a b c"), (3004, " ".join(rng.choice(words) for _ in range(9000)))]
    copies = docs.filter("doc_id % 40 = 1").selectExpr("doc_id + 1000 as doc_id", "text")
    every = docs.unionByName(copies).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    every.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_rows_equal_plain_versions(spark, corpus, monkeypatch):
    docs, labels = read_table(spark, corpus, "documents"), read_table(spark, corpus, "labels")
    trees, space = quality_rules.fit(docs, labels), quality_knn.fit(docs, labels)
    rows = pairs(docs)
    plain = {"quality_rules": lambda r: plain_rules(r, trees), "quality_classifier": lambda r: [x for x in r if plain_vote(x[1] or "", space) >= 0.3], "substring_dedup": plain_cut}

    def one_of_each(r):
        groups = brute_groups(r, 5, 80)
        return [x for x in r if groups[x[0]] == x[0]]

    plain["ngram_jaccard"] = one_of_each
    written, write = [], corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    packed = corpus_pipeline.run(spark, corpus).collect()
    assert [name for name, _ in written] == [name for name, _ in corpus_pipeline.STAGES[:-1]]
    for name, now in written:
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        rows = plain[name](rows)
        assert sorted(pairs(now)) == sorted(rows), name
        assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    assert len(rows) > 200 and any(len(t) < 700 for d, t in rows if d >= 2000)
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[d, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sum(fill.values()) / 2048 + 1


def test_votes_and_terms_equal_plain_ones(spark, corpus, edge_docs):
    space = quality_knn.fit(read_table(spark, corpus, "documents"), read_table(spark, corpus, "labels"))
    texts = [t or "" for _, t in pairs(edge_docs)] + ["The THE the, the 12 x1", "ΑΒΓ αβγ é"]
    for t, row in zip(texts, quality_knn.term_counts(texts)):
        assert {i: int(n) for i, n in enumerate(row) if n} == dict(plain_terms(t))
    got = Counter((r["doc_id"], round(r["score"], 5)) for r in quality_knn.score(edge_docs, space).collect())
    assert got == Counter((d, round(plain_vote(t or "", space), 5)) for d, t in pairs(edge_docs))


def test_tree_verdicts_equal_plain_walks(spark, corpus, edge_docs):
    trees = quality_rules.fit(read_table(spark, corpus, "documents"), read_table(spark, corpus, "labels"))
    for r in quality_rules.judge(edge_docs, trees).join(edge_docs.select("doc_id", "text"), "doc_id").collect():
        if r["doc_id"] == 12:  # two texts under one id
            continue
        p = plain_trees(trees, quality_rules.statistics([r["text"] or ""])[1][0])
        assert abs(r["score"] - p) < 1e-12 and r["base_failed"] == plain_base(r["text"] or "") and r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_stages_on_odd_rows(spark, corpus, edge_docs, no_docs):
    """Nulls, repeated rows and ids, clashing columns, no rows: every stage gives its rows, all but the last the columns."""
    odd = edge_docs.unionByName(spark.createDataFrame([(1, None, "en", 1.0, True, 1, 1), (9, "é" * 900, "en", 1.0, True, 1, 1)], edge_docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        if name != "ngram_jaccard":  # test_operators has the empty table
            assert stage(spark, no_docs, corpus).count() == 0
        out = stage(spark, odd, corpus)
        got = out.collect()
        if name == "packing":
            assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
            continue
        assert out.columns == odd.columns and len(got) <= odd.count()
        if name == "substring_dedup":
            assert len(got) == odd.count() and sum(r["text"] is None for r in got) == 3
        if name == "ngram_jaccard":
            assert {0, 3, 4, 5, 6, 8, 9, 10, 11, 12, None} <= {r["doc_id"] for r in got} and not {2, 7} & {r["doc_id"] for r in got}


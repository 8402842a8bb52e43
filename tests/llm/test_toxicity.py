"""Token odds, tail law and scores against plain versions."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from arbordf.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub(r"^[^\w]+|[^\w]+$", "", w.lower()) for w in WORD.findall(text)]


def path(token):
    return [("prefix", token[:k]) for k in range(toxicity.SHORTEST, min(len(token), toxicity.LONGEST) + 1)] + ([("whole", token)] if token else [])


def plain_odds(rows):
    """token -> log-odds, from (text, label) rows by dictionaries."""
    n, root = defaultdict(lambda: [0, 0]), [0, 0]
    for text, y in rows:
        for t in set(tokens(text)):
            root[1 - y] += 1
            for node in path(t):
                n[node][1 - y] += 1
    start = (root[0] + 0.5) / (sum(root) + 1)

    def odds(token):
        share = start
        for node in path(token):
            if sum(n[node]) > 1:
                share = (n[node][0] + toxicity.PRIOR * share) / (sum(n[node]) + toxicity.PRIOR)
        return math.log(share / (1 - share)) - math.log(start / (1 - start))

    return odds


def test_odds_equal_plain_counts(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [(r["text"], y[r["doc_id"]]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    odds = plain_odds(rows)
    some = sorted({t for text, _ in rows for t in tokens(text)})[:400] + ["fiend", "fiendish", "unseen", "x", ""]
    assert np.allclose(model.token_scores(pa.array(some)), [odds(t) for t in some])
    assert odds("fiend") > 3 and abs(odds("zzz")) < 1e-9


def test_scores_equal_a_plain_scan(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs.limit(60), model).join(docs, "doc_id").collect():
        seen, best, run = defaultdict(int), [], []
        for t in tokens(r["text"]):
            s = float(model.token_scores(pa.array([t]))[0]) - toxicity.DRIFT
            if s > 0:
                seen[t] += 1
                s /= seen[t]
            run.append(s)
        while run:  # maximal segments by their definition
            top = max(((sum(run[i:j]), -(j - i), i, j) for i in range(len(run)) for j in range(i + 1, min(i + 40, len(run)) + 1)), default=(0,))
            if top[0] <= 0:
                break
            best.append(top[0])
            run = [x if not top[2] <= i < top[3] else -1e9 for i, x in enumerate(run)]
        evidence, found = model.evidence(sorted(best), len(tokens(r["text"])))
        assert r["n_passages"] == found and math.isclose(r["evidence"], evidence, rel_tol=1e-6, abs_tol=1e-9)


def test_tail_law_is_recovered():
    rng = np.random.default_rng(1)
    n = rng.integers(50, 5000, 20000)
    k, rate = 0.01, 1.5
    best = np.maximum(np.log(k * n / -np.log(rng.random(20000))) / rate, 0)
    got_k, got_rate = toxicity.extreme_law(best, n)
    assert abs(got_rate - rate) < 0.1 and abs(math.log(got_k / k)) < 0.4
    model = toxicity.Model(k=got_k, rate=got_rate)
    assert 0.007 < np.mean([model.tail(b, m) < math.log(toxicity.P_AT) for b, m in zip(best, n)]) < 0.013


def test_clean_texts_are_left_alone(spark):
    """Held-out clean texts have a significant passage about as often as P_AT says; toxic ones nearly always."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(3000):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(20, 300))], int(i % 8 == 0)
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["vileone", "vilesort", "vileness", "grim"])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    seen = [(r["doc_id"] % 8 == 0, r["n_passages"] > 0) for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([p for toxic, p in seen if not toxic]) <= 0.03
    assert np.mean([p for toxic, p in seen if toxic]) >= 0.95

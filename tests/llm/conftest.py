import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(4000)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = prose(200)
    near = base.split()
    near[100] = "changed"
    passage = prose(70)
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (7, "ONE two"), (8, prose(20000)),
        (9, prose(60) + " " + passage + " " + prose(60)), (10, prose(80) + "\n" + passage + "\n" + prose(40)), (None, base), (11, "x" * 3000), (12, prose(300)), (12, None),
    ]
    rows += [rows[13]]
    return spark.createDataFrame([(i, t, "en", 1.5, True, 7, 3) for i, t in rows], "doc_id long, text string, lang string, score double, kept boolean, start int, n_words int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def labelled(spark):
    """Texts in which quality and toxicity are plain to see, and their labels."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(60)]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            text = [w.upper() + "!!#" for w in text]
        if toxic:
            text[rng.randrange(60)] = text[rng.randrange(60)] = "fiend"
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (900, None, None)], "doc_id long, quality int, toxic int")

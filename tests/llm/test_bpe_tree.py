import base64
import hashlib
import random
import struct

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from arbordf.llm.bpe_tree import RankCoder, TextCoder, read_ranks  # noqa: E402


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_library_on_long_pieces(ranks, library):
    coder, rng = RankCoder(ranks), random.Random(3)
    for alphabet in ("ab", "aeinrst", "=", " \n\t", "abcdefghijklmnopqrstuvwxyz", "éèàß漢字"):
        for _ in range(100):
            piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300)))
            assert coder.encode_piece(piece.encode()) == [i for m in [piece] for i in library._core_bpe.encode_single_piece(m.encode())]


def test_texts_equal_library_and_round_trip(ranks, library):
    coder, rng = TextCoder(RankCoder(ranks), public_tokenizers.PATTERN), random.Random(4)
    alphabet = "ab C'sré.,12 \n\t    \x1c\x85Ö漢́ßΣİ\x1f"
    texts = ["", " ", "\n\n", "a", " a  b ", "x" * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for first, ids, bounds in coder.parts.blocks(texts, 4000):
        for i in range(len(bounds) - 1):
            text = texts[first + i]
            own = ids[bounds[i] : bounds[i + 1]].tolist()
            assert own == library.encode_ordinary(text)
            assert coder.decode(own) == text.encode()


def test_decode_concatenates(ranks):
    coder = RankCoder(ranks)
    data = bytes(range(256)) * 3
    assert coder.decode(coder.encode_piece(data)) == data
    assert coder.decode([]) == b""


def test_digests_equal_library(spark, edge_docs, library):
    """The query's columns by doc_id, null text among them; its path joins halves and decodes up the tree."""
    from arbordf.llm import bpe_tree

    got = bpe_tree.text_digests(edge_docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = []
    for r in edge_docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (struct.pack(f"<{len(ids)}I", *ids), (r["text"] or "").encode())]
        want.append((r["doc_id"], len(ids), *digests))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_texts_go_through_the_tree(ranks):
    calls = []

    class Counting(RankCoder):
        def join(self, left, right):
            calls.append("join")
            return super().join(left, right)

        def merge(self, piece):
            calls.append(len(piece))
            return super().merge(piece)

    coder = Counting(ranks)
    assert coder.encode_piece(b" unwordlikewordness") and calls.count("join") >= 4
    assert max(c for c in calls if c != "join") < len(b" unwordlikewordness")


def test_rank_file(tmp_path):
    p = tmp_path / "r"
    p.write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"aa") + b" 1\n")
    assert read_ranks(str(p)) == {b"a": 0, b"aa": 1}
    assert RankCoder(read_ranks(str(p))).encode_piece(b"aaaaa") == [1, 1, 0]

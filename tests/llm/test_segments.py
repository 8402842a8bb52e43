"""Parts of texts: where they are cut, and ids against the library's plain call."""

import random

import pytest

from arbordf.llm import segments

public_tokenizers = pytest.importorskip("public_tokenizers")


def parts(split, texts):
    got, bounds = split(texts)
    got = got.to_pylist()
    return [got[a:z] for a, z in zip(bounds, bounds[1:])]


def test_words_are_cut_off_their_marks():
    """Words beyond ASCII and marks other than .,! too, so that fewer parts are distinct."""
    got = parts(segments.split_words, ["", "Été, l'été.\nété***", "ж. Ж;", "x", "İ."])
    assert got == [[], ["Été", ",", " l", "'été", ".", " été", "***"], ["ж", ".", " Ж", ";"], ["x"], ["İ."]]


def test_runs_of_ascii_white_space_are_cut_with_all_texts(monkeypatch):
    """Only texts with white space beyond ASCII in a row are cut one by one."""
    texts = ["Été, l'été.\nfin***", "", " a  b\n\n c\td \n", "\n", "  ", "a\x1fb"]
    want = [["Été", ",", " l", "'été", ".", "\n", "fin", "***"], [], [" a", " ", " b", "\n\n", " c\td", " \n"], ["\n"], ["  "], ["a\x1fb"]]
    with monkeypatch.context() as m:
        m.setattr(segments, "byte_level_parts", None)
        assert parts(segments.split_byte_level, texts) == want
    assert parts(segments.split_byte_level, [*texts, "a\u3000\u2003b", "c"]) == [*want, ["a", "\u3000", "\u2003b"], ["c"]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("ordinary", [False, True])
def test_ids_equal_library(name, ordinary):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    alphabets = [
        "ab C'sré.,12 \n\t    \x1c\x85Ö漢\u0301ßΣİ\x1f", "the don't we'll I'm. é'ÉÀ×÷÷.×,\n\n  \r\n$$$***", "á.≠=\u0338<>’— \u3000\xa0\u2003  b\u200b ", "жЖё.ґ,Ω; ѣ҂.",
        " \n", "A.B,c!d?e;f:g'h\"i(j)", "<|endoftext|> <|startoftext|>aAé.", "Åẞﬁǅ.ŉ,ſ! \u0345ᾳ",
    ]
    texts = ["", " ", ".", "a.", "é.", "\n", " \n", "a\n", "a \n", "", "İ.", "x" * 3000]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(0, 25))) for a in rng.choices(alphabets, k=4000)]
    encoder, library = segments.library_encoder(public_tokenizers.path(name), ordinary), Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = ordinary
    for first, ids, bounds in encoder.blocks(texts, 3000):
        for i in range(len(bounds) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(texts[first + i], add_special_tokens=False).ids

"""Blocks of texts as coded words: Arrow splits and finds distinct words, numpy works on the codes.

A word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_runs

SPACES = " \t\n\x0b\x0c\r"
_TO_BLANK = {ord(c): " " for c in SPACES}
#: Bytes handled at once (a longer text makes a block of its own). Bounds memory, never changes a result.
BLOCK_CHARS = 4 << 20


def lower_ascii(texts: list[str]) -> list[str]:
    """A-Z in lower case, all else as it is."""
    table = {c: c + 32 for c in range(65, 91)}
    return [t.lower() if t.isascii() else t.translate(table) for t in texts]


class Words:
    """``distinct`` words of a block (Arrow strings), ``codes`` of all words in order, ``bounds`` of each text."""

    def __init__(self, texts: list[str]):
        plain = [t.replace("\n", " ") for t in texts]
        plain = [t.translate(_TO_BLANK) if "\t" in t or "\r" in t or "\x0b" in t or "\x0c" in t else t for t in plain]
        parts = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), parts.offsets.to_numpy()
        empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
        if empty >= 0:
            real = codes != empty
            bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
            codes = codes[real]
        self.distinct, self.codes, self.bounds = coded.dictionary, codes, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of one value per word."""
        return segment_sums(values, self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, the same in every process."""
        return hash_strings(self.distinct)


def hash_strings(values: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.result_type(values.dtype, np.int64)), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, from the words' hashes in order (runs may cross texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out ^ h[i : i + n]) + np.uint64(i + 1)
    return out


def blocks(texts, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) for runs of texts (an Arrow array or a list) of limited size; null is empty."""
    return text_runs(texts, chars)

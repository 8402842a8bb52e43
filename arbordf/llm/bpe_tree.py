"""Byte-level BPE encoding and decoding as a reduction over a tree.

``RankCoder`` holds a rank table (bytes -> rank). A byte string is encoded by halves down to single bytes; inner nodes join
the two halves' ids. A join re-encodes the bytes of a window of ids around the border by the merge loop and lets the
window grow until both of its edges are stable. Windows are a few bytes as a rule, so the loop never sees long input.

Why that suffices: a sequence of ids is the encoding of its bytes exactly if every id encodes itself and every two
neighbours (a, b) are *compatible*, i.e. bytes(a) + bytes(b) encode to [a, b]; merging takes the lowest rank first, and
a merge across a border of two ids in the full string would also happen in the string of these two alone. Ids outside
the window come from an encoding of the half, so they are compatible with each other; ids within it come from one run of
the merge loop; the two edges are tested. Hence no id outside can change any more. Ids that no merge sequence reaches
would break the first condition; a piece that is itself a token is looked up before the merge loop, as rank-based
coders do, and ids of unreachable tokens are never compatible with anything, which only widens windows.

Decoding maps ids to byte strings and concatenates neighbours up the tree (``RankCoder.decode``).

Whole texts: each match of the pattern is encoded separately, and distinct parts of texts once per worker (see
``segments``). Null text counts as empty: no ids, the hash of no bytes. Repeated rows, null ids and extra columns are
passed through or ignored; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .segments import PartEncoder, pack, split_byte_level


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a line per token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankCoder:
    #: Neighbours joined at once when decoding.
    FAN = 16
    #: Bytes of a half that is remembered.
    SHORT = 8

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pair = lru_cache(maxsize=400_000)(self._pair)
        self.short = lru_cache(maxsize=400_000)(self._tree)

    def merge(self, piece: bytes) -> list[int]:
        """The merge loop: join the neighbours of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while pairs:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])
        return [ranks[p] for p in parts]

    def _pair(self, a: int, b: int) -> list[int] | None:
        """Ids of the bytes of two tokens in a row; None if the two stay."""
        out = self.merge(self.tokens[a] + self.tokens[b])
        return None if out == [a, b] else out

    def compatible(self, a: int, b: int) -> bool:
        return self.pair(a, b) is None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenated bytes of two encodings."""
        if not left or not right:
            return left or right
        inner = self.pair(left[-1], right[0])
        if inner is None:
            return left + right
        a, b = 1, 1  # ids of each side in the window
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            if a > 1 or b > 1:
                inner = self.merge(self.bytes_of(left[len(left) - a :]) + self.bytes_of(right[:b]))
            left_ok = a == len(left) or self.compatible(left[-a - 1], inner[0])
            right_ok = b == len(right) or self.compatible(inner[-1], right[b])
            if left_ok and right_ok:
                return left[: len(left) - a] + inner + right[b:]
            a, b = (a if left_ok else 2 * a), (b if right_ok else 2 * b)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pattern match."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._tree(piece)

    def _tree(self, piece: bytes) -> list[int]:
        """The two halves' ids, joined; halves of a few bytes are remembered."""
        if len(piece) < 2:
            return [self.ranks[piece]] if piece else []
        at = 1 << (len(piece) - 1).bit_length() - 1  # so that the halves of a run of one character are cut alike
        half = self.short if len(piece) <= 2 * self.SHORT else self._tree
        return self.join(half(piece[:at]), half(piece[at:]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree, ``FAN`` neighbours at a time."""
        level = list(map(self.tokens.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[i : i + self.FAN]) for i in range(0, len(level), self.FAN)]
        return level[0] if level else b""


class TextCoder:
    """Encodes blocks of whole texts under a pattern and decodes ids."""

    def __init__(self, coder: RankCoder, pattern: str):
        import regex

        matches, one = regex.compile(pattern).findall, lru_cache(maxsize=100_000)(coder.encode_piece)

        def encode(parts: list[str]) -> list[bytes]:
            return [pack([i for m in matches(p) for i in one(m.encode())]) for p in parts]

        self.parts, self.decode = PartEncoder(split_byte_level, encode), coder.decode


_LOADED: dict[tuple[str, str], TextCoder] = {}


def text_coder(path: str, pattern: str) -> TextCoder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = TextCoder(RankCoder(read_ranks(path)), pattern)
    return _LOADED[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary, decoded binary) for every row of ``docs``: packed ids and the bytes they decode to."""
    return _coded(docs, path, pattern, "doc_id long, n_tokens long, ids binary, decoded binary", lambda raw: raw, pa.binary())


def text_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``; no ids leave the task."""
    return _coded(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda raw: hashlib.sha256(raw).hexdigest(), pa.string())


def _coded(docs: DataFrame, path: str, pattern: str, schema: str, out, kind) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def code(it):
        coder = text_coder(path, pattern)
        for b in it:
            doc_ids, texts = b.column(0), b.column(1)
            for first, ids, bounds in coder.parts.blocks(texts):
                raw, n = ids.astype("<u4").tobytes(), len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(first, n),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array([out(raw[4 * bounds[i] : 4 * bounds[i + 1]]) for i in range(n)], kind),
                        pa.array([out(coder.decode(ids[bounds[i] : bounds[i + 1]].tolist())) for i in range(n)], kind),
                    ],
                    names=names,
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(code, schema)


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return text_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

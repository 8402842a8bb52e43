"""Exact, memoised encoding of whole texts, part by part.

A pre-tokeniser never lets one match cross certain places. Cutting a text only there and encoding the parts one by one
gives the ids of the whole text, and the parts (words, mostly) repeat so often that a worker encodes most of them once.

* Byte-level pattern ``... ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: no match holds a non-space
  followed by white space, so a cut before a single blank, or on either side of a single newline between two
  non-spaces, is safe, as is one between a letter or digit and an ASCII mark. Of a run ``w`` of two or more white-space characters the pattern takes ``w[:-1]`` as one match
  when text follows, and all of ``w`` at the end of the text.
* Word pattern with white space removed: no match holds white space, so every blank or newline is a safe cut, and so is
  one between a letter or digit and an ASCII mark.

Splitting and gathering ids is done by numpy over the bytes of a block of texts, finding distinct parts by Arrow; Python
touches each distinct part of a block once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa

from .common import text_runs

#: Unicode White_Space, as the tokenizers' patterns mean it (Python's own class also holds U+001C to U+001F).
_RUN = re.compile("[\t-\r \x85\xa0  -     　]{2,}")
_COMBINING = re.compile("[\u0300-\u036f]")
#: Parts a worker's memo may hold; beyond it the memo starts anew. Bounds memory, never changes a result.
MEMO_PARTS = 700_000
#: Bytes encoded at once (a longer text makes a block of its own). Bounds memory, never changes a result.
BLOCK_CHARS = 4 << 20
#: Classes of bytes in UTF-8: ASCII white space, letters and digits, and marks; lead bytes of U+0100 to U+017F and U+0400 to
#: U+047F (letters all), and of characters among which is white space.
_SPACE, _LETTER, _MARK, _LEAD, _WIDE = np.zeros((5, 256), dtype=bool)
_SPACE[[*range(9, 14), 32]] = True
_LETTER[[b for b in range(128) if chr(b).isalnum()]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LEAD[[0xC4, 0xC5, 0xD0, 0xD1]] = True
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def pack(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    assert a.itemsize == 4
    return a.tobytes()


def byte_level_parts(text: str) -> list[str]:
    """Parts of a text whose separate encodings make up the encoding of the text (see the module's notes)."""
    out, at, lead = [], 0, ""
    for m in _RUN.finditer(text):
        out += _single(lead + text[at : m.start()])
        if m.end() == len(text):
            return [*out, m.group()]
        out.append(m.group()[:-1])
        lead, at = m.group()[-1], m.end()
    return out + _single(lead + text[at:])


def _single(text: str) -> list[str]:
    """Parts of a text in which no two white-space characters are adjacent."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        head, *tail = line.split(" ")
        out.append(head)
        out += [" " + x for x in tail]
    return [x for x in out if x]


def _places(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the place where each text begins (one more entry at the end)."""
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])


def _cut_marks(data: np.ndarray, cut: np.ndarray) -> None:
    """Cut between a letter or digit and the ASCII mark after it: no match holds the two in a row."""
    marks = np.flatnonzero(_MARK[data])
    marks = marks[marks > 1]
    last, lead = data[marks - 1], data[marks - 2]
    # without U+00D7 and U+00F7, which are no letters, and U+0130, whose small form ends in a combining mark
    letter = (_LEAD[lead] & ((lead != 0xC4) | (last != 0xB0))) | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7))
    cut[marks[_LETTER[last] | ((last >= 0x80) & letter)]] = True


def _parts(data: np.ndarray, starts: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bytes between cuts as strings, without a copy, and the place where each text's parts begin."""
    cut[starts] = True
    offsets = np.flatnonzero(cut)
    parts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    return parts, np.searchsorted(offsets, starts)


def _with_wide_runs(texts: list[str], data: np.ndarray, starts: np.ndarray) -> list[int]:
    """Texts that hold white space beyond ASCII and white space in a row."""
    at = np.flatnonzero(_WIDE[data])
    lead, second = data[at], data[at + 1]
    wide = ((lead == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((lead == 0xE1) & (second == 0x9A)) | ((lead == 0xE2) & (second <= 0x81)) | ((lead == 0xE3) & (second == 0x80))
    return [i for i in np.unique(np.searchsorted(starts, at[wide], side="right") - 1).tolist() if _RUN.search(texts[i])]


def split_byte_level(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Parts of all texts, and the place where each text's parts begin (one more entry at the end)."""
    data, starts = _places([t.encode() for t in texts])
    cut = np.zeros(len(data) + 1, dtype=bool)
    _cut_marks(data, cut)
    at = np.flatnonzero(_SPACE[data])
    newline = data[at] == 10
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[starts] = True
    ends = begins[at + 1]
    joined = (np.diff(at, append=-1) == 1) & ~ends  # to the next white space
    follows = np.concatenate([[False], joined])[:-1]
    # a blank or newline on its own, the first of a run, and the last of a run that does not end the text
    cut[at[np.where(follows, ~joined & ~ends, joined | newline | (data[at] == 32))]] = True
    cut[at[newline & ~joined] + 1] = True
    parts, bounds = _parts(data, starts, cut)
    lists = {i: byte_level_parts(texts[i]) for i in _with_wide_runs(texts, data, starts)}
    if not lists:
        return parts, bounds
    chunks, sizes, last = [], np.diff(bounds), 0
    for i, own in lists.items():
        chunks += [parts.slice(bounds[last], bounds[i] - bounds[last]), pa.array(own, pa.large_string())]
        sizes[i], last = len(own), i + 1
    chunks.append(parts.slice(bounds[last]))
    return pa.concat_arrays(chunks), np.concatenate([[0], np.cumsum(sizes)])


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, each with the blank or newline before it (as a blank), and where each text's words begin.

    For a vocabulary that composes characters, then puts them in lower case. ASCII letters may be put in lower case
    first unless a combining mark follows somewhere: the composed form of a capital need not have a small twin.
    """
    raw = [x if (b"\xcc" in x or b"\xcd" in x) and _COMBINING.search(t) else x.lower() for t, x in zip(texts, (t.encode() for t in texts))]
    data, starts = _places([x.replace(b"\n", b" ") for x in raw])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[:-1] = data == 32
    _cut_marks(data, cut)
    return _parts(data, starts, cut)


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenate the slices ``pool[s : s + n]``."""
    ends = np.cumsum(sizes)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class PartEncoder:
    """Texts to ids through ``split`` (texts to parts) and ``encode`` (parts to packed ids, each part on its own)."""

    def __init__(self, split: Callable, encode: Callable[[list[str]], list[bytes]], limit: int = MEMO_PARTS, whole: Callable[[str], bool] | None = None):
        """``whole`` tells texts that must not be cut: they are encoded at once and not remembered."""
        self.split, self.encode, self.limit, self.whole = split, encode, limit, whole
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, dtype=np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64)

    def _learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            packed = self.encode(some)
            ids = np.frombuffer(b"".join(packed), dtype="<u4")
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            self.pool = _room(self.pool, self.used + len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
            n = len(self.index)
            self.starts, self.sizes = _room(self.starts, n + len(some)), _room(self.sizes, n + len(some))
            self.starts[n : n + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(some)] = sizes
            self.used += len(ids)
            self.index.update(zip(some, range(n, n + len(some))))

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids begin (one more entry at the end)."""
        uncut = [i for i, t in enumerate(texts) if self.whole(t)] if self.whole else []
        if not uncut:
            return self._encode_parts(texts)
        rest = list(texts)
        for i in uncut:
            rest[i] = ""
        ids, bounds = self._encode_parts(rest)
        own = [np.frombuffer(x, dtype="<u4") for x in self.encode([texts[i] for i in uncut])]
        sizes = np.diff(bounds)
        sizes[uncut] = [len(x) for x in own]
        at = bounds[uncut]
        pieces = [x for a, z, own_ids in zip([0, *at], at, own) for x in (ids[a:z], own_ids)]
        return np.concatenate([*pieces, ids[at[-1] :]]), np.concatenate([[0], np.cumsum(sizes)])

    def _encode_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, bounds = self.split(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        if len(new) and len(self.index) + len(new) > self.limit:
            self._reset()
            new = np.arange(len(distinct))
        known[new] = np.arange(len(self.index), len(self.index) + len(new))
        self._learn([distinct[i] for i in new.tolist()])
        at = known[coded.indices.to_numpy()] if len(parts) else np.empty(0, np.int64)
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.pool, self.starts[at], sizes), ends[bounds]

    def blocks(self, texts, chars: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first text, ids, bounds) for runs of texts (an Arrow array or a list) of limited size."""
        for start, some in text_runs(texts, chars or BLOCK_CHARS):
            yield start, *self.encode_block(some)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])


def byte_alphabet() -> dict[int, str]:
    """The byte-level vocabularies' character for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LOADED: dict[tuple[str, bool], PartEncoder] = {}


def library_encoder(path: str, ordinary: bool = False) -> PartEncoder:
    """Encoder for a ``tokenizers`` JSON file, one per Python worker.

    The string of a special token in a text becomes its special id, as the library's plain call has it, or with
    ``ordinary`` the pieces of ordinary text. A text with such a string in any case of letters goes to the library whole.
    A part of letters only, which normalising would not change, is one match of the pattern: the library's model
    takes it at once. All other parts go through the library's whole chain.
    """
    if (path, ordinary) not in _LOADED:
        import json
        import os
        from unicodedata import is_normalized

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = ordinary
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        byte_level = settings["pre_tokenizer"]["type"] == "ByteLevel"
        added = [re.escape(x["content"]) for x in settings.get("added_tokens", [])]
        whole = re.compile("|".join(added), re.IGNORECASE).search if added and not ordinary else None
        table, model = byte_alphabet(), t.model
        chars = np.array([ord(table[b]) for b in range(256)], dtype="<u4")

        def encode(parts: list[str]) -> list[bytes]:
            bare = [p.removeprefix(" ") for p in parts]
            if byte_level:
                one_match = [p.isalpha() for p in bare]
            else:
                one_match = [p.isalpha() and p == p.lower() and (p.isascii() or is_normalized("NFC", p)) for p in bare]
            # all at once to the vocabulary's characters; no part of letters holds a newline
            own = "\n".join(compress(parts if byte_level else bare, one_match)).encode()
            own = chars[np.frombuffer(own, np.uint8)].tobytes().decode("utf-32-le").split(table[10]) if own else []
            tokens = list(map(model.tokenize, own))
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))).tolist()
            ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), "<u4").tobytes()
            whole_chain = t.encode_batch_fast([p for p, one in zip(parts, one_match) if not one], add_special_tokens=False)
            at, rest = zip([0, *ends], ends), iter(whole_chain)
            out = []
            for one in one_match:
                if one:
                    a, z = next(at)
                    out.append(ids[4 * a : 4 * z])
                else:
                    out.append(pack(next(rest).ids))
            return out

        _LOADED[path, ordinary] = PartEncoder(split_byte_level if byte_level else split_words, encode, whole=whole)
    return _LOADED[path, ordinary]

"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the bytes of a text. A chunk ends at a word whose hash is the least among its ``RADIUS``
neighbours on either side, so borders depend on nearby bytes alone: an insertion moves borders near it and no others,
and a passage shared by two texts is cut alike in both but for its edges. Chunks hold about ``2 * RADIUS + 1`` words on
average and ``MOST_WORDS`` at most.

A word of more than ``LONG_WORD`` bytes (text without blanks) is cut into pieces by the same rule over the hashes at the
ends of its characters, within ``PIECE_RADIUS``; pieces then count as words do for borders, but only the last as a word.
A stretch that cycles through up to ``RADIUS`` words has no least hash: it is cut at both ends and every ``CYCLE`` words
from its first least hash, so it is cut alike in any context. A stretch of one repeated character within a word is cut at its ends
only, and is one piece.

A chunk found before, in an earlier text or place (order: doc_id, hash of the text, place), repeats. A run of repeating
chunks in a row with at least ``least_words`` words or ``least_bytes`` bytes is a repeated passage; it is removed and the
first occurrence stays. Shorter runs are left alone, as a few frequent words in a row repeat by chance; ``least_words`` of
1 finds every run.

A text is known by doc_id and the 64-bit hash of the text (``text_key``), from chunking to removal: unlike texts of one
doc_id are texts of their own, equal rows are one text and stay alike. A null text has no chunks and stays null; a null
doc_id never repeats and is never changed. An empty table has no passages. Extra columns stay as they are.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table
from .words import blocks, mix

RADIUS, WINDOW_BYTES, LEAST_WORDS, LEAST_BYTES = 4, 16, 15, 200
LONG_WORD, PIECE_RADIUS, MOST_WORDS = 64, 2, 96
#: Ties in a row that make a stretch, and the words of its chunks: a multiple of every cycle up to RADIUS.
STRETCH, CYCLE = 16, 24
#: The gear table: a fixed pseudo-random 32-bit value for each byte.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _text_key() -> Column:
    return F.xxhash64("text")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash ``h = 2 * h + GEAR[byte]`` of the last ``WINDOW_BYTES`` bytes, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW_BYTES:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def borders(value: np.ndarray, owner: np.ndarray, radius: int, cycle: int = 0) -> np.ndarray:
    """Whether a border follows each place: at least hashes within ``radius`` places of the same owner (ascending), at the
    ends of stretches of ties, every ``cycle`` places within these, and at the last place of an owner."""
    # places of different owners stand more than radius apart, so that neighbours never belong to another one
    changes = np.flatnonzero(np.diff(owner)) + 1
    place = np.arange(len(value)) + radius
    place += radius * np.searchsorted(changes, np.arange(len(value)), side="right")
    line = np.full(place[-1] + radius + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    line[place] = value
    cut, tied = np.ones(len(value), dtype=bool), np.zeros(len(value) + 2, dtype=bool)
    for k in range(1, radius + 1):
        cut &= (value < line[place - k]) & (value <= line[place + k])
        tied[1:-1] |= value == line[place - k]
    turns = np.flatnonzero(tied[1:] != tied[:-1]).reshape(-1, 2)
    for start, end in turns[turns[:, 1] - turns[:, 0] >= STRETCH].tolist():
        cut[start:end] = False
        cut[[start - 1, end - 1]] = True  # the first place of an owner is never tied
        if cycle:
            # counted from a least hash, so that the cycle's beginning does not matter
            cut[start + int(value[start : start + radius].argmin()) : end : cycle] = True
    cut[changes - 1] = True
    cut[-1] = True
    return cut


def pieces(data: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the pieces of long words but the last ones, which are the words' own ends."""
    long = np.flatnonzero(ends - begins > LONG_WORD)
    if not len(long):
        return np.empty(0, dtype=np.int64)
    sizes = (ends - begins)[long]
    at = np.repeat(begins[long] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    word = np.repeat(long, sizes)
    whole = (data[at + 1] & 0xC0) != 0x80  # the next byte begins a character
    at, word = at[whole], word[whole]
    found = at[borders(mix(hashes[at].astype(np.uint64)) >> np.uint64(1), word, PIECE_RADIUS)] + 1
    return np.setdiff1d(found, ends[long])


def chunk_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, words) of every chunk of a block of texts; start and end count bytes within the text."""
    pad = b" " * WINDOW_BYTES
    data = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    space = _SPACE[data]
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    at = WINDOW_BYTES + np.cumsum(sizes + WINDOW_BYTES) - sizes - WINDOW_BYTES
    if not len(begins):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    hashes = gear_hashes(data)
    more = pieces(data, hashes, begins, ends)
    is_word = np.ones(len(ends), dtype=np.int64)
    if len(more):
        where = np.searchsorted(ends, more)
        begins, ends, is_word = np.sort(np.concatenate([begins, more])), np.insert(ends, where, more), np.insert(is_word, where, 0)
    owner = np.searchsorted(at, begins, side="right") - 1
    cut = borders(mix(hashes[ends - 1].astype(np.uint64)) >> np.uint64(1), owner, RADIUS, CYCLE)
    last = np.flatnonzero(cut)
    for end, size in zip(last.tolist(), np.diff(last, prepend=-1).tolist()):
        if size > MOST_WORDS:
            cut[end - size + MOST_WORDS : end : MOST_WORDS] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    text = owner[last]
    return text, begins[first] - at[text], ends[last] - at[text], np.add.reduceat(is_word, first)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, seq, start, end (bytes), words and a 128-bit digest (hi, lo) of every chunk."""

    def cut(it):
        for b in it:
            for first, some in blocks(b.column(1)):
                raw = [t.encode() for t in some]
                text, start, end, words = chunk_bounds(raw)
                digest = b"".join(xxhash.xxh3_128_digest(raw[t][a:z]) for t, a, z in zip(text.tolist(), start.tolist(), end.tolist()))
                halves = np.frombuffer(digest, dtype="<i8").reshape(-1, 2)
                seq = np.arange(len(text)) - np.searchsorted(text, text)
                own = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(own), b.column(2).take(own), *(pa.array(x.astype(np.int32)) for x in (seq, start, end, words)), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    names=["doc_id", "text_key", "seq", "start", "end", "words", "hi", "lo"],
                )

    known = docs.select("doc_id", "text", _text_key().alias("text_key")).filter("doc_id is not null and text is not null")
    return known.mapInArrow(cut, "doc_id long, text_key long, seq int, start int, end int, words int, hi long, lo long")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every repeated passage: doc_id, text_key, start, end (bytes of the text), words, chunks, first_doc_id (a document that
    holds the first occurrence of its first chunk) and copies (occurrences of its most frequent chunk)."""
    # cut twice rather than written once: cutting is cheap and always gives the same chunks
    cut = chunks(docs)
    seen = cut.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "text_key", "seq")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    place = F.struct("doc_id", "text_key", "seq")
    again = cut.join(seen, ["hi", "lo"]).filter(place != F.col("first")).select("doc_id", "text_key", "seq", "start", "end", "words", F.col("first.doc_id").alias("first_doc"), "n")
    # chunks in a row share (place - rank); equal rows have equal chunks, of which one stays
    run = (F.col("seq") - F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("seq"))).alias("run")
    runs = again.dropDuplicates(["doc_id", "text_key", "seq"]).select("*", run).groupBy("doc_id", "text_key", "run")
    passages = runs.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.count("*").alias("chunks"),
        F.min(F.struct("seq", "first_doc"))["first_doc"].alias("first_doc_id"), F.max("n").alias("copies"), F.sum(F.col("end") - F.col("start")).alias("bytes"),
    )
    return passages.filter((F.col("words") >= least_words) | (F.col("bytes") >= least_bytes)).drop("run", "bytes")


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the passages, columns as they were; n_chars, where there, counts the characters left.

    Passages are taken out of the rows of their doc_id and text_key; null texts and null doc_ids stay as they are."""
    names, at = docs.columns, docs.columns.index("text")
    spans = passages.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_spans")
    joined = docs.withColumn("_own", F.when(F.col("text").isNotNull(), _text_key()))
    joined = joined.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("_own") == F.col("_key")), "left").select(*names, "_spans")

    def strip(it):
        for b in it:
            texts = b.column(at).to_pylist()
            for i, s in enumerate(b.column(len(names)).to_pylist()):
                if s:
                    raw, kept, last = texts[i].encode(), [], 0
                    for x in s:
                        kept.append(raw[last : x["start"]])
                        last = x["end"]
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            columns = [b.column(c) for c in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at_n = names.index("n_chars")
                columns[at_n] = pa.array([None if t is None else len(t) for t in texts], columns[at_n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(strip, docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))

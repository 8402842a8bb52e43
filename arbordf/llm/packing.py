"""Packing of token documents into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; the remainders are packed longest first, each into the open window
with the least room that still holds it. Windows with equal room are interchangeable, so the whole corpus is packed
exactly from its histogram of remainder lengths: at most ``window`` numbers reach the driver, at any corpus size. A
segment tree indexed by remaining room finds the tightest room in use. The driver's result is a list of runs ("pieces of
length L with ranks a to b go k at a time into windows from w on"), and every piece looks its place up by its rank among
the pieces of its length. Ranks come from counts per writing task and length, so no length, however frequent, is dealt
to one task.

Null texts count as empty, and an empty text is a piece of one token (the end id). Repeated rows are packed each on its
own; null doc_ids stay null; extra columns are ignored; an empty table gives no pieces. The string of a special token in
a text becomes that token's id, as the library's plain call has it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .segments import library_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"


class RoomTree:
    """Segment tree over rooms 0..capacity; says which is the least room of at least n that some window has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.used = np.zeros(2 * self.leaves, dtype=bool)

    def set(self, room: int, used: bool) -> None:
        i = room + self.leaves
        self.used[i] = used
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = n + self.leaves
        if self.used[i]:
            return n
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts[length]`` pieces of each length into windows, longest first, each into the tightest open window.

    Returns runs (length, first rank, pieces, first window, pieces per window, offset): the i-th piece of a run lies in
    window ``first window + i // per`` at ``offset + (i % per) * length``. Equal to placing piece by piece, where a
    piece that fits twice into the tightest window puts the next of its length there too.
    """
    tree, open_, runs, windows = RoomTree(window), defaultdict(list), [], 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_[room]:
                tree.set(room, True)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} tokens does not fit a window of {window}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = window, windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, window - room))
                keep(room - per * length, first, full)
                rank += full * per
                left -= full * per
            if left and full < n:  # fewer than ``per`` are left: one window takes them
                runs.append((length, rank, left, first + full, per, window - room))
                keep(room - left * length, first + full, 1)
                full, left = full + 1, 0
            keep(room, first + full, n - full)
    return runs


def cut_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int = 1, block_chars: int | None = None) -> DataFrame:
    """Tokenise (doc_id, text) and cut each document into full windows and a remainder; ranks count per task and length.

    ``block_chars`` bytes are encoded at once (default: the encoder's own bound; a longer text makes a block of its own):
    fewer need less of a worker's memory and more time, the pieces are the same."""

    def cut(it):
        from pyspark import TaskContext

        encoder, task, ranks = library_encoder(tokenizer), TaskContext.get().partitionId(), [0] * (window + 1)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for b in it:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1)
            for first, ids, bounds in encoder.blocks(texts, block_chars):
                raw, rows = ids.astype("<u4").tobytes(), []
                for i in range(len(bounds) - 1):
                    own = raw[4 * bounds[i] : 4 * bounds[i + 1]] + end
                    n = len(own) // 4
                    for at in range(0, n, window):
                        size = min(window, n - at)
                        rows.append((doc_ids[first + i], at, size, zlib.crc32(own[4 * at : 4 * (at + size)]), n, task, ranks[size]))
                        ranks[size] += 1
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, window: int) -> DataFrame:
    """Add sequence_id and offset to a table of pieces that does not change between reads (task, rank, length, ...)."""
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    # at most ``window`` rows: one per length
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = np.array(best_fit_decreasing(counts, window) or np.empty((0, 6)), dtype=np.int64)
    # runs sorted by (length, first rank) as one key, so that one binary search finds a piece's run
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    spans = {int(n): (int(a), int(z)) for n, a, z in zip(*_spans(table[:, 0]))}

    def place(it):
        for b in it:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy()
            run = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                a, z = spans[int(n)]
                own = length == n
                run[own] = a + np.searchsorted(table[a:z, 1], rank[own], side="right") - 1
            i, per = rank - table[run, 1], table[run, 4]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(table[run, 3] + i // per), pa.array(table[run, 5] + i % per * length)], names=[*keep, "sequence_id", "offset"]
            )

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.join(bases, ["length", "task"]).mapInArrow(place, out)


def _spans(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(sorted_values, return_index=True)
    return values, first, np.append(first[1:], len(sorted_values))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, block_chars: int | None = None) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset. The cut pieces are written once (a few numbers each)."""
    return pack_pieces(materialize(cut_pieces(docs, tokenizer, window, end_id, block_chars), "pieces"), window)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)

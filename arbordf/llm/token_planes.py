"""Token-id output as bit- or byte-planes.

Layout of a written store (one folder):

* ``chunks/``: one row per block of at most ``chunk_ids`` ids: shard, chunk, first (ids of the shard before it), n_ids,
  planes (zstandard frames, plane k holding byte k or bit k of every id in order), crc32 of the block's little-endian
  bytes, and the pieces of documents in it (doc_id, ord = the document's place in the shard, off = its ids before the
  piece, size, whole = the piece is the whole document).
* ``index/``: one row per chunk: shard, chunk, start (global position), n_ids. It finds the chunk of a position without
  reading planes.

Shards follow ascending doc_id, rows of equal doc_id ascending text. Files are written by Spark's committer, so a lost
or repeated task leaves nothing half-written. Null texts count as empty; an empty text has the end id alone; a null
doc_id sorts first. Extra columns are ignored. An empty table gives an empty store. The string of a special token in a
text becomes that token's id, as the library's plain call has it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, read_table
from .segments import library_encoder

CHUNK_IDS = 1 << 16
CHUNKS = (
    "shard int, chunk int, first long, n_ids int, planes array<binary>, crc long, "
    "pieces array<struct<doc_id: long, ord: long, off: long, size: int, whole: boolean>>"
)
_PIECES = "shard int, chunk int, at long, doc_id long, ord long, off long, size int, whole boolean, crc long"


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Transpose ids into 4 byte planes or 32 bit planes and compress each."""
    c = zstandard.ZstdCompressor(level=level)
    planes = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if kind == "bit":
        planes = [np.packbits((p >> b) & 1) for p in planes for b in range(8)]
    elif kind != "byte":
        raise ValueError(f"kind is byte or bit, not {kind!r}")
    return [c.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Inverse of :func:`to_planes`; the number of planes tells the kind."""
    d = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(d.decompress(p), dtype=np.uint8) for p in planes]
    if len(raw) == 32:
        bits = [np.unpackbits(p, count=n) for p in raw]
        raw = [sum(bits[8 * k + b] << np.uint8(b) for b in range(8)) for k in range(4)]
    return np.ascontiguousarray(np.stack(raw, axis=1)).reshape(-1).view("<u4") if n else np.empty(0, "<u4")


class _Chunker:
    """Cuts a stream of documents into fixed-size chunks of one shard."""

    def __init__(self, shard: int, size: int, kind: str, level: int):
        self.shard, self.size, self.kind, self.level = shard, size, kind, level
        self.parts, self.held, self.pieces, self.chunk, self.first, self.ord = [], 0, [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        off = 0
        while off < len(ids):
            n = min(len(ids) - off, self.size - self.held)
            self.parts.append(ids[off : off + n])
            self.pieces.append({"doc_id": doc_id, "ord": self.ord, "off": off, "size": n, "whole": n == len(ids)})
            self.held += n
            off += n
            if self.held == self.size:
                yield self.flush()
        self.ord += 1

    def flush(self) -> dict:
        ids = np.concatenate(self.parts).astype("<u4")
        row = {
            "shard": self.shard, "chunk": self.chunk, "first": self.first, "n_ids": len(ids),
            "planes": to_planes(ids, self.kind, self.level), "crc": zlib.crc32(ids.tobytes()), "pieces": self.pieces,
        }
        self.first += len(ids)
        self.chunk += 1
        self.parts, self.held, self.pieces = [], 0, []
        return row


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, chunk_ids: int = CHUNK_IDS, plane: str = "byte", level: int = 3) -> None:
    """Tokenise ``docs`` (doc_id, text) with a ``tokenizers`` file and write a store at ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], CHUNKS).schema)

    def shard(it):
        from pyspark import TaskContext

        encoder, out = library_encoder(tokenizer), _Chunker(TaskContext.get().partitionId(), chunk_ids, plane, level)
        end = np.array([end_id], dtype=np.uint32)
        for b in it:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1)
            for start, ids, bounds in encoder.blocks(texts):
                for i in range(len(bounds) - 1):
                    rows = list(out.add(doc_ids[start + i], np.concatenate([ids[bounds[i] : bounds[i + 1]], end])))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)
        if out.held:
            yield pa.RecordBatch.from_pylist([out.flush()], schema)

    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = text.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    chunks = dealt.select("doc_id", "text").mapInArrow(shard, CHUNKS)
    chunks.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{path}/chunks")
    spark = docs.sparkSession
    own = open_chunks(spark, path).select("shard", "chunk", "first", "n_ids")
    own.join(shard_starts(spark, path), "shard").select("shard", "chunk", (F.col("base") + F.col("first")).alias("start"), "n_ids").write.parquet(f"{path}/index")


def open_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): ids before each shard. One row per shard, so one task adds them up at any corpus size."""
    per_shard = open_chunks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per_shard.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")).alias("base"))


def _read_pieces(it):
    for b in it:
        rows = []
        for r in b.to_pylist():
            ids = from_planes(r["planes"], r["n_ids"])
            raw, at = ids.tobytes(), 0
            if zlib.crc32(raw) != r["crc"]:
                raise ValueError(f"shard {r['shard']}, chunk {r['chunk']}: ids differ from those written")
            for p in r["pieces"]:
                rows.append((r["shard"], r["chunk"], r["first"] + at, p["doc_id"], p["ord"], p["off"], p["size"], p["whole"], zlib.crc32(raw[4 * at : 4 * (at + p["size"])])))
                at += p["size"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
        names = ["shard", "chunk", "at", "doc_id", "ord", "off", "size", "whole", "crc"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, in its reflected bit order."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_join(crc_a: int, crc_b: int, size_b: int) -> int:
    """CRC-32 of two byte strings in a row from their own CRCs and the second one's size in bytes."""
    shift, power, n = 0x80000000, 0x00800000, size_b  # x^0; x^8 for each byte
    while n:
        if n & 1:
            shift = _times(power, shift)
        power = _times(power, power)
        n >>= 1
    return _times(shift, crc_a) ^ crc_b


def _join_pieces(it):
    for b in it:
        crcs = []
        for parts in b.column("parts").to_pylist():
            total = 0
            for p in sorted(parts, key=lambda x: x["off"]):
                total = crc32_join(total, p["crc"], 4 * p["size"])
            crcs.append(total)
        names = ["shard", "doc_id", "local", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(crcs, pa.int64())], names=[*names, "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32, taken from the decoded chunks.

    Chunks are decoded independently and once, as the pieces (a few numbers each) are written; only pieces of documents that
    cross a chunk border meet in a shuffle.
    """
    pieces = materialize(open_chunks(spark, path).mapInArrow(_read_pieces, _PIECES), "token-pieces")
    whole = pieces.filter("whole").select("shard", "doc_id", F.col("at").alias("local"), F.col("size").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = (
        pieces.filter("not whole").groupBy("shard", "ord", "doc_id")
        .agg(F.min("at").alias("local"), F.sum("size").alias("n_tokens"), F.collect_list(F.struct("off", "size", "crc")).alias("parts"))
        .mapInArrow(_join_pieces, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    )
    return whole.unionByName(cut).join(shard_starts(spark, path), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids at global positions [start, start + count), found through the index; only their chunks are decoded."""
    index = spark.read.parquet(f"{path}/index").filter((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))
    rows = open_chunks(spark, path).select("shard", "chunk", "planes").join(index, ["shard", "chunk"]).orderBy("start").collect()
    if not rows:
        return np.empty(0, dtype="<u4")
    ids = np.concatenate([from_planes(r["planes"], r["n_ids"]) for r in rows])
    return ids[max(start - rows[0]["start"], 0) : start + count - rows[0]["start"]]


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-planes")
    write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)

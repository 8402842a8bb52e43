"""Labelled rows for fitting, held-out rows kept away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a model is fitted on at most; more labelled rows are left out by hash of doc_id.
MAX_LABELLED = 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text is divisible by 5. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled documents that are not held out.

    Rows without a 0/1 label are ignored; of several labels for a doc_id the smallest counts, of several texts the first in
    order of their hash. The labels side holds at most ``max_rows`` rows of 12 bytes, so it is broadcast whatever the corpus
    holds.
    """
    y = F.col(column).cast("int")
    some = (
        labels.filter(~held_out() & y.isin(0, 1)).groupBy("doc_id").agg(F.min(y).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "y")).alias("row"))  # a doc_id may have any number of rows
    return one.select("doc_id", "row.text", "row.y")

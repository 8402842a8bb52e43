"""Streams of documents: per-document work is stateless, so every operator runs on each micro-batch unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.stylesheet import Stylesheet


def transform_stream(docs: DataFrame, sheet: Stylesheet, key: str, text: str, kind: str = "xml") -> DataFrame:
    """Stylesheet results of a streaming frame of documents."""
    return sheet.transform(docs, key, text, kind=kind)


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``plan`` on every micro-batch and append its rows to Parquet, one folder per batch: a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, slide: str | None, by: list[str]) -> DataFrame:
    """Counts per tumbling or sliding window, late rows dropped behind the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *by).agg(F.count("*").alias("n"))

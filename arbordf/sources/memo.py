"""Expensive per-value functions: compute each distinct key once, join the results back, keep them for later runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys longer than this are stored under their digest.
LONGEST_KEY = 200


def cache_key(key: Column, prefix: str = "") -> Column:
    full = F.concat(F.lit(prefix), key)
    return F.when(F.length(full) > LONGEST_KEY, F.md5(full)).otherwise(full)


class Memo:
    """Results by key in a Parquet folder; entries older than ``ttl_seconds`` count as absent (None: kept for good).

    Runs append, each under the commit protocol, so runs side by side lose nothing: a key that two of them compute has two
    entries, of which the later counts. ``compact`` rewrites the folder without expired and repeated entries; it is to run
    alone.
    """

    def __init__(self, path: str | None = None, prefix: str = "", ttl_seconds: int | None = 1200):
        self.path, self.prefix, self.ttl = path, prefix, ttl_seconds

    def known(self, like: DataFrame) -> DataFrame | None:
        if self.path is None:
            return None
        spark = like.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        rows = spark.read.schema("_key string, _result string, _at timestamp").parquet(self.path)
        fresh = rows if self.ttl is None else rows.filter(F.col("_at") > F.current_timestamp() - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {self.ttl})"))
        return fresh.groupBy("_key").agg(F.max_by("_result", "_at").alias("_result"))

    def compact(self, spark) -> None:
        """Keep the entries that count: they are written beside the folder, which then takes their place."""
        rows = self.known(spark.range(0))
        if rows is None:
            return
        jvm, new = spark.sparkContext._jvm, f"{self.path.rstrip('/')}.new"
        rows.withColumn("_at", F.current_timestamp()).write.mode("overwrite").parquet(new)
        old, made = jvm.org.apache.hadoop.fs.Path(self.path), jvm.org.apache.hadoop.fs.Path(new)
        files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(old, True)
        files.rename(made, old)

    def apply(self, rows: DataFrame, key: str, out: str, function: Callable[[str], str]) -> DataFrame:
        """Add ``out`` = function(column ``key``), called once per distinct key that is not known yet."""
        keyed = rows.withColumn("_key", cache_key(F.col(key), self.prefix))
        wanted = keyed.select("_key", F.col(key).alias("_arg")).filter("_arg is not null").dropDuplicates(["_key"])
        known = self.known(rows)
        if known is not None:
            wanted = wanted.join(known, "_key", "left_anti")

        def compute(it):
            for pdf in it:
                yield pd.DataFrame({"_key": pdf["_key"], "_result": pdf["_arg"].map(function)})

        results = wanted.mapInPandas(compute, "_key string, _result string")
        if self.path is not None:
            results.withColumn("_at", F.current_timestamp()).write.mode("append").parquet(self.path)
            results = self.known(rows)
        return keyed.join(results, "_key", "left").withColumnRenamed("_result", out).drop("_key")

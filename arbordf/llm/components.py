"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two aggregates (a minimum per node, combined before the shuffle) and two equi-joins whose other side has
one row per node, so a hub of any degree is split by adaptive skew joins and never gathered. Rounds end when the links
no longer change; each round's links are written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Links may repeat and point either way; loops and links with a null end are ignored.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = materialize(links.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "links")
    sign = _sign(now)
    while sign[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("v"), F.least("x", "y").alias("m"))
        large = now.join(low, "v").select("u", F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "links")
        last, sign = sign, _sign(now)
        if sign == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

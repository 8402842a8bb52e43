"""Axis steps over the node table as joins: document and parent, or document and block of numbers, then containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import REVERSE_AXES, Test

#: Numbers of a document that make a block of the interval joins.
BLOCK = 256
_CARRIED = ["node_id", "parent_id", "pre", "last_desc", "kind"]


def test_condition(test: Test, axis: str) -> Column:
    """Which nodes a node test takes; the principal kind is attribute on the attribute axis, element elsewhere."""
    principal = "attribute" if axis == "attribute" else "element"
    if test.kind == "node":
        return F.lit(True)
    if test.kind in ("text", "comment", "pi"):
        c = F.col("kind") == test.kind
        return c & (F.col("name") == test.name) if test.name else c
    c = F.col("kind") == principal
    return c if test.kind == "any" else c & (F.col("name") == test.name)


def axis_condition(axis: str) -> Column:
    """Join condition between context columns (``c_*``) and node columns, besides equality of doc_id."""
    pre, last, own = F.col("pre"), F.col("last_desc"), F.col("node_id") == F.col("c_node_id")
    c_pre, c_last = F.col("c_pre"), F.col("c_last_desc")
    real = F.col("kind") != "attribute"
    siblings = real & (F.col("parent_id") == F.col("c_parent_id")) & (F.col("c_kind") != "attribute")
    return {
        "child": real & (F.col("parent_id") == F.col("c_node_id")),
        "attribute": ~real & (F.col("parent_id") == F.col("c_node_id")),
        "parent": F.col("node_id") == F.col("c_parent_id"),
        "self": own,
        "descendant": real & (pre > c_pre) & (pre <= c_last),
        "descendant-or-self": (real | own) & (pre >= c_pre) & (pre <= c_last),
        "ancestor": real & (pre < c_pre) & (c_pre <= last),
        "ancestor-or-self": (real | own) & (pre <= c_pre) & (c_pre <= last),
        "following": real & (pre > c_last),
        "preceding": real & (last < c_pre),
        "following-sibling": siblings & (pre > c_pre),
        "preceding-sibling": siblings & (pre < c_pre),
    }[axis]


def blocked(frame: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row for each block of numbers that ``low`` to ``high`` touches, in column ``_block``."""
    first, last = (F.floor(c / BLOCK).cast("long") for c in (low, high))
    return frame.filter(low <= high).withColumn("_block", F.explode(F.sequence(first, F.greatest(first, last))))


def widest(context: DataFrame, axis: str) -> DataFrame:
    """The context rows that decide a step's node-set: of each oid one for the open axes, and none within another's reach
    for the sibling axes. What they reach is what all of them reach, only not told apart by context."""
    keep = ["oid", "c_doc", "c_parent_id"] if axis.endswith("-sibling") else ["oid", "c_doc"]
    edge = {"following": F.min(F.struct("c_last_desc", "c_pre", "c_node_id", "c_kind", "c_parent_id")), "preceding": F.max(F.struct("c_pre", "c_last_desc", "c_node_id", "c_kind", "c_parent_id")),
            "following-sibling": F.min(F.struct("c_pre", "c_last_desc", "c_node_id", "c_kind", "c_parent_id")), "preceding-sibling": F.max(F.struct("c_pre", "c_last_desc", "c_node_id", "c_kind", "c_parent_id"))}.get(axis)
    if edge is None:
        return context
    rows = context if not axis.endswith("-sibling") else context.filter("c_kind != 'attribute'")
    got = rows.groupBy(*keep).agg(edge.alias("e"))
    return got.select("oid", "c_doc", *(F.col(f"e.c_{x}").alias(f"c_{x}") for x in _CARRIED))


def axis_step(context: DataFrame, nodes: DataFrame, axis: str, test: Test, apart: bool = True) -> DataFrame:
    """Nodes on the axis of each context row: columns oid, doc_id, c_node_id and the node's columns.

    Axes of intervals join on (doc_id, block of numbers), so a document spreads over many tasks and a node meets the
    contexts of its own block only. ``apart`` false: nobody asks which context of an oid a node was reached from.
    """
    found = nodes.filter(test_condition(test, axis))
    c = context.select("oid", F.col("doc_id").alias("c_doc"), *(F.col(x).alias(f"c_{x}") for x in _CARRIED))
    if not apart:
        c = widest(c, axis)
    on = (F.col("c_doc") == F.col("doc_id")) & axis_condition(axis)
    if axis in ("descendant", "descendant-or-self"):
        c = blocked(c, F.col("c_pre"), F.col("c_last_desc"))
    elif axis in ("ancestor", "ancestor-or-self"):
        found = blocked(found, F.col("pre"), F.col("last_desc"))
        c = c.withColumn("_block", F.floor(F.col("c_pre") / BLOCK).cast("long"))
    elif axis in ("following", "preceding"):
        if axis == "following":
            ends = nodes.filter("kind = 'document'").select(F.col("doc_id").alias("_doc"), F.col("last_desc").alias("_end"))
            c = blocked(c.join(ends, F.col("c_doc") == F.col("_doc")).drop("_doc"), F.col("c_last_desc"), F.col("_end")).drop("_end")
        else:
            c = blocked(c, F.lit(0), F.col("c_pre"))
    if "_block" in c.columns:
        if "_block" not in found.columns:
            found = found.withColumn("_block", F.floor(F.col("pre") / BLOCK).cast("long"))
        c, on = c.withColumnRenamed("_block", "c_block"), on & (F.col("c_block") == F.col("_block"))
    return c.join(found, on).select("oid", "c_node_id", *nodes.columns)


def proximity(axis: str) -> Column:
    """Order in which an axis counts positions."""
    return F.desc("pre") if axis in REVERSE_AXES else F.asc("pre")

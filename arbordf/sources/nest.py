"""Flat tables nested by their foreign keys into a node table: columns become attributes, child tables child elements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import to_string
from ..operators.schema import NODE_COLUMNS


@dataclass
class Level:
    """One table: element name, frame, key column, column naming the parent's key, columns that become attributes."""

    name: str
    frame: DataFrame
    key: str
    parent: str | None = None
    attributes: list[str] = field(default_factory=list)
    children: list[Level] = field(default_factory=list)


def nest(root: Level) -> DataFrame:
    """Node rows of one document per row of the root table (doc_id: its key).

    Subtree sizes come from one aggregate per level, from the leaves up; numbers go down level by level: a child stands
    behind its parent, the parent's attributes and the subtrees of earlier siblings. So no window is wider than one
    parent's children, and a document spreads over all tasks. Attributes that are null leave a gap in the numbers.
    """
    sized = _sized(root)
    top = sized.frame.select(F.col(root.key).cast("string").alias("doc_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(1).cast("long").alias("pre"), F.lit(1).alias("sib_pos"), F.col(root.key).alias("_key"), *sized.carried)
    document = top.select(
        "doc_id", F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("pre"), F.col("_size").alias("last_desc"), F.lit(0).alias("depth"),
        F.lit("document").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("sib_pos"), F.lit(0).alias("flags"),
    )
    out = document.select(NODE_COLUMNS)
    for rows in _numbered(sized, top, 1):
        out = out.unionByName(rows)
    return out


@dataclass
class _Sized:
    """A level's frame with ``_size`` (nodes of each row's subtree), ``_attrs`` and per child table ``_n<i>``, ``_s<i>``: rows
    and nodes below."""

    level: Level
    frame: DataFrame
    children: list[_Sized]

    @property
    def carried(self) -> list[str]:
        return ["_size", "_attrs", *(f"_{c}{i}" for i in range(len(self.children)) for c in "ns")]


def _sized(level: Level) -> _Sized:
    types = dict(level.frame.dtypes)
    attrs = F.array(*(F.struct(F.lit(c).alias("k"), to_string(F.col(c), types[c]).alias("v")) for c in level.attributes)) if level.attributes else F.array().cast("array<struct<k:string,v:string>>")
    f = level.frame.select(level.key, *([level.parent] if level.parent else []), attrs.alias("_attrs"), F.lit(1 + len(level.attributes)).cast("long").alias("_size"))
    children = [_sized(c) for c in level.children]
    for i, c in enumerate(children):
        below = c.frame.groupBy(F.col(c.level.parent).alias("_up")).agg(F.count("*").alias(f"_n{i}"), F.sum("_size").alias(f"_s{i}"))
        f = f.join(below, f[level.key] == F.col("_up"), "left").drop("_up")
        f = f.withColumns({f"_n{i}": F.coalesce(f"_n{i}", F.lit(0)), f"_s{i}": F.coalesce(f"_s{i}", F.lit(0))}).withColumn("_size", F.col("_size") + F.col(f"_s{i}"))
    return _Sized(level, f, children)


def _numbered(sized: _Sized, rows: DataFrame, depth: int) -> list[DataFrame]:
    """Element and attribute rows of a level (doc_id, parent_id, pre, sib_pos, _key and what is carried) and all below."""
    level = sized.level
    elements = rows.select(
        "doc_id", F.col("pre").alias("node_id"), "parent_id", "pre", (F.col("pre") + F.col("_size") - 1).alias("last_desc"), F.lit(depth).alias("depth"), F.lit("element").alias("kind"),
        F.lit(level.name).alias("name"), F.lit(None).cast("string").alias("value"), F.col("sib_pos").cast("int").alias("sib_pos"), F.lit(0).alias("flags"),
    )
    attributes = rows.select("doc_id", F.col("pre").alias("parent_id"), F.posexplode("_attrs").alias("i", "a")).filter("a.v is not null").withColumn("pre", F.col("parent_id") + 1 + F.col("i"))
    attributes = attributes.select(
        "doc_id", F.col("pre").alias("node_id"), "parent_id", "pre", F.col("pre").alias("last_desc"), F.lit(depth + 1).alias("depth"), F.lit("attribute").alias("kind"),
        F.col("a.k").alias("name"), F.col("a.v").alias("value"), F.lit(0).alias("sib_pos"), F.lit(0).alias("flags"),
    )
    out = [elements.select(NODE_COLUMNS), attributes.select(NODE_COLUMNS)]
    for i, c in enumerate(sized.children):
        # where the first row of this child table stands, and how many children stand before it
        start = F.col("pre") + 1 + len(level.attributes) + sum((F.col(f"_s{j}") for j in range(i)), F.lit(0))
        up = rows.select(F.col("_key").alias("_up"), "doc_id", F.col("pre").alias("parent_id"), start.alias("_start"), sum((F.col(f"_n{j}") for j in range(i)), F.lit(0)).alias("_before"))
        before = Window.partitionBy(c.level.parent).orderBy(c.level.key)
        f = c.frame.withColumns({"_offset": F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), "_place": F.row_number().over(before)})
        below = f.join(up, f[c.level.parent] == F.col("_up")).select(
            "doc_id", "parent_id", (F.col("_start") + F.coalesce("_offset", F.lit(0))).alias("pre"), (F.col("_before") + F.col("_place")).alias("sib_pos"), F.col(c.level.key).alias("_key"), *c.carried
        )
        out += _numbered(c, below, depth + 1)
    return out

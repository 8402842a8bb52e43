"""Documents to node rows and back: scans, builders and the record-shaped shortcut."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import NODE_COLUMNS, NODE_SCHEMA
from .tree import Node, number, parse_html, parse_xml


def tree_rows(doc_id: str, root: Node) -> list[tuple]:
    """NODE_SCHEMA rows of one tree."""
    number(root)
    last: dict[int, int] = {}
    nodes = list(root.walk())
    for n in reversed(nodes):
        last[n.order] = max([last.get(n.order, n.order), *(last[c.order] for c in (n.children[-1:] or n.attributes[-1:]))])
    place: dict[int, int] = {}
    for n in nodes:
        at = 0
        for c in n.children:
            at += c.kind != "text"
            place[c.order] = at if c.kind != "text" else 0
    depth = {root.order: 0}
    out = []
    for n in nodes:
        if n.parent is not None and n is not root:
            depth[n.order] = depth[n.parent.order] + 1
        parent = None if n is root else n.parent.order
        out.append((doc_id, n.order, parent, n.order, last[n.order], depth[n.order], n.kind, n.name, n.value, place.get(n.order, 0), n.flags))
    return out


def shred(docs: DataFrame, key: str, text: str, kind: str = "xml", on_error: str = "raise", entities: Collection[str] | None = None) -> DataFrame:
    """Node rows of every document. One task parses many documents; a document stays whole in one task.

    Null texts have no rows. ``on_error="skip"`` leaves documents out that are not well-formed.
    ``entities``: see ``parse_html``.
    """
    parse: Callable[[str], Node] = partial(parse_html, entities=entities) if kind == "html" else parse_xml
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NODE_SCHEMA)

    def run(it):
        for b in it:
            rows: list[tuple] = []
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if value is None:
                    continue
                try:
                    rows += tree_rows(doc_id, parse(value))
                except Exception:
                    if on_error == "raise":
                        raise
                if len(rows) > 50_000:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    return docs.select(F.col(key).cast("string"), text).mapInArrow(run, NODE_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_files(spark: SparkSession, path: str, kind: str = "xml") -> DataFrame:
    """Node rows of every file under ``path``; the file's path is its doc_id. Empty files are an error."""
    return shred(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value"), "doc_id", "value", kind)


def read_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Record-shaped XML straight to columns, by Spark's own reader."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def from_string(spark: SparkSession, text: str, doc_id: str = "", kind: str = "xml") -> DataFrame:
    return spark.createDataFrame(tree_rows(doc_id, (parse_html if kind == "html" else parse_xml)(text)), NODE_SCHEMA)


class Builder:
    """Builds a document by hand: elements, texts, attributes and parsed fragments."""

    def __init__(self, doc_id: str = ""):
        self.doc_id, self.root = doc_id, Node("document")

    def element(self, parent: Node | None, name: str) -> Node:
        return (parent or self.root).append(Node("element", name))

    def text(self, element: Node, value: str) -> Node:
        return element.append(Node("text", None, value))

    def attribute(self, element: Node, name: str, value: str) -> Node:
        return element.append(Node("attribute", name, value))

    def fragment(self, element: Node, xml: str) -> list[Node]:
        return [element.append(c) for c in parse_xml(xml).children]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(tree_rows(self.doc_id, self.root), NODE_SCHEMA)


__all__ = ["NODE_COLUMNS", "Builder", "from_string", "read_files", "read_records", "shred", "tree_rows"]

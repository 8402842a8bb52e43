"""Trees and node rows to text: XML, HTML and plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.schema import VOID_TAGS
from .tree import Node

NO_ESCAPE = 1


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(s: str) -> str:
    return escape_text(s).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;")


def serialize(root: Node, method: str = "xml", declaration: bool = False, doctype: tuple[str | None, str | None] = (None, None), encoding: str = "UTF-8", standalone: str | None = None, media_type: str = "text/html") -> str:
    """Text of a tree. HTML gets no declaration, open void elements, raw scripts and a content-type meta in its head."""
    out: list[str] = []
    if method == "xml" and declaration:
        out.append(f'<?xml version="1.0" encoding="{encoding}"' + (f' standalone="{standalone}"' if standalone else "") + "?>\n")
    top = next((c for c in root.children if c.kind == "element"), None) if root.kind == "document" else root
    public, system = doctype
    if method != "text" and top is not None and (system or (public and method == "html")):
        out.append(f"<!DOCTYPE {top.name}" + (f' PUBLIC "{public}"' if public else " SYSTEM") + (f' "{system}"' if system else "") + ">\n")

    def write(n: Node, raw: bool) -> None:
        if n.kind == "document":
            for c in n.children:
                write(c, raw)
        elif n.kind == "text":
            out.append(n.value if raw or method == "text" or n.flags & NO_ESCAPE else escape_text(n.value))
        elif method == "text":
            for c in n.children:
                write(c, raw)
        elif n.kind == "comment":
            out.append(f"<!--{n.value}-->")
        elif n.kind == "pi":
            out.append(f"<?{n.name} {n.value}" + (">" if method == "html" else "?>"))
        elif n.kind == "element":
            lower = n.name.lower()
            out.append(f"<{n.name}" + "".join(f' {a.name}="{escape_attribute(a.value)}"' for a in n.attributes))
            if method == "html":
                out.append(">")
                if lower == "head":
                    out.append(f'<meta http-equiv="Content-Type" content="{media_type}; charset={encoding}">')
                if lower in VOID_TAGS:
                    return
            elif not n.children:
                out.append("/>")
                return
            else:
                out.append(">")
            for c in n.children:
                write(c, method == "html" and lower in ("script", "style"))
            out.append(f"</{n.name}>")

    write(root, False)
    return "".join(out)


def serialize_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, xml) of a node table by one ordered aggregate per document: two tokens per element, one per text.

    An open tag sorts at its own ``pre``; a close tag after the last node below it, inner ones first.
    """
    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    quoted = F.replace(esc(F.col("value")), F.lit('"'), F.lit("&quot;"))
    attrs = (
        nodes.filter("kind = 'attribute'").select("doc_id", F.col("parent_id").alias("a_of"), "pre", F.concat(F.lit(" "), "name", F.lit('="'), quoted, F.lit('"')).alias("a"))
        .groupBy("doc_id", "a_of").agg(F.expr("listagg(a, '') within group (order by pre)").alias("attrs"))
    )
    filled = nodes.filter("kind != 'attribute'").select("doc_id", F.col("parent_id").alias("f_of")).distinct().withColumn("filled", F.lit(True))
    elements = (
        nodes.filter("kind = 'element'").join(attrs.withColumnRenamed("a_of", "node_id"), ["doc_id", "node_id"], "left")
        .join(filled.withColumnRenamed("f_of", "node_id"), ["doc_id", "node_id"], "left")
    )
    head = F.concat(F.lit("<"), "name", F.coalesce("attrs", F.lit("")))
    opening = elements.select("doc_id", F.col("pre").alias("at"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("inner"), F.concat(head, F.when(F.col("filled"), ">").otherwise("/>")).alias("token"))
    closing = elements.filter("filled").select("doc_id", F.col("last_desc").alias("at"), F.lit(1).alias("phase"), (-F.col("pre")).alias("inner"), F.concat(F.lit("</"), "name", F.lit(">")).alias("token"))
    texts = nodes.filter("kind = 'text'").select("doc_id", F.col("pre").alias("at"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("inner"), esc(F.col("value")).alias("token"))
    tokens = opening.unionByName(closing).unionByName(texts).withColumn("k", F.struct("at", "phase", "inner"))
    return tokens.groupBy("doc_id").agg(F.expr("listagg(token, '') within group (order by k)").alias("xml"))


def write_texts(texts: DataFrame, column: str, path: str) -> None:
    """One line per document."""
    texts.select(column).write.mode("overwrite").text(path)


def write_records(rows: DataFrame, path: str, root_tag: str = "rows", row_tag: str = "row") -> None:
    rows.write.mode("overwrite").format("xml").option("rootTag", root_tag).option("rowTag", row_tag).save(path)

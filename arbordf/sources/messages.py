"""Message catalogues (.po): parsing and lookups, as a frame and as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import plural_index, substitute

_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"')
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), "".join(_QUOTED.findall(text)))


def parse_messages(text: str) -> dict[str, list[str]]:
    """msgid -> translations (one, or one per plural form). The header entry has the empty id."""
    out: dict[str, list[str]] = {}
    for block in re.split(r"\n\s*\n", text):
        lines = [line for line in block.splitlines() if line.strip() and not line.startswith("#")]
        fields: list[tuple[str, str]] = []
        for line in lines:
            m = re.match(r"(msgid_plural|msgid|msgstr(?:\[\d+\])?|msgctxt)\s+(.*)", line)
            if m:
                fields.append((m[1], m[2]))
            elif fields:
                fields[-1] = (fields[-1][0], fields[-1][1] + line)
        values = {k: _unquote(v) for k, v in fields}
        if "msgid" in values:
            out[values["msgid"]] = [v for k, v in sorted((k, v) for k, v in values.items() if k.startswith("msgstr"))]
    return out


def language_of(messages: dict[str, list[str]]) -> str:
    m = re.search(r"^Language:\s*(\w\w)", (messages.get("") or [""])[0], re.MULTILINE)
    return m[1].lower() if m else "en"


def message_frame(spark: SparkSession, messages: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in messages.items() if k], "msgid string, msgstr array<string>")


def localize(rows: DataFrame, messages: DataFrame, msgid: str, out: str, values: dict[str, Column] | None = None) -> DataFrame:
    """Add ``out``: the translation of column ``msgid`` (the id itself if there is none), ``{name}`` replaced by values."""
    own = messages.select(F.col("msgid").alias("_id"), F.element_at("msgstr", 1).alias("_text"))
    text = F.coalesce(F.nullif(F.col("_text"), F.lit("")), F.col(msgid))
    return rows.join(own, F.col(msgid) == F.col("_id"), "left").withColumn(out, substitute(text, list((values or {}).items()))).drop("_id", "_text")


def localize_plural(rows: DataFrame, messages: DataFrame, msgid: str, plural: str, n: Column, language: str, out: str) -> DataFrame:
    """Add ``out``: the plural form of a message for the number ``n``, ``{n}`` replaced; without a translation the ids serve."""
    own = messages.select(F.col("msgid").alias("_id"), F.col("msgstr").alias("_forms"))
    form = F.try_element_at(F.col("_forms"), (plural_index(language, n) + 1).cast("int"))
    text = F.coalesce(form, F.when(n == 1, F.col(msgid)).otherwise(F.col(plural)))
    return rows.join(own, F.col(msgid) == F.col("_id"), "left").withColumn(out, substitute(text, [("n", n.cast("string"))])).drop("_id", "_forms")

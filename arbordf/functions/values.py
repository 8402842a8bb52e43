"""The path language's value conversions as Columns: string, number, boolean.

Numbers are doubles. Every comparison guards NaN, which Spark would treat as equal to itself and as the greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
_NUMBER = r"^[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*$"


def kind_of(dtype: str) -> str:
    """XPath type of a Spark type."""
    if dtype in NUMERIC or dtype.startswith("decimal"):
        return "number"
    return "boolean" if dtype == "boolean" else "string"


def to_string(col: Column, dtype: str = "string") -> Column:
    """String of a value: integral numbers without a fraction, others in plain decimal notation."""
    kind = kind_of(dtype)
    if kind == "boolean":
        return F.when(col, "true").otherwise(F.when(col.isNotNull(), "false"))
    if kind == "number":
        if dtype in NUMERIC[:4]:
            return col.cast("string")
        return number_to_string(col.cast("double"))
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss") if dtype.startswith("timestamp") else col.cast("string")


def number_to_string(col: Column) -> Column:
    text = col.cast("string")
    plain = col.cast("decimal(38,15)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(F.isnan(col), "NaN").when(col == float("inf"), "Infinity").when(col == float("-inf"), "-Infinity")
        .when((col == F.floor(col)) & (F.abs(col) < 1e15), col.cast("long").cast("string"))
        .when(text.contains("E"), F.when(F.abs(col) < 1e22, plain).otherwise(text)).otherwise(text)
    )


def to_number(col: Column, dtype: str = "string") -> Column:
    """Number of a value; NaN where a string is not one (exponents and signs but ``-`` are not allowed)."""
    kind = kind_of(dtype)
    if kind == "number":
        return col.cast("double")
    if kind == "boolean":
        return col.cast("int").cast("double")
    text = col if dtype == "string" else to_string(col, dtype)
    return F.when(text.rlike(_NUMBER), F.trim(F.regexp_replace(text, r"[\t\r\n]", " ")).try_cast("double")).otherwise(F.lit(float("nan")))


def to_boolean(col: Column, dtype: str = "string") -> Column:
    """Boolean of a value: numbers other than 0 and NaN, non-empty strings."""
    kind = kind_of(dtype)
    if kind == "number":
        x = col.cast("double")
        return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))
    return F.coalesce(col if kind == "boolean" else F.length(col) > 0, F.lit(False))


def compare(op: str, left: Column, right: Column) -> Column:
    """``= != < <= > >=`` of two numbers, false for NaN except ``!=``."""
    ok = ~F.isnan(left) & ~F.isnan(right)
    if op == "!=":
        return F.coalesce(~ok | (left != right), F.lit(False))
    result = {"=": left == right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.coalesce(ok & result, F.lit(False))


def divide(left: Column, right: Column) -> Column:
    """IEEE division."""
    inf = F.lit(float("inf"))
    by_zero = F.when(F.isnan(left) | (left == 0), F.lit(float("nan"))).when(left > 0, inf).otherwise(-inf)
    return F.when(right == 0, by_zero).otherwise(left / F.when(right != 0, right))


def modulo(left: Column, right: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return F.when(right == 0, F.lit(float("nan"))).otherwise(left % F.when(right != 0, right))

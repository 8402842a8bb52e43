"""Scalar functions of the path language as Columns.

Every function takes ``Value`` arguments (column and type: string, number, boolean) and returns one. ``REGISTRY`` maps names
to functions; an engine's own functions are looked up first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import number_to_string, to_boolean, to_number


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str  # string number boolean

    @property
    def string(self) -> Column:
        """Never null: an absent node is the empty string."""
        if self.kind == "number":
            return F.coalesce(number_to_string(self.col), F.lit("NaN"))
        return F.coalesce(F.when(self.col, "true").otherwise("false") if self.kind == "boolean" else self.col, F.lit(""))

    @property
    def number(self) -> Column:
        return F.coalesce(to_number(self.col, {"number": "double"}.get(self.kind, self.kind)), F.lit(float("nan")))

    @property
    def boolean(self) -> Column:
        return to_boolean(self.col, {"number": "double"}.get(self.kind, self.kind))


def string(c: Column) -> Value:
    return Value(c, "string")


def num(c: Column) -> Value:
    return Value(c, "number")


def boolean(c: Column) -> Value:
    return Value(c, "boolean")


def _rounded(x: Column) -> Column:
    """Halves go up; integral doubles, NaN and infinities stay."""
    return F.when(F.isnan(x) | (F.abs(x) > 1e15), x).otherwise(F.floor(x + 0.5).cast("double"))


def substring(s: Value, start: Value, size: Value | None = None) -> Value:
    """Characters whose place p has ``round(start) <= p < round(start) + round(size)``."""
    a = _rounded(start.number)
    first = F.greatest(F.when(F.isnan(a), F.lit(1e9)).otherwise(a), F.lit(1.0))
    if size is None:
        return string(F.substr(s.string, F.least(first, F.lit(2e9)).cast("int")))
    end = a + _rounded(size.number)
    count = F.when(F.isnan(end), F.lit(0.0)).otherwise(F.least(F.greatest(end - first, F.lit(0.0)), F.lit(2e9)))
    return string(F.substr(s.string, F.least(first, F.lit(2e9)).cast("int"), count.cast("int")))


def substring_before(s: Value, p: Value) -> Value:
    at = F.instr(s.string, p.string)
    return string(F.when(at > 1, F.substr(s.string, F.lit(1), (at - 1).cast("int"))).otherwise(""))


def substring_after(s: Value, p: Value) -> Value:
    at = F.instr(s.string, p.string)
    return string(F.when(F.length(p.string) == 0, s.string).when(at > 0, F.substr(s.string, (at + F.length(p.string)).cast("int"))).otherwise(""))


def normalize_space(s: Value) -> Value:
    return string(F.trim(F.regexp_replace(s.string, "[ \t\r\n]+", " ")))


def _pattern(picture: str, group: str, point: str) -> tuple[str, str, int, int, int, int, str]:
    """prefix, suffix, least and most fraction digits, least integer digits, group size, multiplier of a number picture."""
    m = re.search(rf"[#0{re.escape(group)}{re.escape(point)}]+", picture)
    body = m.group() if m else "#"
    prefix, suffix = (picture[: m.start()], picture[m.end() :]) if m else (picture, "")
    whole, _, part = body.partition(point)
    size = len(whole) - whole.rindex(group) - 1 if group in whole else 0
    scale = "percent" if "%" in prefix + suffix else "permille" if "‰" in prefix + suffix else ""
    return prefix, suffix, part.count("0"), len(part), whole.replace(group, "").count("0"), size, scale


def format_number(x: Value, picture: str, symbols: dict | None = None) -> Value:
    """Number by a picture (``#,##0.00``, ``%``, and ``;`` for negatives); halves are rounded to even digits."""
    sym = {"decimal-separator": ".", "grouping-separator": ",", "zero-digit": "0", "digit": "#", "minus-sign": "-", "NaN": "NaN", "infinity": "Infinity", "percent": "%", "pattern-separator": ";"} | (symbols or {})
    picture = picture.replace(sym["digit"], "#").replace(sym["zero-digit"], "0")
    positive, _, negative = picture.partition(sym["pattern-separator"])
    value = x.number
    prefix, suffix, least, most, digits, size, scale = _pattern(positive, sym["grouping-separator"], sym["decimal-separator"])
    magnitude = F.abs(value) * {"percent": 100, "permille": 1000, "": 1}[scale]
    exact = F.bround(F.when(F.isnan(magnitude) | (magnitude >= 1e19), None).otherwise(magnitude).cast("decimal(38,17)"), most)
    text = exact.cast(f"decimal(38,{most})").cast("string")
    whole = F.split_part(text, F.lit("."), F.lit(1))
    whole = F.lpad(F.when((whole == "0") & F.lit(digits == 0), "").otherwise(whole), F.greatest(F.length(whole), F.lit(digits)).cast("int") if digits else F.length(F.when(whole == "0", "").otherwise(whole)), F.lit("0"))
    if size:
        whole = F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(whole), f"(.{{{size}}})", f"$1{sym['grouping-separator']}"), f"{re.escape(sym['grouping-separator'])}$", ""))
    part = F.split_part(text, F.lit("."), F.lit(2)) if most else F.lit("")
    if most > least:
        part = F.regexp_replace(part, rf"0{{0,{most - least}}}$", "")
    body = F.concat(whole, F.when(F.length(part) > 0, F.concat(F.lit(sym["decimal-separator"]), part)).otherwise(""))
    body = F.when(body == "", "0").otherwise(body)
    if sym["zero-digit"] != "0":
        body = F.translate(body, "0123456789", "".join(chr(ord(sym["zero-digit"]) + i) for i in range(10)))
    if negative:
        neg_prefix, neg_suffix = _pattern(negative, sym["grouping-separator"], sym["decimal-separator"])[:2]
        signed = F.when(value < 0, F.concat(F.lit(neg_prefix), body, F.lit(neg_suffix))).otherwise(F.concat(F.lit(prefix), body, F.lit(suffix)))
    else:
        signed = F.concat(F.when(value < 0, sym["minus-sign"]).otherwise(""), F.lit(prefix), body, F.lit(suffix))
    infinite = F.concat(F.when(value < 0, sym["minus-sign"]).otherwise(""), F.lit(prefix + sym["infinity"] + suffix))
    return string(F.when(F.isnan(value), sym["NaN"]).when(F.abs(value) == float("inf"), infinite).otherwise(signed))


def url_encode(s: Value) -> Value:
    """Percent-encoding of all UTF-8 bytes but letters, digits and ``-._~``."""
    return string(F.replace(F.replace(F.replace(F.url_encode(s.string), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))


def str_escape(s: Value, mode: str = "js") -> Value:
    """For scripts: quotes, backslash and slash get a backslash, line ends become ``\\n``; or for URLs."""
    if mode == "url":
        return url_encode(s)
    return string(F.regexp_replace(F.regexp_replace(s.string, r"""(["'\\/])""", r"\\$1"), "[\r\n]", r"\\n"))


def plural_index(language: str, n: Column) -> Column:
    """Index of the plural form of n."""
    ten, hundred = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    few = (ten >= 2) & (ten <= 4) & ((hundred < 10) | (hundred >= 20))
    if language in ("ru", "uk"):
        return F.when((ten == 1) & (hundred != 11), 0).when(few, 1).otherwise(2)
    if language == "pl":
        return F.when(n == 1, 0).when(few, 1).otherwise(2)
    return F.when(n != 1, 1).otherwise(0)


def substitute(text: Column, pairs: list[tuple[str, Column]]) -> Column:
    """Replace ``{name}`` by its value, for each pair."""
    for name, value in pairs:
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    return text


def _concat(*args: Value) -> Value:
    return string(F.concat(*(a.string for a in args)))


def _total(*args: Value) -> Value:
    out = args[0].number
    for a in args[1:]:
        out = out + a.number
    return num(out)


#: Name -> function of Values. Node functions (count, sum, position, key, ...) belong to the compilers.
REGISTRY: dict[str, Callable[..., Value]] = {
    "string": lambda x: string(x.string),
    "concat": _concat,
    "substring": substring,
    "substring-before": substring_before,
    "substring-after": substring_after,
    "contains": lambda s, p: boolean(F.contains(s.string, p.string)),
    "starts-with": lambda s, p: boolean(F.startswith(s.string, p.string)),
    "string-length": lambda s: num(F.char_length(s.string).cast("double")),
    "normalize-space": normalize_space,
    "translate": lambda s, a, b: string(F.call_function("translate", s.string, a.string, b.string)),
    "number": lambda x: num(x.number),
    "round": lambda x: num(_rounded(x.number)),
    "floor": lambda x: num(F.when(F.isnan(x.number) | (F.abs(x.number) > 1e15), x.number).otherwise(F.floor(x.number).cast("double"))),
    "ceiling": lambda x: num(F.when(F.isnan(x.number) | (F.abs(x.number) > 1e15), x.number).otherwise(F.ceil(x.number).cast("double"))),
    "boolean": lambda x: boolean(x.boolean),
    "not": lambda x: boolean(~x.boolean),
    "true": lambda: boolean(F.lit(True)),
    "false": lambda: boolean(F.lit(False)),
    "local-name": lambda s: string(F.substring_index(s.string, ":", -1)),
    "ltr:url_encode": url_encode,
    "ltr:md5_hex": lambda *a: string(F.md5(F.concat(*(x.string for x in a)))),
    "ltr:encode_base64": lambda x: string(F.replace(F.base64(F.encode(x.string, "utf-8")), F.lit("\r\n"), F.lit(""))),  # Spark breaks lines at 76 characters
    "ltr:baner_code": lambda *a: string(F.lit(None).cast("string")),
    "ltr:existsOnHost": lambda *a: num(F.lit(1.0)),
    "ltr:thread-id": lambda: num(F.spark_partition_id().cast("double")),
    "system-property": lambda x: string(F.lit(None).cast("string")),
}

"""The engine: one object that holds a session, host functions, rights, URL settings and catalogues."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import Value, plural_index, string
from .operators.schema import NODE_COLUMNS
from .plans.nodes import NodeDocuments
from .plans.rows import RowDocuments
from .plans.stylesheet import Environment, Stylesheet
from .sources.memo import Memo
from .sources.messages import language_of, message_frame, parse_messages
from .sources.shred import from_string, read_files, shred


@dataclass
class Engine:
    spark: SparkSession
    functions: dict[str, Callable] = field(default_factory=dict)
    revisions: dict[str, str] = field(default_factory=dict)
    url_prefix: str = ""
    cache_prefix: str = ""
    url_parameters: dict[str, str] = field(default_factory=dict)
    rights: list[tuple[str, str, str]] = field(default_factory=list)
    user_groups: list[tuple[str, str]] = field(default_factory=list)
    messages: dict[str, list[str]] = field(default_factory=dict)
    parameters: dict[str, str] = field(default_factory=dict)
    url_callback: Callable[[str], str] | None = None
    memo: Memo = field(default_factory=Memo)
    documents: dict[str, str] = field(default_factory=dict)

    # documents

    def parse(self, text: str, doc_id: str = "", kind: str = "xml") -> DataFrame:
        return from_string(self.spark, text, doc_id, kind)

    def parse_files(self, path: str, kind: str = "xml") -> DataFrame:
        return read_files(self.spark, path, kind)

    def shred(self, docs: DataFrame, key: str, text: str, kind: str = "xml") -> DataFrame:
        return shred(docs, key, text, kind)

    def xpath(self, nodes: DataFrame, path: str) -> DataFrame:
        """Node rows that a path selects from the document nodes."""
        return self.nodes(nodes).find(path)

    def nodes(self, nodes: DataFrame, **settings) -> NodeDocuments:
        return NodeDocuments(nodes, functions=self._columns(), **settings)

    def rows(self, tables: dict[str, DataFrame], order: dict[str, list[str]], **settings) -> RowDocuments:
        return RowDocuments(tables, order, functions=self._columns(), **settings)

    def string_value(self, nodes: DataFrame) -> DataFrame:
        return NodeDocuments(nodes).strings(nodes).select(*NODE_COLUMNS, "sv")

    def attributes(self, nodes: DataFrame) -> DataFrame:
        """(doc_id, node_id, attributes as a map) of every element that has some."""
        a = nodes.filter("kind = 'attribute'").groupBy("doc_id", F.col("parent_id").alias("node_id"))
        return a.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("attributes"))

    # stylesheets

    def compile(self, path: str) -> Stylesheet:
        return Stylesheet.from_file(path)

    def transform(self, sheet: Stylesheet, docs: DataFrame, key: str, text: str, params: dict | None = None, kind: str = "xml") -> DataFrame:
        return sheet.transform(docs, key, text, {**self.parameters, **(params or {})}, self.environment(), kind)

    def environment(self) -> Environment:
        from .plans.evaluate import string as text_of

        actions, revisions, prefix, messages = self.actions(), self.revisions, self.url_prefix, self.messages
        language, callback, memo = language_of(messages), self.url_callback, {}
        parameters, cache_prefix = dict(self.url_parameters), self.cache_prefix

        def static(url: str) -> str:
            return "/static/" + url + (f"?{revisions[url]}" if url in revisions else "")

        def code(*args: str) -> str:
            key = cache_prefix + url_key(args, parameters)
            if not args or callback is None:
                return "/"
            if key not in memo:
                memo[key] = callback(key)
            return memo[key]

        def pairs(text: str, rest) -> str:
            for name, value in zip(rest[::2], rest[1::2]):
                text = text.replace(f"{{{name}}}", value)
            return text

        def one(msgid: str, *rest: str) -> str:
            return pairs((messages.get(msgid) or [""])[0] or msgid, rest)

        def many(msgid: str, plural: str, n: str, *rest: str) -> str:
            forms, k = messages.get(msgid) or [], plural_form(language, int(float(n)))
            return pairs(forms[k] if k < len(forms) and forms[k] else (msgid if n == "1" else plural), rest)

        built = {
            "ltr:veristat": static, "ltr:veristat_local": lambda url: prefix + static(url), "ltr:url_code": code,
            "ltr:__l": one, "ltr:__ln": many,
        }
        return Environment({**built, **self.functions}, {"chk:check_rights": lambda a, c: text_of(a[0]) in actions}, self.documents)

    # host functions

    def register(self, name: str, function: Callable[..., str]) -> None:
        """A host function of strings; it comes before a built-in of the same name."""
        self.functions[name] = function

    def _columns(self) -> dict[str, Callable]:
        """Host functions and settings as functions of Values; Python functions run as Arrow batches."""
        own: dict[str, Callable] = {
            "ltr:veristat": lambda url: string(self.static_url(url.string)),
            "ltr:veristat_local": lambda url: string(F.concat(F.lit(self.url_prefix), self.static_url(url.string))),
            "chk:check_rights": lambda action: Value(action.string.isin(sorted(self.actions())) if self.actions() else F.lit(False), "boolean"),
            "ltr:__l": lambda msgid, *rest: string(self._filled(self._translated(msgid.string, 0, msgid.string), rest)),
            "ltr:__ln": self._plural,
            "ltr:url_code": self._url_code,
        }
        for name, f in self.functions.items():
            own[name] = _as_column(f)
        return own

    def _translated(self, msgid: Column, form: Column | int, otherwise: Column) -> Column:
        """A message's form, or ``otherwise`` where the catalogue has none."""
        known = {k: v for k, v in self.messages.items() if k and any(v)}
        if not known:
            return otherwise
        at = form if isinstance(form, Column) else F.lit(form)
        forms = _looked_up({k: tuple(v) for k, v in known.items()}, msgid, at)
        return F.coalesce(F.nullif(forms, F.lit("")), otherwise)

    def _plural(self, msgid: Value, plural: Value, n: Value, *rest: Value) -> Value:
        count = F.floor(n.number).cast("long")
        form = plural_index(language_of(self.messages), count)
        return string(self._filled(self._translated(msgid.string, form, F.when(count == 1, msgid.string).otherwise(plural.string)), rest))

    @staticmethod
    def _filled(text: Column, rest) -> Column:
        """``{name}`` replaced by values; ``rest`` is name, value, name, value ..."""
        for name, value in zip(rest[::2], rest[1::2]):
            text = F.replace(text, F.concat(F.lit("{"), name.string, F.lit("}")), value.string)
        return text

    def _url_code(self, *args: Value) -> Value:
        """The callback's URL for the arguments' key, called once per distinct key of a batch and remembered by the worker."""
        if not args or self.url_callback is None:
            return string(F.lit("/"))
        parameters = dict(self.url_parameters)
        parts = []
        for a in args:
            value = F.lit(None).cast("string")
            for name, text in parameters.items():
                value = F.when(F.substr(a.string, F.lit(2)) == name, F.lit(f"{name},{text}")).otherwise(value)
            parts.append(F.when(F.startswith(a.string, F.lit("-")), F.coalesce(value, F.lit(""))).otherwise(a.string))
        return _as_column(self.url_callback)(string(F.concat(F.lit(self.cache_prefix), F.concat_ws(",", *parts))))

    # settings

    def set_url_parameter(self, name: str, value: str) -> None:
        """``-name`` among the arguments of a URL code stands for ``name,value`` from now on."""
        self.url_parameters[name] = value

    def reset_url_parameters(self) -> None:
        self.url_parameters.clear()

    def add_revision(self, url: str, revision: str) -> None:
        self.revisions[url] = revision

    def static_url(self, url: Column) -> Column:
        """``/static/`` + url, with ``?revision`` where one is known."""
        if not self.revisions:
            return F.concat(F.lit("/static/"), url)
        revision = _looked_up({k: (v,) for k, v in self.revisions.items()}, url, F.lit(0))
        return F.concat(F.lit("/static/"), url, F.coalesce(F.concat(F.lit("?"), revision), F.lit("")))

    def with_revisions(self, rows: DataFrame, url: str, revisions: DataFrame, out: str, same: Sequence[str] = ()) -> DataFrame:
        """The same for a table of revisions (url, revision) of any size: a left join, one row for each of ``rows``.

        A revision holds for rows that also agree in the columns ``same``; of several for one url the greatest is taken, a
        null one is none.
        """
        keys = ["url", *same]
        r = revisions.filter("revision is not null").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("revision").alias("_revision"))
        on = F.col(url) == F.col("_url")
        for k in same:
            on = on & (F.col(k) == F.col(f"_{k}"))
        return rows.join(r, on, "left").withColumn(out, F.concat(F.lit("/static/"), F.col(url), F.coalesce(F.concat(F.lit("?"), "_revision"), F.lit("")))).drop("_revision", *(f"_{k}" for k in keys))

    def define_rights(self, library: str, group: str, actions: list[str]) -> None:
        self.rights += [(library, group, a) for a in actions]

    def set_user(self, library: str, groups: list[str]) -> None:
        self.user_groups = [(library, g) for g in groups]

    def actions(self) -> set[str]:
        mine = set(self.user_groups)
        return {a for lib, g, a in self.rights if (lib, g) in mine}

    def load_messages(self, text: str) -> DataFrame:
        self.messages = parse_messages(text)
        return message_frame(self.spark, self.messages)

    def url_codes(self, rows: DataFrame, parts: list[str], out: str) -> DataFrame:
        """Add ``out``: the callback's URL for the comma-joined parts, computed once per distinct key. A part is a column, or
        ``-name`` for a URL parameter."""
        if self.url_callback is None:
            return rows.withColumn(out, F.lit("/"))
        own = [F.lit(url_key([p], self.url_parameters)) if p.startswith("-") else F.col(p) for p in parts]
        keyed = rows.withColumn("_url_key", F.concat(F.lit(self.cache_prefix), F.concat_ws(",", *own)))
        return self.memo.apply(keyed, "_url_key", out, self.url_callback).drop("_url_key")


def url_key(args, parameters: dict[str, str]) -> str:
    """Arguments joined by commas; ``-name`` stands for ``name,value`` of a URL parameter, or nothing."""
    out = []
    for a in args:
        if a.startswith("-"):
            value = parameters.get(a[1:])
            out.append(f"{a[1:]},{value}" if value is not None else "")
        else:
            out.append(a)
    return ",".join(out)


def plural_form(language: str, n: int) -> int:
    """Index of the plural form of n (see ``functions.scalars.plural_index``)."""
    ten, hundred = n % 10, n % 100
    few = 2 <= ten <= 4 and not 10 <= hundred < 20
    if language in ("ru", "uk"):
        return 0 if ten == 1 and hundred != 11 else 1 if few else 2
    if language == "pl":
        return 0 if n == 1 else 1 if few else 2
    return int(n != 1)


#: Entries that may stand in a plan as a literal map; a larger table is sent to the workers once.
LITERALS = 500


def _looked_up(table: dict[str, tuple[str, ...]], key: Column, at: Column) -> Column:
    """Text ``at`` of the key's entry, null where there is none."""
    if len(table) <= LITERALS:
        entries = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        return F.try_element_at(F.try_element_at(entries, key), (at + 1).cast("int"))
    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    sent = SparkSession.active().sparkContext.broadcast(table)

    def batch(keys, places):
        found = (sent.value.get(k, ()) for k in keys)
        return pd.Series([f[i] if i < len(f) else None for f, i in zip(found, places)], dtype=object)

    batch.__annotations__ = {}
    return pandas_udf(batch, "string", PandasUDFType.SCALAR)(key, at.cast("int"))


def _as_column(function: Callable[..., str]) -> Callable[..., Value]:
    """A host function over Arrow batches, called once per distinct combination of arguments in a batch."""
    import pandas as pd

    def apply(*args: Value) -> Value:
        def batch(*cols):
            known: dict[tuple, str] = {}
            out = []
            for row in zip(*cols):
                key = tuple("" if x is None else x for x in row)
                if key not in known:
                    known[key] = function(*key)
                out.append(known[key])
            return pd.Series(out)

        batch.__annotations__ = {}
        from pyspark.sql.functions import PandasUDFType, pandas_udf

        return string(pandas_udf(batch, "string", PandasUDFType.SCALAR)(*(a.string for a in args)))

    return apply

"""Path expressions over flat tables as documents ``/table/row/column``: compiled to plain DataFrame plans.

A row's child elements are its columns; a null column is an absent element. Predicates become filters, absolute paths in
predicates semi- or anti-joins, ``key()`` an equi-join, aggregates over keyed rows one grouped aggregate joined back.
``position()`` numbers blocks of the table's order and adds the blocks' sizes up; siblings are lags, leads and running
frames within their group; "first row of its value" and grouping by ``generate-id`` are aggregates; ``current()`` in a nested
path is a join. No expression runs row by row in Python.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import REGISTRY, Value, boolean, format_number, num, str_escape, string
from ..functions.values import NUMERIC, compare, divide, kind_of, modulo, to_string
from .ast import SIBLING_AXES, Bin, Call, Neg, Num, Path, Str, UnsupportedPath, Var, calls
from .parser import parse

#: Blocks a table's order is cut into for positions: the rows of the table of their sizes.
BLOCKS = 64
#: Rows of a block of running totals over a whole table.
ROWS = 4096
_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}


@dataclass
class RowDocuments:
    """Tables by name with the columns that give their document order; keys, variables and own functions by name."""

    tables: dict[str, DataFrame]
    order: dict[str, list[str]]
    keys: dict[str, tuple[str, str]] = field(default_factory=dict)  # key name -> (table, use column)
    variables: dict[str, Value] = field(default_factory=dict)
    functions: dict[str, object] = field(default_factory=dict)
    formats: dict[str, dict] = field(default_factory=dict)

    def select(self, path: str, columns: dict[str, str] | None = None, sort: list[tuple[str, str, str]] | None = None, limit: int | None = None) -> DataFrame:
        """Rows of ``path``; ``columns`` maps output names to expressions evaluated at each row.

        An expression may be a choice: a list of (test, expression), of which the first true test decides; a test of None
        is true. ``sort`` is a list of (expression, "text" or "number", "ascending" or "descending"), first key first; ties keep
        document order. ``limit`` keeps the first rows.
        """
        rows, leaf = self.rows(parse(path))
        return self._output(rows, leaf, columns, sort, limit)

    def for_each(self, outer: str, inner: str, columns: dict[str, str], sort: list[tuple[str, str, str]] | None = None, limit: int | None = None) -> DataFrame:
        """Rows of ``inner`` for each row of ``outer``, to which ``current()`` points in predicates and columns.

        Equalities of a column with one of ``current()`` make an equi-join, other predicates with ``current()`` filter it.
        """
        up, _ = self.rows(parse(outer))
        e = parse(inner)
        table = self._table(e)
        down, pairs, rest = _Rows(self, table, self.tables[table], outer=up), [], []
        for p in itertools.chain.from_iterable(map(conjuncts, e.steps[1].predicates)):
            pair = down.paired(p)
            if pair is not None:
                pairs.append(pair)
            elif mentions_current(p):
                rest.append(p)
            else:
                down.filter(p)
        other = up.frame.select(*(F.col(c).alias(f"_o_{c}") for c in up.frame.columns))
        down.frame = down.frame.join(other, [F.col(mine) == F.col(f"_o_{its}") for mine, its in pairs]) if pairs else down.frame.join(other, F.lit(True))
        down.whole = False
        for p in rest:
            down.filter(p)
        return self._output(down, None, columns, sort, limit)

    def _output(self, rows: _Rows, leaf: str | None, columns, sort, limit) -> DataFrame:
        compiled = {name: rows.output(parse(text) if isinstance(text, str) else text).alias(name) for name, text in (columns or {}).items()}
        if sort is not None or limit is not None:
            keys = []
            for text, kind, direction in sort or []:
                v = rows.compile(parse(text))
                key = F.lower(v.string) if kind == "text" else F.when(~F.isnan(v.number), v.number)
                keys.append(key.asc_nulls_first() if direction == "ascending" else key.desc_nulls_last())
            rows.frame = rows.frame.orderBy(*keys, *self.order[rows.table])
            if limit is not None:
                rows.frame = rows.frame.limit(limit)
        if columns is None:
            return rows.frame.select(leaf) if leaf else rows.frame.select(self.tables[rows.table].columns)
        return rows.frame.select(*compiled.values())

    def rows(self, e) -> tuple[_Rows, str | None]:
        if isinstance(e, Bin) and e.op == "|":
            (a, leaf), (b, other) = self.rows(e.left), self.rows(e.right)
            if a.table != b.table or leaf != other:
                raise UnsupportedPath("a union takes rows of one table")
            cols = self.tables[a.table].columns
            a.frame = a.frame.select(cols).unionByName(b.frame.select(cols)).dropDuplicates(self.order[a.table])
            return a, leaf
        table = self._table(e)
        out = _Rows(self, table, self.tables[table])
        for p in e.steps[1].predicates:
            out.filter(p)
        return out, (e.steps[2].test.name if len(e.steps) == 3 else None)

    def _table(self, e) -> str:
        """The table a row path starts in: ``/table/row``, or ``document('table')/table/row``."""
        if not isinstance(e, Path) or not absolute_start(e) or len(e.steps) not in (2, 3):
            raise UnsupportedPath("a row path is /table/row or /table/row/column")
        table = e.steps[0].test.name
        if table not in self.tables or e.steps[1].test.name != "row" or (e.start != "root" and e.start.args[0].value != table):
            raise UnsupportedPath(f"no table {table!r}")
        return table


@dataclass
class _Rows:
    docs: RowDocuments
    table: str
    frame: DataFrame
    outer: _Rows | None = None
    names: object = field(default_factory=itertools.count)
    whole: bool = True  # the frame still has every row of the table
    siblings: _Siblings | None = None  # sibling columns that the frame got last

    def fresh(self) -> str:
        return f"_x{next(self.names)}"

    # predicates

    def filter(self, p) -> None:
        if isinstance(p, Bin) and p.op == "and" and not calls(p, {"position", "last"}):
            self.filter(p.left)
            self.filter(p.right)
            return
        if self._first_of_value(p) or self._set_idiom(p) or self._first_rows(p):
            return
        negated = isinstance(p, Call) and p.name == "not"
        inner = p.args[0] if negated else p
        if self._joined(inner, "left_anti" if negated else "left_semi"):
            return
        v = self.compile(p)
        if v.kind == "number":
            v = boolean(compare("=", v.col, self.position()))
        self.frame = self.frame.filter(v.col if v.kind == "boolean" else v.boolean)  # an unknown condition drops the row
        self.whole = False

    def _first_of_value(self, p) -> bool:
        """Predicates that take the first row of each value of a column: one aggregate, no pairs of rows.

        ``not(c = preceding::row/c)`` (or preceding-sibling), which also takes rows without c, and
        ``generate-id(.) = generate-id(key(k, c)[1])`` for a key of this table by c.
        """
        column, absent = self._not_seen_before(p), True
        if column is None:
            column, absent = self._first_by_key(p), False
        if column is None:
            return False
        full, order = self.docs.tables[self.table], self._order()
        if self.whole and self.frame is full:
            rest = [c for c in full.columns if c not in order]
            first = full.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.min(F.struct(*order, *rest)).alias("_row"))
            self.frame = first.select("_row.*").select(full.columns)
            if absent:
                self.frame = self.frame.unionByName(full.filter(F.col(column).isNull()))
        else:
            first = full.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.min(F.struct(*order)).alias("_first")).select("_first")
            known = self.frame.filter(F.col(column).isNotNull()).join(first, F.struct(*order) == F.col("_first"), "left_semi")
            self.frame = known.unionByName(self.frame.filter(F.col(column).isNull())) if absent else known
        self.whole = False
        return True

    def _not_seen_before(self, p) -> str | None:
        e = p.args[0] if isinstance(p, Call) and p.name == "not" else None
        if isinstance(e, Bin) and e.op == "=" and self.bare(e.left) and isinstance(e.right, Path) and e.right.start is None and len(e.right.steps) == 2:
            row, leaf = e.right.steps
            if row.axis in ("preceding", "preceding-sibling") and row.test.name == "row" and not row.predicates and leaf.test == e.left.steps[0].test:
                return leaf.test.name
        return None

    def _first_by_key(self, p) -> str | None:
        if not (isinstance(p, Bin) and p.op == "=" and all(isinstance(x, Call) and x.name == "generate-id" for x in (p.left, p.right))):
            return None
        e = p.right.args[0] if p.right.args else None
        if not (isinstance(e, Path) and isinstance(e.start, Call) and e.start.name == "key" and not e.steps and e.predicates == (Num(1.0),)):
            return None
        table, use = self.docs.keys[e.start.args[0].value]
        own = not p.left.args or is_self(p.left.args[0])
        return use if own and table == self.table and self.bare(e.start.args[1]) and e.start.args[1].steps[0].test.name == use else None

    def _set_idiom(self, p) -> bool:
        """``count(. | path) = count(path)``: the row is among the path's rows; ``!=``: it is not. A semi- or anti-join."""
        if not (isinstance(p, Bin) and p.op in ("=", "!=") and all(isinstance(x, Call) and x.name == "count" and len(x.args) == 1 for x in (p.left, p.right))):
            return False
        both, other = p.left.args[0], p.right.args[0]
        if not (isinstance(both, Bin) and both.op == "|" and is_self(both.left) and both.right == other):
            return False
        rows, leaf = self.docs.rows(other)
        if rows.table != self.table or leaf is not None:
            raise UnsupportedPath("rows are compared with rows of their own table")
        order = self._order()
        self.frame = self.frame.join(rows.frame.select(order), order, "left_semi" if p.op == "=" else "left_anti")
        self.whole = False
        return True

    def _first_rows(self, p) -> bool:
        """``[n]``, ``position() <= n``, ``position() = last()``: the first or last rows in order, no numbering."""
        if isinstance(p, Call) and p.name == "last" and not p.args:
            p = Bin("=", Call("position", ()), p)
        if isinstance(p, Bin) and p.left == Call("position", ()):
            if p.op == "=" and p.right == Call("last", ()):
                self.frame = self.frame.orderBy(*(F.desc(c) for c in self._order())).limit(1)
                self.whole = False
                return True
            if p.op in ("<", "<=") and isinstance(p.right, Num):
                n = math.ceil(p.right.value) - 1 if p.op == "<" else math.floor(p.right.value)
                self.frame = self.frame.orderBy(*self._order()).limit(max(n, 0))
                self.whole = False
                return True
        return False

    def paired(self, p) -> tuple[str, str] | None:
        """(column here, column of ``current()``) of an equality whose sides have one kind, for an equi-join."""
        if isinstance(p, Bin) and p.op == "=":
            for a, b in ((p.left, p.right), (p.right, p.left)):
                if self.bare(a) and is_current(b):
                    mine, its = a.steps[0].test.name, b.steps[0].test.name
                    kinds = [dict(f.dtypes).get(c) for f, c in ((self.frame, mine), (self.outer.frame, its))]
                    if None not in kinds and kind_of(kinds[0]) == kind_of(kinds[1]) and not {"float", "double"} & set(kinds):
                        return mine, its
        return None

    def _joined(self, e, how: str) -> bool:
        """Existence tests against another table: ``column = /table/row/column`` and ``key(name, column)``."""
        if isinstance(e, Path) and not e.steps and isinstance(e.start, Call) and not e.predicates:
            e = e.start
        if isinstance(e, Call) and e.name == "key":
            table, use = self.docs.keys[e.args[0].value]
            mine, other = self.compile(e.args[1]).col, self.docs.tables[table].select(F.col(use).alias("_use"))
        elif isinstance(e, Bin) and e.op == "=" and self.absolute(e.right):
            rows, leaf = self.docs.rows(e.right)
            mine, other = self.compile(e.left).col, rows.frame.select(F.col(leaf).alias("_use"))
        else:
            return False
        name = self.fresh()
        self.frame = self.frame.withColumn(name, mine).join(other, F.col(name) == F.col("_use"), how).drop(name)
        self.whole = False
        return True

    def absolute(self, e) -> bool:
        return isinstance(e, Path) and absolute_start(e) and len(e.steps) == 3

    # positions

    def _order(self) -> list[str]:
        return self.docs.order[self.table]

    def position(self) -> Column:
        """Place of each row: its place within a block of the order, and the sizes of the blocks before."""
        name = self.fresh()
        self.frame = numbered(self.frame, self._order(), name)
        return F.col(name)

    def beside(self, step, leaf: str, how: str) -> Value:
        """A sibling's column (``how`` "value") or ``count``/``sum`` of all siblings on one side.

        Predicates ``c = current()/c`` name the group; a number takes the n-th nearest. Siblings are rows of the whole table,
        so for a filtered frame the window runs over the table and is joined back by its order.
        """
        group, place = [], None
        for p in step.predicates:
            same = p.left.steps[0].test.name if isinstance(p, Bin) and p.op == "=" and self.bare(p.left) and is_current(p.right) else None
            if same is not None and p.right.steps[0].test.name == same and place is None:
                group.append(same)
            elif isinstance(p, Num) and place is None:
                place = int(p.value)
            else:
                raise UnsupportedPath(f"cannot use {p} among siblings")
        if step.test.name not in ("row", None) or place is not None and how != "value":
            raise UnsupportedPath(f"cannot use {step} among siblings")
        full, order, name, before = self.docs.tables[self.table], self._order(), self.fresh(), step.axis in ("preceding-sibling", "preceding")
        kind = kind_of(dict(full.dtypes)[leaf])
        value = to_double(F.col(leaf)) if kind == "number" else F.col(leaf)
        if self.siblings is None or self.siblings.joined is not self.frame:  # what was added just before shares table and join
            self.siblings = _Siblings(self.frame, self.frame if self.whole else full, order)
        s = self.siblings
        if group:
            forward = Window.partitionBy(*group).orderBy(*order)
            if how == "value":
                nearest = (F.lag if before else F.lead)(value, place or 1).over(forward)
                s.wide = s.wide.withColumn(name, nearest if place or not before else F.first(value).over(side(group, order, before)))
            else:
                total = (F.count(F.col(leaf)) if how == "count" else F.sum(value)).over(side(group, order, before))
                s.wide = s.wide.withColumn(name, F.coalesce(total.cast("double"), F.lit(0.0)))
        elif how == "value":
            if not place and before:
                raise UnsupportedPath("of all rows before, name one by its place")
            s.near(name, value, place or 1, before)
        else:
            s.total(name, leaf, value, how, before)
        s.names.append(name)
        if self.whole:
            self.frame = s.wide
        else:
            self.frame = s.start.join(s.wide.select(*order, *s.names), order)
        s.joined = self.frame
        return num(F.col(name)) if how != "value" or kind == "number" else Value(F.col(name), kind)

    def last(self) -> Column:
        name = self.fresh()
        self.frame = self.frame.crossJoin(F.broadcast(self.frame.agg(F.count("*").cast("double").alias(name))))  # one row
        return F.col(name)

    # expressions

    def output(self, e) -> Column:
        """An expression as a result column: a bare column keeps its own type."""
        if isinstance(e, list):
            return self.choice(e)
        if self.bare(e) and e.steps[0].test.name in self.frame.columns:
            return F.col(e.steps[0].test.name)
        if self.outer is not None and is_current(e) and f"_o_{e.steps[0].test.name}" in self.frame.columns:
            return F.col(f"_o_{e.steps[0].test.name}")
        return self.compile(e).col

    def choice(self, arms: list[tuple[str | None, str]]) -> Column:
        """``choose``: the expression of the first true test."""
        out = None
        for test, text in arms:
            value = self.output(parse(text))
            if test is None:
                return value if out is None else out.otherwise(value)
            v = self.compile(parse(test))
            holds = v.col if v.kind == "boolean" else v.boolean
            out = F.when(holds, value) if out is None else out.when(holds, value)
        return out

    @staticmethod
    def bare(e) -> bool:
        return isinstance(e, Path) and e.start is None and len(e.steps) == 1 and e.steps[0].axis in ("child", "attribute") and not e.steps[0].predicates

    def compile(self, e) -> Value:
        if isinstance(e, Num):
            return num(F.lit(e.value))
        if isinstance(e, Str):
            return string(F.lit(e.value))
        if isinstance(e, Var):
            return self.docs.variables[e.name]
        if isinstance(e, Neg):
            return num(-self.compile(e.arg).number)
        if isinstance(e, Bin):
            return self.binary(e)
        if isinstance(e, Path):
            return self.path(e)
        return self.call(e)

    def path(self, e: Path) -> Value:
        if e.start is None and len(e.steps) == 1 and e.steps[0].axis in ("child", "attribute"):
            return self.column(e.steps[0].test.name)
        if is_current(e):
            return self.column(f"_o_{e.steps[0].test.name}" if self.outer is not None else e.steps[0].test.name)
        if e.start is None and len(e.steps) == 2 and e.steps[0].axis in SIBLING_AXES:
            return self.beside(e.steps[0], e.steps[1].test.name, "value")
        if is_self(e):
            return self.text()
        if isinstance(e.start, Call) and e.start.name == "exsl:node-set":
            return self.path(Path(e.start.args[0], e.steps, e.predicates) if not isinstance(e.start.args[0], Path) else Path(e.start.args[0].start, (*e.start.args[0].steps, *e.steps), (*e.start.args[0].predicates, *e.predicates)))
        if isinstance(e.start, Call) and e.start.name == "key" and len(e.steps) == 1:
            return self.keyed(e.start, e.steps[0].test.name, e.predicates)
        if self.absolute(e):  # the first node in document order
            rows, leaf = self.docs.rows(e)
            name = self.fresh()
            one = rows.frame.orderBy(*self.docs.order[rows.table]).select(F.col(leaf).alias(name)).limit(1)
            self.frame = self.frame.join(F.broadcast(one), how="left")  # one row
            return Value(F.col(name), kind_of(dict(one.dtypes)[name]))
        if e.start is not None and e.start != "root" and not e.steps and not e.predicates:
            return self.compile(e.start)
        raise UnsupportedPath(f"cannot use {e} at a row")

    def text(self) -> Value:
        """String value of the row: its columns' strings in a row."""
        types = dict(self.docs.tables[self.table].dtypes)
        return string(F.concat(*(F.coalesce(self.column(c).string if kind_of(t) == "string" else to_string(F.col(c), t), F.lit("")) for c, t in types.items())))

    def column(self, name: str) -> Value:
        types = dict(self.frame.dtypes)
        if name not in types:
            return string(F.lit(None).cast("string"))
        kind = kind_of(types[name])
        if kind == "number":
            return num(F.col(name).cast("double"))
        return Value(F.col(name) if types[name] in ("string", "boolean") else to_string(F.col(name), types[name]), kind)

    def keyed(self, call: Call, leaf: str, predicates: tuple = ()) -> Value:
        """Column of the first row (document order) that a key finds, of the last with ``[last()]``, of the n-th with ``[n]``:
        an equi-join with one row per key value."""
        table, use = self.docs.keys[call.args[0].value]
        other, order, name, at = self.docs.tables[table], self.docs.order[table], self.fresh(), self.fresh()
        if len(predicates) > 1 or predicates and not (isinstance(predicates[0], Num) or predicates[0] == Call("last", ())):
            raise UnsupportedPath("of a key's rows one is taken by its place")
        n = predicates[0] if predicates else Num(1.0)
        row = F.struct(*order, F.col(leaf).alias("_leaf"))
        if n in (Num(1.0), Call("last", ())):
            found = other.groupBy(F.col(use).alias("_use")).agg((F.min(row) if n == Num(1.0) else F.max(row))["_leaf"].alias(name))
        else:
            place = F.row_number().over(Window.partitionBy(use).orderBy(*order))
            found = other.select(F.col(use).alias("_use"), F.col(leaf).alias(name), place.alias("_place")).filter(F.col("_place") == n.value).drop("_place")
        self.frame = self.frame.withColumn(at, self.compile(call.args[1]).col).join(found, F.col(at) == F.col("_use"), "left").drop("_use", at)
        kind = kind_of(dict(other.dtypes)[leaf])
        return num(F.col(name).cast("double")) if kind == "number" else Value(F.col(name), kind)

    def aggregate(self, e, how: str) -> Value:
        """count or sum of keyed rows, of siblings or of an absolute path: one grouped aggregate, joined back.

        The argument of a key may be another key's column: totals per value travel up through the linking table.
        """
        if isinstance(e, Path) and e.start is None and e.steps and e.steps[0].axis in SIBLING_AXES:
            leaf = e.steps[1].test.name if len(e.steps) == 2 else self._order()[0]
            return self.beside(e.steps[0], leaf, how)
        target = e.start if isinstance(e, Path) and isinstance(e.start, Call) and e.start.name == "key" else e
        name, at = self.fresh(), self.fresh()
        if isinstance(target, Call) and target.name == "key":
            table, use = self.docs.keys[target.args[0].value]
            rows = _Rows(self.docs, table, self.docs.tables[table])
            for p in getattr(e, "predicates", ()):
                rows.filter(p)
            leaf = e.steps[0].test.name if isinstance(e, Path) and e.steps else None
            got = rows.frame.groupBy(F.col(use).alias("_use")).agg(self._reduce(rows, how, leaf).alias(name))
            arg = target.args[1]
            while isinstance(arg, Path) and isinstance(arg.start, Call) and arg.start.name == "key" and len(arg.steps) == 1 and not arg.predicates:
                between, up = self.docs.keys[arg.start.args[0].value]
                links = self.docs.tables[between].select(F.col(up).alias("_up"), F.col(arg.steps[0].test.name).alias("_via")).distinct()
                got = links.join(got, F.col("_via") == F.col("_use")).groupBy("_up").agg(F.sum(name).alias(name)).withColumnRenamed("_up", "_use")
                arg = arg.start.args[1]
            self.frame = self.frame.withColumn(at, self.compile(arg).col).join(got, F.col(at) == F.col("_use"), "left").drop("_use", at)
        else:
            rows, leaf = self.docs.rows(e)
            self.frame = self.frame.join(F.broadcast(rows.frame.agg(self._reduce(rows, how, leaf).alias(name))), how="left")  # one row
        return num(F.coalesce(F.col(name), F.lit(0.0)))

    def _reduce(self, rows: _Rows, how: str, leaf: str | None) -> Column:
        if how == "count":
            return (F.count(leaf) if leaf else F.count("*")).cast("double")
        return F.sum(rows.column(leaf).number)

    def binary(self, e: Bin) -> Value:
        if e.op in ("and", "or"):
            a, b = self.compile(e.left), self.compile(e.right)
            # unknown counts as false: three-valued logic gives the same, and plain conditions reach the scan
            x, y = (v.col if v.kind == "boolean" else v.boolean for v in (a, b))
            return boolean(x & y if e.op == "and" else x | y)
        if e.op in _FLIP:
            return self.comparison(e)
        a, b = self.compile(e.left).number, self.compile(e.right).number
        if e.op == "+":
            return num(a + b)
        if e.op == "-":
            return num(a - b)
        if e.op == "*":
            return num(a * b)
        if e.op in ("div", "mod"):
            return num(divide(a, b) if e.op == "div" else modulo(a, b))
        raise UnsupportedPath(f"no {e.op!r} between values")

    def comparison(self, e: Bin) -> Value:
        if self.absolute(e.left) and not self.absolute(e.right):
            return self.comparison(Bin(_FLIP[e.op], e.right, e.left))
        if isinstance(e.left, Num) and self.bare(e.right):
            return self.comparison(Bin(_FLIP[e.op], e.right, e.left))
        if self.bare(e.left) and isinstance(e.right, (Num, Str)) and (plain := self.plain(e)) is not None:
            return boolean(plain)
        a = self.compile(e.left)
        if self.absolute(e.right):
            return self.existential(a, e.op, e.right)
        b = self.compile(e.right)
        present = F.lit(True)
        for side, v in ((e.left, a), (e.right, b)):
            if isinstance(side, Path):
                present = present & v.col.isNotNull()
        if e.op in ("=", "!=") and "boolean" in (a.kind, b.kind):
            result = a.boolean == b.boolean
            return boolean(result if e.op == "=" else ~result)
        if e.op in ("=", "!=") and "number" not in (a.kind, b.kind):
            result = F.coalesce(a.col, F.lit("")) == F.coalesce(b.col, F.lit(""))
            return boolean(present & (result if e.op == "=" else ~result))
        return boolean(present & compare(e.op, a.number, b.number))

    def plain(self, e: Bin) -> Column | None:
        """A column against a literal of its own type, as a condition the scan can check; null for an absent element."""
        name, value = e.left.steps[0].test.name, e.right.value
        kind = dict(self.frame.dtypes).get(name)
        if kind == "string" and isinstance(value, str) and e.op in ("=", "!="):
            return F.col(name) == value if e.op == "=" else F.col(name) != value
        if kind not in NUMERIC or isinstance(value, str):
            return None
        c = F.col(name)
        if kind not in ("float", "double") and value == int(value):
            value = int(value)
        result = {"=": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[e.op]
        return result & ~F.isnan(c) if kind in ("float", "double") and e.op in (">", ">=") else result

    def existential(self, a: Value, op: str, path: Path) -> Value:
        """Is there a node for which the comparison holds? By the path's extremes, in one row."""
        rows, leaf = self.docs.rows(path)
        b, lo, hi = rows.column(leaf), self.fresh(), self.fresh()
        values = b.number if op not in ("=", "!=") or b.kind == "number" else b.string
        if op == "=":
            flag = self.fresh()
            mine = a.number if b.kind == "number" else a.string
            found = rows.frame.select(values.alias("_v")).distinct().withColumn(flag, F.lit(True))
            at = self.fresh()
            self.frame = self.frame.withColumn(at, mine).join(found, F.col(at) == F.col("_v"), "left").drop("_v", at)
            return boolean(F.coalesce(F.col(flag), F.lit(False)))
        values = F.when(~F.isnan(values), values) if b.kind == "number" or op != "!=" else values
        self.frame = self.frame.join(F.broadcast(rows.frame.agg(F.min(values).alias(lo), F.max(values).alias(hi))), how="left")  # one row
        if op == "!=":
            mine = a.number if b.kind == "number" else a.string
            return boolean(F.coalesce((F.col(lo) != mine) | (F.col(hi) != mine), F.lit(False)))
        return boolean(compare(op, a.number, F.coalesce(F.col(hi if op in ("<", "<=") else lo), F.lit(float("nan")))))

    def call(self, e: Call) -> Value:
        own = self.docs.functions.get(e.name)
        if own is not None:
            return own(*(self.compile(a) for a in e.args))
        if e.name == "position":
            return num(self.position())
        if e.name == "last":
            return num(self.last())
        if e.name in ("count", "sum"):
            total = None
            for a in e.args:
                v = self.compile(a) if e.name == "sum" and self.bare(a) else self.aggregate(a, e.name)
                total = v.number if total is None else total + v.number
            return num(total)
        if e.name == "format-number":
            return format_number(self.compile(e.args[0]), e.args[1].value, self.docs.formats.get(e.args[2].value if len(e.args) > 2 else ""))
        if e.name == "ltr:str_escape":
            return str_escape(self.compile(e.args[0]), e.args[1].value if len(e.args) > 1 else "js")
        if e.name in ("name", "local-name") and len(e.args) == 1 and isinstance(e.args[0], Path):
            return string(F.lit(e.args[0].steps[-1].test.name))
        if e.name == "generate-id":
            return string(F.concat(F.lit(f"id_{self.table}_"), *(F.col(c).cast("string") for c in self._order())))
        if not e.args and e.name in ("string", "number", "string-length", "normalize-space"):
            return REGISTRY[e.name](self.text())
        if e.name == "exsl:node-set":
            return self.compile(e.args[0])
        if e.name not in REGISTRY:
            raise UnsupportedPath(f"no function {e.name!r}")
        return REGISTRY[e.name](*(self.compile(a) for a in e.args))


def side(keys: list[str], order: list[str], before: bool):
    """A window of the rows on one side. For the rows after, the order is turned round: a frame that is open towards the end
    is computed anew for each row, one that is open towards the start grows."""
    return Window.partitionBy(*keys).orderBy(*(F.col(c) if before else F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)


class _Siblings:
    """Columns of siblings over a whole table, and the frame they are joined to."""

    def __init__(self, start: DataFrame, wide: DataFrame, order: list[str]):
        self.start, self.wide, self.base, self.order, self.names, self.joined, self.placed = start, wide, wide, order, [], None, False

    def place(self) -> None:
        """Rows numbered once (``_spot``), in blocks (``_own``) of a fixed number of rows, by which windows and joins deal them.
        What is joined to them is taken from these rows (``base``), not from rows that columns were joined to before."""
        if not self.placed:
            self.wide = self.base = numbered(self.wide, self.order, "_spot").withColumn("_own", F.floor((F.col("_spot") - 1) / ROWS))
            self.placed = True

    def near(self, name: str, value: Column, place: int, before: bool) -> None:
        """The value ``place`` rows away; for the next row, from the block's window or the neighbouring block's edge."""
        self.place()
        if place > 1:
            other = self.base.select((F.col("_spot") + float(place if before else -place)).alias("_at"), value.alias(name))
            self.wide = self.wide.join(other, F.col("_spot") == F.col("_at"), "left").drop("_at")
            return
        edges = self.base.groupBy((F.col("_own") + (1 if before else -1)).alias("_at")).agg((F.max_by if before else F.min_by)(value, F.col("_spot")).alias("_edge"))
        edge = F.pmod(F.col("_spot") - 1, F.lit(float(ROWS))) == float(0 if before else ROWS - 1)
        inside = (F.lag if before else F.lead)(value, 1).over(Window.partitionBy("_own").orderBy("_spot"))
        wide = self.wide.withColumn(name, inside).join(edges, F.col("_own") == F.col("_at"), "left")
        self.wide = wide.withColumn(name, F.when(edge, F.col("_edge")).otherwise(F.col(name))).drop("_at", "_edge")

    def total(self, name: str, leaf: str, value: Column, how: str, before: bool) -> None:
        """``count`` or ``sum`` of one side: within the block, then the totals of the blocks on that side."""
        self.place()
        aggregate = F.count(F.col(leaf)) if how == "count" else F.sum(value)
        sums = running(self.base.groupBy(F.col("_own").alias("_at")).agg(aggregate.cast("double").alias("_total")), before)
        wide = self.wide.withColumn(name, F.coalesce(aggregate.over(side(["_own"], ["_spot"], before)).cast("double"), F.lit(0.0)))
        self.wide = wide.join(sums, F.col("_own") == F.col("_at")).withColumn(name, F.col(name) + F.col("_rest")).drop("_at", "_rest")


def numbered(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place (from 1, a double) of each row in the order.

    The first column of the order cuts the rows into ``BLOCKS`` ranges at approximate quantiles; a window numbers each
    range, and the sizes of the ranges before (a table of at most ``BLOCKS`` rows) are added. The cuts decide the balance
    alone, not the result. Only a first column without quantiles (text) is numbered in one task.
    """
    kind = dict(frame.dtypes)[order[0]]
    if kind not in NUMERIC:
        return frame.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("double"))
    cuts = frame.agg(F.percentile_approx(order[0], [i / BLOCKS for i in range(1, BLOCKS)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    # nulls come first in the order
    block = F.coalesce(sum((F.when(F.col(order[0]) > c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0))
    block = F.when(F.col(order[0]).isNull(), -1).otherwise(block)
    dealt = frame.withColumn("_block", block)
    sizes = dealt.groupBy("_block").agg(F.count("*").alias("_size"))
    before = sizes.select(F.col("_block").alias("_of"), F.coalesce(F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    dealt = dealt.withColumn("_place", place).join(F.broadcast(before), F.col("_block") == F.col("_of"))  # at most BLOCKS + 1 rows
    return dealt.withColumn(name, (F.col("_place") + F.col("_before")).cast("double")).drop("_block", "_of", "_place", "_before")


def running(sums: DataFrame, before: bool) -> DataFrame:
    """(_at, _rest): totals of the blocks before (or after) each block, in two levels of windows of ``ROWS`` blocks each."""
    sums = sums.withColumn("_high", F.floor(F.col("_at") / ROWS))
    tops = sums.groupBy(F.col("_high").alias("_top")).agg(F.sum("_total").alias("_all"))
    tops = tops.select("_top", F.coalesce(F.sum("_all").over(side([], ["_top"], before)), F.lit(0.0)).alias("_far"))
    near = sums.select("_at", "_high", F.coalesce(F.sum("_total").over(side(["_high"], ["_at"], before)), F.lit(0.0)).alias("_near"))
    return near.join(tops, F.col("_high") == F.col("_top")).select("_at", (F.col("_near") + F.col("_far")).alias("_rest"))


def to_double(c: Column) -> Column:
    return c.cast("double")


def conjuncts(p) -> list:
    return [*conjuncts(p.left), *conjuncts(p.right)] if isinstance(p, Bin) and p.op == "and" else [p]


def absolute_start(e: Path) -> bool:
    return e.start == "root" or (isinstance(e.start, Call) and e.start.name == "document" and len(e.start.args) == 1 and isinstance(e.start.args[0], Str))


def is_self(e) -> bool:
    return isinstance(e, Path) and e.start is None and len(e.steps) == 1 and e.steps[0].axis == "self" and not e.steps[0].predicates


def is_current(e) -> bool:
    """``current()/column``."""
    return isinstance(e, Path) and isinstance(e.start, Call) and e.start.name == "current" and len(e.steps) == 1 and not e.predicates


def mentions_current(e) -> bool:
    if isinstance(e, Call):
        return e.name == "current" or any(map(mentions_current, e.args))
    if isinstance(e, Bin):
        return mentions_current(e.left) or mentions_current(e.right)
    if isinstance(e, Neg):
        return mentions_current(e.arg)
    return isinstance(e, Path) and (mentions_current(e.start) or any(map(mentions_current, e.predicates)) or any(mentions_current(p) for s in e.steps for p in s.predicates))

"""Path expressions over the node table, compiled to joins, windows and aggregates.

A context is a frame of node rows with ``oid``, the node an outer expression stands at (equal doc_id understood). Steps
join, predicates filter; a path inside a predicate is navigated once for all candidate nodes and joined back as one row
per candidate. Node-sets are sets: each step ends in one row per (oid, node).
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import REGISTRY, Value, boolean, format_number, num, string
from ..functions.values import compare, divide, modulo, to_number
from ..operators.axes import BLOCK, axis_step, blocked, proximity, test_condition
from ..operators.schema import NODE_COLUMNS
from .ast import Bin, Call, Neg, Num, Path, Step, Str, UnsupportedPath, Var, calls, fuse, positional
from .parser import parse

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}
_NODE_SETS = {"key", "exsl:node-set"}
#: Numbers of a document that one window of neighbours spans.
STRETCH = 1 << 16


@dataclass
class NodeDocuments:
    """A node table with keys (name -> (match path, use expression)), variables and own functions."""

    nodes: DataFrame
    keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    variables: dict[str, Value] = field(default_factory=dict)
    functions: dict[str, object] = field(default_factory=dict)
    names: object = field(default_factory=itertools.count)

    # entry points

    def find(self, path: str, context: DataFrame | None = None) -> DataFrame:
        """Node rows that ``path`` selects from the context nodes (the document nodes if not given). A path that starts with
        ``document('id')`` starts at that document of the table."""
        e, start = parse(path), self.roots() if context is None else context
        if isinstance(e, Path) and isinstance(e.start, Call) and e.start.name == "document" and isinstance(e.start.args[0], Str):
            start, e = self.roots().filter(F.col("doc_id") == e.start.args[0].value), Path(None, e.steps, e.predicates)
        return self.navigate(start.withColumn("oid", F.col("node_id")), e).select(NODE_COLUMNS).dropDuplicates(["doc_id", "node_id"])

    def evaluate(self, context: DataFrame, columns: dict[str, str]) -> DataFrame:
        """One row per context node: doc_id, node_id and each expression's value."""
        frame = context
        compiled = {}
        if any(calls(parse(text), {"position", "last"}) for text in columns.values()):  # places among a document's context nodes
            w = Window.partitionBy("doc_id")
            frame = frame.withColumns({"_pos": F.row_number().over(w.orderBy("pre")).cast("double"), "_last": F.count("*").over(w).cast("double")})
        for name, text in columns.items():
            frame, v = self.compile(frame, parse(text))
            frame = frame.withColumn(tmp := self.fresh(), v.col)
            compiled[name] = tmp
        return frame.select("doc_id", "node_id", *(F.col(t).alias(n) for n, t in compiled.items()))

    def roots(self) -> DataFrame:
        return self.nodes.filter("kind = 'document'")

    def fresh(self) -> str:
        return f"_v{next(self.names)}"

    # node-sets

    def navigate(self, frame: DataFrame, e) -> DataFrame:
        """Rows (oid, node columns) of a node-set expression from each row of ``frame`` (oid, node columns)."""
        if isinstance(e, Bin) and e.op == "|":
            both = self.navigate(frame, e.left).select("oid", *NODE_COLUMNS).unionByName(self.navigate(frame, e.right).select("oid", *NODE_COLUMNS))
            return both.dropDuplicates(["oid", "doc_id", "node_id"])
        if isinstance(e, Call):
            e = Path(e, ())
        if not isinstance(e, Path):
            raise UnsupportedPath(f"not a node-set: {e}")
        if e.start == "root":
            up = frame.select("oid", "doc_id").distinct()
            now = self.roots().join(up, "doc_id").select("oid", *NODE_COLUMNS)
        elif e.start is None:
            now = frame.select("oid", *NODE_COLUMNS)
        elif isinstance(e.start, Call) and e.start.name == "key":
            now = self.keyed(frame, e.start)
        elif isinstance(e.start, Call) and e.start.name == "exsl:node-set":
            now = self.navigate(frame, e.start.args[0]).select("oid", *NODE_COLUMNS)
        elif isinstance(e.start, Call):
            raise UnsupportedPath(f"{e.start.name}() gives no node-set here")
        else:
            now = self.navigate(frame, e.start).select("oid", *NODE_COLUMNS)
        if e.predicates:
            now = self.predicates(now.withColumn("c_node_id", F.lit(0)), e.predicates, F.asc("pre"))
        for step in fuse(e.steps):
            now = self.step(now, step)
        return now

    def step(self, frame: DataFrame, step: Step) -> DataFrame:
        if step.axis == "self":
            now = frame.filter(test_condition(step.test, "self")).withColumn("c_node_id", F.col("node_id"))
        else:
            if step.axis.endswith("-sibling") and step.predicates[:1] == (Num(1.0),):
                now = self.neighbour(frame, step)
                return self.predicates(now, step.predicates[1:], proximity(step.axis)).select("oid", *NODE_COLUMNS).dropDuplicates(["oid", "doc_id", "node_id"])
            same = current_match(step.predicates[0]) if step.axis == "child" and step.predicates else None
            if same is not None:
                now = self.matched(frame, step, *same)
                return self.predicates(now, step.predicates[1:], proximity(step.axis)).select("oid", *NODE_COLUMNS)
            now = axis_step(frame, self.nodes, step.axis, step.test, any(map(positional, step.predicates)))
        now = self.predicates(now, step.predicates, proximity(step.axis))
        if step.axis in ("child", "attribute", "self"):  # a node has one parent: no duplicates arise
            return now.select("oid", *NODE_COLUMNS)
        return now.select("oid", *NODE_COLUMNS).dropDuplicates(["oid", "doc_id", "node_id"])

    def neighbour(self, frame: DataFrame, step: Step) -> DataFrame:
        """The nearest sibling of each context row: contexts and siblings of a parent in one line, each context takes the
        last (or next) sibling it passes, in its stretch of ``STRETCH`` numbers or else from the nearest stretch that has one.
        No pairs, and no window is wider than a stretch or a parent's stretches. Windows run from the step's far end, as a
        frame that is open towards the end is computed anew for each row."""
        keys, before = ["doc_id", "parent_id"], step.axis == "preceding-sibling"
        stretch = F.floor(F.col("pre") / STRETCH).alias("_stretch")
        mine = frame.filter("kind != 'attribute'").select(*keys, "pre", stretch, F.lit(None).cast("long").alias("_found"), F.struct("oid", "node_id").alias("_for"))
        other = self.nodes.filter(test_condition(step.test, step.axis) & (F.col("kind") != "attribute")).select(*keys, "pre", stretch, F.col("pre").alias("_found"), F.lit(None).cast("struct<oid:bigint,node_id:bigint>").alias("_for"))
        line, nearest, order = mine.unionByName(other), F.max if before else F.min, F.asc if before else F.desc
        # range frames leave out the context's own place
        inside = Window.partitionBy(*keys, "_stretch").orderBy(order("pre")).rangeBetween(Window.unboundedPreceding, -1)
        far = Window.partitionBy(*keys).orderBy(order("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
        ends = line.groupBy(*keys, "_stretch").agg(nearest("_found").alias("_end")).withColumn("_far", nearest("_end").over(far))
        ends = ends.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_stretch").alias("_of"), "_far").filter("_far is not null")
        got = line.withColumn("_at", nearest("_found").over(inside)).filter("_for is not null")
        got = got.join(ends, (F.col("doc_id") == F.col("_doc_id")) & (F.col("parent_id") == F.col("_parent_id")) & (F.col("_stretch") == F.col("_of")), "left")
        got = got.withColumn("_at", F.coalesce("_at", "_far")).filter("_at is not null")
        got = got.select(F.col("_for.oid").alias("oid"), F.col("_for.node_id").alias("c_node_id"), F.col("doc_id").alias("c_doc"), "_at")
        return got.join(self.nodes, (F.col("c_doc") == F.col("doc_id")) & (F.col("_at") == F.col("pre"))).select("oid", "c_node_id", *NODE_COLUMNS)

    def matched(self, frame: DataFrame, step: Step, own: str, current: str) -> DataFrame:
        """Children whose attribute ``own`` equals the attribute ``current`` of the node the expression stands at: one
        equi-join of (document, parent, value), so children that do not match are not paired with contexts."""
        c, wanted = self.attribute(frame.select("oid", *NODE_COLUMNS), current, "oid")
        c = c.filter(wanted.isNotNull()).select("oid", F.col("doc_id").alias("c_doc"), F.col("node_id").alias("c_node_id"), wanted.alias("_wanted"))
        found, has = self.attribute(self.nodes.filter(test_condition(step.test, "child") & (F.col("kind") != "attribute")), own)
        return c.join(found, (F.col("c_doc") == F.col("doc_id")) & (F.col("c_node_id") == F.col("parent_id")) & (F.col("_wanted") == has)).select("oid", "c_node_id", *NODE_COLUMNS)

    def predicates(self, frame: DataFrame, predicates: tuple, order: Column) -> DataFrame:
        keep = frame.columns
        for p in predicates:
            if positional(p):
                w = Window.partitionBy("oid", "doc_id", "c_node_id")
                frame = frame.withColumn("_pos", F.row_number().over(w.orderBy(order)).cast("double"))
                if calls(p, {"last"}):
                    frame = frame.withColumn("_last", F.count("*").over(w).cast("double"))
            if is_node_set(p):  # true if it has a node, whatever the node's text
                frame, condition = self.truth(frame, p)
            else:
                frame, v = self.compile(frame, p)
                condition = compare("=", v.col, F.col("_pos")) if v.kind == "number" else v.boolean
            frame = frame.filter(condition).select(keep)
        return frame

    def keyed(self, frame: DataFrame, call: Call) -> DataFrame:
        """Nodes a key finds in the same document: an equi-join of (doc_id, use value)."""
        match, use = self.keys[call.args[0].value]
        marked = self.navigate(self.roots().withColumn("oid", F.lit(0).cast("long")), parse(f"//{match}" if not match.startswith("/") else match)).select(NODE_COLUMNS)
        indexed = self.strings(self.navigate(marked.withColumn("oid", F.col("node_id")), parse(use)), parse(use))
        indexed = indexed.select(F.col("doc_id").alias("k_doc"), F.col("oid").alias("k_id"), F.col("sv").alias("k_use"))
        nodes = marked.join(indexed, (F.col("node_id") == F.col("k_id")) & (F.col("doc_id") == F.col("k_doc"))).select(*NODE_COLUMNS, "k_use")
        arg = call.args[1]
        if is_node_set(arg):
            wanted = self.strings(self.navigate(frame, arg)).select("oid", F.col("doc_id").alias("w_doc"), F.col("sv").alias("w_use")).distinct()
        else:
            framed, v = self.compile(frame, arg)
            wanted = framed.select("oid", F.col("doc_id").alias("w_doc"), v.string.alias("w_use")).distinct()
        return nodes.join(wanted, (F.col("doc_id") == F.col("w_doc")) & (F.col("k_use") == F.col("w_use"))).select("oid", *NODE_COLUMNS).dropDuplicates(["oid", "doc_id", "node_id"])

    def strings(self, frame: DataFrame, e=None) -> DataFrame:
        """Add ``sv``, the string value: own value, or all text below in document order. ``e``, the expression that led
        to the nodes, tells where own values suffice."""
        if isinstance(e, Path) and e.steps and (e.steps[-1].axis == "attribute" or e.steps[-1].test.kind == "text"):
            return frame.withColumn("sv", F.coalesce("value", F.lit("")))
        block = F.floor(F.col("pre") / BLOCK).cast("long")
        texts = self.nodes.filter("kind = 'text'").select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), F.col("value").alias("t_value"), block.alias("t_block"))
        below = frame.filter("kind in ('element', 'document')").select("doc_id", "node_id", "pre", "last_desc").dropDuplicates(["doc_id", "node_id"])
        below = blocked(below, F.col("pre"), F.col("last_desc"))
        joined = below.join(texts, (F.col("doc_id") == F.col("t_doc")) & (F.col("_block") == F.col("t_block")) & (F.col("t_pre") > F.col("pre")) & (F.col("t_pre") <= F.col("last_desc")))
        text = joined.groupBy("doc_id", "node_id").agg(F.expr("listagg(t_value, '') within group (order by t_pre)").alias("_text"))
        out = frame.join(text, ["doc_id", "node_id"], "left")
        return out.withColumn("sv", F.when(F.col("kind").isin("element", "document"), F.coalesce("_text", F.lit(""))).otherwise(F.coalesce("value", F.lit("")))).drop("_text")

    # values

    def nested(self, frame: DataFrame, e) -> DataFrame:
        """The node-set of ``e`` at every distinct node of ``frame``; oid is that node."""
        here = frame.select(NODE_COLUMNS).dropDuplicates(["doc_id", "node_id"]).withColumn("oid", F.col("node_id"))
        return self.navigate(here, e)

    def back(self, frame: DataFrame, got: DataFrame, *values: str) -> DataFrame:
        """Join one row per (doc_id, oid) back to the frame's nodes."""
        other = got.select(F.col("doc_id").alias("b_doc"), F.col("oid").alias("b_oid"), *values)
        return frame.join(other, (F.col("doc_id") == F.col("b_doc")) & (F.col("node_id") == F.col("b_oid")), "left").drop("b_doc", "b_oid")

    def reduced(self, frame: DataFrame, e, how) -> tuple[DataFrame, Column]:
        """One aggregate of a nested node-set per node; ``how`` gives the aggregate and whether it reads string values."""
        name = self.fresh()
        while isinstance(e, Call) and e.name == "exsl:node-set":
            e = e.args[0]
        up, down = shared_start(e)
        if up:  # contexts with one parent share what is below it: it is reduced once for each parent
            met = self.nested(frame, up).select("oid", *NODE_COLUMNS)
            met, value = self.reduced(met, down, how)
            return self.back(frame, met.select("doc_id", "oid", value.alias(name)), name), F.col(name)
        got = self.nested(frame, e)
        aggregate, strings = how
        if strings:
            got = self.strings(got, e)
        return self.back(frame, got.groupBy("doc_id", "oid").agg(aggregate.alias(name)), name), F.col(name)

    def attribute(self, frame: DataFrame, name: str, of: str = "node_id") -> tuple[DataFrame, Column]:
        """Value of one attribute of each node: one equi-join, as a node has at most one of a name."""
        tmp = self.fresh()
        other = self.nodes.filter((F.col("kind") == "attribute") & (F.col("name") == name))
        other = other.select(F.col("doc_id").alias("b_doc"), F.col("parent_id").alias("b_oid"), F.col("value").alias(tmp))
        frame = frame.join(other, (F.col("doc_id") == F.col("b_doc")) & (F.col(of) == F.col("b_oid")), "left")
        return frame.drop("b_doc", "b_oid"), F.col(tmp)

    def compile(self, frame: DataFrame, e) -> tuple[DataFrame, Value]:
        if (name := own_attribute(e)) is not None:
            frame, c = self.attribute(frame, name)
            return frame, string(c)
        if (name := current_attribute(e)) is not None:
            frame, c = self.attribute(frame, name, "oid" if "oid" in frame.columns else "node_id")
            return frame, string(c)
        if isinstance(e, Num):
            return frame, num(F.lit(e.value))
        if isinstance(e, Str):
            return frame, string(F.lit(e.value))
        if isinstance(e, Var):
            return frame, self.variables[e.name]
        if isinstance(e, Neg):
            frame, v = self.compile(frame, e.arg)
            return frame, num(-v.number)
        if is_node_set(e):
            frame, c = self.reduced(frame, e, (F.min(F.struct("pre", "sv"))["sv"], True))
            return frame, string(c)
        if isinstance(e, Path):
            return self.compile(frame, e.start)
        if isinstance(e, Bin):
            return self.binary(frame, e)
        return self.call(frame, e)

    def truth(self, frame: DataFrame, e) -> tuple[DataFrame, Column]:
        """Boolean of an expression; a node-set is true if it has a node."""
        if (name := own_attribute(e)) is not None:
            frame, c = self.attribute(frame, name)
            return frame, c.isNotNull()
        if is_node_set(e):
            frame, c = self.reduced(frame, e, (F.count("*"), False))
            return frame, F.coalesce(c > 0, F.lit(False))
        frame, v = self.compile(frame, e)
        return frame, v.boolean

    def binary(self, frame: DataFrame, e: Bin) -> tuple[DataFrame, Value]:
        if e.op in ("and", "or"):
            frame, a = self.truth(frame, e.left)
            frame, b = self.truth(frame, e.right)
            return frame, boolean(a & b if e.op == "and" else a | b)
        if e.op in _FLIP:
            return self.comparison(frame, e)
        frame, a = self.compile(frame, e.left)
        frame, b = self.compile(frame, e.right)
        x, y = a.number, b.number
        return frame, num({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: divide(x, y), "mod": lambda: modulo(x, y)}[e.op]())

    def comparison(self, frame: DataFrame, e: Bin) -> tuple[DataFrame, Value]:
        left, right = is_node_set(e.left), is_node_set(e.right)
        if left and right:
            return self.between_sets(frame, e)
        if right:
            return self.comparison(frame, Bin(_FLIP[e.op], e.right, e.left))
        frame, b = self.compile(frame, e.right)
        if left and (name := own_attribute(e.left)) is not None and b.kind != "boolean":
            frame, c = self.attribute(frame, name)
            held = c.isNotNull() & self.plain(e.op, string(c), b)
            return frame, boolean(held & b.col.isNotNull() if current_attribute(e.right) else held)
        if not left:
            frame, a = self.compile(frame, e.left)
            there = [v.col.isNotNull() for side, v in ((e.left, a), (e.right, b)) if current_attribute(side)]
            return frame, boolean(functools.reduce(operator.and_, there, self.plain(e.op, a, b)))
        if b.kind == "boolean" and e.op in ("=", "!="):
            frame, a = self.truth(frame, e.left)
            return frame, boolean(a == b.col if e.op == "=" else a != b.col)
        # exists a node for which it holds: the scalar travels to the nodes, one flag per node comes back
        scalar, flag = self.fresh(), self.fresh()
        frame = frame.withColumn(scalar, b.col)
        got = self.strings(self.nested(frame, e.left), e.left)
        mine = frame.select(F.col("doc_id").alias("s_doc"), F.col("node_id").alias("s_id"), scalar).dropDuplicates()
        met = got.join(mine, (F.col("doc_id") == F.col("s_doc")) & (F.col("oid") == F.col("s_id")))
        held = met.filter(self.plain(e.op, string(F.col("sv")), Value(F.col(scalar), b.kind))).select("doc_id", "oid", scalar).distinct().withColumn(flag, F.lit(True))
        other = held.select(F.col("doc_id").alias("b_doc"), F.col("oid").alias("b_oid"), F.col(scalar).alias("b_scalar"), flag)
        frame = frame.join(other, (F.col("doc_id") == F.col("b_doc")) & (F.col("node_id") == F.col("b_oid")) & F.col(scalar).eqNullSafe(F.col("b_scalar")), "left")
        return frame.drop("b_doc", "b_oid", "b_scalar", scalar), boolean(F.coalesce(F.col(flag), F.lit(False)))

    def between_sets(self, frame: DataFrame, e: Bin) -> tuple[DataFrame, Value]:
        """Two node-sets: equal strings by an equi-join, everything else by extremes."""
        a, b = self.strings(self.nested(frame, e.left), e.left), self.strings(self.nested(frame, e.right), e.right)
        name = self.fresh()
        if e.op == "=":
            x, y = a.select("doc_id", "oid", "sv").distinct(), b.select("doc_id", "oid", "sv").distinct()
            held = x.join(y, ["doc_id", "oid", "sv"]).select("doc_id", "oid").distinct().withColumn(name, F.lit(True))
            return self.back(frame, held, name), boolean(F.coalesce(F.col(name), F.lit(False)))
        value = F.col("sv") if e.op == "!=" else to_number(F.col("sv"))
        value = value if e.op == "!=" else F.when(~F.isnan(value), value)
        ends = [g.groupBy("doc_id", "oid").agg(F.min(value).alias(f"{p}lo"), F.max(value).alias(f"{p}hi")) for g, p in ((a, "a"), (b, "b"))]
        c = {"!=": (F.col("alo") != F.col("bhi")) | (F.col("ahi") != F.col("blo")), "<": F.col("alo") < F.col("bhi"), "<=": F.col("alo") <= F.col("bhi"), ">": F.col("ahi") > F.col("blo"), ">=": F.col("ahi") >= F.col("blo")}[e.op]
        held = ends[0].join(ends[1], ["doc_id", "oid"]).select("doc_id", "oid", c.alias(name))
        return self.back(frame, held, name), boolean(F.coalesce(F.col(name), F.lit(False)))

    @staticmethod
    def plain(op: str, a: Value, b: Value) -> Column:
        if op in ("=", "!="):
            if "boolean" in (a.kind, b.kind):
                return (a.boolean == b.boolean) if op == "=" else (a.boolean != b.boolean)
            if "number" not in (a.kind, b.kind):
                return (a.string == b.string) if op == "=" else (a.string != b.string)
        return compare(op, a.number, b.number)

    def call(self, frame: DataFrame, e: Call) -> tuple[DataFrame, Value]:
        own = self.functions.get(e.name)
        if own is None and e.name in ("position", "last"):
            column = "_pos" if e.name == "position" else "_last"
            if column not in frame.columns:
                raise UnsupportedPath(f"{e.name}() stands outside a predicate")
            return frame, num(F.col(column))
        if own is None and e.name in ("count", "sum") and len(e.args) == 1:
            how = (F.count("*").cast("double"), False) if e.name == "count" else (F.sum(to_number(F.col("sv"))), True)
            frame, c = self.reduced(frame, e.args[0], how)
            return frame, num(F.coalesce(c, F.lit(0.0)))
        if own is None and e.name in ("name", "local-name", "generate-id"):
            node = e.args[0] if e.args else Path(None, (Step("self", parse("node()").steps[0].test),))
            column = F.concat(F.lit("id_"), "doc_id", F.lit("_"), F.hex("node_id")) if e.name == "generate-id" else F.coalesce("name", F.lit(""))
            frame, c = self.reduced(frame, node, (F.min(F.struct("pre", column.alias("n")))["n"], False))
            return frame, string(F.substring_index(F.coalesce(c, F.lit("")), ":", -1) if e.name == "local-name" else F.coalesce(c, F.lit("")))
        if own is None and e.name in ("not", "boolean"):
            frame, c = self.truth(frame, e.args[0])
            return frame, boolean(~c if e.name == "not" else c)
        args = e.args
        if not args and e.name in ("string", "number", "string-length", "normalize-space"):
            args = (Path(None, (Step("self", parse("node()").steps[0].test),)),)
        if own is None and e.name == "format-number":
            frame, v = self.compile(frame, args[0])
            return frame, format_number(v, args[1].value)
        function = own or REGISTRY.get(e.name)
        if function is None:
            raise UnsupportedPath(f"no function {e.name!r}")
        values = []
        for a in args:
            frame, v = self.compile(frame, a)
            frame = frame.withColumn(name := self.fresh(), v.col)
            values.append(Value(F.col(name), v.kind))
        return frame, function(*values)


def own_attribute(e) -> str | None:
    """Name of the attribute if the expression is ``@name`` of the context node."""
    if isinstance(e, Path) and e.start is None and len(e.steps) == 1 and not e.predicates:
        s = e.steps[0]
        if s.axis == "attribute" and s.test.kind == "name" and not s.predicates:
            return s.test.name
    return None


def current_attribute(e) -> str | None:
    """Name of the attribute if the expression is ``current()/@name``."""
    if isinstance(e, Path) and isinstance(e.start, Call) and e.start.name == "current" and not e.predicates:
        return own_attribute(Path(None, e.steps))
    return None


def current_match(p) -> tuple[str, str] | None:
    """(own attribute, attribute of ``current()``) if the predicate says that they are equal."""
    if isinstance(p, Bin) and p.op == "=":
        for a, b in ((p.left, p.right), (p.right, p.left)):
            if (own := own_attribute(a)) is not None and (current := current_attribute(b)) is not None:
                return own, current
    return None


def mentions_current(e) -> bool:
    if isinstance(e, Call) and e.name == "current":
        return True
    if dataclasses.is_dataclass(e):
        return any(mentions_current(getattr(e, f.name)) for f in dataclasses.fields(e))
    return isinstance(e, tuple) and any(map(mentions_current, e))


def shared_start(e) -> tuple[Path | None, Path | None]:
    """A path's parent steps, which give one node each at most, and the rest; none if the rest depends on where it started."""
    if not isinstance(e, Path) or e.start is not None or e.predicates or mentions_current(e):
        return None, None
    n = next((i for i, s in enumerate(e.steps) if s.axis != "parent" or s.predicates), len(e.steps))
    return (Path(None, e.steps[:n]), Path(None, e.steps[n:])) if 0 < n < len(e.steps) else (None, None)


def is_node_set(e) -> bool:
    if current_attribute(e):
        return False
    if isinstance(e, Bin):
        return e.op == "|"
    if isinstance(e, Call):
        return e.name in _NODE_SETS
    if isinstance(e, Path):
        return bool(e.steps) or e.start in (None, "root") or is_node_set(e.start)
    return False

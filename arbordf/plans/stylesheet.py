"""Stylesheets: compiled once on the driver, run over whole documents in tasks.

Template expansion recurses to a depth only the data know, so it is the one part that no relational plan expresses; each
document is expanded by the task that holds it, documents are independent, and nothing is shuffled. A compiled stylesheet
is plain Python data and travels with the task.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace
from pathlib import Path as FilePath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.serialize import NO_ESCAPE, serialize
from ..sources.tree import Node, new_document, number, parse_html, parse_xml
from .ast import SELF_OR_BELOW, Bin, Call, Path, UnsupportedPath
from .evaluate import Context, axis, evaluate, filtered, in_order, matches, string, to_boolean, to_number
from .parser import parse, parse_template

log = logging.getLogger(__name__)
_XSL = "xsl:"
_BLANK = re.compile(r"[ \t\r\n]*")


class StylesheetError(ValueError):
    """The stylesheet is wrong, or terminated its run."""


@dataclass
class Rule:
    pattern: object
    mode: str | None
    priority: float
    precedence: int
    order: int
    body: Node


@dataclass
class Environment:
    """What the host supplies: functions (strings in, string out), catalogue, rights, URL settings, secondary documents."""

    functions: dict = field(default_factory=dict)
    node_functions: dict = field(default_factory=dict)
    documents: dict[str, str] = field(default_factory=dict)
    formats: dict[str, dict] = field(default_factory=dict)
    messages: list[str] | None = None  # where xsl:message texts go besides the log


@dataclass
class Stylesheet:
    rules: dict[str | None, list[Rule]] = field(default_factory=dict)
    named: dict[str, Node] = field(default_factory=dict)
    globals: list[Node] = field(default_factory=list)
    keys: list[tuple[str, object, object]] = field(default_factory=list)
    formats: dict[str, dict] = field(default_factory=dict)
    sets: dict[str, list[Node]] = field(default_factory=dict)
    output: dict[str, str] = field(default_factory=dict)
    strip: set[str] = field(default_factory=set)
    preserve: set[str] = field(default_factory=set)
    source: str = ""

    # compiling

    @classmethod
    def from_file(cls, path: str) -> Stylesheet:
        return cls.from_string(FilePath(path).read_text(encoding="utf-8"), str(FilePath(path).parent))

    @classmethod
    def from_string(cls, text: str, folder: str = ".", parts: dict[str, str] | None = None) -> Stylesheet:
        """``parts`` holds texts that include and import find by their href, before files of ``folder``."""
        s = cls(source=text)
        s._parts = parts or {}
        s._precedence = s._order = 0
        s._load(text, folder)
        for rules in s.rules.values():
            rules.sort(key=lambda r: (r.precedence, r.priority, r.order), reverse=True)
        del s._precedence, s._order, s._parts
        return s

    def _part(self, folder: str, href: str) -> tuple[str, str]:
        """Text of an included or imported stylesheet, and the folder its own hrefs start from."""
        if href in self._parts:
            return self._parts[href], folder
        path = FilePath(folder, href)
        return path.read_text(encoding="utf-8"), str(path.parent)

    def _load(self, text: str, folder: str) -> None:
        root = next(c for c in parse_xml(text).children if c.kind == "element")
        _strip_blank(root)
        if root.name not in ("xsl:stylesheet", "xsl:transform"):  # a literal result element is a whole stylesheet
            t = Node("element", "xsl:template")
            t.append(Node("attribute", "match", "/"))
            t.append(root)
            self._template(t)
            return
        top = [c for c in root.children if c.kind == "element"]
        for c in top:
            if c.name == "xsl:import":
                self._load(*self._part(folder, c.attribute("href")))
                self._precedence += 1
        for c in top:
            kind = c.name.removeprefix(_XSL) if c.name.startswith(_XSL) else ""
            if kind == "include":
                self._load(*self._part(folder, c.attribute("href")))
            elif kind == "template":
                self._template(c)
            elif kind in ("variable", "param"):
                self.globals = [g for g in self.globals if g.attribute("name") != c.attribute("name")] + [c]
            elif kind == "key":
                self.keys.append((c.attribute("name"), parse(c.attribute("match")), parse(c.attribute("use"))))
            elif kind == "decimal-format":
                self.formats[c.attribute("name") or ""] = {a.name: a.value for a in c.attributes if a.name != "name"}
            elif kind == "output":
                for a in c.attributes:
                    self.output.setdefault(a.name, a.value)
            elif kind == "attribute-set":
                self.sets.setdefault(c.attribute("name"), []).append(c)
            elif kind in ("strip-space", "preserve-space"):
                (self.strip if kind == "strip-space" else self.preserve).update(c.attribute("elements").split())

    def _template(self, t: Node) -> None:
        self._order += 1
        if t.attribute("name"):
            self.named[t.attribute("name")] = t
        if t.attribute("match"):
            for p in _alternatives(parse(t.attribute("match"))):
                own = t.attribute("priority")
                mode = t.attribute("mode")
                rule = Rule(p, mode, float(own) if own else _priority(p), self._precedence, self._order, t)
                self.rules.setdefault(mode, []).append(rule)

    # running

    def run(self, document: Node, params: dict[str, str] | None = None, env: Environment | None = None) -> Node:
        """Result tree of one document."""
        return _Run(self, document, params or {}, env or Environment()).result()

    def render(self, text: str, params: dict | None = None, env: Environment | None = None, kind: str = "xml") -> str:
        """Serialised result of one document's text."""
        result = self.run((parse_html if kind == "html" else parse_xml)(text), params, env)
        return self.to_text(result)

    def to_text(self, result: Node) -> str:
        top = [c for c in result.children if c.kind == "element" or (c.kind == "text" and c.value.strip())]
        method = self.output.get("method") or ("html" if top and top[0].kind == "element" and top[0].name.lower() == "html" else "xml")
        return serialize(
            result, method, self.output.get("omit-xml-declaration", "no") != "yes", (self.output.get("doctype-public"), self.output.get("doctype-system")),
            self.output.get("encoding", "UTF-8"), self.output.get("standalone"), self.output.get("media-type", "text/html"),
        )

    def transform(self, docs: DataFrame, key: str, text: str, params: dict | None = None, env: Environment | None = None, kind: str = "xml") -> DataFrame:
        """(key, result) of every document of a frame. Null texts give null results."""

        def run(it):
            for b in it:
                out = [None if t is None else self.render(t, params, env, kind) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "result"])

        return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, result string")

    def messages(self, docs: DataFrame, key: str, text: str, params: dict | None = None, env: Environment | None = None, kind: str = "xml") -> DataFrame:
        """(key, place, message, terminated) of every message that the documents' runs send, in order."""

        def run(it):
            for b in it:
                rows = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own, ended = replace(env or Environment(), messages=[]), False
                    try:
                        if t is not None:
                            self.render(t, params, own, kind)
                    except StylesheetError:
                        ended = True
                    rows += [(k, i, m, ended and i == len(own.messages)) for i, m in enumerate(own.messages, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())], names=[key, "place", "message", "terminated"])

        return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, place int, message string, terminated boolean")

    def task_graph(self) -> tuple[list[str], list[tuple[str, str]]]:
        """Templates and which of them can start which: vertices and edges of the expansion."""
        label = lambda t: t.attribute("name") or f"{t.attribute('match')}" + (f" ({t.attribute('mode')})" if t.attribute("mode") else "")
        bodies = {id(t): t for t in [*self.named.values(), *(r.body for rules in self.rules.values() for r in rules)]}.values()
        edges = set()
        for t in bodies:
            for n in t.walk():
                if n.name == "xsl:call-template":
                    edges.add((label(t), n.attribute("name")))
                elif n.name == "xsl:apply-templates":
                    edges.update((label(t), label(r.body)) for r in self.rules.get(n.attribute("mode"), []))
        return sorted(map(label, bodies)), sorted(edges)

    def graphml(self) -> str:
        vertices, edges = self.task_graph()
        root = new_document().append(Node("element", "graphml"))
        graph = root.append(Node("element", "graph"))
        graph.append(Node("attribute", "edgedefault", "directed"))
        for v in vertices:
            graph.append(Node("element", "node")).append(Node("attribute", "id", v))
        for a, b in edges:
            e = graph.append(Node("element", "edge"))
            e.append(Node("attribute", "source", a))
            e.append(Node("attribute", "target", b))
        return serialize(root, "xml")


def _strip_blank(n: Node) -> None:
    if n.name == "xsl:text":
        return
    n.children = [c for c in n.children if c.kind != "text" or not _BLANK.fullmatch(c.value)]
    for c in n.children:
        _strip_blank(c)


def _alternatives(p) -> list:
    return _alternatives(p.left) + _alternatives(p.right) if isinstance(p, Bin) and p.op == "|" else [p]


def _priority(p) -> float:
    if isinstance(p, Path) and p.start is None and len(p.steps) == 1 and not p.steps[0].predicates:
        t = p.steps[0].test
        return 0.0 if t.kind == "name" or (t.kind == "pi" and t.name) else -0.5
    return 0.5


class _Run:
    def __init__(self, sheet: Stylesheet, document: Node, params: dict[str, str], env: Environment):
        self.sheet, self.document, self.params = sheet, document, params
        own = {"key": self._key, "document": self._document}
        self.env = Environment(env.functions, env.node_functions | own, env.documents, {**env.formats, **sheet.formats}, env.messages)
        self.index: dict[tuple[str, int], dict[str, list[Node]]] = {}
        self.loaded: dict[str, Node] = {}
        self.globals: dict[str, object] = {}
        self.fragments = 0
        if sheet.strip:
            self._strip(document, False)
        document.document = document.document or ""

    def _strip(self, n: Node, preserved: bool) -> None:
        names = self.sheet
        if n.kind == "element":
            preserved = not (n.name in names.strip or ("*" in names.strip and n.name not in names.preserve))
            if not preserved:
                n.children = [c for c in n.children if c.kind != "text" or not _BLANK.fullmatch(c.value)]
        for c in n.children:
            self._strip(c, preserved)
        if n.kind == "document":
            number(n)

    def result(self) -> Node:
        out = new_document()
        pending = list(self.sheet.globals)
        for _ in range(len(pending) + 1):  # globals may name later ones
            rest = []
            for g in pending:
                try:
                    name = g.attribute("name")
                    if g.name == "xsl:param" and name in self.params:
                        self.globals[name] = self.params[name]
                    else:
                        self.globals[name] = self._value(g, self._context(self.document))
                except UnsupportedPath:
                    rest.append(g)
            if len(rest) == len(pending):
                break
            pending = rest
        if pending:
            raise StylesheetError(f"cannot evaluate ${pending[0].attribute('name')}")
        self._apply([self.document], None, self._context(self.document), {}, out)
        return number(out)

    def _context(self, node: Node, position: int = 1, size: int = 1, variables: dict | None = None) -> Context:
        return Context(node, position, size, self.globals if variables is None else variables, self.env)

    # keys and documents

    def _key(self, args, c: Context) -> list[Node]:
        name, value = string(args[0]), args[1]
        root = c.node.root()
        table = self.index.get((name, id(root)))
        if table is None:
            table = self.index[name, id(root)] = {}
            for key, match, use in self.sheet.keys:
                if key != name:
                    continue
                for n in root.walk():
                    if any(self._matches(n, p, c) for p in _alternatives(match)):
                        v = evaluate(use, self._context(n))
                        for s in {x.text() for x in v} if isinstance(v, list) else {string(v)}:
                            table.setdefault(s, []).append(n)
        wanted = {n.text() for n in value} if isinstance(value, list) else {string(value)}
        return in_order(n for s in wanted for n in table.get(s, []))

    def _document(self, args, c: Context) -> list[Node]:
        uris = [n.text() for n in args[0]] if isinstance(args[0], list) else [string(args[0])]
        out = []
        for uri in uris:
            if uri not in self.loaded:
                text = self.sheet.source if uri == "" else self.env.documents.get(uri)
                if text is None and FilePath(uri).is_file():
                    text = FilePath(uri).read_text(encoding="utf-8")
                if text is None:
                    continue
                self.loaded[uri] = parse_xml(text)
                self.loaded[uri].document = f"\x7f{uri}"
            out.append(self.loaded[uri])
        return out

    # rules

    def _matches(self, node: Node, pattern, c: Context) -> bool:
        if isinstance(pattern, Call):
            pattern = Path(pattern, ())
        if not isinstance(pattern, Path):
            raise UnsupportedPath(f"not a pattern: {pattern}")
        if isinstance(pattern.start, Call) and not pattern.steps:
            return any(n is node for n in evaluate(pattern.start, self._context(node)))
        return self._steps(node, pattern, len(pattern.steps))

    def _steps(self, node: Node, p: Path, n: int) -> bool:
        """Do the first ``n`` steps of the pattern lead to the node?"""
        if n == 0:
            if p.start == "root":
                return node.kind == "document"
            return p.start is None or any(x is node for x in evaluate(p.start, self._context(node)))
        step = p.steps[n - 1]
        if step == SELF_OR_BELOW:
            return any(self._steps(a, p, n - 1) for a in axis(node, "ancestor-or-self"))
        up = node.parent
        if not matches(node, step) or up is None or (node.kind == "attribute") != (step.axis == "attribute"):
            return False
        if step.predicates:
            same = [x for x in axis(up, step.axis) if matches(x, step)]
            if not any(x is node for x in filtered(same, step.predicates, self._context(node))):
                return False
        return n == 1 and p.start is None or self._steps(up, p, n - 1)

    def _apply(self, nodes: list[Node], mode: str | None, c: Context, passed: dict, out: Node, below: int | None = None) -> None:
        for i, n in enumerate(nodes, 1):
            rule = next((r for r in self.sheet.rules.get(mode, ()) if (below is None or r.precedence < below) and self._matches(n, r.pattern, c)), None)
            if rule is not None:
                self._body(rule.body, Context(n, i, len(nodes), dict(self.globals), self.env), passed, out, (mode, rule))
            elif n.kind in ("document", "element"):
                self._apply(n.children, mode, c, {}, out)
            elif n.kind in ("text", "attribute"):
                out.append(Node("text", None, n.value or "", n.flags & NO_ESCAPE))

    # instructions

    def _body(self, parent: Node, c: Context, passed: dict, out: Node, rule=None) -> None:
        scope = Context(c.node, c.position, c.size, dict(c.variables), c.env, c.current)
        for n in parent.children:
            if n.kind == "text":
                out.append(Node("text", None, n.value))
            elif n.kind != "element":
                continue
            elif n.name.startswith(_XSL):
                action = getattr(self, "_do_" + n.name.removeprefix(_XSL).replace("-", "_"), None)
                if action is None:
                    log.warning("unknown instruction %s skipped", n.name)
                    continue
                action(n, scope, passed, out, rule)
            else:
                e = out.append(Node("element", n.name))
                self._use_sets(n.attribute("xsl:use-attribute-sets"), scope, e)
                for a in n.attributes:
                    if not a.name.startswith(_XSL) and a.name != "xmlns:xsl":
                        e.append(Node("attribute", a.name, self._avt(a.value, scope)))
                self._body(n, scope, {}, e, rule)

    def _avt(self, text: str, c: Context) -> str:
        return "".join(p if isinstance(p, str) else string(evaluate(p, c)) for p in parse_template(text))

    def _eval(self, text: str, c: Context):
        return evaluate(parse(text), c)

    def _value(self, n: Node, c: Context, rule=None):
        """Value of a variable, parameter or argument: an expression, or a fragment as a node-set of its root."""
        if n.attribute("select") is not None:
            return self._eval(n.attribute("select"), c)
        if not n.children:
            return ""
        return [self._fragment(n, c, rule)]

    def _fragment(self, n: Node, c: Context, rule=None) -> Node:
        f = new_document()
        self._body(n, c, {}, f, rule)
        self.fragments += 1
        f.document = f"\x7e{self.fragments:09d}"
        return number(f)

    def _arguments(self, n: Node, c: Context, rule) -> dict:
        return {w.attribute("name"): self._value(w, c, rule) for w in n.children if w.name == "xsl:with-param"}

    def _sorted(self, n: Node, nodes: list[Node], c: Context) -> list[Node]:
        keys = [s for s in n.children if s.name == "xsl:sort"]
        for s in reversed(keys):  # stable sorts, the first key last
            e, size = parse(s.attribute("select") or "."), len(nodes)
            values = [evaluate(e, Context(x, i, size, c.variables, c.env, x)) for i, x in enumerate(nodes, 1)]
            down = self._avt(s.attribute("order") or "ascending", c) == "descending"
            if self._avt(s.attribute("data-type") or "text", c) == "number":
                ranks = [(0, 0.0) if (v := to_number(x)) != v else (1, v) for x in values]
            else:
                upper_first = s.attribute("case-order") == "upper-first"
                ranks = [((t := string(x)).lower(), t if upper_first else t.swapcase()) for x in values]
            nodes = [nodes[i] for i in sorted(range(size), key=ranks.__getitem__, reverse=down)]  # equal ones keep their order
        return nodes

    def _do_apply_templates(self, n, c, passed, out, rule):
        nodes = c.node.children if n.attribute("select") is None else self._eval(n.attribute("select"), c)
        if not isinstance(nodes, list):
            raise StylesheetError("apply-templates takes nodes")
        self._apply(self._sorted(n, list(nodes), c), n.attribute("mode"), c, self._arguments(n, c, rule), out)

    def _do_apply_imports(self, n, c, passed, out, rule):
        if rule is not None:
            self._apply([c.node], rule[0], c, passed, out, rule[1].precedence)

    def _do_call_template(self, n, c, passed, out, rule):
        body = self.sheet.named.get(n.attribute("name"))
        if body is None:
            raise StylesheetError(f"no template named {n.attribute('name')!r}")
        args = self._arguments(n, c, rule)
        self._body(body, Context(c.node, c.position, c.size, dict(self.globals), c.env, c.current), args, out, rule)

    def _do_for_each(self, n, c, passed, out, rule):
        nodes = self._sorted(n, list(self._eval(n.attribute("select"), c)), c)
        for i, x in enumerate(nodes, 1):
            self._body(n, Context(x, i, len(nodes), c.variables, c.env), {}, out, rule)

    def _do_sort(self, *_):
        pass

    _do_with_param = _do_fallback = _do_sort

    def _do_if(self, n, c, passed, out, rule):
        if to_boolean(self._eval(n.attribute("test"), c)):
            self._body(n, c, passed, out, rule)

    def _do_choose(self, n, c, passed, out, rule):
        for w in n.children:
            if w.name == "xsl:otherwise" or (w.name == "xsl:when" and to_boolean(self._eval(w.attribute("test"), c))):
                self._body(w, c, passed, out, rule)
                return

    def _do_variable(self, n, c, passed, out, rule):
        c.variables[n.attribute("name")] = self._value(n, c, rule)

    def _do_param(self, n, c, passed, out, rule):
        name = n.attribute("name")
        c.variables[name] = passed[name] if name in passed else self._value(n, c, rule)

    def _do_value_of(self, n, c, passed, out, rule):
        text = string(self._eval(n.attribute("select"), c))
        if text:
            out.append(Node("text", None, text, NO_ESCAPE if n.attribute("disable-output-escaping") == "yes" else 0))

    def _do_text(self, n, c, passed, out, rule):
        text = "".join(x.value for x in n.children if x.kind == "text")
        if text:
            out.append(Node("text", None, text, NO_ESCAPE if n.attribute("disable-output-escaping") == "yes" else 0))

    def _use_sets(self, names: str | None, c: Context, e: Node) -> None:
        for name in (names or "").split():
            for s in self.sheet.sets.get(name, []):
                self._use_sets(s.attribute("use-attribute-sets"), c, e)
                self._body(s, self._context(c.node), {}, e)

    def _do_element(self, n, c, passed, out, rule):
        e = out.append(Node("element", self._avt(n.attribute("name"), c)))
        self._use_sets(n.attribute("use-attribute-sets"), c, e)
        self._body(n, c, {}, e, rule)

    def _do_attribute(self, n, c, passed, out, rule):
        value = self._fragment(n, c, rule).text()
        if out.kind == "element" and not out.children:
            out.append(Node("attribute", self._avt(n.attribute("name"), c), value))
        elif out.kind == "document":  # a fragment of attributes: kept for copy-of
            out.append(Node("attribute", self._avt(n.attribute("name"), c), value))

    def _do_copy(self, n, c, passed, out, rule):
        x = c.node
        if x.kind == "document":
            self._body(n, c, {}, out, rule)
        elif x.kind == "element":
            e = out.append(Node("element", x.name))
            self._use_sets(n.attribute("use-attribute-sets"), c, e)
            self._body(n, c, {}, e, rule)
        else:
            _copy(x, out)

    def _do_copy_of(self, n, c, passed, out, rule):
        v = self._eval(n.attribute("select"), c)
        if not isinstance(v, list):
            out.append(Node("text", None, string(v)))
            return
        for x in v:
            _copy(x, out)

    def _do_comment(self, n, c, passed, out, rule):
        out.append(Node("comment", None, self._fragment(n, c, rule).text()))

    def _do_processing_instruction(self, n, c, passed, out, rule):
        out.append(Node("pi", self._avt(n.attribute("name"), c), self._fragment(n, c, rule).text().lstrip()))

    def _do_message(self, n, c, passed, out, rule):
        text = self._fragment(n, c, rule).text()
        log.warning("%s", text)
        if self.env.messages is not None:
            self.env.messages.append(text)
        if n.attribute("terminate") == "yes":
            raise StylesheetError(text)

    def _do_number(self, n, c, passed, out, rule):
        picture = self._avt(n.attribute("format") or "1", c)
        if n.attribute("value") is not None:
            numbers = [int(to_number(self._eval(n.attribute("value"), c)) + 0.5)]
        else:
            numbers = self._numbers(n, c)
        mark, size = n.attribute("grouping-separator"), n.attribute("grouping-size")
        group = (self._avt(mark, c), int(to_number(self._avt(size, c)))) if mark and size else None
        out.append(Node("text", None, _formatted(numbers, picture, group)))

    def _numbers(self, n: Node, c: Context) -> list[int]:
        x = c.node
        count, start = n.attribute("count"), n.attribute("from")

        def counted(y: Node) -> bool:
            if count is None:
                return y.kind == x.kind and y.name == x.name
            return any(self._matches(y, p, c) for p in _alternatives(parse(count)))

        def stop(y: Node) -> bool:
            return start is not None and any(self._matches(y, p, c) for p in _alternatives(parse(start)))

        if n.attribute("level") == "any":
            total = 0
            for y in x.root().walk():
                if y.kind == "attribute":
                    continue
                if stop(y):
                    total = 0
                total += counted(y)
                if y is x:
                    break
            return [total] if total else []
        chain = []
        for y in axis(x, "ancestor-or-self"):
            if stop(y):
                break
            if counted(y):
                chain.append(1 + sum(counted(s) for s in axis(y, "preceding-sibling")))
                if n.attribute("level") != "multiple":
                    break
        return chain[::-1]


def _copy(x: Node, out: Node) -> None:
    if x.kind == "document":
        for child in x.children:
            _copy(child, out)
        for a in x.attributes:
            _copy(a, out)
        return
    made = Node(x.kind, x.name, x.value, x.flags & NO_ESCAPE)
    if x.kind == "attribute":
        if not out.children:
            out.append(made)
        return
    made = out.append(made)
    for a in x.attributes:
        made.append(Node("attribute", a.name, a.value))
    for child in x.children:
        _copy(child, made)


def _formatted(numbers: list[int], picture: str, group: tuple[str, int] | None = None) -> str:
    """Numbers by a picture such as ``1.``, ``A``, ``i`` or ``01-a``; the last token serves all further numbers."""
    parts = re.split(r"([^\W_]+)", picture)
    tokens, marks = parts[1::2] or ["1"], parts[2:-1:2]
    out = []
    for i, k in enumerate(numbers):
        token = tokens[min(i, len(tokens) - 1)]
        if i:
            out.append(marks[min(i - 1, len(marks) - 1)] if marks else ".")
        digits = _one(k, token)
        if group and token[-1:] == "1":
            digits = re.sub(rf"(?<=\d)(?=(\d{{{group[1]}}})+$)", lambda _: group[0], digits)
        out.append(digits)
    return parts[0] + "".join(out) + (parts[-1] if len(parts) > 1 else "")


def _one(k: int, token: str) -> str:
    if token[-1:] == "1":
        return str(k).rjust(len(token), "0")
    if token in ("a", "A"):
        out = ""
        while k > 0:
            k, digit = divmod(k - 1, 26)
            out = chr(ord(token) + digit) + out
        return out
    if token in ("i", "I"):
        out = ""
        for value, roman in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            times, k = divmod(k, value)
            out += roman * times
        return out if token == "i" else out.upper()
    return str(k)

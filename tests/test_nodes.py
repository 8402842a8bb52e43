import pytest
from pyspark.sql import functions as F

from arbordf.plans import nodes as nodes_module
from arbordf.plans.evaluate import Context, evaluate
from arbordf.plans.nodes import NodeDocuments
from arbordf.plans.parser import parse
from arbordf.sources.serialize import serialize_nodes
from arbordf.sources.shred import Builder, from_string, tree_rows
from arbordf.sources.tree import parse_html, parse_xml

XML = '<a x="1"><b id="p">one</b><b id="q">two<c>3</c></b><c>7</c><d ref="q"/></a>'
PATHS = [
    "/a/b", "//c", "/a/b[2]/c", "//b[last()]", "//@id", "/a/*[position() > 1]", "//c/ancestor::*", "//c/preceding::*", "//c/following::*",
    "/a/b[1]/following-sibling::*", "//d/preceding-sibling::*[1]", "//b[@id = 'q']", "//*[c]", "//*[not(c)]", "/a/b[c = 3]", "/a/c[. > //b/c]",
    "//b | //d", "//text()", "//*[@id = //@ref]", "//c/ancestor-or-self::*", "//b/descendant-or-self::node()", "//c/..", "//*[d]", "//d[@ref]", "//b[string-length(.) = 4]",
]


@pytest.fixture(scope="module")
def nodes(spark):
    return NodeDocuments(from_string(spark, XML, "d").cache(), keys={"k": ("b", "@id")})


@pytest.mark.parametrize("path", PATHS)
def test_plan_equals_tree_walk(nodes, path):
    doc = parse_xml(XML)
    expected = sorted(n.order for n in evaluate(parse(path), Context(doc)))
    assert sorted(r["pre"] for r in nodes.find(path).collect()) == expected


def test_keys_and_values(nodes):
    assert [r["pre"] for r in nodes.find("key('k', 'q')").collect()] == [6]
    got = nodes.evaluate(nodes.find("//b"), {"n": "name()", "s": "string(.)", "c": "count(*)", "id": "@id"}).orderBy("node_id").collect()
    assert [tuple(r)[2:] for r in got] == [("b", "one", 0.0, "p"), ("b", "two3", 1.0, "q")]


def test_axes_partition_the_document():
    doc = parse_xml(XML)
    elements = [n for n in doc.walk() if n.kind != "attribute"]
    from arbordf.plans.evaluate import axis

    for n in elements:
        parts = [x.order for a in ("ancestor", "descendant", "preceding", "following", "self") for x in axis(n, a)]
        assert sorted(parts) == sorted(e.order for e in elements)


SIBLINGS = '<a><b k="1"/><c/><b k="2"><d/><d/></b>t<b k="3"/><c/><c/><b k="4"/><e k="2" f="4"/><e k="9" f="1"/><e f="4"/><e k="4"/><b k="2"/></a>'


@pytest.mark.parametrize("stretch", [1, 3, 1 << 16])
def test_neighbours_over_stretches(spark, monkeypatch, stretch):
    """No window is open towards the end: there each row would read all rows after it."""
    monkeypatch.setattr(nodes_module, "STRETCH", stretch)
    d, doc = NodeDocuments(from_string(spark, SIBLINGS, "d")), parse_xml(SIBLINGS)
    for path in ("//c/following-sibling::b[1]", "//*/preceding-sibling::c[1]", "/a/*/following-sibling::*[1]", "//b/following-sibling::e[1][@f]"):
        got = d.find(path)
        assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
        assert sorted(r["pre"] for r in got.collect()) == sorted(n.order for n in evaluate(parse(path), Context(doc))), path


def test_current_and_parents_pair_nothing(spark):
    """Siblings met through the parent: an equi-join by value, or one count for each parent, never all pairs."""
    d = NodeDocuments(from_string(spark, SIBLINGS, "d"))
    columns = {"k": "@k", "same": "count(../b[@k = current()/@k])", "turned": "count(../b[current()/@f = @k][2])", "all": "count(exsl:node-set(../b))", "sum": "sum(../b/@k)", "up": "count(../..)", "none": "count(../../x)"}
    got = d.evaluate(d.find("//e"), columns)
    assert [tuple(r)[2:] for r in got.orderBy("node_id").collect()] == [("2", 2, 0, 5, 12, 1, 0), ("9", 0, 0, 5, 12, 1, 0), (None, 0, 0, 5, 12, 1, 0), ("4", 1, 0, 5, 12, 1, 0)]
    for path in ("count(../b[@k = current()/@k])", "count(../b)"):
        joins = [line for line in d.evaluate(d.find("//e"), {"n": path})._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "parent_id" in line]
        # children meet a parent by value too, or a parent that stands there once
        assert joins and (path == "count(../b)" or any("_wanted" in line for line in joins)), joins
    plan = d.evaluate(d.find("//e"), {"n": "count(../b)"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and d.reduced(d.find("//e"), parse("../b"), (F.count("*"), False))[0].count() == 4


def test_serialize_nodes(spark):
    text = '<a x="1&amp;2"><b>t&lt;</b><c/></a>'
    assert serialize_nodes(from_string(spark, text)).first()["xml"] == text


def test_builder_and_html(spark):
    b = Builder("x")
    e = b.element(None, "r")
    b.attribute(e, "k", "v")
    b.text(e, "t")
    b.fragment(e, "<z/>")
    assert b.frame(spark).count() == 5
    rows = tree_rows("h", parse_html('<!DOCTYPE html><p>a<br>b<script>var t="</p>"</script><p>c'))
    assert [r[7] for r in rows if r[6] == "element"] == ["p", "br", "script", "p"]


def test_references_end_in_a_semicolon():
    page = '<p a="x&amp;y&copy=2&quot;">a&amp;&amp<b>&am&#65;&#66 &copy;&nope;\ue000</b><script>"&amp;&lt"</script></p>'

    def texts(root):
        return [n.value for n in root.walk() if n.kind in ("text", "attribute")]

    assert texts(parse_html(page)) == ['x&y&copy=2"', "a&&amp", "&amA&#66 \u00a9&nope;\ue000", '"&amp;&lt"']
    assert texts(parse_html(page, ("lt", "gt", "amp"))) == ["x&y&copy=2&quot;", "a&&amp", "&am&#65;&#66 &copy;&nope;\ue000", '"&amp;&lt"']


def test_empty_document_is_an_error():
    with pytest.raises(ValueError):
        parse_xml(" ")

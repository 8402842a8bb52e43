import pytest

from arbordf.engine import Engine, plural_form, url_key
from arbordf.plans.stylesheet import Environment, Stylesheet, StylesheetError
from arbordf.sources.messages import parse_messages

HEAD = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output omit-xml-declaration="yes"/>'
DOC = '<a><b id="p" n="1">x</b><b n="10">y&amp;</b><b n="2">z</b></a>'


def run(body, doc=DOC, **more):
    return Stylesheet.from_string(f"{HEAD}{body}</xsl:stylesheet>").render(doc, **more)


CASES = [
    ('<xsl:template match="/"><o><xsl:for-each select="//b"><xsl:sort select="@n" data-type="number"/><xsl:value-of select="@n"/>,</xsl:for-each></o></xsl:template>', "<o>1,2,10,</o>"),
    ('<xsl:template match="/"><o><xsl:for-each select="//b"><xsl:sort select="@n"/><xsl:value-of select="@n"/>,</xsl:for-each></o></xsl:template>', "<o>1,10,2,</o>"),
    ('<xsl:template match="b">[<xsl:value-of select="."/>]</xsl:template><xsl:template match="b[@n=2]">two</xsl:template>', "[x][y&amp;]two"),
    ('<xsl:template match="*"><xsl:copy/></xsl:template><xsl:template match="a" priority="2"><xsl:apply-templates/></xsl:template>', "<b/><b/><b/>"),
    ('<xsl:key name="k" match="b" use="@id"/><xsl:template match="/"><xsl:value-of select="key(\'k\', \'p\')/@n"/></xsl:template>', "1"),
    ('<xsl:variable name="v"><i>1</i><i>2</i></xsl:variable><xsl:template match="/"><xsl:value-of select="sum(exsl:node-set($v)/i)"/></xsl:template>', "3"),
    ('<xsl:param name="q" select="5"/><xsl:template match="/"><xsl:value-of select="$q + 1"/></xsl:template>', "6"),
    ('<xsl:template match="/"><xsl:value-of select="format-number(1234.5, \'#,##0.00\')"/>|<xsl:value-of select="format-number(number(\'x\'), \'#\')"/></xsl:template>', "1,234.50|NaN"),
    ('<xsl:template match="/"><xsl:for-each select="//b"><xsl:if test="position() = last()"><xsl:value-of select="."/></xsl:if></xsl:for-each></xsl:template>', "z"),
    ('<xsl:attribute-set name="s"><xsl:attribute name="k">v</xsl:attribute></xsl:attribute-set><xsl:template match="/"><x xsl:use-attribute-sets="s"/></xsl:template>', '<x k="v"/>'),
    ('<xsl:template match="/"><xsl:text disable-output-escaping="yes">&lt;hr&gt;</xsl:text><xsl:value-of select="//b[2]"/></xsl:template>', "<hr>y&amp;"),
    ('<xsl:strip-space elements="*"/><xsl:template match="/"><xsl:value-of select="count(//node())"/></xsl:template>', "7"),
    ('<xsl:template match="/"><xsl:value-of select="document(\'\')//xsl:template/@match"/></xsl:template>', "/"),
]


@pytest.mark.parametrize("body,expected", CASES)
def test_cases(body, expected):
    assert run(body) == expected


def test_parameters_and_host_functions():
    assert run('<xsl:param name="q"/><xsl:template match="/"><xsl:value-of select="$q"/></xsl:template>', params={"q": "z"}) == "z"
    env = Environment(functions={"up": str.upper})
    assert run('<xsl:template match="/"><xsl:value-of select="up(//b[1])"/></xsl:template>', env=env) == "X"


def test_terminate():
    with pytest.raises(StylesheetError):
        run('<xsl:template match="/"><xsl:message terminate="yes">no</xsl:message></xsl:template>')


def test_import_precedence(tmp_path):
    (tmp_path / "i.xsl").write_text(f'{HEAD}<xsl:template match="b">old</xsl:template><xsl:template match="a">(<xsl:apply-templates/>)</xsl:template></xsl:stylesheet>')
    (tmp_path / "m.xsl").write_text(f'{HEAD}<xsl:import href="i.xsl"/><xsl:template match="b">new<xsl:apply-imports/></xsl:template></xsl:stylesheet>')
    assert Stylesheet.from_file(str(tmp_path / "m.xsl")).render("<a><b/></a>") == "(newold)"


def test_task_graph():
    s = Stylesheet.from_string(f'{HEAD}<xsl:template match="/"><xsl:call-template name="f"/></xsl:template><xsl:template name="f"/></xsl:stylesheet>')
    assert ("/", "f") in s.task_graph()[1] and "<graphml>" in s.graphml()


def test_engine_functions(spark):
    e = Engine(spark, url_prefix="cdn", revisions={"a": "3"}, url_callback=lambda key: f"/u/{key}", url_parameters={"p": "1"})
    e.define_rights("l", "g", ["edit"])
    e.set_user("l", ["g"])
    e.load_messages('msgid "hi"\nmsgstr "salve {n}"\n')
    docs = spark.createDataFrame([("1", "<r/>"), ("2", None)], "id string, xml string")
    body = "".join(f"<xsl:value-of select=\"{x}\"/>;" for x in ("ltr:veristat_local('a')", "ltr:url_code('x', '-p')", "chk:check_rights('edit')", "ltr:__l('hi', 'n', 'Q')"))
    got = {r[0]: r[1] for r in e.transform(Stylesheet.from_string(f'{HEAD}<xsl:template match="/">{body}</xsl:template></xsl:stylesheet>'), docs, "id", "xml").collect()}
    assert got == {"1": "cdn/static/a?3;/u/x,p,1;true;salve Q;", "2": None}


def test_plurals_keys_and_catalogues():
    assert [plural_form("ru", n) for n in (1, 2, 5, 11, 21, 112)] == [0, 1, 2, 2, 0, 2]
    assert [plural_form("en", n) for n in (0, 1, 2)] == [1, 0, 1]
    assert url_key(("a", "-x", "b"), {}) == "a,,b"
    assert parse_messages('msgid "a"\nmsgstr "b\\n"\n"c"\n')["a"] == ["b\nc"]

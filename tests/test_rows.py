"""Row paths and engine functions against plain versions; plans that must stay distributed."""

import base64

import pytest
from pyspark.sql import functions as F

from arbordf import engine as engine_module
from arbordf.engine import Engine
from arbordf.functions.scalars import format_number as column_format
from arbordf.functions.scalars import num
from arbordf.operators.axes import axis_step
from arbordf.plans import evaluate
from arbordf.plans import rows as rows_module
from arbordf.plans.ast import Test, UnsupportedPath
from arbordf.plans.rows import RowDocuments, numbered
from arbordf.plans.stylesheet import Stylesheet
from arbordf.sources.memo import Memo
from arbordf.sources.shred import from_string
from arbordf.streaming import each_batch, transform_stream

HEAD = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output omit-xml-declaration="yes"/>'


@pytest.fixture(scope="module")
def docs(spark):
    t = spark.createDataFrame([(i, i % 3 if i % 7 else None, float(i * i % 11)) for i in range(1, 60)], "k long, g long, v double").repartition(5)
    return RowDocuments({"t": t}, {"t": ["k"]}, {"by-g": ("t", "g")})


def rows(docs):
    return sorted(map(tuple, docs.tables["t"].collect()))


def test_positions_need_no_single_task(docs):
    frame = numbered(docs.tables["t"], ["k"], "_p")
    assert sorted((r["k"], r["_p"]) for r in frame.collect()) == [(i, float(i)) for i in range(1, 60)]
    plan = docs.select("/t/row", {"k": "k", "p": "position()"})._jdf.queryExecution().executedPlan().toString()
    big = [line for line in plan.splitlines() if "Exchange SinglePartition" in line and "sum" not in line and "_block" not in line]
    assert plan.count("Exchange SinglePartition") <= 2 and len(big) <= 2  # the sizes of the blocks
    top = docs.select("/t/row[position() <= 3]", {"k": "k"})
    assert [r[0] for r in top.orderBy("k").collect()] == [1, 2, 3] and "Window" not in top._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in docs.select("/t/row[last()]", {"k": "k"}).collect()] == [59]


def test_siblings(docs):
    all_rows = rows(docs)
    got = docs.select("/t/row[v > 4]", {"k": "k", "before": "preceding-sibling::row[g = current()/g][1]/v", "sum": "sum(following-sibling::row/v)", "n": "count(preceding::row/g)", "next": "following-sibling::row[2]/v"}).collect()
    assert len(got) == sum(v > 4 for _, _, v in all_rows)
    for r in got:
        k, g = r["k"], dict((a, b) for a, b, _ in all_rows)[r["k"]]
        same = [v for a, b, v in all_rows if a < k and b == g]
        assert r["before"] == (same[-1] if same else None)
        assert r["sum"] == sum(v for a, _, v in all_rows if a > k) and r["n"] == sum(b is not None for a, b, _ in all_rows if a < k)
        assert r["next"] == dict((a, v) for a, _, v in all_rows).get(k + 2)


def test_first_of_value(docs):
    def first(path):
        return sorted(r[0] for r in docs.select(path, {"k": "k"}).collect())

    nulls = [k for k, g, _ in rows(docs) if g is None]
    assert first("/t/row[not(g = preceding::row/g)]") == sorted([1, 2, 3, *nulls])
    assert first("/t/row[generate-id(.) = generate-id(key('by-g', g)[1])]") == [1, 2, 3]
    assert first("/t/row[k > 1][not(g = preceding-sibling::row/g)]") == sorted([2, 3, *nulls])
    plan = docs.select("/t/row[not(g = preceding::row/g)]", {"k": "k"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan
    with pytest.raises(UnsupportedPath):
        docs.select("/t/row", {"x": "preceding-sibling::row[v > 3]/v"}).collect()


def test_current_joins_by_equality(docs):
    got = docs.for_each("/t/row[k < 4]", "/t/row[g = current()/g and k != current()/k]", {"a": "current()/k", "b": "k"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    data = rows(docs)
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, g, _ in data for b, h, _ in data if a < 4 and g == h is not None and a != b)


def test_interval_axes_join_by_block(spark):
    nodes = from_string(spark, "<a>" + "<b><c/></b>" * 400 + "</a>", "d")
    context = nodes.filter("name = 'a'").withColumn("oid", F.col("node_id"))
    for axis in ("descendant", "ancestor", "following", "preceding"):
        step = axis_step(context, nodes, axis, Test("any"))
        plan = step._jdf.queryExecution().optimizedPlan().toString()
        join = [line for line in plan.splitlines() if "Join" in line and "block" in line]
        assert join, plan
    assert axis_step(context, nodes, "descendant", Test("name", "c")).count() == 400


def test_large_tables_of_the_host(spark):
    e = Engine(spark, revisions={f"u{i}": str(i) for i in range(engine_module.LITERALS + 10)})
    e.messages = {f"m{i}": [f"a{i}", f"b{i}"] for i in range(engine_module.LITERALS + 10)}
    t = spark.createDataFrame([("u3", "m4"), ("zz", "zz")], "u string, m string")
    got = e.rows({"t": t}, {"t": ["u"]}).select("/t/row", {"s": "ltr:veristat(u)", "l": "ltr:__l(m)", "p": "ltr:__ln(m, 'many', 5)"}).collect()
    assert sorted(map(tuple, got)) == [("/static/u3?3", "a4", "b4"), ("/static/zz", "zz", "many")]


def test_host_function_once_per_distinct_value(spark, tmp_path):
    log = tmp_path / "calls"

    def f(x):
        with open(log, "a") as out:
            out.write(f"{x}\n")
        return x.upper()

    e = Engine(spark)
    e.register("up", f)
    t = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "k long, x string").coalesce(1)
    assert {r[0] for r in e.rows({"t": t}, {"t": ["k"]}).select("/t/row", {"y": "up(x)"}).collect()} == {"A", "B"}
    assert len(log.read_text().split()) == 2


def test_number_pictures_agree(spark):
    pictures, values = ["#,##0.00", "0", "#.##", "000.0", "0%", "#,##0;(0)"], [0.0, 1.5, 2.5, -1234567.125, 0.075, 1e9, float("nan"), float("inf"), -0.005]
    t = spark.createDataFrame([(v,) for v in values], "x double")
    for p in pictures:
        got = [r[0] for r in t.select(column_format(num(F.col("x")), p).col).collect()]
        assert got == [evaluate.format_number(v, p) for v in values], p


def test_memo_expires_and_compacts(spark, tmp_path):
    t, path = spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), f"file://{tmp_path}/memo"
    assert {r["o"] for r in Memo(path, ttl_seconds=None).apply(t, "k", "o", str.upper).collect()} == {"A", "B"}
    assert {r["o"] for r in Memo(path, ttl_seconds=3600).apply(t, "k", "o", lambda k: "new").collect()} == {"A", "B"}
    assert {r["o"] for r in Memo(path, ttl_seconds=0).apply(t, "k", "o", lambda k: "new").collect()} <= {"new", None}
    Memo(path, ttl_seconds=None).compact(spark)
    assert spark.read.parquet(path).count() == 2


def test_include_and_import_of_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.xsl").write_text(f'{HEAD}<xsl:template name="f">F</xsl:template></xsl:stylesheet>')
    (tmp_path / "sub" / "part.xsl").write_text(f'{HEAD}<xsl:include href="deep.xsl"/><xsl:template match="b">b<xsl:call-template name="f"/></xsl:template></xsl:stylesheet>')
    (tmp_path / "main.xsl").write_text(f'{HEAD}<xsl:include href="sub/part.xsl"/><xsl:template match="a">(<xsl:apply-templates/>)</xsl:template></xsl:stylesheet>')
    assert Stylesheet.from_file(str(tmp_path / "main.xsl")).render("<a><b/></a>") == "(bF)"


def test_streams(spark, tmp_path):
    """Documents that arrive as files are transformed batch by batch; a window over time drops late rows."""
    spark.createDataFrame([("1", "<r>x</r>"), ("2", None)], "id string, xml string").write.parquet(f"{tmp_path}/in")
    sheet = Stylesheet.from_string(f'{HEAD}<xsl:template match="/"><o><xsl:value-of select="r"/></o></xsl:template></xsl:stylesheet>')
    stream = spark.readStream.schema("id string, xml string").parquet(f"{tmp_path}/in")
    q = each_batch(transform_stream(stream, sheet, "id", "xml"), lambda df: df.filter("result is not null"), f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("id", "result").collect()] == [("1", "<o>x</o>")]


def test_base64_is_one_line(spark):
    values = ["", "a", "x" * 57, "x" * 58, "\u00e9" * 500]
    t = spark.createDataFrame(list(enumerate(values)), "k long, u string")
    got = RowDocuments({"t": t}, {"t": ["k"]}).select("/t/row", {"k": "k", "b": "ltr:encode_base64(u)"}).collect()
    assert {r["k"]: r["b"] for r in got} == {i: base64.b64encode(v.encode()).decode() for i, v in enumerate(values)}


def test_revisions_of_shared_urls_repeat_no_row(spark):
    rows = spark.createDataFrame([(1, "a"), (3, "a"), (6, "a"), (6, "a"), (7, "b"), (None, "a"), (9, None)], "k long, u string")
    revisions = spark.createDataFrame([("a", 3, "r3"), ("a", 6, "r6"), ("a", 6, "r6"), ("b", 7, None), (None, 9, "r9")], "url string, k long, revision string")

    def got(same):
        return sorted((r["k"] or 0, r["s"] or "") for r in Engine(spark).with_revisions(rows, "u", revisions, "s", same).select("k", "s").collect())

    assert got(["k"]) == [(0, "/static/a"), (1, "/static/a"), (3, "/static/a?r3"), (6, "/static/a?r6"), (6, "/static/a?r6"), (7, "/static/b"), (9, "")]
    assert got([]) == [(0, "/static/a?r6"), (1, "/static/a?r6"), (3, "/static/a?r6"), (6, "/static/a?r6"), (6, "/static/a?r6"), (7, "/static/b"), (9, "")]


def test_siblings_over_blocks(spark, monkeypatch):
    """Small blocks: every edge is met, and no frame is open towards the end (each row would read all rows after it)."""
    monkeypatch.setattr(rows_module, "ROWS", 4)
    data = [(i, i % 3 if i % 7 else None, float(i * i % 11) if i % 5 else None) for i in range(1, 90)]
    docs = RowDocuments({"t": spark.createDataFrame(data, "k long, g long, v double").repartition(5)}, {"t": ["k"]})
    columns = {
        "k": "k", "before": "preceding-sibling::row[1]/v", "after": "following-sibling::row[1]/v", "third": "following-sibling::row[3]/v", "earlier": "count(preceding-sibling::row/v)",
        "later": "sum(following::row/v)", "same": "sum(following-sibling::row[g = current()/g]/v)",
    }
    for path in ("/t/row", "/t/row[v > 4]"):
        got = docs.select(path, columns)
        plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedfollowing" not in plan
        kept = [r for r in data if path == "/t/row" or (r[2] or 0) > 4]
        value = {k: v for k, _, v in data}
        assert [r["k"] for r in got.orderBy("k").collect()] == [k for k, _, _ in kept]
        for r, (k, g, _) in zip(got.orderBy("k").collect(), kept):
            assert (r["before"], r["after"], r["third"]) == (value.get(k - 1), value.get(k + 1), value.get(k + 3))
            assert r["earlier"] == sum(v is not None for a, _, v in data if a < k) and r["later"] == sum(v or 0 for a, _, v in data if a > k)
            assert r["same"] == sum(v or 0 for a, b, v in data if a > k and b == g)

"""Pages as Markdown, form values by tag, and sinks that replace."""

import pytest
from pyspark.sql import functions as F

from cairnwork.functions.scalars import shaped_uuid
from cairnwork.operators import forms as T
from cairnwork.operators.filters import under_policy
from cairnwork.sinks import files
from cairnwork.sources import readers

PAGE = """<html><head><title>no</title></head><body><h2>C2 list</h2><p>Some <b>text</b> &amp; more<br>next</p><script>x | y</script>
<table><tr><th>Waiting list</th><th colspan=2>Total</th></tr><tr><td>Number accepting | a place</td><td> 1,200<br></td><td><table><tr><td>in</td></tr></table></td></tr><tr></tr></table><ul><li>one<li>two</ul></body>"""


def test_pages_become_markdown(spark):
    assert readers.page_markdown(None) == "" and readers.page_markdown("<table></table>") == ""
    lines = readers.page_markdown(PAGE).split("\n")
    assert lines[:3] == ["## C2 list", "Some text & more", "next"]
    assert lines[3:6] == ["| Waiting list | Total |  |", "|---|---|---|", "| Number accepting / a place | 1,200 | in |"]
    assert [x.strip("- ") for x in lines[6:]] == ["one", "two"]
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")
    rows = T.pipe_tables(readers.markdown_pages(pages), "page_id", "markdown").collect()
    assert [(r.section, r.label, r["values"]) for r in rows] == [("C2 list", "Number accepting / a place", ["1,200", "in"])]


def test_form_values(spark):
    values = spark.createDataFrame([(1, "t1", " 5 "), (1, "t2", "/2"), (1, "t2", "/9"), (1, "t3", "/Off"), (1, "t9", "x"), (1, "t1", "")], "doc int, tag string, raw string")
    tags = spark.createDataFrame([("t1", "A.1"), ("t2", "A.2"), ("t3", "A.3")], "tag string, field string")
    options = spark.createDataFrame([("t2", "/2", "Private")], "tag string, code string, label string")
    found, unknown = readers.form_values(values, tags, options)
    assert {tuple(r) for r in found.collect()} == {(1, "A.1", "5"), (1, "A.2", "Private"), (1, "A.2", "9")} and [r.tag for r in unknown.collect()] == ["t9"]


def test_units(spark):
    out = readers.target_units(spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "id string, units array<string>"))
    assert {tuple(r) for r in out.collect()} == {("a", "x"), ("a", "y"), ("b", None), ("c", None)}


def test_replacements(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    out = files.replace_documents(stored, spark.createDataFrame([(1, "z")], "k int, v string"), "k", ["v"])
    assert {tuple(r) for r in out.collect()} == {(1, "z"), (2, "c")}
    with pytest.raises(ValueError):
        files.replace_documents(stored, spark.createDataFrame([(1, None)], "k int, v string"), "k", ["v"])
    path = str(tmp_path / "t")
    assert files.replace_table(stored, path) == 3 and files.replace_table(stored.limit(1), path) == 1


def test_shaped_uuid(spark):
    got = spark.range(1).select(shaped_uuid(F.lit("2024-01-31"))).first()[0]
    import hashlib

    h = hashlib.sha256(b"2024-01-31").hexdigest()
    assert got == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def test_anchors_of_any_quotes(spark):
    html = """<a class=x href="/a">one <b>bold</b></a> <A HREF='b?x=1'>two</A><a href=c.pdf>three</a><a name=n>none</a>"""
    out = readers.anchors(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("position").collect()
    assert [(r.position, r.href, r.label) for r in out] == [(0, "/a", "one bold"), (1, "b?x=1", "two"), (2, "c.pdf", "three")]


def test_links_by_tags(spark):
    html = """<!-- <a href="/hidden">no</a> --><a title="a > b" href="/a">one <b>bold</b>
      line</a><A HREF=/b>two<a href='/c'>three &amp; more</a> after <a name="n">none</a><script>var x = '<a href="/s">s</a>';</script><a href=" /d "></a><a href>x</a>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "no links"), (4, "")], "page_id int, html string")
    got = [(r.page_id, r.position, r.href, r.label) for r in readers.page_links(pages).orderBy("page_id", "position").collect()]
    assert got == [(1, 0, "/a", "one bold line"), (1, 1, "/b", "two"), (1, 2, "/c", "three & more"), (1, 3, "/d", "")]


def test_policies(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, open boolean")
    policies = {"all": [F.col("open"), F.col("id") == 2], "none": []}
    assert sorted(r.id for r in under_policy(rows, policies, "all").collect()) == [1, 2]
    assert under_policy(rows, policies, "none").count() == under_policy(rows, policies, "other").count() == 0


def test_formats(spark):
    zipped = b"PK\x03\x04"
    rows = [(b"%PDF-1.7",), (zipped + b"..xl/workbook.xml",), (zipped + b"..word/document.xml",), (zipped,), (b" <!DOCTYPE html>",), (b"",), (None,)]
    out = spark.createDataFrame(rows, "c binary").select(readers.format_of(F.col("c")).alias("f")).collect()
    assert [r.f for r in out] == ["pdf", "xlsx", "docx", "zip", "html", "other", "other"]

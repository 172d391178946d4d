import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import documents as docs
from shelfwise.sources.files import binary_files

PAGE = (
    "<!DOCTYPE html><html><head><TITLE>A &amp; B</TITLE><style>p{}</style><script>var t='</p>';</script></head>"
    "<body><!-- <p>no</p> --><ul><li><a href='x'>one</a></li><li>two</li></ul><h2>Head</h2><p>par <b>bold</b><br>next"
    "<p>open  par</p>tail<pre>code</pre><div> </div></body></html>"
)


def parse(spark, html):
    df = spark.createDataFrame([("http://h/en/1", html)], "url string, html string")
    return docs.parsed(df, "url", "html")


def test_elements(spark):
    row = parse(spark, PAGE).head()
    assert [(e.id, e.type, e.content) for e in row.elements] == [
        ("0", "title", "A & B"), ("1", "list", "one"), ("2", "list", "two"), ("3", "section_header", "Head"),
        ("4", "text", "par bold next"), ("5", "text", "open par"), ("6", "text", "tail"), ("7", "text", "code"),
    ]
    assert row.parsed_text.split("\n")[0] == "A & B" and row.file_name == "1"
    assert row.elements_json.startswith('[{"id":"0","type":"title","content":"A & B"}')


@pytest.mark.parametrize("html", [None, "", "<div></div>", "<script>x</script>"])
def test_failed_parses_are_dropped(spark, html):
    assert parse(spark, html).count() == 0


def test_whole_text_of_a_long_page(spark):
    html = "<p>" + "word " * 400_000 + "</p>" + "<p>x</p>" * 20_000 + "<p>end</p>"
    row = parse(spark, html).select(F.size("elements").alias("n"), F.element_at("elements", -1).content.alias("last")).head()
    assert (row.n, row.last) == (20_002, "end")


def test_fields(spark):
    text = (
        "glued the.19@mail5.example.com x +1 (743) 555-3824 y 70.23.22.57.\ntoken = \"24be64\" z\n"
        "Licensed under the Apache License, Version 2.0. More"
    )
    df = spark.createDataFrame([(1, text), (2, "v1.2.3.4.5 nothing"), (3, None)], "doc_id int, text string")
    first, second, third = docs.extract_fields(df, "text").collect()
    assert (first.email, first.phone, first.token) == ("the.19@mail5.example.com", "+1 (743) 555-3824", "24be64")
    assert first.licence == "Licensed under the Apache License, Version 2.0"
    assert all(second[f] is None and third[f] is None for f in docs.FIELD_PATTERNS)


def test_field_match_is_first_hit_either_way(spark):
    df = spark.createDataFrame(
        [(1, ["nothing", "Total: 12-34", "12 34"], "12.34", None), (2, ["abc"], "long abc value", "x"), (3, ["q"], "zz", None)],
        "doc_id int, parts array<string>, a string, b string",
    )
    got = {(r.doc_id, r.field): r.line_id for r in docs.match_fields(df, F.col("parts"), ["a", "b"]).collect()}
    assert got == {(1, "a"): 1, (2, "a"): 0, (3, "a"): None}


def test_types_by_lookup(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert [r[0] for r in df.select(docs.typed_by(F.col("k"), {"a": "invoice"})).collect()] == ["invoice", "other", "other"]


def test_binary_files_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, html in (("a.html", PAGE), ("b.html", "<p>b</p>"), ("c.txt", "skip")):
        with open(os.path.join(folder, name), "w") as out:
            out.write(html)
    files = binary_files(spark, folder, "*.html")
    parsed = docs.parsed(files.withColumn("html", F.decode("content", "UTF-8")).drop("content"), "path", "html")
    rows = {r.file_name: r for r in docs.with_file_bytes(parsed, files.filter("file_name = 'b.html'")).collect()}
    assert set(rows) == {"a.html", "b.html"}
    assert rows["b.html"].parsed_text == "b" and rows["b.html"].image_base64 == "PHA+YjwvcD4="
    assert rows["a.html"].image_base64 is None

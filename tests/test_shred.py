"""The tree's rules, checked against a second, independent reading of the same pages."""

import html as html_module
import random
import re

from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.operators import shred as S
from pageloom.operators.shred import shred


def dom_of(df, **options):
    """Nodes as dictionaries, with the strings their intervals stand for."""
    row = shred(df, **options).first()
    strings = row["dom_strings"]
    return [n.asDict() | {
        "parts": None if n["first"] is None else strings[n["first"] : n["upto"]], "lead": None if n["lead"] is None else strings[n["lead"]],
        "text": strings[n["first"]] if n["kind"] != "element" else None} for n in row["dom"]]


def outline(dom):
    return [(n["depth"], n["tag"] or n["kind"]) for n in dom]


def test_unclosed_elements_nest_and_stray_ends_are_ignored(page):
    dom = dom_of(page("<div><p>a<p>b</b></div><i>c"), text_nodes=True)
    assert outline(dom) == [(0, "div"), (1, "p"), (2, "text"), (2, "p"), (3, "text"), (0, "i"), (1, "text")]


def test_void_and_self_closed_elements_hold_nothing(page):
    dom = dom_of(page("<br>x<img src=a>y<div/>z"), text_nodes=True)
    assert {n["depth"] for n in dom} == {0}


def test_script_text_is_raw_and_outside_page_text(page):
    dom = dom_of(page("<p>a<script>var t='</p><b>';</script>b</p>"), text_nodes=True, parts_of=("p", "script"))
    assert dom[0]["parts"] == ["a", "b"]
    assert [n["parts"] for n in dom if n["tag"] == "script"] == [["var t='</p><b>';"]]
    assert [n["kind"] for n in dom if n["text"] and "var" in n["text"]] == ["raw"]


def test_source_spans(page):
    source = "<html><body class=x><p>é 1<b>2</b></p><footer>f</footer >tail"
    spans = {n["tag"]: source[n["lo"]:n["hi"]] for n in dom_of(page(source))}
    assert spans["p"] == "<p>é 1<b>2</b></p>"
    assert spans["footer"] == "<footer>f</footer >"
    assert spans["body"] == source[6:]


def test_attributes_and_entities(page):
    dom = dom_of(page('<a HREF="/x?a=1&amp;b=2" class=" k  j " hidden>A &lt; B</a>'), parts_of=("a",))
    assert dict(dom[0]["attrs"]) == {"href": "/x?a=1&b=2", "class": " k  j ", "hidden": ""}
    assert dom[0]["lead"] == "A < B"
    kept = dom_of(page("<a href=x id=y>z</a>"), attrs=("id",))
    assert dict(kept[0]["attrs"]) == {"id": "y"}


def test_decode_twice(page):
    assert dom_of(page("<p>&amp;copy;</p>"), parts_of=("p",))[0]["parts"] == ["&copy;"]
    assert dom_of(page("<p>&amp;copy;</p>"), parts_of=("p",), decode_twice=True)[0]["parts"] == ["©"]


def test_missing_html_keeps_its_row(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "")], "page_id long, url string, html string")
    rows = {r["page_id"]: r["dom"] for r in shred(df).collect()}
    assert rows == {1: None, 2: []}


def test_intervals_nest_on_the_test_pages(spark):
    df = shred(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), text_nodes=True)
    bad = df.select(F.filter("dom", lambda n: (n["parent"] >= 0) & (
        (F.get("dom", n["parent"])["end"] < n["end"]) | (n["parent"] >= n["id"])
        | (F.get("dom", n["parent"])["depth"] + 1 != n["depth"]))).alias("bad")).where(F.size("bad") > 0)
    assert bad.isEmpty()


def test_page_text_is_source_text(spark):
    """All strings of a page equal its source with markup removed by pattern."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r[0]: r[1] for r in shred(pages, text_nodes=True).select("page_id", F.array_join(F.transform(
        F.filter("dom", lambda n: n["kind"] == "text"), N.string), "")).collect()}
    for row in pages.collect():
        bare = re.sub(r"(?s)<(script|style)>.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", row["html"])
        assert got[row["page_id"]] == html_module.unescape(re.sub(r"<[^>]+>", "", bare))


def test_deep_nesting(page):
    dom = dom_of(page("<div>" * 3000 + "x"), text_nodes=True)
    assert len(dom) == 3001 and dom[0]["end"] == 3000 and dom[-1]["depth"] == 3000


def test_output_batches_split(spark):
    html = "<p>x</p>" * 4000
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(html).alias("html"))
    sizes = shred(df).groupBy(F.size("dom").alias("n")).count().collect()
    assert [(r["n"], r["count"]) for r in sizes] == [(4000, 40)]


def test_plain_tags_are_read_as_the_library_reads_them(monkeypatch):
    bits = ["<p>", "</p>", "<P>", "</P >", '<div class="a b">', "</div>", "<br/>", '<img src="x" alt="a &amp; b&copy=2">', "<img src=x alt>", "<a href='i' id=\"i\">",
            "</a>", "<script>", '<script type="x">"<p>";', "</script>", "<title>", "</title>", "<!-- c -->", "<![foo y]>", "text", "&lt;b", "&", "<", '<a b="c"d="e">',
            '<A  B="x\n" b="y" >', '<x-y z="1">', "<p\x0bq=\"1\">", '<p a="1', "</", '</a b="c">', "<pre>", "</pre>", "<xmp>", "\x00", '<p =x="1">', "<style>", "</style>"]
    chance, want = random.Random(4), {"parts_of": None, "parts_of_class": frozenset(), "text_nodes": True, "attrs": None, "decode_twice": "both"}
    pages = ["".join(chance.choices(bits, k=chance.randrange(1, 25))) for _ in range(3000)]

    def read(pages):
        reader = S._TreeReader(want)
        for source in pages:
            reader.add_page(source)
        return [column.to_pylist() for column in reader.to_arrow()]

    asked = []
    library = S.HTMLParser.parse_starttag
    monkeypatch.setattr(S.HTMLParser, "parse_starttag", lambda self, i: asked.append(i) or library(self, i))
    plain = read(['<div class="a"><p>x</p><br></div>'] * 5)
    assert not asked and [n["tag"] for n in plain[0][0]][:2] == ["div", "p"]
    found = read(pages)
    for pattern in ("_PLAIN_START", "_PLAIN_END"):
        monkeypatch.setattr(S, pattern, re.compile("(?!)"))
    assert read(pages) == found

import pytest
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.operators import boilerplate as B
from pageloom.operators import sections as S
from pageloom.operators import special as P
from pageloom.operators.shred import HEADINGS, shred
from pageloom.sources import sinks


def sections(df, dropped=None):
    rows = S.section_rows(shred(df, parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True), dropped)
    return [(r["header"], r["kind"], r["text"] if r["text"] is not None else r["items"]) for r in rows.orderBy("pos").collect()]


HIDING = {
    'style="display: none"': False, 'style="display:none"': True, 'style="VISIBILITY: hidden"': False, 'style="opacity: 0.5"': False,
    'style="position: absolute; top: -9999px"': False, 'style="left: -9999px"': True, 'aria-hidden="TRUE"': False,
    'aria-hidden="false"': True, "hidden": False, 'class="Hidden-x"': False, 'class="shown"': True, "": True,
}


@pytest.mark.parametrize("attributes,visible", HIDING.items())
def test_each_visibility_rule_and_its_descendants(page, attributes, visible):
    df = page(f"<body><div><div {attributes}><section><p>x</p></section></div></div></body>")
    assert sections(df) == ([("unassociated", "text", "x")] if visible else [])


def test_a_hidden_child_hides_its_parent_unless_marked(page):
    body = "<body><div><p>a</p><i style='display: none'>b</i>{}</div></body>"
    assert sections(page(body.format(""))) == []
    shown = "<body><div><p>a</p><i style='display: none' aria-hidden=true>b</i></div></body>"
    assert sections(page(shown)) == [("unassociated", "text", "a")]
    dom = shred(page(body.format(""))).select(N.hidden(F.col("dom"), relaxed=True).alias("h"), "dom").first()
    assert [n["tag"] for n, h in zip(dom["dom"], dom["h"]) if h] == ["i"]


def test_walk_order_headers_and_block_kinds(page):
    html = """<body>lead<h2>“One” </h2><p>a <b>b</b></p><div>c<span>d</span><h3></h3></div><h2 hidden>no</h2>
      <ul><li>1</li></ul><ul><li>1</li><li>2 <ol><li>3</li></ol></li></ul><ol><li>x</li></ol><menu><li>m <p>n</p></li></menu>
      <div class="code"><pre>p  q</pre></div><pre>gone</pre><pre lang=py>r</pre><a href=x>l</a><!-- c --><p>-</p></body>"""
    one = 'H2: "One"'
    assert sections(page(html)) == [
        ("unassociated", "text", "lead"), (one, "text", "a b"), (one, "text", "c"), (one, "text", "d"),
        (one, "list", ["1", "2 3", "3"]), (one, "ordered_list", ["1. x"]), (one, "list_items", ["m n"]),
        (one, "code", "p q"), (one, "code", "r"), (one, "text", "l")]


def test_tables(page):
    html = """<body><p>before</p><table></table><table><tr><th>h</th></tr><tr><td>1</td></tr></table>
      <table><tr><td>A</td><td>B</td><td>A</td></tr><tr><td>1</td><td>2<br> x</td><td>3</td><td>4</td></tr><tr><td>5</td></tr></table></body>"""
    page_ = shred(page(html), parts_of=S.SECTION_PARTS, text_nodes=True)
    rows = [tuple(r)[1:] for r in S.table_rows(page_).orderBy("table_pos", "row_idx", "col_idx").collect()]
    assert rows == [(2, 0, 0, "A", "1"), (2, 0, 1, "B", "2\nx"), (2, 0, 2, "A", "3"), (2, 1, 0, "A", "5")]
    tables = page_.select(S.html_tables(F.col("dom")).alias("t")).first()["t"]
    assert [(t["pre"], t["columns"]) for t in tables] == [("before", []), ("before", []), ("before", ["A", "B", "A"])]
    table = F.element_at(S.html_tables(F.col("dom")), -1)
    maps = page_.select(table.alias("t")).select(F.transform("t.rows", lambda r: S.row_map(F.col("t.columns"), r)).alias("m"))
    assert maps.first()["m"] == [{"A": "3", "B": "2\nx"}, {"A": "5"}]


def test_content_by_headers(page):
    html = """<h1>T</h1>s1<p>a <b> b</b></p><h2>U</h2><a href=x>l</a><div><h2>in</h2>deep</div><h2>U</h2>second<h1> </h1>end"""
    rows = shred(page(html), parts_of=HEADINGS, text_nodes=True).select(S.content_by_headers(F.col("dom")).alias("c")).first()["c"]
    assert [(r["level"], r["header"], r["content"]) for r in rows] == [
        (1, "T", "s1\na b\nU\nLink: l\nin deep\nU\nsecond"), (2, "U", "Link: l\nin deep"), (2, "in", "deep"), (2, "U", "second"), (1, "", "end")]
    merged = shred(page(html), parts_of=HEADINGS, text_nodes=True).select(
        S.content_map(S.content_by_headers(F.col("dom"))).alias("m")).first()["m"]
    assert merged["U"] == "second"


def test_clean_scrape_scope_and_order(page):
    html = "<title>t</title><p>out</p><div id=main-content><p>b</p><nav><p>n</p></nav><h2>h</h2><p>b</p><li> c <i> d</i></li></div>"
    row = shred(page(html), parts_of=("title", "p", "li", *HEADINGS)).select(S.clean_scrape(F.col("dom")).alias("c")).first()["c"]
    assert (row["clean_data"], row["char_count"], row["title"]) == ("h\nb\ncd", 4, "t")


def test_section_text_is_visible_text(spark):
    """Every word of a section stands in the page's text."""
    page_ = shred(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), parts_of=S.SECTION_PARTS, text_nodes=True)
    words = F.split(F.regexp_replace(F.concat_ws(" ", F.transform(
        F.filter("dom", lambda n: n["kind"] == "text"), N.string)), r"[^\x21-\x7F]+", " "), " ")
    found = page_.select(words.alias("w"), F.explode(S.sections(F.col("dom"))).alias("b")).where("b.kind = 'text' and b.text not like '%.%'")
    assert found.where(~F.forall(F.split("b.text", " "), lambda x: F.array_contains("w", x))).where(
        ~F.col("b.text").rlike("[A-Za-z]")).isEmpty()


def test_site_rules_from_data(page, spark):
    html = "<body><div class='keep ad-slot'><p>a</p></div><aside><p>b</p></aside><nav><p>c</p></nav><p role=note>d</p><p class=x-hero>e</p></body>"
    rules = spark.createDataFrame([("example.com", ["keep"], ["hero"], None, None, ["aside"], None, None, ["note"], ["nav"], None)], B.SITE_FILTERS)
    df = B.with_site_filters(shred(page(html)).withColumn("website", F.lit("example.com")), rules)
    hits = {(r["tag"], r["rule"]) for r in B.dropped_rows(df, B.Filters(content=True, by_class=True)).collect()}
    assert hits == {("div", "class"), ("aside", "name"), ("p", "parent_name"), ("p", "role"), ("p", "class")}
    assert B.dropped_rows(df, B.Filters()).isEmpty()
    other = df.withColumn("website", F.lit("z")).withColumn("site", F.lit(None).cast(df.schema["site"].dataType))
    assert {r["tag"] for r in B.dropped_rows(other, B.Filters(content=True, by_class=True)).collect()} == {"nav", "p"}


def test_search_page_without_results(page):
    assert P.search_result_rows(shred(page("<div class=main><p>x</p></div>"), **P.serp_parts())).isEmpty()
    assert P.search_result_rows(shred(page("<p>x</p>"), **P.serp_parts())).isEmpty()


def test_documents_of_a_bare_page(page):
    df = shred(page("<p>x</p>"), parts_of=S.SECTION_PARTS, text_nodes=True).withColumn("website", F.lit("w")).withColumn("unique_page_name", F.lit("n"))
    row = sinks.page_documents(df).first()
    assert row["organized"].endswith(', "unassociated": []}') and '"tables": {}' in row["structured"]

"""Stored shredding: strings once per page, fields read as leaf columns, jobs that do not shred again."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.operators import elements as E
from pageloom.operators import sections as S
from pageloom.operators.shred import shred
from pageloom.plans import crawl as C
from pageloom.plans.options import OPTIONS, extract, extract_stored
from pageloom.sources.shredded import ATTRIBUTES, TEXT, read_shredded, write_shredded

MARKUP = ("<!DOCTYPE html><html><head><title>A &amp;amp; B</title><script>var x='</p>';</script><style>p {}</style></head><body><!-- note -->"
          "<h1>One</h1><template><a href=/t>in a template</a><!-- inner -->text</template><p>a<p>b <b>&amp;lt;c</b></p></body>")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shredded") / "pages")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = spark.createDataFrame([(-1, "http://h/x", MARKUP), (-2, "http://h/y", None), (-3, "http://h/z", "")], "page_id long, url string, html string")
    pages = pages.select("page_id", "url", "html").unionByName(extra)
    write_shredded(pages, path, partitions=2)
    return path, pages


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_options_are_the_same_from_the_store(spark, stored):
    path, pages = stored
    results = extract_stored(spark, path, list(OPTIONS))
    assert rows(results) == rows(extract(pages, list(OPTIONS)))
    assert "MapInArrow" not in plan(results) and "Exchange" not in plan(results)
    for name in OPTIONS:  # each with just what it says it reads
        assert rows(extract_stored(spark, path, [name])) == rows(extract(pages, [name])), name


def test_only_the_fields_named_are_read(spark, stored):
    path, _ = stored
    schema = lambda df: df._jdf.queryExecution().executedPlan().collectLeaves().head().requiredSchema().json()
    text = schema(extract_stored(spark, path, ["get_h1"]))
    assert "attrs" not in text and "html" not in text and "dom_strings" in text and "first" in text
    text = schema(extract_stored(spark, path, ["get_video_links"]))
    assert "attrs" in text and "html" not in text and "dom_strings" not in text and "first" not in text
    text = schema(extract_stored(spark, path, ["extract_emails"]))
    assert "html" in text and "attrs" not in text and "dom_strings" not in text
    assert "dom_strings_twice" not in schema(read_shredded(spark, path, (*ATTRIBUTES, *TEXT)))


def test_jobs_are_the_same_from_the_store(spark, stored):
    path, pages = stored
    twice = read_shredded(spark, path, decode_twice=True)
    again = shred(pages, parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True, keep_html=True)
    # Jobs beside the sections see strings decoded once.
    assert rows(S.section_rows(twice)) == rows(S.section_rows(again))
    for job in (C.crawl_items, C.simple_pages, C.parse_data):
        assert rows(job(read_shredded(spark, path))) == rows(job(pages)) and "MapInArrow" not in plan(job(read_shredded(spark, path)))
    assert rows(E.link_rows(read_shredded(spark, path))) == rows(E.link_rows(shred(pages, parts_of=("a",), attrs=("href", "class", "id"))))


def test_strings_of_every_kind(spark, stored):
    path, _ = stored
    row = read_shredded(spark, path).where("page_id = -1").first()
    twice = read_shredded(spark, path, decode_twice=True).where("page_id = -1").first()
    text = lambda r, n: None if n["first"] is None else r["dom_strings"][n["first"] : n["upto"]]
    by_tag = {n["tag"]: text(row, n) for n in row["dom"] if n["tag"]}
    assert by_tag["title"] == ["A &amp; B"] and by_tag["script"] == ["var x='</p>';"] and by_tag["style"] == ["p {}"]
    assert by_tag["template"] == ["in a template", "text"] and by_tag["a"] == [] and by_tag["b"] == ["&lt;c"]
    assert by_tag["body"] == ["One", "a", "b ", "&lt;c"]
    assert [text(row, n) for n in row["dom"] if n["kind"] in ("comment", "other")] == [["DOCTYPE html"], [" note "], [" inner "]]
    assert [row["dom_strings"][n["lead"]] for n in row["dom"] if n["tag"] == "a"] == ["in a template"]
    assert [text(twice, n) for n in twice["dom"] if n["tag"] in ("title", "b")] == [["A & B"], ["<c"]]
    assert len(row["dom_strings"]) == len(set(n["first"] for n in row["dom"] if n["kind"] != "element"))


def test_nested_elements_repeat_nothing(spark):
    n = 4000
    page = spark.createDataFrame([(1, "u", "".join(f"<p>{i} " for i in range(n)))], "page_id long, url string, html string")
    row = shred(page, parts_of=("p",)).first()
    assert len(row["dom_strings"]) == n == len(row["dom"])
    assert [(x["first"], x["upto"]) for x in row["dom"]] == [(i, n) for i in range(n)]
    sizes = shred(page, parts_of=("p",)).select(F.aggregate("dom", F.lit(0), lambda a, x: a + F.size(N.parts(x)))).first()[0]
    assert sizes == n * (n + 1) // 2

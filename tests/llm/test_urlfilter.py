import pytest
from pyspark.sql import functions as F

from pageloom.llm import urlfilter
from pageloom.llm.queries import URL_RULES

URLS = {
    "http://a.NET/x": ("a.net", "/x", "net/", "block"), "https://EXAMPLE.net/en/a?b#c": ("example.net", "/en/a", "example.net/en/", "allow"),
    "http://www.example.net/en": ("www.example.net", "/en", "net/", "block"), "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
    "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://a.net": ("a.net", "", None, "allow"), "http://a.net?q=/": ("a.net", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "": ("", "", None, "allow"), "x://y://z/p": ("y:", "//z/p", None, "allow"), "://h/p\nq?r": ("h", "/p\nq", None, "allow"),
    "http://bad.example.com/p/?utm_source=z&b=2&a=1#f": ("bad.example.com", "/p/", None, "block"),
    "https://BAD.example.com/p?a=1&b=2&ref=k": ("bad.example.com", "/p", None, "block"), "https://bad.example.com/p?a=1": ("bad.example.com", "/p", None, "allow"),
}
LISTED = ["http://bad.example.com/p?a=1&b=2", "http://bad.example.com/p?b=2&a=1", None, "no scheme"]


def test_rules_and_list(spark):
    rows = [(i, u, 1, "c") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame([*rows, rows[0], (None, "http://a.net/", 1, "c")], "page_id long, url string, at int, key string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    found = urlfilter.judge(pages, listed, URL_RULES).collect()
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert len(found) == len(rows) + 2 and by_id[None][3] == "block"
    assert {u: by_id[i] for i, u in enumerate(URLS)} == URLS


def test_empty_sides(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    nothing = spark.createDataFrame([], "url string")
    assert [r["verdict"] for r in urlfilter.judge(pages, nothing, ()).collect()] == ["allow"]
    assert urlfilter.judge(pages.limit(0), pages.select("url"), URL_RULES).collect() == []


@pytest.mark.parametrize("most", [1, 8, 1 << 16])
def test_filter_misses_nothing(spark, monkeypatch, most):
    """However few the blocks, all listed URLs pass, and the join removes the false hits."""
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", most)
    listed = spark.range(3000).select(F.concat(F.lit("http://h.com/"), "id").alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.com/"), "id").alias("url"))
    found = urlfilter.judge(pages, listed, ()).collect()
    assert {r["page_id"] for r in found if r["verdict"] == "block"} == set(range(3000)) and len(found) == 6000
    false_hits = sum(r["possible"] and r["verdict"] == "allow" for r in found)
    assert false_hits < 60


def test_no_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = urlfilter.judge(pages, pages.select("url"), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

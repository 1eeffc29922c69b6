"""Work that is done once, however often its result is read."""

import pytest

from checks import derived_queries, store_queries
from pageloom.operators import frontier as R
from pageloom.operators.shred import shred
from pageloom.plans.options import extract


@pytest.fixture
def tables(spark, tmp_path):
    customers = [(k, f"Customer{k}", k % 4, "AUTO", 1.0 if k % 2 else -1.0) for k in range(1, 13)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in range(4)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def shreddings(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_images_are_made_once_for_both_runs(spark, tables):
    found = store_queries.fanout_rerun(spark, tables)
    assert shreddings(found) == 0
    assert tuple(found.first()) == (12, 6 + 6 * 4)


def test_entries_and_links_come_from_one_shredding(spark, tables):
    found = derived_queries.sitemap_link(spark, tables)
    assert shreddings(found) == 0
    rows = {r["page_id"]: (r["sitemap_entry"], r["sitemap_link"]) for r in found.collect()}
    host = "https://shop{}.example.com".format
    assert len(rows) == 12
    assert rows[3] == (f"{host(3)}/maps/sitemap3.xml", None) and rows[10] == (f"{host(2)}/robots.txt", "https://m.example.com/2")


def test_options_of_shredded_pages(spark, page):
    pages = page('<a href="/feed/">x</a><h1>H</h1>').unionByName(page(None, page_id=2))
    ready = shred(pages, attrs=("href", "rel"), parts_of=("h1",))
    got = {r["page_id"]: r["processed_values"] for r in extract(ready, ["find_sitemap_link", "get_h1"]).collect()}
    want = {r["page_id"]: r["processed_values"] for r in extract(pages, ["find_sitemap_link", "get_h1"]).collect()}
    assert got == want and got[1]["find_sitemap_link"] == "/feed/" and got[2]["get_h1"] is None


def test_a_walk_ends_without_reading_all_it_reached(spark, monkeypatch):
    files = spark.createDataFrame([("http://h/robots.txt", "Sitemap: http://h/sitemap1.xml")], "url string, body string")
    asked, latest = [], R._Walk.latest
    monkeypatch.setattr(R._Walk, "latest", lambda self, *of: asked.append(of) or latest(self, *of))
    found = R.reach(spark.createDataFrame([("http://h/robots.txt",)], "seed string"), files)
    assert {tuple(r) for r in R.pairs(found).collect()} == {("http://h/robots.txt", u) for u in ("http://h/robots.txt", "http://h/sitemap1.xml")}
    assert [len(of) for of in asked] == [1, 0]  # once for the URLs that came, once for the result

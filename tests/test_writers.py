"""Large buckets are written by several tasks, and inherited flags are told from the passing nodes alone."""

import glob

import pytest
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.functions.lambdas import let
from pageloom.functions.urls import base_parts, resolve_from, resolve_url
from pageloom.operators import store
from pageloom.operators.shred import shred
from pageloom.sources import sinks
from pageloom.sources import tables as T
from pageloom.streaming import frontier


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def files(path):
    return [f for f in glob.glob(f"{path}/bucket=*/*.parquet")]


@pytest.fixture
def apart(spark):
    """Spark's joining of small partitions off, so that the tasks asked for can be counted."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_site_is_written_by_several_tasks(spark, apart, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS_PER_WRITER", 10)
    path = str(tmp_path / "store")
    T.create_store(spark, path, ["sitemap_urls"], buckets=1)
    rows = spark.range(100).select("id", F.lit(7).cast("long").alias("domain_id"), F.col("id").cast("string").alias("url"))
    for _ in range(2):
        store.merge_into(path, "sitemap_urls", T.fill("sitemap_urls", rows, now()))
    assert len(files(f"{path}/sitemap_urls")) > 1
    assert T.read_table(spark, path, "sitemap_urls").select("id").distinct().count() == T.read_table(spark, path, "sitemap_urls").count() == 100


def test_documents_of_a_bucket_are_written_by_several_tasks(spark, apart, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENTS_PER_WRITER", 10)
    path = str(tmp_path / "documents")
    one = F.array(F.struct(F.lit("Title").alias("key"), F.lit("[]").alias("value")))
    sinks.merge_organized(spark.range(100).select(F.col("id").alias("page_id"), F.col("id").cast("string").alias("unique_page_name"), one.alias("members")), path, buckets=1)
    assert len(files(f"{path}/documents")) > 1
    assert sinks.read_organized(spark, path).count() == 100


def test_urls_of_a_bucket_are_written_by_several_tasks(spark, apart, tmp_path, monkeypatch):
    monkeypatch.setattr(frontier, "URLS_PER_WRITER", 10)
    path = str(tmp_path / "frontier")
    urls = spark.range(100).select(F.concat(F.lit("https://a.example/"), "id").alias("url"), now().alias("seen_at"))
    frontier.store_urls(path, urls, "s", 0, "seen_at", "1 day", buckets=1)
    assert len(files(f"{path}/seen/source=s/batch=0")) > 1
    assert frontier.given_out(spark, path).count() == 100


def test_flags_are_those_of_an_ancestor_or_the_node(page, spark):
    html = "<div><p class='x'>a<b class='x'>c</b></p><i>d</i></div><u class='x'>e</u><s>f</s><p class='x'></p>"
    for source in (html, "<p>none</p>", "", None):
        row = shred(page(source), text_nodes=True).select(
            "dom", N.spread(F.col("dom"), lambda n: F.coalesce(N.attr(n, "class"), F.lit("")) == "x").alias("f")).first()
        if source is None:
            assert row["f"] is None
            continue
        marked = []
        for n in row["dom"]:
            marked.append((n["attrs"] or {}).get("class") == "x" or (n["parent"] >= 0 and marked[n["parent"]]))
        assert row["f"] == marked


def test_values_stand_at_their_nodes(page):
    dom = F.col("dom")
    ids = F.reverse(F.transform(N.tagged(dom, "b", "i"), lambda n: n["id"]))
    table = N.by_node(dom, ids, F.transform(ids, lambda i: F.concat(F.lit("v"), i.cast("string"))))
    found = shred(page("<p><b></b><u></u><i></i></p><s></s>")).select(let(table, lambda t: F.transform(dom, lambda n: N.of_node(t, n)))).first()[0]
    assert found == [None, "v1", None, "v3", None]


def test_links_from_a_base_taken_apart_are_the_same(spark):
    refs = ["", None, "/a.b/c", "/a/../b", "/a/.", "/..", "//h/x", "x.png", "../x", "?q", "#", "https://o.example/a.b", "http://o.example/a/../b",
            "HTTPS://o.example/", "https://o.example?", "mailto:x", "https:x", " /a", "/a b", "https://"]
    bases = ["https://h.example/d/e.html?q#f", "http://h.example", "ftp://h.example/x", "", None]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    rows = df.select("base", "ref", resolve_url(F.col("base"), F.col("ref")).alias("x"), let(base_parts(F.col("base")), lambda b: resolve_from(b, F.col("ref"))).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in rows)
    from urllib.parse import urljoin
    for r in rows:
        if r["base"] == bases[0] and r["ref"] in ("/a.b/c", "/a/../b", "//h/x", "x.png", "../x", "https://o.example/a.b", "mailto:x", "http://o.example/a/../b"):
            assert r["x"] == urljoin(r["base"], r["ref"]), r

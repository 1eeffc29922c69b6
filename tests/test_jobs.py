import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pageloom.operators import elements as E
from pageloom.operators import sitemaps as M
from pageloom.operators import store as R
from pageloom.operators.shred import malformed, shred
from pageloom.operators.websites import with_website
from pageloom.plans import crawl as C
from pageloom.plans.options import OPTIONS, extract, extract_page
from pageloom.session import run_dir
from pageloom.sources import pages as G
from pageloom.sources import snapshots as Z
from pageloom.sources import tables as T
from pageloom.streaming import ingest as I

PAGES = "/root/testdata/sf0.001/pages.parquet"


def as_of():
    return F.lit("2026-01-01").cast("timestamp")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- upserts
def test_upsert_new_changed_unchanged_and_repeated(spark):
    schema = "k int, a string, b string, at int"
    target = spark.createDataFrame([(1, "a1", "b1", 0), (2, "a2", "b2", 0), (3, "a3", None, 0)], schema)
    source = spark.createDataFrame([(2, "x", "y", 1), (2, "x2", "y2", 2), (3, "a3", None, 0), (4, "n", "m", 1)], schema)
    once = R.upsert(target, source, ["k"], ["a"], order=["at"])
    assert rows(once) == [(1, "a1", "b1", 0), (2, "x2", "b2", 0), (3, "a3", None, 0), (4, "n", "m", 1)]
    assert rows(R.upsert(once, source, ["k"], ["a"], order=["at"])) == rows(once)
    assert rows(R.upsert(target, source, ["k"], order=["at"]))[1] == (2, "x2", "y2", 2)
    assert rows(R.upsert(target, source.select("k", "a", "at"), ["k"], order=["at"]))[3] == (4, "n", None, 1)


def test_merge_into_touches_only_its_buckets(spark):
    path = run_dir(spark, "merge-test")
    T.create_store(spark, path, buckets=8)
    first = T.fill("scrape_results", spark.range(40).select(F.col("id").alias("webpage_id"), F.lit("c").alias("content")), as_of())
    R.merge_into(path, "scrape_results", first)
    stamps = {d: os.path.getmtime(f"{path}/scrape_results/{d}") for d in os.listdir(f"{path}/scrape_results") if d.startswith("bucket")}
    assert len(stamps) > 4
    change = T.fill("scrape_results", spark.range(1).select(F.lit(7).cast("long").alias("webpage_id"), F.lit("d").alias("content")), as_of())
    R.merge_into(path, "scrape_results", change, R.RESULT_UPDATES)
    after = {d: os.path.getmtime(f"{path}/scrape_results/{d}") for d in stamps}
    assert sum(after[d] != stamps[d] for d in stamps) == 1
    stored = T.read_table(spark, path, "scrape_results")
    assert stored.count() == 40 and rows(stored.where("content = 'd'").select("webpage_id")) == [(7,)]


def test_defaults_and_audit(spark):
    tasks = T.fill("scrape_tasks", spark.createDataFrame([(1, "u")], "id long, url_to_scrape string"), as_of()).first()
    assert (tasks["priority"], tasks["force_new_scrape"], tasks["scrape_status"]) == (5, False, "pending")
    assert len(T.TABLES) == 17
    empty = {n: spark.createDataFrame([], t.schema) for n, t in T.TABLES.items()}
    assert R.audit(empty).isEmpty()
    bad = {**empty, "links": T.fill("links", spark.createDataFrame([(1, 9, None), (2, 9, "h")], "id long, page_id long, href string"), as_of())}
    assert rows(R.audit(bad)) == [("links", "foreign key", "page_id", 2), ("links", "not null", "href", 1)]


def test_delete_follows_the_declared_rules(spark):
    make = lambda name, data, schema: T.fill(name, spark.createDataFrame(data, schema), as_of())
    store = {
        "webpages": make("webpages", [(1, "a", 5), (2, "b", 5)], "id long, url string, domain_id long"),
        "links": make("links", [(1, 1, "x"), (2, 2, "y")], "id long, page_id long, href string"),
        "scrape_tasks": make("scrape_tasks", [(1, "a", 1, 7), (2, "b", 2, 8)], "id long, url_to_scrape string, webpage_id long, scrape_result_id long"),
        "scrape_histories": make("scrape_histories", [(1, 1, "ok"), (2, 2, "ok")], "id long, task_id long, status string")}
    left = R.delete_rows(store, "webpages", store["webpages"].where("id = 1"))
    assert rows(left["links"].select("id")) == [(2,)]
    assert rows(left["scrape_tasks"].select("id", "webpage_id")) == [(1, None), (2, 2)]
    gone = R.delete_rows(store, "scrape_tasks", store["scrape_tasks"].where("id = 1"))
    assert rows(gone["scrape_histories"].select("id")) == [(2,)]


# --- sitemaps
def test_sitemap_walk_with_cycle_depth_and_kinds(spark):
    files = spark.createDataFrame([
        ("http://a/robots.txt", "User-agent: *\n SITEMAP: http://a/map.xml\nsitemap:http://a/sitemap.txt"),
        ("http://a/map.xml", "<loc>http://a/sitemap2.xml</loc><loc>http://a/page?x=1&amp;y</loc><broken"),
        ("http://a/sitemap2.xml", "<sm:loc>\nhttp://a/map-sitemap.xml </sm:loc><loc>http://a/sitemap2.xml</loc>"),
        ("http://a/map-sitemap.xml", "<loc>http://a/robots.txt?sitemap</loc>"),
        ("http://a/sitemap.txt", "http://a/sitemap2.xml\nhttp://a/p2\n\n")], "url string, body string")
    seeds = spark.createDataFrame([("http://a/robots.txt",), ("http://none/robots.txt",)], "seed string")
    reached = M.expand_sitemaps(seeds, files)
    assert rows(reached.where("seed like '%//a/%'").select("url", "depth")) == [
        ("http://a/map-sitemap.xml", 3), ("http://a/map.xml", 1), ("http://a/robots.txt", 0), ("http://a/robots.txt?sitemap", 4),
        ("http://a/sitemap.txt", 1), ("http://a/sitemap2.xml", 2)]
    assert M.expand_sitemaps(seeds, files, max_depth=1).agg(F.max("depth")).first()[0] == 1
    assert rows(M.sitemap_pages(reached, files).select("url")) == [("http://a/p2",), ("http://a/page?x=1&y",)]
    assert rows(C.item_sitemap_links(reached).select("url")) == [
        ("http://a/map-sitemap.xml",), ("http://a/robots.txt?sitemap",), ("http://a/sitemap2.xml",)]


# --- websites
def test_public_suffix_rules(spark):
    suffixes = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("blogspot.com",)], "suffix string")
    urls = ["https://a.B.Example.com:8/x", "http://x.example.co.uk", "http://foo.bar.ck", "http://www.ck", "http://me.blogspot.com",
            "http://localhost/", "http://10.0.0.1/", "http://x.unknown", "http://co.uk/", "http://a.b.www.ck"]
    got = {r["url"]: (r["website"], r["suffix"]) for r in with_website(spark.createDataFrame([(u,) for u in urls], "url string"), suffixes).collect()}
    assert [got[u] for u in urls] == [
        ("Example.com", "com"), ("example.co.uk", "co.uk"), ("foo.bar.ck", "bar.ck"), ("www.ck", "ck"), ("me.blogspot.com", "blogspot.com"),
        ("localhost", ""), ("10.0.0.1", ""), ("unknown", ""), (".co.uk", "co.uk"), ("www.ck", "ck")]


# --- snapshots and files
def test_snapshot_header_cases(spark):
    texts = ["<p>x</p>", Z.START + "\n url: http://a: b \n website: w\nMETADATA_END-->\n<p>y</p>", Z.START + " url: u"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, content string")
    got = [tuple(r) for r in Z.parse_snapshots(df).select("name", "url", "website", "html").orderBy("name").collect()]
    assert got == [("0", None, None, "<p>x</p>"), ("1", "http://a: b", "w", "<p>y</p>"), ("2", "u", None, "")]


def test_manifest_is_newest_first(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "name string, saved_at int")
    assert [r["name"] for r in Z.manifest(df).collect()] == ["b", "c", "a"]


def test_url_list_blank_line(spark, tmp_path):
    (tmp_path / "u.csv").write_text('http://a,x\n\n"http://b,c"\n')
    assert rows(G.read_url_list(spark, str(tmp_path), strict=False)) == [("http://a",), ("http://b,c",)]
    with pytest.raises(PySparkException):
        G.read_url_list(spark, str(tmp_path)).collect()
    with pytest.raises(NotImplementedError):
        G.load_urls(spark, "ftp", "x")
    assert rows(G.load_urls(spark, "single_url", "http://z")) == [("http://z",)]


# --- plans
def test_all_twenty_options_run_alone_and_skip_unknown(page):
    assert len(OPTIONS) == 20
    df = page("<html><head><title>t</title></head><body><h1>H</h1><a href='/feed/'>f</a></body></html>")
    for name in OPTIONS:
        assert extract(df, [name]).select("processed_values").first()[0].asDict().keys() == {name}
    assert extract(df, ["nope", "get_h1"]).schema["processed_values"].dataType.names == ["get_h1"]
    values = extract(df, list(OPTIONS)).first()["processed_values"]
    assert values["get_h1"] == "H" and values["find_sitemap_link"] == "/feed/" and values["get_footer_html"] is None


def test_page_without_html(page):
    row = extract(page(None), ["get_h1", "extract_emails", "get_all_headers"]).first()
    assert row["processing"] is False and all(v is None for v in row["processed_values"])


def test_wrong_task_and_method(spark, page):
    with pytest.raises(ValueError):
        C.process_saved(page("x"), ["get_h1"])
    with pytest.raises(ValueError):
        C.parse_data(page("x"), "regex")


def test_titles_and_fallbacks(page):
    for html, want in (("<h1>a<b>b</b></h1><title>t</title>", "ab"), ("<title>t</title>", "t"), ("<title></title>", None), ("<p>", "No Title Found")):
        assert shred(page(html), parts_of=("h1", "title")).select(E.title_or_heading(F.col("dom"))).first()[0] == want


def test_link_text_is_the_first_direct_string(page):
    html = "<a href=1>a <b>b</b></a><a href=2> <i>x</i>y</a><a href=3><i>x</i>y</a><a>z</a><a id=q class='k l' href=''>w</a>"
    got = rows(E.link_rows(shred(page(html, "http://h/d/p"), parts_of=("a",))).drop("page_id", "pos"))
    assert got == [("a", "http://h/d/1", "", None), ("w", "http://h/d/p", "k l", "q"), ("y", "http://h/d/3", "", None), ("z", "http://h/d/p", "", None)]


def test_pretty_html_closes_what_the_page_left_open(page):
    html = "<!DOCTYPE html><html><body><p id=x>a &amp; <b>b</b><br><!-- c --><div><script>1 < 2</script></body></html>"
    got = shred(page(html), text_nodes=True).select(E.pretty_html(F.col("dom"))).first()[0]
    assert got.split("\n") == [
        "<!DOCTYPE html>", "<html>", " <body>", '  <p id="x">', "   a &amp;", "   <b>", "    b", "   </b>", "   <br/>", "   <!-- c -->",
        "   <div>", "    <script>", "     1 < 2", "    </script>", "   </div>", "  </p>", " </body>", "</html>"]


def test_json_ld_good_two_comment_and_malformed(page):
    html = """<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json"><!-- x -->[2]</script>
      <script type="application/ld+json">{bad</script><script>{"c": 3}</script>"""
    shredded = shred(page(html), parts_of=("script",))
    assert [json.loads(s) for s in shredded.select(E.json_ld_valid(F.col("dom"))).first()[0]] == [{"a": 1}, [2]]
    assert E.json_ld_rows(shredded).where("document is null").count() == 1


# --- streams
def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    source = spark.read.schema(G.PAGES).parquet(PAGES)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    for run in ("one", "two"):  # a second checkpoint replays every file
        I.ingest(I.page_stream(spark, str(tmp_path / "in"), files_per_trigger=2), store, str(tmp_path / run), as_of(),
                 {"availableNow": True}, buckets=2).awaitTermination()
        stored = T.read_table(spark, store, "scrape_results").select("webpage_id", "title", "content_hash", "content_length")
        assert rows(stored) == rows(R.result_rows(C.crawl_items(source), as_of()).select(*stored.columns))
    assert T.read_table(spark, store, "webpages").count() == source.count()


# --- plans stay as designed
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_shreds_once_and_needs_no_shuffle(spark):
    big = spark.range(10**9).select(F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"), F.lit("<p>x</p>").alias("html"))
    for df in (extract(big, list(OPTIONS)), C.crawl_items(big), E.link_rows(shred(big, parts_of=("a",))), C.simple_pages(big)):
        text = plan(df)
        assert text.count("MapInArrow") == 1 and "Exchange" not in text


def test_a_page_filter_reaches_the_scan(spark):
    text = plan(extract_page(G.read_pages(spark, PAGES), "http://x/y", ["get_h1"]))
    assert "EqualTo(url,http://x/y)" in text


def test_hot_keys_are_reduced_before_the_shuffle(spark):
    hot = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    for df in (R.latest_per_key(hot, ["k"], ["v"]), R.orphans(hot, "k", hot.limit(0), "k"), R.exact_duplicates(hot.select("v", F.col("k").cast("string").alias("t")), "v", "t")):
        assert "partial_" in plan(df)


# --- what used to be lost in silence
def test_a_store_keeps_its_number_of_buckets(spark, tmp_path):
    T.create_store(spark, str(tmp_path), ("webpages",), buckets=3)
    T.create_store(spark, str(tmp_path), ("links",))
    assert T.bucket_count(spark, str(tmp_path)) == 3
    with pytest.raises(ValueError, match="3 buckets"):
        T.create_store(spark, str(tmp_path), ("images",), buckets=4)


def test_replaced_rows_of_pages_without_any_go_too(spark, tmp_path):
    path = str(tmp_path)
    T.create_store(spark, path, ("links",), buckets=2)
    make = lambda data: T.fill("links", spark.createDataFrame(data, "id long, page_id long, href string"), as_of())
    pages = lambda *ids: spark.createDataFrame([(i,) for i in ids], "page_id long")
    R.replace_into(path, "links", make([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")]), pages(1, 2))
    R.replace_into(path, "links", make([(4, 3, "d")]), pages(1, 3))
    assert rows(T.read_table(spark, path, "links").select("id", "page_id")) == [(3, 2), (4, 3)]


def test_restricted_rows_are_not_deleted(spark):
    make = lambda name, data, schema: T.fill(name, spark.createDataFrame(data, schema), as_of())
    store = {"domains": make("domains", [(5, "d"), (6, "e")], "id long, url string"),
             "webpages": make("webpages", [(1, "a", 5), (2, "b", 5)], "id long, url string, domain_id long")}
    assert rows(R.restricted(store, "domains", store["domains"])) == [("webpages", "domain_id", 5, 2)]
    with pytest.raises(ValueError, match="domains"):
        R.delete_rows(store, "domains", store["domains"].where("id = 5"))
    assert rows(R.delete_rows(store, "domains", store["domains"].where("id = 6"))["domains"].select("id")) == [(5,)]


def test_a_url_without_a_site_has_no_site_key(spark):
    urls = spark.createDataFrame([("ftp://f/x",), ("http://a/x",)], "url string")
    made = R.new_webpages(spark.createDataFrame([], T.TABLES["webpages"].schema), urls, as_of())
    assert {r["url"]: r["domain_id"] is None for r in made.collect()} == {"ftp://f/x": True, "http://a/x": False}


def test_late_urls_are_found_in_batch(spark):
    urls = spark.createDataFrame([("http://a/x?q",), ("http://a/x#y",), ("http://a/z",)], "url string")
    given = spark.createDataFrame([("http://a/z",)], "canonical_url string")
    assert rows(I.unseen(urls, given).select("canonical_url")) == [("http://a/x",)]


def test_malformed_markup_is_read_on(spark, page):
    source = page("<p>ok</p><![foo x]><p>more</p><![CDATA[y]]>")
    row = shred(source, parts_of=("p",)).first()
    dom = row["dom"]
    assert [row["dom_strings"][n["first"] : n["upto"]] for n in dom if n["tag"] == "p"] == [["ok"], ["more"]]
    assert rows(malformed(source)) == [(1, 1)]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from pageloom import session

    class Session:
        def __init__(self, **conf):
            self.conf = type("Conf", (dict,), {"set": dict.__setitem__})(conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.run_dir(Session(**{"spark.master": "spark://host:7077"}), "x")
    assert session.run_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///c/"}), "x").startswith("hdfs:///c/x-")

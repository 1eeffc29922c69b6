"""The frontier that never forgets, page versions by time, and deletion in stored tables, on small cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import store as R
from pageloom.sources import tables as T
from pageloom.streaming import frontier as Q
from pageloom.streaming import ingest as I

DAY = datetime.datetime(2026, 1, 1)


def stamp():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def urls(spark, rows):
    return spark.createDataFrame([(u, None if h is None else DAY + datetime.timedelta(hours=h)) for u, h in rows], "url string, seen_at timestamp")


def told(spark, store):
    return sorted((r["canonical_url"], r["url"], (r["seen_at"] - DAY).total_seconds() / 3600, r["late"], r["source"], r["batch"]) for r in Q.given_out(spark, store).collect())


def test_batches_repeats_and_compaction(spark, tmp_path):
    chance, store, known, want, newest = random.Random(8), str(tmp_path / "store"), set(), [], None
    batches = [[(f"http://h/{chance.randrange(200)}{chance.choice(['', '#a', '?b=1'])}", k * 10 + chance.randrange(-25, 10)) for _ in range(25)] for k in range(4)]
    batches[1] += [(None, 3), ("http://h/no-time", None), batches[1][0]]
    batches.insert(2, [])
    for number, rows in enumerate(batches):
        first = {}
        for u, h in rows:
            if u is not None and h is not None:
                key = u.split("#")[0].split("?")[0]
                first[key] = min(first.get(key, (h, u)), (h, u))
        for key, (h, u) in first.items():
            if key not in known:
                want.append((key, u, float(h), newest is not None and h < newest - 6, "one", number))
        known |= set(first)
        newest = max([h for _, h in rows if h is not None] + ([] if newest is None else [newest]), default=None)
        for _ in range(2):  # a batch repeated after a failure
            Q.store_urls(store, urls(spark, rows), "one", number, "seen_at", "6 hours", buckets=4)
    assert set(told(spark, store)) ^ set(want) == set() and len(told(spark, store)) == len(want) and any(w[3] for w in want)
    Q.store_urls(store, urls(spark, batches[0] + [("http://h/new", 0)]), "two", 0, "seen_at", "6 hours", buckets=4)
    want.append(("http://h/new", "http://h/new", 0.0, False, "two", 0))
    assert told(spark, store) == sorted(want)


def test_compaction_keeps_what_was_given_out(spark, tmp_path):
    store, checkpoint = str(tmp_path / "store"), "c"
    source = Q.source_of(checkpoint)
    for number in range(3):
        Q.store_urls(store, urls(spark, [(f"http://h/{number}", number), ("http://h/all", number)]), source, number, "seen_at", "1 day", buckets=2)
    before = [t[:4] for t in told(spark, store)]
    Q.compact(spark, store, checkpoint, 1)
    assert [t[:4] for t in told(spark, store)] == before and {t[5] for t in told(spark, store)} == {1, 2}
    Q.store_urls(store, urls(spark, [("http://h/0", 99), ("http://h/late", -99)]), source, 3, "seen_at", "1 day", buckets=2)
    assert [t[0] for t in told(spark, store) if t[5] == 3] == ["http://h/late"] and [r["url"] for r in Q.late(spark, store).collect()] == ["http://h/late"]
    assert Q.on_time(spark, store).count() == len(before)


@pytest.mark.parametrize("timed", [True, False])
def test_the_latest_version_counts(spark, tmp_path, timed):
    store = str(tmp_path / "store")
    T.create_store(spark, store, I.ITEM_TABLES, 2)
    html = "<title>{}</title><body><a href=/{}>x</a></body>"
    rows = [(3, "http://h/a", html.format("old", 1), DAY), (1, "http://h/a", html.format("new", 2), DAY + datetime.timedelta(1)), (2, "http://h/b", html.format("b", 3), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, fetched_at timestamp")
    I.store_pages(store, pages if timed else pages.drop("fetched_at"), stamp())
    names = T.read_table(spark, store, "webpages").select(F.col("id").alias("webpage_id"), "url")
    found = {r["url"]: r["title"] for r in T.read_table(spark, store, "scrape_results").join(names, "webpage_id").collect()}
    assert found == {"http://h/a": "new" if timed else "old", "http://h/b": "b"}
    assert sorted(r["href"] for r in T.read_table(spark, store, "links").collect()) == ["http://h/2" if timed else "http://h/1", "http://h/3"]


def test_contents_are_in_no_aggregate(spark):
    rows = spark.range(9).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.lit("text").alias("body"), F.col("id").alias("_row"))
    plan = R.latest_version(rows, ["k"], ["t"], "_row")
    assert sorted((r["k"], r["t"]) for r in plan.collect()) == [(0, 6), (1, 7), (2, 8)]
    aggregates = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line]
    assert aggregates and not any("body" in line for line in aggregates)


def test_a_forbidden_deletion_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    T.create_store(spark, store, buckets=2)
    make = lambda table, rows, schema: R.merge_into(store, table, T.fill(table, spark.createDataFrame(rows, schema), stamp()))
    make("domains", [(1, "http://a"), (2, "http://b")], "id long, url string")
    make("webpages", [(10, "http://a/x", 1), (11, "http://a/y", 1)], "id long, url string, domain_id long")
    make("links", [(100, 10, "/1"), (101, 10, "/2"), (102, 11, "/3")], "id long, page_id long, href string")
    make("scrape_tasks", [(5, "http://a/x", 10)], "id long, url_to_scrape string, webpage_id long")
    make("scrape_histories", [(6, 5, "done"), (7, 5, "done")], "id long, task_id long, status string")
    with pytest.raises(ValueError, match="domains"):
        R.delete_stored(store, "domains", spark.createDataFrame([(1,)], "id long"))
    assert T.read_table(spark, store, "links").count() == 3 and T.read_table(spark, store, "domains").count() == 2
    R.delete_stored(store, "webpages", T.read_table(spark, store, "webpages").where("id = 10"))
    assert [r["id"] for r in T.read_table(spark, store, "links").collect()] == [102]
    assert [(r["id"], r["webpage_id"]) for r in T.read_table(spark, store, "scrape_tasks").collect()] == [(5, None)]
    assert T.read_table(spark, store, "scrape_histories").count() == 2
    R.delete_stored(store, "domains", spark.createDataFrame([(2,), (99,)], "id long"))
    assert [r["id"] for r in T.read_table(spark, store, "domains").collect()] == [1]

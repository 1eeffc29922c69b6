"""Merged lookups and grouping inside a row, against plain Python, and how their work grows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom.functions.lambdas import grouped, last_of_each, match
from pageloom.operators import sections as S
from pageloom.operators.shred import shred
from pageloom.sources import sinks


def test_against_plain_python(spark):
    chance = random.Random(6)
    word = lambda: chance.choice(["a", "b", "B", "", "é", None, "aa", "c"])
    rows = [([word() for _ in range(chance.randint(0, 9))], [word() for _ in range(chance.randint(0, 9))]) for _ in range(200)]
    frame = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i int, k array<string>, t array<string>")
    items = F.transform("k", lambda k, i: i * 10)
    whole = F.filter("k", lambda k: k.isNotNull())
    for r in frame.select("*", match(F.col("k"), F.col("t")).alias("m"), grouped(items, F.col("k")).alias("g"),
                          last_of_each(whole, F.transform(whole, lambda k, i: i)).alias("l")).collect():
        assert r["m"] == [max((j for j, t in enumerate(r["t"]) if t == k), default=None) if k is not None else None for k in r["k"]]
        want = {}
        for i, k in enumerate(r["k"]):
            want.setdefault(k, []).append(i * 10)
        assert [(g["key"], g["items"]) for g in r["g"]] == list(want.items())
        assert r["l"] == {k: i for i, k in enumerate(k for k in r["k"] if k is not None)}


TABLE = "<table><tr><td>k</td></tr><tr><td>v</td></tr></table>"


def page_of(spark, heads, blocks_each, every=100):
    """Headings with paragraphs, a list each, and a table under every hundredth, as a table repeats all paragraphs ahead of it."""
    under = lambda i: "".join(f"<p>text {i} {j}</p>" for j in range(blocks_each)) + f"<ul><li>a{i}</li><li>b</li></ul>" + (TABLE if i % every == 0 else "")
    body = "".join(f"<h2>Head {i}</h2>{under(i)}" for i in range(heads))
    return spark.createDataFrame([(1, "http://h/p", f"<html><head><title>t</title></head><body>{body}</body></html>")], "page_id long, url string, html string")


@pytest.mark.parametrize("kind", list(sinks.DOCUMENTS))
def test_documents_of_large_pages_grow_in_proportion(spark, kind):
    def seconds(heads):
        page = shred(page_of(spark, heads, 3), parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
        page = page.withColumn("website", F.lit("w")).withColumn("unique_page_name", F.lit("n"))
        start = time.time()
        length = sinks.page_documents(page, kinds=(kind,)).select(F.length(kind)).first()[0]
        assert length > heads * 10
        return time.time() - start

    seconds(10)
    few, many = seconds(300), seconds(3000)
    assert many < 20 * max(few, 0.3)


def test_maps_of_large_pages_grow_in_proportion(spark):
    def seconds(heads):
        page = shred(page_of(spark, heads, 2), parts_of=S.SECTION_PARTS, text_nodes=True)
        contents = S.content_by_headers(F.col("dom"))
        start = time.time()
        found = page.select(contents.alias("c"), S.html_tables(F.col("dom")).alias("t")).select(F.size(S.content_map(F.col("c"))), F.size("t")).first()
        assert tuple(found) == (heads, -(-heads // 100))
        return time.time() - start

    seconds(10)
    few, many = seconds(300), seconds(3000)
    assert many < 20 * max(few, 0.3)


def test_maps_evaluate_their_input_once(spark):
    """An expression named twice, or within a lambda, is evaluated again for each, however dear it is."""
    assert str(last_of_each(F.col("the_keys"), F.col("the_values"))).count("the_") == 2
    assert str(S.content_map(F.col("the_contents"))).count("the_contents") == 1

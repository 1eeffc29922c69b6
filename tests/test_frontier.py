"""Reachability by shared sets of seeds, against a closure computed pair by pair."""

import random

import pytest

from pageloom.operators import frontier as R
from pageloom.operators.sitemaps import expand_sitemaps


def closure(seeds, links):
    out = set()
    for seed in seeds:
        todo, seen = [seed], {seed}
        while todo:
            for url in links.get(todo.pop(), ()):
                if url not in seen:
                    seen.add(url)
                    todo.append(url)
        out |= {(seed, url) for url in seen}
    return out


def files_of(spark, links):
    body = lambda urls: "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "<url><loc>http://p/page</loc></url>"
    return spark.createDataFrame([(u, body(to)) for u, to in links.items()], "url string, body string")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links_with_cycles(spark, seed):
    chance = random.Random(seed)
    name = lambda i: f"http://h/sitemap{i}.xml"
    links = {name(i): [name(chance.randrange(34)) for _ in range(chance.choice((0, 1, 1, 2, 3)))] for i in range(30)}
    links[name(0)] = [name(0)]
    seeds = [name(i) for i in chance.sample(range(34), 9)]
    frame = spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "seed string")
    found = R.reach(frame, files_of(spark, links))
    got = [tuple(r) for r in R.pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == closure(seeds, links)
    assert {(r["seed"], r["url"]) for r in expand_sitemaps(frame.na.drop(), files_of(spark, links)).collect()} == set(got)


def test_shared_maps_cost_a_row_per_file_and_per_seed(spark):
    n, deep = 60, 40
    links = {f"http://s{i}/robots.txt": ["http://m/sitemap0.xml"] for i in range(n)}
    files = spark.createDataFrame(
        [(u, "Sitemap: " + to[0]) for u, to in links.items()]
        + [(f"http://m/sitemap{k}.xml", f"<sitemap><loc>http://m/sitemap{2 * k + 1}.xml</loc></sitemap><sitemap><loc>http://m/sitemap{2 * k + 2}.xml</loc></sitemap>"
            f"<url><loc>http://m/page{k % 3}</loc></url>") for k in range(deep)], "url string, body string")
    seeds = spark.createDataFrame([(u,) for u in links], "seed string")
    found = R.reach(seeds, files)
    used = R.used_sets(found)
    assert found.urls.count() == n + 2 * deep + 1 and used.count() == 2 * n
    shared = found.urls.where("url like 'http://m/%'").select("seeds").distinct().collect()
    assert len(shared) == 1 and used.where(used.seeds == shared[0][0]).count() == n
    assert sorted(r["url"] for r in R.listed_pages(found, files).collect()) == ["http://m/page0", "http://m/page1", "http://m/page2"]


def test_nothing_to_reach(spark):
    none = spark.createDataFrame([], "url string, body string")
    found = R.reach(spark.createDataFrame([("http://a/x.xml",)], "seed string"), none)
    assert [tuple(r) for r in R.pairs(found).collect()] == [("http://a/x.xml", "http://a/x.xml")]
    assert R.pairs(R.reach(spark.createDataFrame([], "seed string"), none)).collect() == []

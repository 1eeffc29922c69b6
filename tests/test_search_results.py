import random

import pytest

from pageloom.operators import special as P
from pageloom.operators.shred import shred

RESULT = """<div class="main"><div class="GyAeWb"><div class="s6JM6d"><div class="eqAnXb x"><div class="dURPMd"><div><div>
<div><div class="VwiC3b">About <b>it</b></div><div><div><h3>It</h3><a href="/s">x</a></div><div><a href="/t">y</a></div></div></div>
<div class="Wt5Tfe"><span class="CSkcDe">Why?</span></div></div></div></div></div></div></div></div>"""


def test_rows_of_a_search_page_and_of_one_without_html(spark):
    pages = spark.createDataFrame([(1, "u", RESULT), (2, "u", None), (3, "u", RESULT.replace("eqAnXb", "z"))], "page_id long, url string, html string")
    rows = P.search_result_rows(shred(pages, attrs=("class", "href"), **P.serp_parts())).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, None, "It", "About it", "/s"), (1, 1, None, "It", "About it", "/t"), (1, 2, "People also ask", "Why?", None, None)]


@pytest.mark.parametrize("path", ["a", "a b", "a b a c"])
def test_results_are_below_elements_of_all_earlier_classes(spark, path):
    """Random trees, where elements of a class lie in others of it, against a walk up from every node."""
    rng = random.Random(5)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(rng.choice((1, 1, 2)))) if depth else ""
        return f"<div class='{rng.choice(('a', 'b', 'c', 'a c', ''))}'><a href='{rng.randrange(10**6)}'>x</a>{inner}</div>"

    pages = [(i, "u", f"{tree(3)}<div class=main>{tree(9)}</div>{tree(4)}") for i in range(25)]
    page = shred(spark.createDataFrame(pages, "page_id long, url string, html string"), attrs=("class", "href"), **P.serp_parts())
    found = {}
    for r in P.search_result_rows(page, {**P.SERP_CLASSES, "path": path}).orderBy("page_id", "pos").collect():
        found.setdefault(r["page_id"], []).append(r["url"])
    want = {}
    for r in page.select("page_id", "dom").collect():
        dom = r["dom"]
        up = lambda n: dom[n["parent"]] if n["parent"] >= 0 else None
        holds = lambda n, name: name in (n["attrs"] or {}).get("class", "").split()

        def is_result(n):
            steps = path.split()
            if not holds(n, steps.pop()):
                return False
            while steps and (n := up(n)):
                if holds(n, steps[-1]):
                    steps.pop()
            return not steps

        main = next(n for n in dom if holds(n, "main"))
        results = {n["id"] for n in dom if main["id"] < n["id"] <= main["end"] and is_result(n)}
        inner = lambda n: [m for m in dom if m["parent"] == n["id"] and m["tag"] == "div"]
        for b in dom:
            top = b
            for _ in range(3):
                top = top and top["tag"] == "div" and up(top)
            if top and top["id"] in results:
                urls = [next(m["attrs"]["href"] for m in dom[e["id"] :] if m["tag"] == "a") for c in inner(b) for e in inner(c)]
                if urls:
                    want.setdefault(r["page_id"], []).extend(urls)
    assert want and found == want

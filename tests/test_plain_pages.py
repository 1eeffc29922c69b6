import random

from pageloom.operators import shred as S
from pageloom.plans.crawl import ITEM_ATTRS, ITEM_PARTS, crawl_items

ITEM = {"parts_of": frozenset(ITEM_PARTS), "parts_of_class": frozenset(), "text_nodes": False, "attrs": frozenset(ITEM_ATTRS), "decode_twice": False}


def read(pages, want):
    reader = S._TreeReader(want)
    for source in pages:
        reader.add_page(source)
    return [column.to_pylist() for column in reader.to_arrow()]


def test_plain_markup_is_read_in_one_go(monkeypatch):
    """The library's loop is entered once, not once a tag and text."""
    steps, library = [], S._TreeReader.updatepos
    monkeypatch.setattr(S._TreeReader, "updatepos", lambda self, i, j: steps.append(i) or library(self, i, j))
    dom, strings = read(['<body class="x">' + '<p>a &amp; b <a href="/c">d</a><br></p>' * 100 + "</body>"], ITEM)
    assert len(steps) < 5 and len(dom[0]) == 301 and strings[0] == ["d"] * 100


def test_tags_met_before_are_read_as_at_first():
    """A reader that has seen the tags, one that has not and one whose memory is full agree, whatever is asked for."""
    bits = ["<p>", "</p>", "<P >", "</P>", "<td\n>", "<br>", "<b>", "</b>", '<a href="x>y" class="k">', "<a>", "</a>", "<a", ">", "<", "</", "x &lt; y", " ", "<pre>", "</pre>",
            "<rt>", "</rt>", "<title>", "</title>", "<script>", "</script>", "<i x>", "<!-- <p> -->", "<verylongnameofanelement0>", "</verylongnameofanelement0>"]
    rng = random.Random(7)
    pages = ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(800)]
    for texts in (False, True):
        for parts in (None, frozenset(), frozenset(("a", "p", "rt", "title"))):
            want = {**ITEM, "parts_of": parts, "parts_of_class": frozenset(("k",)), "text_nodes": texts}
            fresh = [[column[0] for column in read([source], want)] for source in pages]
            assert [list(row) for row in zip(*read(pages, want), strict=True)] == fresh
            reader = S._TreeReader(want)
            reader.known = dict.fromkeys(range(S._KNOWN))
            for source in pages:
                reader.add_page(source)
            assert len(reader.known) == S._KNOWN
            assert [list(row) for row in zip(*(c.to_pylist() for c in reader.to_arrow()), strict=True)] == fresh


def test_items_of_odd_pages(spark):
    html = """<title></title><meta name="out"><head><meta name="a" content="b"><meta name="" content=""></head><a> </a><a href="x"> l
      m</a><a href="/y"><b>n</b></a><img><img src="i.png" alt="t" id=""><link rel="sitemap"><link rel="sitemap" href="/s.xml"><body id="q">z</body>"""
    pages = spark.createDataFrame([(1, "http://h.org/d/p", html), (2, None, None), (3, None, "<a href='u'>v</a>")], "page_id long, url string, html string")
    one, none, bare = crawl_items(pages).orderBy("page_id").collect()
    assert (one["title"], one["header_structure"]) == (None, '{"title":null,"meta_tags":[{"name":"a","content":"b"}]}')
    assert [tuple(r) for r in one["links"]] == [("l m", "http://h.org/d/x", "", None)]
    assert [tuple(r) for r in one["images"]] == [("http://h.org/d/p", "", "", None), ("http://h.org/d/i.png", "t", "", None)]
    assert (one["clean_body"], one["sitemap_entry"]) == ('<body id="q">z</body>', "http://h.org/s.xml")
    assert (none["links"], none["images"], none["clean_body"]) == (None, None, "")
    assert [r["text"] for r in bare["links"]] == ["v"] and bare["images"] == []

import itertools
import re
from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.functions import urls as U


def apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_resolve_url_agrees_with_the_standard_library(spark):
    bases = ["http://a.b/c/d;p?q#f", "https://x.y", "https://x.y/", "http://a.b/c/d/", "http://a.b/c//d/e?x=1", "HTTP://A.b/x/../y"]
    refs = ["", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "..", "../", "../g", "../..",
            "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "./../g", "./g/.", "g/./h", "g/../h", "http:g",
            "http://o/p", "https://x.y/z?", "mailto:a@b", "javascript:void(0)", "  /sp", "/a//b", "x//y", "x//", "/é,à", "?",
            "#", "?#", "/a?b=c/../d", "a/b/..", "/a.b/c", "HTTPS://Q/w", "ftp://q/a/../b", "tel:123", "/x y", "."]
    pairs = list(itertools.product(bases, refs))
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string").orderBy("i")
    got = [r[0] for r in df.select(U.resolve_url(F.col("b"), F.col("r"))).collect()]
    assert [(p, g) for p, g in zip(pairs, got) if g != urljoin(*p)] == []
    assert apply(spark, [None], lambda v: U.resolve_url(F.lit("http://a/b"), v)) == ["http://a/b"]


def test_domains(spark):
    urls = ["https://U@Ex.com:80/a?b", "HTTP://x/y", "ftp://f/g", "no-scheme/x", "http://[::1/x", "http:foo", None, ""]
    assert apply(spark, urls, U.domain_of) == ["https://U@Ex.com:80", "http://x", None, None, None, "http://", None, None]
    assert apply(spark, ["http://a.b/c;p/d;q?x#y", "http://a.b"], U.canonical_url) == ["http://a.b/c;p/d", "http://a.b"]
    assert apply(spark, ["http://u:p@h.com.:8/x"], U.host) == ["h.com"]


def test_first_url(spark):
    texts = ["see https://a.com/path now", "www.b.org", "at c.net.", "nothing here", ""]
    assert apply(spark, texts, U.first_url_in_text) == ["https://a.com", "http://www.b.org", "http://www.c.net", None, None]


def test_search_url(spark):
    assert apply(spark, ["  lip \t filler "], U.search_url) == ["https://www.google.com/search?q=lip+filler&ie=utf-8&oe=utf-8"]


PIECES = st.sampled_from(["a", "é", " ", "\u00a0", "\u2003", "\x1c", "\n", "-", "/", "<b>", "&amp;", "&lt;", "“", "’", "—", "™", "1", "x_y"])
TEXTS = st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=20, max_size=20)
RELAXED = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@RELAXED
@given(TEXTS)
def test_whitespace_functions_agree_with_python(spark, texts):
    assert apply(spark, texts, X.strip) == [t.strip() for t in texts]
    assert apply(spark, texts, X.collapse) == [re.sub(r"\s+", " ", t).strip(" ") for t in texts]


def expected_clean(text):
    import html

    text = re.sub(r"<[^>]+>", "  ", html.unescape(text))
    for a, b in zip("“”–—\u00a0‘’", "\"\"-- ''"):
        text = text.replace(a, b)
    text = re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7f]+", " ", text)).strip()
    return "" if text in ("-", "/") else text


@RELAXED
@given(TEXTS)
def test_clean_text_agrees_with_python(spark, texts):
    assert apply(spark, texts, X.clean_text) == [expected_clean(t) for t in texts]


def test_scrape_cleanup(spark):
    assert apply(spark, [" a\u00a0&amp;lt;b™ ©\n\né "], X.scrape_cleanup) == [" a <b   "]


PATTERN_TEXTS = ["call (555) 123-4567 or 555.123.4567x, 5551234567", "a.b+c@d-e.co.uk x@y.z1 q@r.c|m", "12 Rue de l'été 5 Main St.",
                 "é555-123-4567 ١٢٣ 456 7890", "123 Main Street\u00a0North 9 a b c"]


def test_patterns_agree_with_python(spark):
    for find, pattern in ((X.phones, X.PHONE), (X.emails, X.EMAIL)):
        python = re.compile(pattern.removeprefix("(?U)"))
        assert apply(spark, PATTERN_TEXTS, find) == [python.findall(t) for t in PATTERN_TEXTS]
    python = re.compile(X.ADDRESS.removeprefix("(?U)"))
    assert apply(spark, PATTERN_TEXTS, X.addresses) == [python.findall(t) for t in PATTERN_TEXTS]
    assert apply(spark, PATTERN_TEXTS, lambda v: X.addresses(v, full=True)) == [
        [m.group() for m in python.finditer(t)] for t in PATTERN_TEXTS]


def test_page_title(spark):
    assert apply(spark, [None, "Ab-1 é" + "x" * 80], X.page_title) == ["no_title", ("Ab_1__" + "x" * 80)[:60]]

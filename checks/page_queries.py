"""Queries over the given pages, documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import dealt
from checks.registry import register
from pageloom.functions import text as X
from pageloom.functions import urls as U
from pageloom.operators import elements as E
from pageloom.operators import sections as S
from pageloom.operators.shred import HEADINGS, malformed, shred
from pageloom.operators.websites import with_website
from pageloom.sources.pages import read_pages


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read_pages(spark, f"{sf_dir}/pages.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def decoded(expr: str) -> str:
    """SQL: the entities the page texts contain, decoded."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"),
                         ("&#x27;", "''"), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


# SQL fragments shared by several twins. RE2's \s is ASCII only, hence the explicit class.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DOMAIN = "regexp_extract(url, '^https?://[^/?#]*')"
SOURCE_TITLE = decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
BODY = """CASE WHEN strpos(html, '</body>') > 0
          THEN substr(html, strpos(html, '<body>'), strpos(html, '</body>') + 7 - strpos(html, '<body>'))
          WHEN strpos(html, '</html>') > 0
          THEN substr(html, strpos(html, '<body>'), strpos(html, '</html>') - strpos(html, '<body>'))
          ELSE substr(html, strpos(html, '<body>')) END"""


def squeezed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


@register(f"""
SELECT page_id, {DOMAIN} AS domain, {SOURCE_TITLE} AS title,
       len(list_filter(regexp_extract_all(html, '(?s)<a href="[^"]*">([^<]*)', 1),
                       lambda t: {squeezed(decoded('t'))} <> '')) AS n_links,
       md5({squeezed(BODY)}) AS content_hash, length({squeezed(BODY)}) AS content_length
FROM pages""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), parts_of=("a", "title"), attrs=(), keep_html=True)
    body = X.sanitize(E.fragment(F.col("dom"), F.col("html"), "body"))
    rows = page.select("page_id", U.domain_of(F.col("url")).alias("domain"), E.title(F.col("dom")).alias("title"),
                       F.size(E.links(F.col("dom"), F.col("url"))).cast("long").alias("n_links"), body.alias("body"))
    return rows.select("page_id", "domain", "title", "n_links", X.content_hash(F.col("body")).alias("content_hash"),
                       F.length("body").cast("long").alias("content_length"))


@register(f"""
SELECT page_id, {SOURCE_TITLE} AS title, 1 AS n_malformed,
       len(list_filter(regexp_extract_all(html, '(?s)<a href="[^"]*">([^<]*)', 1),
                       lambda t: {squeezed(decoded('t'))} <> '')) AS n_links
FROM pages WHERE contains(html, '<article>')""", longs="n_links n_malformed")
def page_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a marked section no parser knows: it is counted, read as a comment, and nothing behind it is lost."""
    source = pages(spark, sf_dir).where(F.col("html").contains("<article>"))
    source = source.withColumn("html", F.regexp_replace("html", "<body>", "<body><![foo x]>"))
    page = shred(source, parts_of=("a", "title"), attrs=())
    rows = page.select("page_id", E.title(F.col("dom")).alias("title"), F.size(E.links(F.col("dom"), F.lit("http://a/"))).cast("long").alias("n_links"))
    return rows.join(malformed(source), "page_id")


# --- URLs
@register(f"SELECT page_id, {DOMAIN} AS domain, regexp_extract(url, '^[a-z]+://[^/?#]*') AS domain_url FROM pages")
def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.domain_of(url).alias("domain"), U.domain_url(url).alias("domain_url"))


@register("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical_url, "
          "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.canonical_url(url).alias("canonical_url"), U.path(url).alias("path"))


def suffix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix rules taken from the pages' own hosts: their last label, and the two labels under `net`."""
    host = U.host(F.col("url"))
    top = F.substring_index(host, ".", -1)
    rules = F.array(top, F.when(top == "net", F.substring_index(host, ".", -2)))
    return pages(spark, sf_dir).select(F.explode(rules).alias("suffix")).where("suffix is not null").distinct()


_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_WEBSITE_SQL = f"""
WITH h AS (SELECT page_id, url, string_split({_HOST}, '.') AS l FROM pages),
s AS (SELECT *, CASE WHEN l[-1] = 'net' THEN 2 ELSE 1 END AS k FROM h),
w AS (SELECT page_id, url, array_to_string(l[-(k + 1):], '.') AS website, array_to_string(l[-k:], '.') AS suffix FROM s)"""


@register(f"""
WITH h AS (SELECT page_id, {_HOST} AS host FROM pages),
s AS (SELECT *, CASE WHEN host LIKE 'blog.%' THEN 2 WHEN host LIKE 'm.%' THEN 1 ELSE 0 END AS more, string_split(host, '.') AS l FROM h)
SELECT page_id, CASE more WHEN 2 THEN 'v.k.u.t.' || host WHEN 1 THEN 'v.k.u.t.' || host
       ELSE array_to_string(l[-(CASE WHEN l[-1] = 'net' THEN 3 ELSE 2 END):], '.') END AS website,
       CASE more WHEN 2 THEN 'k.u.t.' || host WHEN 1 THEN 'k.u.t.' || host
       ELSE array_to_string(l[-(CASE WHEN l[-1] = 'net' THEN 2 ELSE 1 END):], '.') END AS suffix
FROM s""")
def url_website_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix rules of six labels and more: plain ones for blogs, wildcards for mobile hosts."""
    rows = pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    rule = F.when(F.col("host").startswith("blog."), F.concat(F.lit("k.u.t."), "host")).when(
        F.col("host").startswith("m."), F.concat(F.lit("*.u.t."), "host"))
    rules = rows.select(rule.alias("suffix")).where("suffix is not null").distinct().unionByName(suffix_list(spark, sf_dir))
    deep = rows.select("page_id", F.concat(F.lit("http://w.v.k.u.t."), "host", F.lit("/x")).alias("url"))
    return with_website(deep, rules).drop("url")


@register(_WEBSITE_SQL + " SELECT page_id, website, suffix FROM w")
def url_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_website(pages(spark, sf_dir).select("page_id", "url"), suffix_list(spark, sf_dir)).drop("url")


@register(_WEBSITE_SQL + """ SELECT page_id,
  regexp_replace(website || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^a-zA-Z0-9]', '_', 'g')
    AS unique_page_name FROM w""")
def url_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = with_website(pages(spark, sf_dir).select("page_id", "url"), suffix_list(spark, sf_dir))
    return named.select("page_id", U.unique_page_name(F.col("website"), F.col("url")).alias("unique_page_name"))


_HREFS = """SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages"""


@register(f"SELECT page_id, pos, {decoded('raw')} AS raw, {DOMAIN} || {decoded('raw')} AS resolved FROM ({_HREFS})")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shred(pages(spark, sf_dir), attrs=("href",)).select("page_id", "url", F.posexplode(E.hrefs(F.col("dom"))).alias("pos", "raw"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "raw", U.resolve_url(F.col("url"), F.col("raw")).alias("resolved"))


# RE2 needs the pattern's alternation spelled the same; both engines take the leftmost, first alternative.
_URL_HIT = ("regexp_extract(text, '(?:(?:http[s]?://)?(?:[a-zA-Z0-9.-]+(?:\\.[a-zA-Z]{2,4}))"
            "|(?:www\\.[a-zA-Z0-9.-]+(?:\\.[a-zA-Z]{2,4})))')")


@register(f"""SELECT doc_id, CASE WHEN h = '' THEN NULL WHEN h LIKE 'http://%' OR h LIKE 'https://%' THEN h
 WHEN h LIKE 'www.%' THEN 'http://' || h ELSE 'http://www.' || h END AS first_url
 FROM (SELECT doc_id, {_URL_HIT} AS h FROM documents)""")
def first_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", U.first_url_in_text(F.col("text")).alias("first_url"))


@register(f"""SELECT item_id, 'https://www.google.com/search?q=' || replace({squeezed('text')}, ' ', '+') || '&ie=utf-8&oe=utf-8'
 AS search_url FROM benchmark""")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", U.search_url(F.col("text")).alias("search_url"))


# --- fragments and titles
@register(f"""SELECT page_id, substr(html, strpos(html, '<head>'), strpos(html, '</head>') + 7 - strpos(html, '<head>')) AS header_html,
 {BODY} AS body_html,
 CASE WHEN strpos(html, '<footer>') > 0 THEN substr(html, strpos(html, '<footer>'),
   strpos(html, '</footer>') + 9 - strpos(html, '<footer>')) END AS footer_html FROM pages""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), attrs=(), keep_html=True)
    return page.select("page_id", *[
        E.fragment(F.col("dom"), F.col("html"), tag).alias(f"{name}_html")
        for name, tag in (("header", "head"), ("body", "body"), ("footer", "footer"))])


@register()
def full_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(pages(spark, sf_dir), text_nodes=True).select("page_id", E.pretty_html(F.col("dom")).alias("html"))


_H1 = decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")


@register(f"""SELECT page_id, {SOURCE_TITLE} AS title, {_H1} AS title_or_heading,
 left(regexp_replace({SOURCE_TITLE}, '[^a-zA-Z0-9]', '_', 'g'), 60) AS page_title FROM pages""")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom = F.col("dom")
    return shred(pages(spark, sf_dir), parts_of=("title", "h1"), attrs=()).select(
        "page_id", E.title(dom).alias("title"), E.title_or_heading(dom).alias("title_or_heading"),
        X.page_title(E.title(dom)).alias("page_title"))


@register(f"SELECT page_id, 'h1' AS tag, 0 AS pos, trim({_H1}) AS text FROM pages WHERE html LIKE '%<h1>%'", longs="pos")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.heading_rows(shred(pages(spark, sf_dir), parts_of=HEADINGS, attrs=()))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@register(f"""SELECT page_id, '{{"title":' || to_json({SOURCE_TITLE}) || ',"meta_tags":[]}}' AS header_structure FROM pages""")
def meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), parts_of=("title",), attrs=("name", "content"))
    return page.select("page_id", E.header_structure(F.col("dom")).alias("header_structure"))


_ANCHORS = """SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">[^<]*', 0)) AS a FROM pages"""


@register(f"""SELECT page_id, text, href, '' AS class_attr, CAST(NULL AS VARCHAR) AS id_attr FROM (
 SELECT page_id, {squeezed(decoded("regexp_extract(a, '(?s)>(.*)', 1)"))} AS text,
        {DOMAIN} || {decoded("regexp_extract(a, '\"([^\"]*)\"', 1)")} AS href FROM ({_ANCHORS})) WHERE text <> ''""")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.link_rows(shred(pages(spark, sf_dir), parts_of=("a",), attrs=("href", "class", "id"))).drop("pos")


@register(f"""SELECT page_id, len(list_filter(h, lambda x: x LIKE '/%' OR contains(x, {DOMAIN}))) AS n_internal,
 len(list_filter(h, lambda x: NOT (x LIKE '/%' OR contains(x, {DOMAIN})))) AS n_external
 FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)""")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dom, url = F.col("dom"), F.col("url")
    return shred(pages(spark, sf_dir), attrs=("href",)).select(
        "page_id", F.size(E.internal_links(dom, url)).cast("long").alias("n_internal"),
        F.size(E.external_links(dom, url)).cast("long").alias("n_external"))


# --- text jobs
_PHONE = r"\(?\b\d{3}\)?[-.\s]*\d{3}[-.\s]*\d{4}\b"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_ADDRESS = r"[0-9]{1,5}\s([\p{L}\p{N}_]+\s){1,2}[\p{L}\p{N}_]*\.?"


def matches_sql(key: str, column: str, relation: str, pattern: str, name: str, group: int = 0) -> str:
    found = f"regexp_extract_all({column}, '{pattern}', {group})"
    return (f"SELECT {key}, unnest({found}) AS {name}, generate_subscripts({found}, 1) - 1 AS pos FROM {relation}")


def matches(df: DataFrame, key: str, found, name: str) -> DataFrame:
    return df.select(key, F.posexplode(found).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


@register(matches_sql("doc_id", "text", "documents", _PHONE, "phone"))
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(texts(spark, sf_dir), "doc_id", X.phones(F.col("text")), "phone")


@register(matches_sql("doc_id", "text", "documents", _EMAIL, "email"))
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(texts(spark, sf_dir), "doc_id", X.emails(F.col("text")), "email")


@register(f"SELECT lower(split_part(email, '@', 2)) AS email_domain, count(*) AS n FROM ({matches_sql('doc_id', 'text', 'documents', _EMAIL, 'email')}) GROUP BY 1")
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = emails(spark, sf_dir)
    return found.groupBy(F.lower(F.substring_index("email", "@", -1)).alias("email_domain")).agg(F.count("*").alias("n"))


@register(matches_sql("doc_id", "text", "documents", _ADDRESS, "address", 1))
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(texts(spark, sf_dir), "doc_id", X.addresses(F.col("text")), "address")


@register(matches_sql("doc_id", "text", "documents", _ADDRESS, "address"))
def addresses_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(texts(spark, sf_dir), "doc_id", X.addresses(F.col("text"), full=True), "address")


@register(f"""SELECT page_id, len(regexp_extract_all(html, '{_PHONE}')) AS n_phones, len(regexp_extract_all(html, '{_EMAIL}')) AS n_emails,
 len(regexp_extract_all(html, '{_ADDRESS}')) AS n_addresses FROM pages""")
def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return pages(spark, sf_dir).select("page_id", *[
        F.size(found(html)).cast("long").alias(f"n_{found.__name__}") for found in (X.phones, X.emails, X.addresses)])


def clean_sql(expr: str) -> str:
    """SQL twin of the text clean-up, for text whose entities are in `decoded`."""
    e = f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"
    e = f"translate({e}, '“”–—' || chr(160) || '‘’', '\"\"-- ''''')"
    e = f"regexp_replace({e}, '[^\\x00-\\x7F]+', ' ', 'g')"
    e = f"trim(regexp_replace({e}, '[\\s\\x0B\\x1C-\\x1F]+', ' ', 'g'))"
    return f"CASE WHEN {e} IN ('-', '/') THEN '' ELSE {e} END"


@register(f"SELECT doc_id, {clean_sql(decoded('text'))} AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


def cleanup_sql(expr: str) -> str:
    e = f"replace(replace(replace({expr}, '&amp;', '&'), '&gt;', '>'), '&lt;', '<')"
    return f"regexp_replace(regexp_replace({e}, '{WS}+', ' ', 'g'), '[^\\x00-\\x7F]', '', 'g')"


@register(f"SELECT page_id, {cleanup_sql('html')} AS clean FROM pages")
def scrape_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.scrape_cleanup(F.col("html")).alias("clean"))


# --- sections, lists, whole-page text
# In these pages an article is a heading and then paragraphs, of which some open `<p><b>` and are
# never closed: those reach to the article's end and hold the ones after them.
_NAV_ITEMS = "regexp_extract_all(html, '(?s)<li><a href=\"[^\"]*\">(.*?)</a></li>', 1)"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_PARAGRAPHS = f"""SELECT *, list_transform(range(1, len(ps) + 1), lambda i:
   CASE WHEN starts_with(ps[i], '<b>') THEN array_to_string(ps[i:], '') ELSE ps[i] END) AS raws
 FROM (SELECT *, string_split({_ARTICLE}, '<p>')[2:] AS ps FROM pages)"""


_ARTICLE_H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


def without_tags(expr: str) -> str:
    return decoded(f"regexp_replace({expr}, '<[^>]*>', '', 'g')")


def pieces_sql(expr: str, separator: str) -> str:
    """SQL: the strings between tags, each stripped, blank ones dropped."""
    stripped = f"regexp_replace({decoded('t')}, '^{WS}+|{WS}+$', '', 'g')"
    return (f"array_to_string(list_filter(list_transform(regexp_extract_all('>' || {expr} || '<', '>([^<]+)', 1), "
            f"lambda t: {stripped}), lambda t: t <> ''), '{separator}')")


@register(f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, header, kind, text, items FROM (
 SELECT page_id, 1 AS k, 'unassociated' AS header, 'list' AS kind, CAST(NULL AS VARCHAR) AS text,
   array_to_string(list_transform({_NAV_ITEMS}, lambda t: {clean_sql(decoded('t'))}), chr(10)) AS items FROM pages WHERE len({_NAV_ITEMS}) > 1
 UNION ALL SELECT page_id, 2, 'unassociated', 'text', {clean_sql(decoded("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))}, NULL FROM pages
 UNION ALL SELECT page_id, 3, 'H1: ' || {clean_sql(_H1)}, 'text', {clean_sql(without_tags('raws[1]'))}, NULL FROM ({_PARAGRAPHS})
 UNION ALL SELECT page_id, 4, 'H1: ' || {clean_sql(_H1)}, 'text', {clean_sql(decoded("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"))}, NULL FROM pages
 ) WHERE text IS NULL OR text <> ''""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
    return S.section_rows(page).select("page_id", F.col("pos").cast("long").alias("pos"), "header", "kind", "text", F.array_join("items", "\n").alias("items"))


@register(f"""SELECT page_id, pos - 1 AS pos, item FROM (SELECT page_id,
  unnest(list_transform({_NAV_ITEMS}, lambda t: {clean_sql(decoded('t'))})) AS item,
  generate_subscripts({_NAV_ITEMS}, 1) AS pos, len({_NAV_ITEMS}) AS n FROM pages) WHERE n > 1""")
def lists_ul(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), parts_of=("li", "p"), attrs=("style", "class", "hidden", "aria-hidden"), decode_twice=True)
    found = page.select("page_id", F.explode(S.unordered_lists(F.col("dom"))).alias("l"))
    return matches(found, "page_id", F.col("l.items"), "item")


@register(f"""SELECT page_id, 0 AS pos, 1 AS level, trim({_H1}) AS header, {pieces_sql('raws[1]', ' ')} AS content
 FROM ({_PARAGRAPHS})""", longs="pos level")
def content_by_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), parts_of=HEADINGS, text_nodes=True, attrs=())
    rows = page.select("page_id", F.posexplode(S.content_by_headers(F.col("dom"))).alias("pos", "c"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("c.level").cast("long").alias("level"), "c.header", "c.content")


@register(f"""SELECT page_id, array_to_string(texts, chr(10)) AS clean_data,
 list_sum(list_transform(texts, lambda t: length(t)))::BIGINT AS char_count, {SOURCE_TITLE} AS title FROM (
 SELECT *, list_filter(all_texts, lambda t, i: t <> '' AND NOT list_contains(all_texts[:i - 1], t)) AS texts FROM (
 SELECT *, list_concat([{pieces_sql(_ARTICLE_H1, '')}], list_transform(raws, lambda r: {pieces_sql('r', '')})) AS all_texts
 FROM ({_PARAGRAPHS})))""")
def clean_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), parts_of=("title", "p", "li", *HEADINGS), attrs=("id",))
    return page.select("page_id", S.clean_scrape(F.col("dom")).alias("c")).select(
        "page_id", "c.clean_data", F.col("c.char_count").cast("long").alias("char_count"), "c.title")


@register(f"""SELECT page_id, unnest(list_transform(raws, lambda r: {without_tags('r')})) AS text,
 generate_subscripts(raws, 1) - 1 AS pos FROM ({_PARAGRAPHS})""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(pages(spark, sf_dir), parts_of=("p",), attrs=())
    return matches(page, "page_id", S.paragraphs(F.col("dom")), "text")

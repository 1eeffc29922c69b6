"""Queries over rich pages derived from the relational tables, with twins computed from those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as D
from checks.registry import register
from pageloom.functions import nodes as N
from pageloom.functions.lambdas import let
from pageloom.operators import boilerplate as B
from pageloom.operators import elements as E
from pageloom.operators import sections as S
from pageloom.operators import sitemaps as M
from pageloom.operators import special as P
from pageloom.operators.shred import HEADINGS, shred
from pageloom.plans.options import extract
from pageloom.plans.crawl import crawl_items, item_sitemap_contents, item_sitemap_links
from pageloom.session import run_dir
from pageloom.sources import sinks
from pageloom.sources.shredded import ATTRIBUTES, read_shredded

C_URL = "'https://shop' || c_nationkey || '.example.com/c/' || c_custkey || '/index.html'"
C_HOST = "'https://shop' || c_nationkey || '.example.com'"
PHOTO = f"{C_HOST} || '/c/img/' || c_custkey || '.jpg'"
CDN = "'https://cdn.example.com/' || c_custkey || '.png'"
LAZY = "'https://cdn.example.com/lazy' || c_custkey || '.gif'"
ALT = "CASE WHEN c_custkey % 4 = 0 THEN 'Company LOGO' ELSE 'Product ' || c_custkey END"


def long(name: str):
    return F.col(name).cast("long").alias(name)


@register(f"""
SELECT c_custkey AS page_id, 0 AS pos, {PHOTO} AS src, 'Photo of ' || c_name AS alt, 'pic big' AS class_attr, 'i' || c_custkey AS id_attr FROM customer
UNION ALL SELECT c_custkey, 1, {CDN}, {ALT}, '', NULL FROM customer
UNION ALL SELECT c_custkey, 2, {C_URL}, 'Lazy', '', NULL FROM customer
UNION ALL SELECT c_custkey, 3, {C_URL}, 'none', '', NULL FROM customer""", longs="pos")
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.image_rows(shred(D.customer_pages(spark, sf_dir), attrs=("src", "alt", "class", "id")))
    return rows.withColumn("pos", F.col("pos").cast("long"))


_IMAGE_ATTRS = ("src", "data-src", "nitro-lazy-src", "style", "alt")


@register(f"""
SELECT c_custkey AS page_id, 0 AS pos, {PHOTO} AS image FROM customer UNION ALL SELECT c_custkey, 1, {CDN} FROM customer
UNION ALL SELECT c_custkey, 2, {LAZY} FROM customer
UNION ALL SELECT c_custkey, 3, {C_HOST} || '/bg/' || c_nationkey || '.webp' FROM customer""", longs="pos")
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), attrs=_IMAGE_ATTRS)
    return E.explode_strings(page, E.image_links(F.col("dom"), F.col("url")), "image").withColumn("pos", F.col("pos").cast("long"))


@register(f"""SELECT c_custkey AS page_id, {CDN} AS src, {ALT} AS alt, c_custkey % 4 > 0 AS kept FROM customer
UNION ALL SELECT c_custkey, {LAZY}, 'Lazy', true FROM customer""")
def image_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), attrs=_IMAGE_ATTRS)
    found = page.select("page_id", E.filtered_images(F.col("dom"), F.col("url")).alias("kept"), F.explode(E.images_with_alt(F.col("dom"), F.col("url"))).alias("i"))
    return found.select("page_id", "i.src", "i.alt", F.array_contains("kept", F.col("i")).alias("kept"))


@register("""SELECT c_custkey AS page_id, 0 AS pos, '/v/' || c_custkey || '.mp4' AS src FROM customer
UNION ALL SELECT c_custkey, 1, 'https://video.example.com/' || c_nationkey FROM customer""", longs="pos")
def video_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), attrs=("src",))
    return E.explode_strings(page, E.video_links(F.col("dom")), "src").withColumn("pos", F.col("pos").cast("long"))


@register("""SELECT c_custkey AS page_id, href, true AS internal FROM customer, (VALUES (1), (2)) v(k),
 LATERAL (SELECT CASE k WHEN 1 THEN '/segments/' || c_mktsegment ELSE '//cdn.example.org/x' END AS href)
UNION ALL SELECT c_custkey, 'https://other.example.net/' || c_custkey, false FROM customer""")
def internal_external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), attrs=("href",))
    sides = F.map_from_arrays(F.array(F.lit(True), F.lit(False)), F.array(E.internal_links(F.col("dom"), F.col("url")), E.external_links(F.col("dom"), F.col("url"))))
    return page.select("page_id", F.explode(sides).alias("internal", "hrefs")).select("page_id", F.explode("hrefs").alias("href"), "internal")


@register("""SELECT c_custkey AS page_id, 0 AS pos, 'Before ' || c_nationkey AS text FROM customer
UNION ALL SELECT c_custkey, 1, c_mktsegment || 'Nation' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 2, 'After' FROM customer UNION ALL SELECT c_custkey, 3, 'onetwo ' || c_custkey || 'three' FROM customer
UNION ALL SELECT c_custkey, 4, 'Table' FROM customer UNION ALL SELECT c_custkey, 5, 'Key values' FROM customer
UNION ALL SELECT c_custkey, 6, 'KeyValuename' || c_name || 'xcutsegment' FROM customer
UNION ALL SELECT c_custkey, 7, 'More' FROM customer UNION ALL SELECT c_custkey, 8, 'other' FROM customer
UNION ALL SELECT c_custkey, 9, 'cdn' FROM customer""", longs="pos")
def section_after_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), parts_of=("p", "ol", "ul", "table", "a", *HEADINGS), text_nodes=True, attrs=())
    return E.explode_strings(page, E.section_after(F.col("dom"), "Facts"), "text").withColumn("pos", F.col("pos").cast("long"))


@register("""SELECT c_custkey AS page_id, '{"title":"' || c_name || ' page","meta_tags":[{"name":"segment","content":"' || c_mktsegment
 || '"},{"name":"empty"}]}' AS header_structure FROM customer""")
def meta_tags_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), parts_of=("title",), attrs=("name", "content"))
    return page.select("page_id", E.header_structure(F.col("dom")).alias("header_structure"))


@register("""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name,
 CASE WHEN c_custkey % 5 > 0 THEN c_nationkey::BIGINT END AS nation FROM customer""")
def json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.json_ld_rows(shred(D.customer_pages(spark, sf_dir), parts_of=("script",), attrs=("type",)))
    return rows.select("page_id", F.variant_get("document", "$.name", "string").alias("name"),
                       F.variant_get("document", "$.nation", "long").alias("nation"))


@register("""SELECT c_custkey AS page_id, 'Before ' || c_nationkey AS pre, 'After' AS post,
 '1. ' || c_mktsegment || chr(10) || '2. Nation ' || c_nationkey AS items FROM customer""")
def lists_ol(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), parts_of=("li", "p"), decode_twice=True)
    found = page.select("page_id", F.explode(S.ordered_lists(F.col("dom"))).alias("l"))
    return found.select("page_id", "l.pre", "l.post", F.array_join("l.items", "\n").alias("items"))


@register("""SELECT c_custkey AS page_id, 0 AS table_pos, r AS row_idx, c AS col_idx, col, value FROM customer,
 (VALUES (0, 0, 'Key'), (0, 1, 'Value'), (1, 0, 'Key')) v(r, c, col),
 LATERAL (SELECT CASE WHEN r = 1 THEN 'segment' WHEN c = 0 THEN 'name' ELSE c_name || chr(10) || 'x' END AS value)""", longs="table_pos row_idx col_idx")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
    return S.table_rows(page).select("page_id", long("table_pos"), long("row_idx"), long("col_idx"), "col", "value")


@register("""SELECT c_custkey AS page_id, pos, header, kind, text, items FROM customer,
 LATERAL (SELECT * FROM (VALUES
 (0, 'H1: ' || c_name, 'text', 'In ' || c_mktsegment || ' & nation ' || c_nationkey, NULL),
 (1, 'H2: Facts', 'text', 'Before ' || c_nationkey, NULL),
 (2, 'H2: Facts', 'ordered_list', NULL, '1. ' || c_mktsegment || chr(10) || '2. Nation ' || c_nationkey),
 (3, 'H2: Facts', 'text', 'After', NULL),
 (4, 'H2: Facts', 'list', NULL, 'one' || chr(10) || 'two ' || c_custkey || 'three' || chr(10) || 'three'),
 (5, 'H2: Table', 'text', 'Key values', NULL), (6, 'H2: Table', 'table', NULL, NULL),
 (7, 'H3: More', 'text', 'other', NULL), (8, 'H3: More', 'text', 'cdn', NULL), (9, 'H3: More', 'text', 'tail', NULL)
 ) b(pos, header, kind, text, items))""", longs="pos")
def sections_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
    return S.section_rows(page).select("page_id", long("pos"), "header", "kind", "text", F.array_join("items", "\n").alias("items"))


@register("""SELECT c_custkey AS page_id, header, content FROM customer, LATERAL (SELECT * FROM (VALUES
 ('More', 'Link: other' || chr(10) || 'Link: cdn' || chr(10) || 'tail'),
 ('Table', 'Key values' || chr(10) || 'Key Value name ' || c_name || ' x cut segment' || chr(10) || 'More' || chr(10) ||
    'Link: other' || chr(10) || 'Link: cdn' || chr(10) || 'tail'),
 ('Facts', 'Before ' || c_nationkey || chr(10) || c_mktsegment || ' Nation ' || c_nationkey || chr(10) || 'After' || chr(10)
    || 'one two ' || c_custkey || ' three'),
 ('Pictures', ''),
 (c_name, 'In ' || c_mktsegment || ' & nation ' || c_nationkey || chr(10) || 'Pictures' || chr(10) || 'Facts' || chr(10)
    || 'Before ' || c_nationkey || chr(10) || c_mktsegment || ' Nation ' || c_nationkey || chr(10) || 'After' || chr(10)
    || 'one two ' || c_custkey || ' three' || chr(10) || 'Table' || chr(10)
    || 'Key values' || chr(10) || 'Key Value name ' || c_name || ' x cut segment' || chr(10) || 'More' || chr(10) ||
    'Link: other' || chr(10) || 'Link: cdn' || chr(10) || 'tail')
 ) h(header, content))""")
def content_by_headers_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir), parts_of=HEADINGS, text_nodes=True, attrs=())
    return page.select("page_id", F.explode(S.content_map(S.content_by_headers(F.col("dom")))).alias("header", "content"))


# Whether the part's style hides its element: by position in the list of styles.
_HIDES = "p_size % 10 < 7"


@register(f"""SELECT p_partkey AS page_id, text FROM part, LATERAL (SELECT unnest(
 CASE WHEN {_HIDES} THEN [] ELSE ['Maybe ' || p_size] END || ['Nav ' || p_partkey, 'Share ' || p_brand, 'Dialog ' || p_type,
 'By ' || p_brand, 'Kept ' || p_type, 'Shown ' || p_name, 'Shown ' || p_name, 'Type ' || p_type, 'Foot ' || p_partkey]) AS text)""")
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.part_pages(spark, sf_dir), parts_of=("p",))
    texts = let(N.hidden(F.col("dom")), lambda hid: F.transform(
        F.filter("dom", lambda n: N.is_tag(n, "p") & ~F.get(hid, n["id"])), N.text))
    return page.select("page_id", F.explode(texts).alias("text"))


_SECTION_TEXTS = f"""SELECT p_partkey AS page_id, header, kind, text FROM part, LATERAL (SELECT unnest(
 [{{'header': 'unassociated', 'kind': 'text', 'text': 'Nav ' || p_partkey, 'drop': true}}]
 || CASE WHEN {_HIDES} THEN [] ELSE [{{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'Maybe ' || p_size, 'drop': false}}] END
 || [{{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'Share ' || p_brand, 'drop': true}},
     {{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'Dialog ' || p_type, 'drop': true}},
     {{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'By ' || p_brand, 'drop': p_partkey % 3 = 0}},
     {{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'Kept ' || p_type, 'drop': false}},
     {{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'Tab ' || p_partkey, 'drop': true}},
     {{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'Shown ' || p_name, 'drop': false}},
     {{'header': 'H1: ' || p_name, 'kind': 'text', 'text': 'Shown ' || p_name, 'drop': false}},
     {{'header': 'H2: Details', 'kind': 'text', 'text': 'Brand ' || p_brand, 'drop': false}},
     {{'header': 'H2: Details', 'kind': 'text', 'text': 'Type ' || p_type, 'drop': false}},
     {{'header': 'H2: Details', 'kind': 'text', 'text': 'Loose ' || p_size, 'drop': false}},
     {{'header': 'H2: Details', 'kind': 'code', 'text': 'code ' || p_partkey || ' end', 'drop': false}},
     {{'header': 'H2: Details', 'kind': 'list_items', 'text': 'Item ' || p_size, 'drop': false}},
     {{'header': 'H2: Details', 'kind': 'text', 'text': 'Foot ' || p_partkey, 'drop': true}}], recursive := true))"""


def _with_rules(source: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with their site's rules, before they are shredded."""
    return B.with_site_filters(source.withColumn("website", F.regexp_extract(F.col("url"), r"([a-z]+\.com)/", 1)), rules)


def _sections_of_parts(spark: SparkSession, sf_dir: str, filters: B.Filters) -> DataFrame:
    source = _with_rules(D.part_pages(spark, sf_dir), spark.createDataFrame([], B.SITE_FILTERS))
    ready = shred(source, parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
    rows = S.section_rows(ready, B.dropped_test(F.col("dom"), F.col("site"), F.col("website"), filters))
    return rows.select("page_id", "header", "kind", F.coalesce("text", F.get("items", F.lit(0))).alias("text"))


@register(_SECTION_TEXTS)
def sections_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections_of_parts(spark, sf_dir, B.Filters())


@register(_SECTION_TEXTS + ' WHERE NOT "drop"')
def boilerplate_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections_of_parts(spark, sf_dir, B.Filters(content=True, by_class=True, by_link=True, by_div=True))


@register("""SELECT p_partkey AS page_id, tag, rule FROM part, (VALUES ('head', 'name'), ('nav', 'name'), ('p', 'parent_name'),
 ('div', 'class'), ('div', 'role'), ('a', 'tabindex'), ('footer', 'name'), ('p', 'parent_name')) v(tag, rule)
 UNION ALL SELECT p_partkey, 'div', 'site' FROM part WHERE p_partkey % 3 = 0""")
def site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = shred(_with_rules(D.part_pages(spark, sf_dir), spark.createDataFrame([], B.SITE_FILTERS)))
    return B.dropped_rows(ready, B.Filters(content=True, by_class=True)).select("page_id", "tag", "rule")


_OWN_RULES = """SELECT p_partkey AS page_id, tag, rule FROM part, (VALUES ('head', 'name'), ('nav', 'name'), ('p', 'parent_name'),
 ('div', 'class'), ('div', 'role'), ('a', 'tabindex'), ('p', 'parent_name')) v(tag, rule)"""


@register(_OWN_RULES + """ UNION ALL SELECT p_partkey, 'div', 'site' FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey, 'h2', 'name' FROM part, (VALUES (1), (2)) twice(i)""")
def site_rules_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the pages' own sites, written as JSON and read again: footers are kept, second headings dropped."""
    sites = _with_rules(D.part_pages(spark, sf_dir), spark.createDataFrame([], B.SITE_FILTERS)).select(F.col("website").alias("site_name")).distinct()
    path = f"{run_dir(spark, 'rules')}/rules"
    sites.select("site_name", F.array(F.lit("footer")).alias("include"), F.array(F.lit("h2")).alias("name")).write.option("maxRecordsPerFile", 1).json(path)
    rules = B.read_site_filters(spark, path)
    ready = shred(_with_rules(D.part_pages(spark, sf_dir), rules))
    return B.dropped_rows(ready, B.Filters(content=True, by_class=True)).select("page_id", "tag", "rule")


@register("SELECT p_partkey AS page_id, 'H2: Details' AS kept, false AS menu FROM part")
def heading_keys_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in a dropped element are no sections: a menu with a heading of its own is put before each page's text."""
    menu = F.replace(F.col("html"), F.lit("<h2>"), F.lit("<nav><h2>Menu</h2></nav><h2>"))
    source = _with_rules(D.part_pages(spark, sf_dir).withColumn("html", menu), spark.createDataFrame([], B.SITE_FILTERS))
    page = shred(source, parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
    dropped = B.dropped_test(F.col("dom"), F.col("site"), F.col("website"), B.Filters(content=True))
    keys = page.select("page_id", S.section_keys(F.col("dom"), dropped).alias("keys"))
    kept = F.get(F.filter("keys", lambda k: k == "H2: Details"), F.lit(0))
    return keys.select("page_id", kept.alias("kept"), F.array_contains("keys", "H2: Menu").alias("menu"))


@register("""SELECT p_partkey AS page_id, p_name || chr(10) || 'Details' || chr(10) || 'Maybe ' || p_size || chr(10) || 'Share ' || p_brand
 || chr(10) || 'Dialog ' || p_type || chr(10) || 'By ' || p_brand || chr(10) || 'Kept ' || p_type || chr(10) || 'Shown ' || p_name
 || chr(10) || 'Type ' || p_type || chr(10) || 'Item ' || p_size AS clean_data,
 length(p_name || 'DetailsMaybe ' || p_size || 'Share ' || p_brand || 'Dialog ' || p_type || 'By ' || p_brand || 'Kept ' || p_type
 || 'Shown ' || p_name || 'Type ' || p_type || 'Item ' || p_size) AS char_count, p_name AS title FROM part""")
def clean_scrape_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.part_pages(spark, sf_dir), parts_of=("title", "p", "li", *HEADINGS), attrs=("id",))
    return page.select("page_id", S.clean_scrape(F.col("dom")).alias("c")).select(
        "page_id", "c.clean_data", F.col("c.char_count").cast("long").alias("char_count"), "c.title")


@register("""SELECT s_suppkey AS page_id, 0 AS table_pos, 0 AS column_pos, pair_pos, key, value FROM supplier,
 (VALUES (0, 'Name'), (1, 'Nation')) v(pair_pos, key), LATERAL (SELECT CASE pair_pos WHEN 0 THEN s_name ELSE s_nationkey::VARCHAR END AS value)""", longs="table_pos column_pos pair_pos")
def div_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.supplier_pages(spark, sf_dir), parts_of_class=P.DIV_TABLE_PARTS, attrs=("role", "class", "scope"))
    return P.div_table_rows(page).select("page_id", long("table_pos"), long("column_pos"), long("pair_pos"), "key", "value")


@register("""SELECT s_suppkey AS page_id, pos, type, title, description, url FROM supplier, LATERAL (SELECT * FROM (VALUES
 (0, NULL, s_name, 'About ' || s_name, '/s/' || s_suppkey), (1, NULL, s_name, 'About ' || s_name, '/t/' || s_suppkey),
 (2, 'People also ask', 'Why ' || s_suppkey || '?', NULL, NULL), (3, 'YouTube Videos', NULL, NULL, '/v/' || s_suppkey),
 (4, 'Discussions and forums', 'Forum ' || s_nationkey, NULL, '/f/' || s_suppkey)) r(pos, type, title, description, url))""", longs="pos")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shred(D.supplier_pages(spark, sf_dir), attrs=("class", "href"), **P.serp_parts())
    return P.search_result_rows(page).withColumn("pos", F.col("pos").cast("long"))


# --- sitemaps
@register(f"""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN {C_HOST} || '/maps/sitemap' || c_nationkey || '.xml'
 ELSE {C_HOST} || '/robots.txt' END AS sitemap_entry,
 CASE WHEN c_nationkey % 2 = 0 THEN 'https://m.example.com/' || c_nationkey WHEN c_custkey % 2 = 0 THEN '/feed/' || c_custkey END AS sitemap_link
 FROM customer""")
def sitemap_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0")
    robots = nations.select(D.template("https://shop{n_nationkey}.example.com/robots.txt").alias("url"),
                            D.template("# n\nSitemap: https://m.example.com/{n_nationkey}\n").alias("body"))
    path = run_dir(spark, "shredded")
    page = shred(D.customer_pages(spark, sf_dir), attrs=("href", "rel"))
    links_only = F.filter("dom", lambda n: n["tag"].isin("a", "link"))  # all that either side looks at
    page.select("page_id", "url", links_only.alias("dom")).write.parquet(path)
    stored = read_shredded(spark, path, ATTRIBUTES, columns=("page_id", "url"))
    links = extract(M.with_robots(stored, robots), ["find_sitemap_link"]).select("page_id", F.col("processed_values.find_sitemap_link").alias("sitemap_link"))
    entries = stored.select("page_id", M.sitemap_entry(F.col("dom"), F.col("url")).alias("sitemap_entry"))
    return entries.join(links, "page_id")


_TREE = f"""WITH RECURSIVE files AS (SELECT p_partkey AS k FROM part),
 walk(k, depth) AS (SELECT 0::BIGINT, 1 UNION ALL
   SELECT walk.k * {D.FAN_OUT} + c, depth + 1 FROM walk JOIN files USING (k), generate_series(1, {D.FAN_OUT}) g(c))"""


def _reached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = D.sitemap_files(spark, sf_dir)
    seeds = files.where(F.col("url").endswith("/robots.txt")).select(F.col("url").alias("seed"))
    return M.expand_sitemaps(seeds, files), files


@register(_TREE + """ SELECT 'https://maps.example.com/robots.txt' AS url, 0 AS depth
 UNION ALL SELECT 'https://maps.example.com/sitemap' || k || '.xml', depth FROM walk""", longs="depth")
def sitemap_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)[0].select("url", long("depth"))


@register("SELECT 'https://maps.example.com/part/' || p_partkey || '?a=1&b=2' AS url FROM part")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sitemap_pages(*_reached(spark, sf_dir)).select("url")


@register(_TREE + """ SELECT 'link' AS kind, count(*) AS n FROM walk WHERE depth > 1
 UNION ALL SELECT 'content', count(*) FROM walk JOIN files USING (k)""")
def item_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached, files = _reached(spark, sf_dir)
    links, contents = item_sitemap_links(reached), item_sitemap_contents(reached, files)
    return links.agg(F.count("*").alias("n")).select(F.lit("link").alias("kind"), "n").unionByName(
        contents.agg(F.count("*").alias("n")).select(F.lit("content").alias("kind"), "n"))


# --- crawl items and documents
@register(f"""SELECT c_custkey AS page_id, {C_URL} AS url, c_name || ' page' AS title,
 '<body><h1>' || c_name || '</h1> <p>In <a href="/segments/' || c_mktsegment || '">' || c_mktsegment || '</a> &amp; nation ' || c_nationkey || '</p>' AS body_start,
 'More</h3><a href="https://other.example.net/' || c_custkey || '">other</a><a href="//cdn.example.org/x">cdn</a> tail </body>' AS body_end,
 '{{"title":"' || c_name || ' page","meta_tags":[{{"name":"segment","content":"' || c_mktsegment || '"}},{{"name":"empty"}}]}}' AS header_structure,
 c_mktsegment || ' ' || {C_HOST} || '/segments/' || c_mktsegment || chr(10) || 'other https://other.example.net/' || c_custkey || chr(10) || 'cdn https://cdn.example.org/x' AS links,
 {PHOTO} || ' Photo of ' || c_name || ' pic big i' || c_custkey || chr(10) || {CDN} || ' ' || {ALT} || '  -' || chr(10) || {C_URL} || ' Lazy  -' || chr(10) || {C_URL} || ' none  -' AS images,
 CASE WHEN c_custkey % 5 > 0 THEN '{{"@type": "Person", "name": "' || c_name || '", "nation": ' || c_nationkey || '}} ' ELSE '' END AS schema_org_data,
 CASE WHEN c_custkey % 3 = 0 THEN {C_HOST} || '/maps/sitemap' || c_nationkey || '.xml' ELSE {C_HOST} || '/robots.txt' END AS sitemap_entry
 FROM customer""")
def crawl_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = crawl_items(D.customer_pages(spark, sf_dir))
    links = F.transform("links", lambda x: F.concat_ws(" ", x["text"], x["href"]))
    images = F.transform("images", lambda x: F.concat_ws(" ", x["src"], x["alt"], x["class_attr"], F.coalesce(x["id_attr"], F.lit("-"))))
    opening = F.concat(F.substring_index("clean_body", "</p>", 1), F.lit("</p>"))
    return items.select(
        "page_id", "url", "title", opening.alias("body_start"), F.substring_index("clean_body", "<h3>", -1).alias("body_end"), "header_structure",
        F.array_join(links, "\n").alias("links"), F.array_join(images, "\n").alias("images"), F.array_join("schema_org_data", "\n").alias("schema_org_data"),
        "sitemap_entry")


def _documents(spark: SparkSession, sf_dir: str, kind: str, pages: DataFrame | None = None) -> DataFrame:
    page = shred(D.customer_pages(spark, sf_dir) if pages is None else pages, parts_of=S.SECTION_PARTS, text_nodes=True, decode_twice=True)
    named = page.withColumn("website", F.lit("example.com")).withColumn("unique_page_name", F.concat(F.lit("c_"), F.col("page_id")))
    return sinks.page_documents(named, kinds=(kind,)).select("page_id", kind)


_ABOUT = f"""'{{"overview": {{"uuid":"' || md5({C_URL}) || '","website":"example.com","url":"' || {C_URL} || '","unique_page_name":"c_' || c_custkey
 || '","page_title":"' || regexp_replace(c_name || ' page', '[^a-zA-Z0-9]', '_', 'g') || '"}}'"""


@register(f"""SELECT c_custkey AS page_id, {_ABOUT} || ', "Title": "' || c_name || ' page", "H1: ' || c_name || '": ["In ' || c_mktsegment
 || ' & nation ' || c_nationkey || '"], "H2: Pictures": [], "H2: Facts": ["Before ' || c_nationkey || '", {{"list": ["1. ' || c_mktsegment
 || '","2. Nation ' || c_nationkey || '"]}}, "After", {{"list": ["one","two ' || c_custkey || 'three","three"]}}], "H2: Table": ["Key values", '
 || '{{"tables": [{{"Key":"name","Value":"' || c_name || '\\nx"}},{{"Key":"segment"}}]}}], "H3: More": ["other", "cdn", "tail"], "unassociated": []}}'
 AS organized FROM customer""")
def organized_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "organized")


_ORGANIZED = """', "Title": "' || c_name || ' page", "H1: ' || c_name || '": ["In ' || c_mktsegment || ' & nation ' || c_nationkey
 || '"], "H2: Pictures": [], "H2: Facts": ' || facts || ', "H2: Table": ["Key values", '
 || '{"tables": [{"Key":"name","Value":"' || c_name || '\\nx"},{"Key":"segment"}]}], "H3: More": ["other", "cdn", "' || CASE WHEN c_custkey % 2 = 0 THEN 'end' ELSE 'tail' END || '"]'
 || CASE WHEN c_custkey % 2 = 0 THEN ', "H2: New facts": ' || facts ELSE '' END || ', "unassociated": []}'"""
_FACTS = """'["Before ' || c_nationkey || '", {"list": ["1. ' || c_mktsegment || '","2. Nation ' || c_nationkey || '"]}, "After", {"list": ["one","two '
 || c_custkey || 'three","three"]}]'"""


@register(f"SELECT 'c_' || c_custkey AS unique_page_name, {_ABOUT} || {_ORGANIZED} AS organized FROM (SELECT *, {_FACTS} AS facts FROM customer)")
def organized_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page comes again with other markup: a new heading is added, changed contents replace the old, the rest stays."""
    path = run_dir(spark, "organized")
    pages = D.customer_pages(spark, sf_dir)
    again = pages.where("page_id % 2 = 0").withColumn("html", F.replace(F.replace("html", F.lit("<h2>Facts"), F.lit("<h2>New facts")), F.lit(" tail\n"), F.lit(" end\n")))
    for run in (pages, again, again):
        members = _documents(spark, sf_dir, "members", run).withColumn("unique_page_name", F.concat(F.lit("c_"), F.col("page_id").cast("string")))
        sinks.merge_organized(members, path, buckets=4)
    return sinks.read_organized(spark, path).select("unique_page_name", sinks.members_json(F.col("members")).alias("organized"))


@register(f"""SELECT c_custkey AS page_id, {_ABOUT} || ', "tables": {{"H2: Table": [{{"pre": "In' || c_mktsegment || '& nation ' || c_nationkey
 || ' Before ' || c_nationkey || ' After Key values", "table": [{{"Key":"name","Value":"' || c_name || '\\nx"}},{{"Key":"segment"}}]}}]}}, "lists": '
 || '{{"H2: Facts": [{{"pre":"After","list":["one","two ' || c_custkey || 'three","three"],"post":"Key values"}}]}}, "ordered_lists": {{"H2: Facts": [{{"pre":"Before '
 || c_nationkey || '","list":["1. ' || c_mktsegment || '","2. Nation ' || c_nationkey || '"],"post":"After"}}]}}}}' AS structured FROM customer""")
def structured_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "structured")


@register(f"""SELECT c_custkey AS page_id, array_to_string(['overview', '', '  uuid', '    ' || md5({C_URL}), '', '  website', '    example.com', '',
 '  url', '    ' || {C_URL}, '', '  unique_page_name', '    c_' || c_custkey, '', '  page_title',
 '    ' || regexp_replace(c_name || ' page', '[^a-zA-Z0-9]', '_', 'g'), 'Title', '  ' || c_name || ' page', 'H1: ' || c_name,
 '  - In ' || c_mktsegment || ' & nation ' || c_nationkey, 'H2: Pictures', 'H2: Facts', '  - Before ' || c_nationkey, '  - 1. ' || c_mktsegment,
 '  - 2. Nation ' || c_nationkey, '  - After', '  - one', '  - two ' || c_custkey || 'three', '  - three', 'H2: Table', '  - Key values',
 '  - {{"Key":"name","Value":"' || c_name || '\\nx"}}', '  - {{"Key":"segment"}}', 'H3: More', '  - other', '  - cdn', '  - tail', 'unassociated'],
 chr(10)) AS text FROM customer""")
def text_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "text")

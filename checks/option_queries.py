"""All options' values, and the jobs that share one stored shredding, over pages whose markup is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as D
from checks.derived_queries import ALT, C_HOST, C_URL, CDN, LAZY, PHOTO
from checks.page_queries import _ADDRESS, _EMAIL, _PHONE, cleanup_sql
from checks.registry import register
from pageloom.operators import elements as E
from pageloom.operators.shred import shred
from pageloom.plans import crawl as C
from pageloom.plans.options import OPTIONS, extract, extract_stored
from pageloom.session import run_dir
from pageloom.sources.shredded import read_shredded, write_shredded

LD = """CASE WHEN c_custkey % 5 > 0 THEN '{"@type": "Person", "name": "' || c_name || '", "nation": ' || c_nationkey || '} <!-- c -->' ELSE '{"broken": {c_custkey' END"""
HTML = D.template_sql(
    D.CUSTOMER_HTML, alt=ALT, ld=LD,
    sitemap="""CASE WHEN c_custkey % 3 = 0 THEN '<link rel="sitemap" href="/maps/sitemap' || c_nationkey || '.xml">' ELSE '' END""",
    feed="""CASE WHEN c_custkey % 2 = 0 THEN '<link rel="alternate" href="/feed/' || c_custkey || '">' ELSE '' END""")

# The page above, a tag or string a line.
PRETTY = """<!DOCTYPE html>
<html>
 <head>
  <title>
   {c_name} page
  </title>
  <meta name="segment" content="{c_mktsegment}"/>
  <meta name="empty" content=""/>
  <meta charset="utf-8"/>
{?sitemap}{?feed}  <script type="application/ld+json">
   {?ld}
  </script>
 </head>
 <body>
  <h1>
   {c_name}
  </h1>
  <p>
   In
   <a href="/segments/{c_mktsegment}">
    {c_mktsegment}
   </a>
   &amp; nation {c_nationkey}
  </p>
  <h2>
   Pictures
  </h2>
  <img src="../img/{c_custkey}.jpg" alt="Photo of {c_name}" class="pic big" id="i{c_custkey}"/>
  <img src="https://cdn.example.com/{c_custkey}.png" alt="{?alt}"/>
  <img data-src="https://cdn.example.com/lazy{c_custkey}.gif" alt="Lazy"/>
  <img alt="none"/>
  <div style="background: url('/bg/{c_nationkey}.webp')">
  </div>
  <video src="/v/{c_custkey}.mp4">
  </video>
  <iframe src="https://video.example.com/{c_nationkey}">
  </iframe>
  <video>
  </video>
  <h2>
   Facts
  </h2>
  <p>
   Before {c_nationkey}
  </p>
  <ol>
   <li>
    {c_mktsegment}
   </li>
   <li>
    Nation
    <b>
     {c_nationkey}
    </b>
   </li>
  </ol>
  <p>
   After
  </p>
  <ul>
   <li>
    one
   </li>
   <li>
    two {c_custkey}
    <ul>
     <li>
      three
     </li>
    </ul>
   </li>
  </ul>
  <h2>
   Table
  </h2>
  <p>
   Key values
  </p>
  <table>
   <tr>
    <td>
     Key
    </td>
    <td>
     Value
    </td>
   </tr>
   <tr>
    <td>
     name
    </td>
    <td>
     {c_name}
     <br/>
     x
    </td>
    <td>
     cut
    </td>
   </tr>
   <tr>
    <td>
     segment
    </td>
   </tr>
  </table>
  <h3>
   More
  </h3>
  <a href="https://other.example.net/{c_custkey}">
   other
  </a>
  <a href="//cdn.example.org/x">
   cdn
  </a>
  tail
 </body>
</html>"""
PRETTY_SQL = D.template_sql(
    PRETTY, alt=ALT, ld=LD,
    sitemap="""CASE WHEN c_custkey % 3 = 0 THEN '  <link rel="sitemap" href="/maps/sitemap' || c_nationkey || '.xml"/>' || chr(10) ELSE '' END""",
    feed="""CASE WHEN c_custkey % 2 = 0 THEN '  <link rel="alternate" href="/feed/' || c_custkey || '"/>' || chr(10) ELSE '' END""")


@register(f"SELECT c_custkey AS page_id, {PRETTY_SQL} AS html FROM customer")
def full_html_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(D.customer_pages(spark, sf_dir), text_nodes=True).select("page_id", E.pretty_html(F.col("dom")).alias("html"))


_MORE = "Link: other\nLink: cdn\ntail"
_TABLE = "Key values\nKey Value name {c_name} x cut segment"
_FACTS = "Before {c_nationkey}\n{c_mktsegment} Nation {c_nationkey}\nAfter\none two {c_custkey} three"
_TEXT = (
    "\n\nHeader 1: {c_name}\nIn {c_mktsegment} & nation {c_nationkey}\nPictures\nFacts\n" + _FACTS + "\nTable\n" + _TABLE + "\nMore\n" + _MORE + "\n"
    "\n\nHeader 2: Pictures\n\n\n\nHeader 2: Facts\n" + _FACTS + "\n\n\nHeader 2: Table\n" + _TABLE + "\nMore\n" + _MORE + "\n\n\nHeader 3: More\n" + _MORE + "\n")
_HEADERS = """'{"h1":["' || c_name || '"],"h2":["Pictures","Facts","Table"],"h3":["More"],"h4":[]"""
_LINE = "chr(10)"
_SOUP = ("'<!--METADATA_START' || chr(10) || '        url: ' || url || chr(10) || '        website: None' || chr(10) || '        path: None' || chr(10) || "
         "'        domain_type: None' || chr(10) || '        unique_page_name: None' || chr(10) || '        METADATA_END-->' || chr(10) || html")


def found_sql(pattern: str, group: int = 0) -> str:
    return f"array_to_string(regexp_extract_all(html, '{pattern}', {group}), {_LINE})"


VALUES_SQL = f"""
SELECT page_id, 'QuickScraper' AS signature, false AS processing, {PRETTY_SQL} AS get_full_scrape,
  substr(html, strpos(html, '<head>'), strpos(html, '</head>') + 7 - strpos(html, '<head>')) AS get_header_html,
  substr(html, strpos(html, '<body>'), strpos(html, '</body>') + 7 - strpos(html, '<body>')) AS get_body_html, NULL::VARCHAR AS get_footer_html, c_name AS get_h1,
  {PHOTO} || {_LINE} || {CDN} || {_LINE} || {LAZY} || {_LINE} || {C_HOST} || '/bg/' || c_nationkey || '.webp' AS get_image_links,
  {CDN} || ' ' || {ALT} || {_LINE} || {LAZY} || ' Lazy' AS get_images_and_alt_text,
  CASE WHEN c_custkey % 4 > 0 THEN {CDN} || ' ' || {ALT} || {_LINE} ELSE '' END || {LAZY} || ' Lazy' AS get_filtered_images,
  '/segments/' || c_mktsegment || {_LINE} || '//cdn.example.org/x' AS get_internal_links, 'https://other.example.net/' || c_custkey AS get_external_links,
  '/v/' || c_custkey || '.mp4' || {_LINE} || 'https://video.example.com/' || c_nationkey AS get_video_links,
  {_HEADERS}}}' AS get_main_headers, {_HEADERS},"h5":[],"h6":[]}}' AS get_all_headers,
  {found_sql(_PHONE)} AS extract_phone_numbers, {found_sql(_ADDRESS, 1)} AS extract_addresses, {found_sql(_EMAIL)} AS extract_emails,
  CASE WHEN c_custkey % 2 = 0 THEN '/feed/' || c_custkey END AS find_sitemap_link, '[]' AS get_tables, {D.template_sql(_TEXT)} AS extract_content_by_headers,
  {_SOUP} AS save_soup_to_text
FROM (SELECT *, c_custkey AS page_id, {C_URL} AS url, {HTML} AS html FROM customer)"""


def _values(results: DataFrame) -> DataFrame:
    """Every option's value as one string."""
    v = F.col("processed_values")
    kinds = {f.name: f.dataType.simpleString() for f in results.schema["processed_values"].dataType}

    def plain(name: str):
        if name == "extract_content_by_headers":
            return v[name]["plain_text"]
        if kinds[name] == "string":
            return v[name]
        if kinds[name] == "array<string>":
            return F.array_join(v[name], "\n")
        if name in ("get_images_and_alt_text", "get_filtered_images"):
            return F.array_join(F.transform(v[name], lambda i: F.concat(i["src"], F.lit(" "), i["alt"])), "\n")
        return F.to_json(v[name])

    return results.select("page_id", "signature", "processing", *(plain(name).alias(name) for name in OPTIONS))


@register(VALUES_SQL)
def extract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twenty options from one shredding, by their values."""
    return _values(extract(D.customer_pages(spark, sf_dir), [*OPTIONS, "no_such_option"]))


def _stored(spark: SparkSession, pages: DataFrame) -> str:
    path = run_dir(spark, "shredded")
    write_shredded(pages, path)
    return path


@register(VALUES_SQL)
def extract_stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored shredding."""
    return _values(extract_stored(spark, _stored(spark, D.customer_pages(spark, sf_dir)), list(OPTIONS)))


_PARAGRAPHS = ("'In ' || c_mktsegment || ' & nation ' || c_nationkey", "'Before ' || c_nationkey", "'After'", "'Key values'")


@register(f"""
SELECT page_id, c_name || ' page' AS title, substr(html, strpos(html, '<body>'), strpos(html, '</body>') + 7 - strpos(html, '<body>')) AS body,
  c_name AS simple_title, {cleanup_sql("url")} || chr(10) || c_name || chr(10) || {" || chr(10) || ".join(_PARAGRAPHS)} AS simple_rows,
  length({" || ".join(_PARAGRAPHS)})::BIGINT AS char_count, {_HEADERS},"h5":[],"h6":[]}}' AS headings,
  CASE WHEN c_custkey % 5 > 0 THEN '{{"@type": "Person", "name": "' || c_name || '", "nation": ' || c_nationkey || '}} ' ELSE '' END AS documents
FROM (SELECT *, c_custkey AS page_id, {C_URL} AS url, {HTML} AS html FROM customer)""")
def jobs_on_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl items, simple pages and parsed data from one stored shredding: no job shreds again."""
    path = _stored(spark, D.customer_pages(spark, sf_dir))
    stored = read_shredded(spark, path)
    items = C.crawl_items(read_shredded(spark, path)).select("page_id", "title", "clean_body")
    simple = C.simple_pages(stored).select(
        "page_id", F.col("title").alias("simple_title"), F.array_join("rows", "\n").alias("simple_rows"), F.col("char_count").cast("long").alias("char_count"))
    parsed = C.parse_data(read_shredded(spark, path, columns=["page_id"])).select(
        "page_id", F.to_json("headings").alias("headings"), F.array_join("structured_data", "\n").alias("documents"))
    body = stored.select("page_id", E.fragment(F.col("dom"), F.col("html"), "body").alias("body"))
    return items.drop("clean_body").join(body, "page_id").join(simple, "page_id").join(parsed, "page_id")

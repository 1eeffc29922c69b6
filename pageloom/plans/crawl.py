"""The crawl item of a page, the simple page run, and re-processing of saved pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.functions import text as X
from pageloom.functions.lambdas import let
from pageloom.functions.urls import base_parts
from pageloom.operators import elements as E
from pageloom.operators import sections as S
from pageloom.operators.shred import HEADINGS, shred
from pageloom.operators.sitemaps import sitemap_entry
from pageloom.plans.options import extract
from pageloom.sources.snapshots import parse_snapshots

ITEM_ATTRS = ("href", "src", "alt", "class", "id", "name", "content", "type", "rel")
ITEM_PARTS = ("a", "title", "script")
# The elements an item is made of and those around them: more than ten, as Spark looks so many up by hash and compares fewer one by one.
ITEM_TAGS = ("a", "img", "script", "title", "link", "body", "head", "html", "meta", "base", "style")


def _source(pages: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, unless the pages come shredded (`sources.shredded`): then all is there already."""
    return pages if "dom" in pages.columns else pages.select(*columns)


def crawl_items(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, clean_body, header_structure, links, images, schema_org_data, sitemap_entry).

    One row for every page, with or without a sitemap. `schema_org_data` holds the JSON-LD
    documents that parse, as text. Pages may come shredded, as for the other jobs here.
    """
    page = shred(_source(pages, "page_id", "url", "html"), parts_of=ITEM_PARTS, attrs=ITEM_ATTRS, keep_html=True)
    dom, url, html, nodes, base = F.col("dom"), F.col("url"), F.col("html"), F.col("nodes"), F.col("base")
    # What several columns need is a column first, as each would work it out again; the whole page goes no further.
    page = page.select("page_id", "url", "html", "dom_strings", N.tagged(dom, *ITEM_TAGS).alias("nodes"), E.meta_tags(dom).alias("metas"), base_parts(url).alias("base"))
    return page.select(
        "page_id", "url", E.title(nodes).alias("title"), X.sanitize(E.fragment(nodes, html, "body")).alias("clean_body"),
        E.header_json(E.title(nodes), F.col("metas")).alias("header_structure"), E.links(nodes, url, base).alias("links"),
        E.images(nodes, url, base).alias("images"), E.json_ld_valid(nodes).alias("schema_org_data"),
        sitemap_entry(nodes, url).alias("sitemap_entry"))


def item_sitemap_links(reached: DataFrame) -> DataFrame:
    """(sitemap_entry, url): the nested sitemaps found from an entry point, one row each.

    `reached` comes from `expand_sitemaps`. Items refer to these rows by their `sitemap_entry`:
    a site's list is kept once and in rows, not once per page and not collected into one value.
    """
    direct = F.when(F.col("seed").endswith("/robots.txt"), 1).otherwise(0)
    return reached.where(F.col("depth") > direct).select(F.col("seed").alias("sitemap_entry"), "url")


def item_sitemap_contents(reached: DataFrame, files: DataFrame) -> DataFrame:
    """(sitemap_entry, url, content): the bodies of the sitemap files read from an entry point."""
    read = reached.where(~F.col("url").endswith("/robots.txt")).join(files, "url")
    return read.select(F.col("seed").alias("sitemap_entry"), "url", F.col("body").alias("content"))


def simple_pages(pages: DataFrame) -> DataFrame:
    """(page_id, rows, char_count, title): url, title and each paragraph, cleaned; counted before cleaning."""
    page = shred(_source(pages, "page_id", "url", "html"), parts_of=("h1", "title", "p"), attrs=())
    dom = F.col("dom")

    def build(e: Column) -> Column:
        raw = F.concat(F.array(F.col("url"), e["title"]), e["paragraphs"])
        return F.struct(
            F.transform(raw, X.scrape_cleanup).alias("rows"),
            F.aggregate(e["paragraphs"], F.lit(0), lambda acc, p: acc + F.length(p)).alias("char_count"),
            e["title"].alias("title"))

    facts = F.struct(E.title_or_heading(dom).alias("title"), S.paragraphs(dom).alias("paragraphs"))
    return page.select("page_id", F.when(dom.isNotNull(), let(facts, build)).alias("r")).select("page_id", "r.*")


def process_saved(saved: DataFrame, options: Iterable[str], task: str = "process_only") -> DataFrame:
    """`extract` over saved pages (page_id, content); their metadata header gives the url."""
    if task != "process_only" or "content" not in saved.columns:
        raise ValueError("saved pages are processed with task 'process_only' and a `content` column")
    return extract(parse_snapshots(saved), options)


def parse_data(pages: DataFrame, method: str = "lxml") -> DataFrame:
    """(page_id, content, headings, structured_data)."""
    if method != "lxml":
        raise ValueError(f"unsupported parsing method {method!r}")
    page = shred(_source(pages, "page_id", "html"), parts_of=("title", "p", "li", "script", *HEADINGS), attrs=("id", "type"))
    dom = F.col("dom")
    return page.select(
        "page_id", S.clean_scrape(dom)["clean_data"].alias("content"), E.headings_by_tag(dom).alias("headings"),
        E.json_ld_valid(dom).alias("structured_data"))

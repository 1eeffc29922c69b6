"""Sitemaps: discovery on a page, parsing by file kind, and the walk over nested files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.functions.lambdas import first
from pageloom.functions.text import strip
from pageloom.functions.urls import domain_of, resolve_url
from pageloom.operators.groups import look_up_small
from pageloom.session import run_dir

# What a link to a sitemap or feed looks like.
SITEMAP_PATTERNS = (
    r"sitemap.*\.xml", r"sitemap.*\.html?", r"/feed/?", r"/rss/?", r"/atom/?",
    r"/video_sitemap.*\.xml", r"/news_sitemap.*\.xml", r"/image_sitemap.*\.xml",
)


# Files of robots.txt up to which they are broadcast; they are limited to 500 KB by their standard and mostly far below.
ROBOTS_ROWS = 5_000


def robots_url(url: Column) -> Column:
    return F.concat(domain_of(url), F.lit("/robots.txt"))


def sitemap_entry(dom: Column, url: Column) -> Column:
    """Where a crawl of the page's site starts: its `link rel=sitemap`, else its robots.txt."""
    declared = first(F.filter(dom, lambda n: N.is_tag(n, "link") & (N.attr(n, "rel") == "sitemap") & N.attr(n, "href").isNotNull()))
    return F.when(declared.isNotNull(), resolve_url(url, N.attr(declared, "href"))).otherwise(robots_url(url))


def _lines(body: Column) -> Column:
    return F.split(body, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")


def robots_sitemaps(body: Column) -> Column:
    """Values of a robots.txt's `Sitemap:` lines, whatever their case."""
    hits = F.filter(_lines(body), lambda line: F.lower(F.ltrim(line)).startswith("sitemap:"))
    return F.transform(hits, lambda line: strip(F.regexp_replace(line, r"^[^:]*:", "")))


def with_robots(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Add `robots_body` to pages from fetched robots.txt files (url, body), one per site."""
    files = robots.select(F.col("url").alias("_robots_url"), F.col("body").alias("robots_body")).filter("_robots_url is not null")
    keyed = pages.withColumn("_robots_url", F.coalesce(robots_url(F.col("url")), F.lit("")))
    return look_up_small(keyed, ["_robots_url"], files, ["url"], ROBOTS_ROWS).drop("_robots_url")


def page_sitemap_link(dom: Column, robots_body: Column | None = None) -> Column:
    """First sitemap of the robots.txt, else the first link, else the first alternate, that looks like one."""
    looks = "(?i)" + "|".join(SITEMAP_PATTERNS)

    def hit(n: Column) -> Column:
        return N.attr(n, "href").rlike(looks)

    anchor = first(F.filter(dom, lambda n: N.is_tag(n, "a") & hit(n)))
    alternate = first(F.filter(dom, lambda n: N.is_tag(n, "link") & F.array_contains(
        F.split(N.attr_or_empty(n, "rel"), r"\s+"), "alternate") & hit(n)))
    found = [N.attr(anchor, "href"), N.attr(alternate, "href")]
    return F.coalesce(*([first(robots_sitemaps(robots_body))] if robots_body is not None else []), *found)


def listed_urls(url: Column, body: Column) -> Column:
    """URLs a file lists: `loc` values of .xml, lines of .txt, `Sitemap:` lines of anything else.

    By pattern rather than an XML parser, so a malformed file still gives what it has and a
    namespace prefix does not matter.
    """
    locs = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</"), 1),
        lambda u: F.replace(F.replace(u, F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&")))
    return (
        F.when(url.endswith(".xml"), locs)
        .when(url.endswith("/robots.txt") | ~url.endswith(".txt"), robots_sitemaps(body))
        .otherwise(F.filter(_lines(body), lambda line: line != "")))


def sitemap_links(files: DataFrame) -> DataFrame:
    """(url, listed, is_sitemap) for each URL a file lists.

    A sitemap is a URL with `sitemap` in it, or whatever a robots.txt names as one.
    """
    found = files.select("url", F.explode(listed_urls(F.col("url"), F.col("body"))).alias("listed"))
    return found.select("url", "listed", (
        F.col("listed").contains("sitemap") | F.col("url").endswith("/robots.txt")).alias("is_sitemap"))


def expand_sitemaps(seeds: DataFrame, files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Sitemap files reachable from each seed: (seed, url, depth), every pair once, at its least depth.

    `seeds` has `seed` (a URL to start from), `files` the fetched bodies as (url, body). The
    walk is breadth-first, one join per level; each level is written to the shared folder, which
    keeps plans short and survives lost executors. It ends by itself, as no pair is taken twice.
    """
    spark = seeds.sparkSession
    folder = run_dir(spark, "sitemaps")
    edges_path = f"{folder}/edges"
    sitemap_links(files).where("is_sitemap").select("url", "listed").distinct().write.parquet(edges_path)
    edges = spark.read.parquet(edges_path)

    start = seeds.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth")).distinct()
    start.write.partitionBy("depth").parquet(f"{folder}/seen")
    depth = 0
    while max_depth is None or depth < max_depth:
        seen = spark.read.schema("seed string, url string, depth int").parquet(f"{folder}/seen")
        level = (
            seen.where(F.col("depth") == depth).join(edges, "url")
            .select("seed", F.col("listed").alias("url")).distinct()
            .join(seen.select("seed", "url"), ["seed", "url"], "left_anti"))
        depth += 1
        level.withColumn("depth", F.lit(depth)).write.mode("append").partitionBy("depth").parquet(f"{folder}/seen")
        if spark.read.schema("seed string, url string, depth int").parquet(f"{folder}/seen").where(F.col("depth") == depth).isEmpty():
            break
    return spark.read.schema("seed string, url string, depth int").parquet(f"{folder}/seen")


def sitemap_pages(reached: DataFrame, files: DataFrame) -> DataFrame:
    """(seed, url): the page URLs listed by the sitemaps a seed reaches, each once."""
    listed = sitemap_links(files).where("not is_sitemap").select("url", "listed")
    return reached.join(listed, "url").select("seed", F.col("listed").alias("url")).distinct()

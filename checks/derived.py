"""Pages with rich markup, made row by row from the relational tables, so they grow with them.

No page gathers several rows: each comes from one customer, part, supplier or order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def template(text: str, **extra: Column) -> Column:
    """`{name}` in the text becomes the column's value; `{?name}` a column given by keyword."""
    pieces = []
    for part in re.split(r"(\{\??\w+\})", text):
        if part.startswith("{?"):
            pieces.append(extra[part[2:-1]])
        elif re.fullmatch(r"\{\w+\}", part):
            pieces.append(F.col(part[1:-1]).cast("string"))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def template_sql(text: str, **extra: str) -> str:
    """SQL for what `template` makes: string literals and columns joined."""
    pieces = []
    for part in re.split(r"(\{\??\w+\})", text):
        if part.startswith("{?"):
            pieces.append(f"({extra[part[2:-1]]})")
        elif re.fullmatch(r"\{\w+\}", part):
            pieces.append(part[1:-1])
        elif part:
            pieces.append("'" + part.replace("'", "''") + "'")
    return "concat(" + ", ".join(pieces) + ")"


def maybe(condition: str, text: str, otherwise: str = "") -> Column:
    return F.when(F.expr(condition), template(text)).otherwise(template(otherwise) if otherwise else F.lit(""))


# Rows of a test table dealt to one task at most, about: a task's time then stays the same on larger tables.
ROWS_PER_TASK = 10_000


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, in more parts where there are many: the test tables are one file each, so a scan would be one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK)))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


CUSTOMER_URL = "https://shop{c_nationkey}.example.com/c/{c_custkey}/index.html"


CUSTOMER_HTML = """<!DOCTYPE html><html><head><title>{c_name} page</title>
<meta name="segment" content="{c_mktsegment}"><meta name="empty" content=""><meta charset="utf-8">
{?sitemap}{?feed}<script type="application/ld+json">{?ld}</script></head>
<body><h1>{c_name}</h1>
<p>In <a href="/segments/{c_mktsegment}">{c_mktsegment}</a> &amp; nation {c_nationkey}</p>
<h2>Pictures</h2>
<img src="../img/{c_custkey}.jpg" alt="Photo of {c_name}" class="pic big" id="i{c_custkey}">
<img src="https://cdn.example.com/{c_custkey}.png" alt="{?alt}">
<img data-src="https://cdn.example.com/lazy{c_custkey}.gif" alt="Lazy"><img alt="none">
<div style="background: url('/bg/{c_nationkey}.webp')"></div>
<video src="/v/{c_custkey}.mp4"></video><iframe src="https://video.example.com/{c_nationkey}"></iframe><video></video>
<h2>Facts</h2><p>Before {c_nationkey}</p><ol><li>{c_mktsegment}</li><li>Nation <b>{c_nationkey}</b></li></ol><p>After</p>
<ul><li>one</li><li>two {c_custkey}<ul><li>three</li></ul></li></ul>
<h2>Table</h2><p>Key values</p><table><tr><td>Key</td><td>Value</td></tr>
<tr><td>name</td><td>{c_name}<br>x</td><td>cut</td></tr><tr><td>segment</td></tr></table>
<h3>More</h3><a href="https://other.example.net/{c_custkey}">other</a><a href="//cdn.example.org/x">cdn</a> tail
</body></html>"""


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media, metadata, lists and a table."""
    html = template(
        CUSTOMER_HTML,
        sitemap=maybe("c_custkey % 3 = 0", '<link rel="sitemap" href="/maps/sitemap{c_nationkey}.xml">'),
        feed=maybe("c_custkey % 2 = 0", '<link rel="alternate" href="/feed/{c_custkey}">'),
        ld=maybe("c_custkey % 5 > 0", '{"@type": "Person", "name": "{c_name}", "nation": {c_nationkey}} <!-- c -->', '{"broken": {c_custkey'),
        alt=maybe("c_custkey % 4 = 0", "Company LOGO", "Product {c_custkey}"))
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"), template(CUSTOMER_URL).alias("url"), html.alias("html"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden and boilerplate elements around the part's name, chosen by its size and key."""
    style = F.element_at(F.array(*map(F.lit, (
        'style="display: none"', 'style="VISIBILITY: HIDDEN"', 'style="opacity: 0"',
        'style="position: absolute; left: -9999px"', 'aria-hidden="true"', "hidden", 'class="is-hidden-sm"',
        'style="display:none"', "", 'class="plain"'))), (F.col("p_size") % 10 + 1).cast("int"))
    html = template(
        """<html><head><title>{p_name}</title></head><body>
<nav><p>Nav {p_partkey}</p></nav><div id="main-content"><h1>{p_name}</h1>
<div><div {?style}><p>Maybe {p_size}</p></div></div>
<div class="share-box"><p>Share {p_brand}</p></div><div role="dialog"><p>Dialog {p_type}</p></div>
<div data-testid="byline"><p>By {p_brand}</p></div><div class="promo2"><p>Kept {p_type}</p></div>
<a tabindex="0" href="/t">Tab {p_partkey}</a><p>Shown {p_name}</p><p>Shown {p_name}</p>
<h2>Details</h2><span>Brand {p_brand}</span><p>Type {p_type}</p><h2>Details</h2>Loose {p_size}
<div class="highlight"><pre>code  {p_partkey}
 end</pre></div><menu><li>Item {p_size}</li></menu></div>
<footer><p>Foot {p_partkey}</p></footer></body></html>""", style=style)
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.when(F.expr("p_partkey % 3 = 0"), "https://www.healthline.com/p/").otherwise("https://parts.example.com/p/"),
                 F.col("p_partkey")).alias("url"), html.alias("html"))


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Div-role tables and a search-result page in one."""
    html = template(
        """<html><body><div role="table" class="dvmd_tm_table wide">
<div class="dvmd_tm_tblock dvmd_tm_cblock"><div class="dvmd_tm_tcell" scope="row"> Name </div><div class="dvmd_tm_tcell">old</div>
<div class="dvmd_tm_tcell">{s_name}</div><div class="dvmd_tm_tcell" scope="row">Nation</div><div class="dvmd_tm_tcell">{s_nationkey}</div></div>
<div class="dvmd_tm_tblock dvmd_tm_cblock"></div><div class="dvmd_tm_tblock">no</div></div>
<div class="main"><div class="GyAeWb"><div class="s6JM6d"><div class="eqAnXb"><div class="dURPMd"><div><div>
<div><div class="VwiC3b">About <b>{s_name}</b></div><div><div><h3>{s_name}</h3><a href="/s/{s_suppkey}">x</a></div><div><a href="/t/{s_suppkey}">y</a></div></div></div>
<div class="Wt5Tfe"><span class="CSkcDe">Why {s_suppkey}?</span></div>
<div class="uVMCKf"><a class="BVG0Nb" href="/v/{s_suppkey}">v</a></div>
<div class="Ww4FFb q"><div><div><h3>Forum {s_nationkey}</h3><a href="/f/{s_suppkey}">f</a></div></div></div>
</div></div></div></div></div></div></div></body></html>""")
    return _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("page_id"), template("https://sup{s_nationkey}.example.com/{s_suppkey}").alias("url"), html.alias("html"))


FAN_OUT = 8


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of sitemap files with one per part, eight below each, under the robots.txt of one site.

    Part p lists parts 8p+1 .. 8p+8, its own page, and part 0 again, which closes a cycle.
    """
    parts = _read(spark, sf_dir, "part")
    below = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(FAN_OUT)), lambda k: F.concat(
        F.lit("<sm:sitemap><sm:loc> https://maps.example.com/sitemap"),
        (F.col("p_partkey") * FAN_OUT + k).cast("string"), F.lit(".xml\n</sm:loc></sm:sitemap>"))), "")
    body = template(
        "<urlset>{?below}<url><loc>https://maps.example.com/part/{p_partkey}?a=1&amp;b=2</loc></url>"
        "<sitemap><loc>https://maps.example.com/sitemap0.xml</loc></sitemap><broken>", below=below)
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\n siteMAP: https://maps.example.com/sitemap"), F.col("p_partkey"), F.lit(".xml\n"))
    files = parts.select(template("https://maps.example.com/sitemap{p_partkey}.xml").alias("url"), body.alias("body"))
    top = parts.where("p_partkey = 0").select(F.lit("https://maps.example.com/robots.txt").alias("url"), robots.alias("body"))
    return files.unionByName(top)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response metadata of each page: (url, status, headers, cookies, history, size)."""
    id_ = F.col("page_id")
    pairs = F.struct(F.lit("session").alias("name"), id_.cast("string").alias("value"))
    second = F.struct(F.lit("lang").alias("name"), F.regexp_extract("url", r"/(..)/\d", 1).alias("value"))
    return _read(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(id_ % 7 == 0, 404).otherwise(200).cast("long").alias("status"),
        F.when(id_ % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("server"), F.concat(F.lit("srv"), (id_ % 4).cast("string")),
            F.lit("Link"), F.concat(F.lit("<"), F.col("url"), F.lit(">")))).alias("headers"),
        F.when(id_ % 2 == 0, F.array(pairs, second)).otherwise(F.array(pairs)).alias("cookies"),
        F.when(id_ % 5 == 0, F.array(F.lit("http://a.example/"), F.lit("http://b.example/"))).otherwise(
            F.array().cast("array<string>")).alias("history"),
        F.octet_length("html").cast("long").alias("size"))


MAPS = 50


def shared_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap files that many sites share: part p lists parts 8p+1 .. 8p+8; the robots.txt of each supplier lists two of the first fifty."""
    parts = _read(spark, sf_dir, "part")
    below = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(FAN_OUT)), lambda k: F.concat(
        F.lit("<sitemap><loc>https://maps.example.com/sitemap"), (F.col("p_partkey") * FAN_OUT + k).cast("string"), F.lit(".xml</loc></sitemap>"))), "")
    files = parts.select(template("https://maps.example.com/sitemap{p_partkey}.xml").alias("url"), template(
        "<urlset>{?below}<url><loc>https://maps.example.com/part/{p_partkey}</loc></url></urlset>", below=below).alias("body"))
    robots = _read(spark, sf_dir, "supplier").select(
        template("https://sup{s_suppkey}.example.com/robots.txt").alias("url"),
        F.concat_ws("\n", *(F.concat(F.lit("Sitemap: https://maps.example.com/sitemap"), at.cast("string"), F.lit(".xml"))
                            for at in (F.col("s_suppkey") % MAPS, F.col("s_suppkey") * 7 % MAPS))).alias("body"))
    return files.unionByName(robots)

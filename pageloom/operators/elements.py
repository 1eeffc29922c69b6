"""Titles, headings, links, media, metadata: expressions over `dom`, and the tables they explode to.

Column functions take `dom` (and `url` or `html`) and give one value per page; table
functions take shredded pages and give one row per item. Order is document order unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.functions.lambdas import first, let, match
from pageloom.functions.text import sanitize, strip
from pageloom.functions.urls import base_parts, domain_url, resolve_from, resolve_url
from pageloom.operators.shred import HEADINGS, VOID

# Fixed values.
IMAGE_TAGS = ("img", "div", "span", "a")
IMAGE_ATTRS = ("src", "data-src", "nitro-lazy-src", "style")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp")
DULL_ALT_WORDS = ("icon", "ico", "logo", "spinner", "location", "phone", "email")
NO_TITLE = "No Title Found"


# --- whole-page fragments
def fragment(dom: Column, html: Column, tag: str) -> Column:
    """First element of that tag as written in the source; NULL when absent."""
    return let(N.first_tag(dom, tag), lambda n: N.source(html, n))


def pretty_html(dom: Column) -> Column:
    """One line per tag and string, indented one space per level. Needs `text_nodes`.

    Closing tags are placed by listing, for every node, the elements that end with it.
    """
    def attributes(n: Column) -> Column:
        pairs = F.transform(F.map_entries(n["attrs"]), lambda e: F.concat(
            F.lit(" "), e["key"], F.lit('="'), _escape(e["value"], quotes=True), F.lit('"')))
        return F.array_join(pairs, "")

    def line(n: Column) -> Column:
        body = (
            F.when(n["kind"] == "element", F.concat(
                F.lit("<"), n["tag"], F.when(F.size(n["attrs"]) == 0, F.lit("")).otherwise(attributes(n)),
                F.when(n["tag"].isin(*_VOID), F.lit("/>")).otherwise(F.lit(">"))))
            .when(n["kind"] == "comment", F.concat(F.lit("<!--"), N.string(n), F.lit("-->")))
            .when(n["kind"] == "other", F.concat(F.lit("<!"), N.string(n), F.lit(">")))
            .otherwise(let(strip(N.string(n)), lambda s: F.when(
                s != "", F.when(n["kind"] == "raw", s).otherwise(_escape(s)))))
        )
        return F.concat(F.repeat(F.lit(" "), n["depth"]), body)

    def closing(n: Column) -> Column:
        return F.concat(F.repeat(F.lit(" "), n["depth"]), F.lit("</"), n["tag"], F.lit(">"))

    def ordered(els: Column) -> Column:
        # (position, rank) sorts each closing tag after the last node inside, innermost first.
        opens = F.transform(dom, lambda n: F.struct(
            n["id"].alias("at"), F.lit(0).alias("late"), line(n).alias("line")))
        closes = F.transform(els, lambda n: F.struct(
            n["end"].alias("at"), (F.lit(1_000_000_000) - n["id"]).alias("late"), closing(n).alias("line")))
        return F.transform(F.sort_array(F.concat(opens, closes)), lambda s: s["line"])

    els = F.filter(dom, lambda n: (n["kind"] == "element") & ~n["tag"].isin(*_VOID))
    return let(els, lambda e: F.array_join(F.filter(ordered(e), lambda s: s.isNotNull()), "\n"))


_VOID = tuple(sorted(VOID))


def _escape(c: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else [])
    for char, entity in pairs:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


# --- titles and headings
def title(dom: Column) -> Column:
    """First string directly in a title element, as it stands."""
    return first(F.filter(F.transform(N.tagged(dom, "title"), lambda n: N.lead(n)), lambda t: t.isNotNull()))


def h1(dom: Column) -> Column:
    """Text of the first h1."""
    return let(N.first_tag(dom, "h1"), N.text)


def title_or_heading(dom: Column) -> Column:
    """First h1, else the title element's string, else a fixed phrase."""
    t = N.first_tag(dom, "title")
    return F.when(N.first_tag(dom, "h1").isNotNull(), h1(dom)).when(
        t.isNotNull(), let(t, lambda n: F.when(F.size(N.parts(n)) == 1, N.parts(n)[0]))
    ).otherwise(F.lit(NO_TITLE))


def headings_by_tag(dom: Column, levels: int = 6) -> Column:
    """map<tag, array<text>> for h1..h`levels`; tags without headings keep an empty list."""
    entries = []
    for tag in HEADINGS[:levels]:
        entries += [F.lit(tag), F.transform(N.tagged(dom, tag), lambda n: strip(N.text(n)))]
    return F.create_map(*entries)


def heading_rows(shredded: DataFrame, levels: int = 6) -> DataFrame:
    """(page_id, tag, pos, text): pos counts from 0 within the tag."""
    rows = shredded.select("page_id", F.explode(headings_by_tag(F.col("dom"), levels)).alias("tag", "texts"))
    return rows.select("page_id", "tag", F.posexplode("texts").alias("pos", "text"))


def section_after(dom: Column, heading: str, tag: str = "h2") -> Column:
    """array<text> of the element siblings after the first `tag` whose string is `heading`.

    Needs `text_nodes` and the siblings' tags in `parts_of`.
    """
    hit = first(F.filter(dom, lambda n: N.is_tag(n, tag) & (N.only_string(dom, n) == heading)))
    return let(hit, lambda h: F.transform(
        F.filter(dom, lambda n: (n["parent"] == h["parent"]) & (n["id"] > h["id"]) & (n["kind"] == "element")),
        lambda n: N.stripped_text(n)))


# --- metadata
def meta_tags(dom: Column) -> Column:
    """array<struct<name, content>> of the metas directly in head; empty values are NULL, all-empty ones dropped."""
    metas = F.filter(dom, lambda n: N.is_tag(n, "meta") & N.is_tag(N.node_at(dom, n["parent"]), "head"))
    pairs = F.transform(metas, lambda n: F.struct(
        F.nullif(N.attr(n, "name"), F.lit("")).alias("name"),
        F.nullif(N.attr(n, "content"), F.lit("")).alias("content")))
    return F.filter(pairs, lambda p: p["name"].isNotNull() | p["content"].isNotNull())


def header_structure(dom: Column) -> Column:
    """JSON `{"title": .., "meta_tags": [..]}`, encoded once; absent names and contents are left out."""
    return header_json(title(dom), meta_tags(dom))


def header_json(title_: Column, metas: Column) -> Column:
    """`header_structure` of a title and meta tags that are known."""
    known = F.to_json(F.struct(title_.alias("title"), metas.alias("meta_tags")))
    return F.when(title_.isNull(), F.concat(F.lit('{"title":null,'), F.substring(known, 2, 2_000_000_000))).otherwise(known)


def json_ld(dom: Column) -> Column:
    """array<string>: the cleaned text of each JSON-LD script, valid or not. Needs `script` in `parts_of`."""
    scripts = F.filter(dom, lambda n: N.is_tag(n, "script") & (N.attr(n, "type") == "application/ld+json")
                       & (F.size(N.parts(n)) > 0))
    return F.transform(scripts, lambda n: F.regexp_replace(
        F.regexp_replace(N.text(n), r"(?s)</?[^ >/]+.*?>", ""), r"(?s)<!--.*?(?:-->|\z)", ""))


def json_ld_valid(dom: Column) -> Column:
    """array<string>: the JSON-LD documents that parse."""
    return F.filter(json_ld(dom), lambda s: F.try_parse_json(s).isNotNull())


def json_ld_rows(shredded: DataFrame) -> DataFrame:
    """(page_id, pos, source, document): `document` is a VARIANT, NULL where the text does not parse."""
    rows = shredded.select("page_id", F.posexplode(json_ld(F.col("dom"))).alias("pos", "source"))
    return rows.withColumn("document", F.try_parse_json("source"))


# --- links and media
_LINK = "array<struct<text:string,href:string,class_attr:string,id_attr:string>>"


def links(dom: Column, url: Column, base: Column | None = None) -> Column:
    """Anchors whose first direct string is not blank: text, resolved href, class, id (NULL if none). `base` are the URL's `base_parts`, where they are known."""
    named = F.filter(F.transform(N.tagged(dom, "a"), lambda n: F.struct(sanitize(N.lead(n)).alias("text"), n["attrs"].alias("attrs"))), lambda a: a["text"] != "")
    return let(base_parts(url) if base is None else base, lambda of: F.transform(named, lambda a: F.struct(
        a["text"].alias("text"),
        resolve_from(of, N.attr(a, "href")).alias("href"),
        N.attr_or_empty(a, "class").alias("class_attr"),
        F.nullif(N.attr(a, "id"), F.lit("")).alias("id_attr")))).cast(_LINK)


def link_rows(shredded: DataFrame) -> DataFrame:
    """(page_id, pos, text, href, class_attr, id_attr). Hrefs are resolved after the explode."""
    anchors = F.filter("dom", lambda n: N.is_tag(n, "a") & (sanitize(N.lead(n)) != ""))
    found = F.transform(anchors, lambda n: F.struct(
        sanitize(N.lead(n)).alias("text"), N.attr(n, "href").alias("href"), N.attr_or_empty(n, "class").alias("class_attr"),
        F.nullif(N.attr(n, "id"), F.lit("")).alias("id_attr")))
    rows = shredded.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "pos", "a.text", resolve_url(F.col("url"), F.col("a.href")).alias("href"), "a.class_attr", "a.id_attr")


def images(dom: Column, url: Column, base: Column | None = None) -> Column:
    """Every img: resolved src (the page itself when missing), alt, class, id. `base` are the URL's `base_parts`, where they are known."""
    return let(base_parts(url) if base is None else base, lambda of: F.transform(N.tagged(dom, "img"), lambda n: F.struct(
        resolve_from(of, N.attr(n, "src")).alias("src"),
        N.attr_or_empty(n, "alt").alias("alt"),
        N.attr_or_empty(n, "class").alias("class_attr"),
        F.nullif(N.attr(n, "id"), F.lit("")).alias("id_attr"))))


def image_rows(shredded: DataFrame) -> DataFrame:
    """(page_id, pos, src, alt, class_attr, id_attr)."""
    rows = shredded.select("page_id", "url", F.posexplode(N.tagged(F.col("dom"), "img")).alias("pos", "n"))
    n = F.col("n")
    return rows.select(
        "page_id", "pos", resolve_url(F.col("url"), N.attr(n, "src")).alias("src"),
        N.attr_or_empty(n, "alt").alias("alt"), N.attr_or_empty(n, "class").alias("class_attr"),
        F.nullif(N.attr(n, "id"), F.lit("")).alias("id_attr"))


def image_links(dom: Column, url: Column) -> Column:
    """Distinct resolved image URLs from src, lazy-loading and style attributes, by first appearance."""
    def candidate(value: Column) -> Column:
        # What stands in the last url(..), without its quotes.
        inner = F.regexp_replace(F.regexp_extract(value, r"(?s)^.*url\(([^)]*)", 1), "^[\"']+|[\"']+\\z", "")
        return F.when(value.contains("url("), inner).otherwise(value)

    tags = N.tagged(dom, *IMAGE_TAGS)
    raw = F.flatten(F.transform(tags, lambda n: F.array(*[candidate(N.attr(n, a)) for a in IMAGE_ATTRS])))
    pictures = F.filter(raw, lambda v: N.contains_any(v, IMAGE_EXTENSIONS))
    return F.array_distinct(let(base_parts(url), lambda base: F.transform(pictures, lambda v: resolve_from(base, v))))


def images_with_alt(dom: Column, url: Column, found: Column | None = None) -> Column:
    """array<struct<src, alt>>: for each image link, the imgs whose src equals it as written,
    else those whose data-src does, else those whose nitro-lazy-src does. `found` are the image links, where they are known."""
    def of(attribute: str):
        return lambda imgs: F.transform(imgs, lambda n: N.attr(n, attribute))

    def with_places(imgs: Column, e: Column) -> Column:
        def pick(attribute: str, *taken: str) -> Column:
            def keep(n: Column, i: Column) -> Column:
                ok = F.get(e[attribute], i).isNotNull()
                for earlier in taken:
                    ok = ok & F.get(e[earlier], i).isNull()
                return F.when(ok, F.struct(
                    F.get(e[attribute], i).alias("at"), n["id"].alias("id"), N.attr(n, attribute).alias("src"), N.attr_or_empty(n, "alt").alias("alt")))

            return F.filter(F.transform(imgs, keep), lambda f: f.isNotNull())

        found = F.concat(pick("src"), pick("data-src", "lazy_in_src"), pick("nitro-lazy-src", "nitro_in_src", "nitro_in_lazy"))
        return F.transform(F.sort_array(found), lambda f: F.struct(f["src"], f["alt"]))

    src, lazy, nitro = of("src"), of("data-src"), of("nitro-lazy-src")
    return let(image_links(dom, url) if found is None else found, lambda links_: let(N.tagged(dom, "img"), lambda imgs: let(F.struct(
        match(src(imgs), links_).alias("src"), match(lazy(imgs), links_).alias("data-src"), match(nitro(imgs), links_).alias("nitro-lazy-src"),
        match(lazy(imgs), src(imgs)).alias("lazy_in_src"), match(nitro(imgs), src(imgs)).alias("nitro_in_src"),
        match(nitro(imgs), lazy(imgs)).alias("nitro_in_lazy")), lambda e: with_places(imgs, e))))


def filtered_images(dom: Column, url: Column, found: Column | None = None) -> Column:
    """`images_with_alt` (`found`, where it is known) without those whose alt text names an icon, logo and the like."""
    return F.filter(images_with_alt(dom, url) if found is None else found, lambda i: ~N.contains_any(F.lower(i["alt"]), DULL_ALT_WORDS))


def hrefs(dom: Column) -> Column:
    return F.transform(
        F.filter(dom, lambda n: N.is_tag(n, "a") & N.attr(n, "href").isNotNull()), lambda n: N.attr(n, "href"))


def _internal(url: Column, href: Column) -> Column:
    return href.startswith("/") | href.contains(domain_url(url))


def internal_links(dom: Column, url: Column) -> Column:
    """Hrefs as written that start with a slash (`//other.host` too) or contain the page's domain."""
    return F.filter(hrefs(dom), lambda h: _internal(url, h))


def external_links(dom: Column, url: Column) -> Column:
    """The other hrefs."""
    return F.filter(hrefs(dom), lambda h: ~_internal(url, h))


def video_links(dom: Column) -> Column:
    """src of every video, then of every iframe."""
    def sources(tag: str) -> Column:
        return F.filter(F.transform(N.tagged(dom, tag), lambda n: N.attr(n, "src")), lambda s: s.isNotNull())

    return F.concat(sources("video"), sources("iframe"))


def explode_strings(shredded: DataFrame, values: Column, name: str) -> DataFrame:
    """(page_id, pos, name) from an array of strings per page."""
    return shredded.select("page_id", F.posexplode(values).alias("pos", name))

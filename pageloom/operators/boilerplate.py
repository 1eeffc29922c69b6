"""Which elements to leave out of the sections: built-in lists plus per-site rules held as data.

A node test from `drop_rule` goes to `sections(dom, dropped=...)`; `dropped_rows` tells which
rule hit. Everything is off unless switched on in `Filters`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import nodes as N
from pageloom.operators.groups import look_up_small

# Fixed values.
KEPT_TAGS = ("html", "body", "title")
DROPPED_ROLES = ("menuitem", "dialog", "menu", "button", "figure", "icon", "picture", "navigation", "toolbar", "menubar")
DROPPED_TAGS = ("script", "style", "svg", "head", "nav", "footer", "select", "button", "figure", "fieldset", "form",
                "section", "mbox-text-span", "sidebar-section")
DROPPED_CLASSES = ("share", "social", "advert", "promo", "overlay", "widget", "footer", "header", "menu", "modal",
                   "popup", "figure", "icon", "mbox-text-span")
DROPPED_PARTIAL_CLASSES = ("share", "social", "advert", "promo", "overlay", "widget", "footer", "header", "menu", "modal",
                           "popup", "figure", "icon", "announcement", "drawer", "size-chart", "size-guide", "cookie",
                           "privacy", "terms", "disclaimer", "copyright", "legal", "product-recommendations",
                           "sidebar-section", "recommendations", "icons")
# Elements to drop on one site: (website, tag, attribute, value).
SITE_ELEMENTS = (("healthline.com", "div", "data-testid", "byline"), ("healthline.com", "div", "id", "read-next"))

_STRINGS = T.ArrayType(T.StringType())
SITE_FILTERS = T.StructType(
    [T.StructField("site_name", T.StringType())]
    + [T.StructField(n, _STRINGS) for n in (
        "class", "partial_class", "id", "div", "name", "a_element", "text", "role", "include")]
    + [T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("tag", T.StringType()), T.StructField("attr", T.StringType()),
        T.StructField("value", T.StringType())])))])


@dataclass(frozen=True)
class Filters:
    content: bool = False  # the whole filter
    by_class: bool = False
    by_link: bool = False
    by_div: bool = False


def read_site_filters(spark, path: str) -> DataFrame:
    """Per-site rules from JSON: a list of objects keyed by `site_name`, one per site."""
    return spark.read.schema(SITE_FILTERS).option("multiLine", True).json(path)


def with_site_filters(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the struct `site` (NULL without rules) by `website`; of repeated sites one row is kept.

    Give it pages before they are shredded: few rules are broadcast, and where there are too many,
    pages move, hot sites in parts.
    """
    names = [f.name for f in SITE_FILTERS if f.name != "site_name"]
    site = rules.groupBy("site_name").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("site"))
    site = site.withColumnRenamed("site_name", "_site").filter("_site is not null")
    keyed = pages.withColumn("_site", F.coalesce("website", F.lit("")))
    return look_up_small(keyed, ["_site"], site, ["url"] if "url" in pages.columns else ["_site"]).select(*pages.columns, "site")


def _listed(site: Column, field: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(site[field], value), F.lit(False))


def _class_hit(n: Column, site: Column) -> Column:
    """An exact class name, or one that starts or ends with a listed word set off by - or _."""
    words = "|".join(DROPPED_PARTIAL_CLASSES)
    exact = "|".join(DROPPED_CLASSES)
    value = N.attr_or_empty(n, "class")
    built_in = value.rlike(rf"(?:^|\s)(?:{exact})(?=\s|\z)|(?:^|\s)(?:{words})(?=[-_\s]|\z)|[-_](?:{words})(?=\s|\z)")
    own = F.exists(N.classes(n), lambda c: _listed(site, "class", c) | F.coalesce(F.exists(
        site["partial_class"], lambda w: (w != "") & (
            (c == w) | c.startswith(F.concat(w, F.lit("-"))) | c.startswith(F.concat(w, F.lit("_")))
            | c.endswith(F.concat(F.lit("-"), w)) | c.endswith(F.concat(F.lit("_"), w)))), F.lit(False)))
    return (value != "") & (built_in | own)


def drop_rule(dom: Column, n: Column, site: Column, website: Column, filters: Filters) -> Column:
    """Name of the first rule that drops the element, NULL if none does."""
    if not filters.content:
        return F.lit(None).cast("string")
    parent_tag = F.get(dom, n["parent"])["tag"]
    off = F.lit(False)
    by_class = _class_hit(n, site) if filters.by_class else off
    is_link = N.is_tag(n, "a")
    by_link = is_link & (N.attr(n, "tabindex").isNotNull() | by_class | N.attr_or_empty(n, "id").contains("icon"))
    fixed = off
    for name, tag, attribute, value in SITE_ELEMENTS:
        fixed = fixed | ((website == name) & N.is_tag(n, tag) & F.coalesce(N.attr(n, attribute) == value, off))
    own = F.coalesce(F.exists(site["elements"], lambda e: (e["tag"] == n["tag"]) & (
        N.attr(n, e["attr"]) == e["value"])), off)
    return (
        F.when((n["kind"] != "element") | n["tag"].isin(*KEPT_TAGS) | _listed(site, "include", n["tag"]), F.lit(None))
        .when(F.coalesce(parent_tag.isin(*DROPPED_TAGS), off) | _listed(site, "name", parent_tag), "parent_name")
        .when(n["tag"].isin(*DROPPED_TAGS) | _listed(site, "name", n["tag"]), "name")
        .when(F.coalesce(N.attr(n, "role").isin(*DROPPED_ROLES), off) | _listed(site, "role", N.attr(n, "role")), "role")
        .when(N.attr(n, "tabindex").isNotNull(), "tabindex")
        .when(by_class, "class")
        .when(by_link if filters.by_link else off, "a")
        .when(N.is_tag(n, "div") & by_class if filters.by_div else off, "div")
        .when(F.coalesce(fixed, off) | own, "site")
    )


def dropped_test(dom: Column, site: Column, website: Column, filters: Filters) -> N.NodeTest | None:
    """The node test to give to `sections` and `hidden`; None while the filter is off."""
    if not filters.content:
        return None
    return lambda n: drop_rule(dom, n, site, website, filters).isNotNull()


def dropped_rows(shredded: DataFrame, filters: Filters) -> DataFrame:
    """(page_id, id, tag, rule) for every element a rule drops. Needs `website` and `site`."""
    dom = F.col("dom")
    hits = F.filter(F.transform(dom, lambda n: F.struct(
        n["id"].alias("id"), n["tag"].alias("tag"),
        drop_rule(dom, n, F.col("site"), F.col("website"), filters).alias("rule"))), lambda h: h["rule"].isNotNull())
    return shredded.select("page_id", F.explode(hits).alias("h")).select("page_id", "h.*")

"""Extractors for two particular layouts: div-role tables and search-result pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.functions.lambdas import count_before, first, last, let

# Class names of the div-role tables.
TABLE_CLASS = "dvmd_tm_table"
COLUMN_CLASS = "dvmd_tm_tblock dvmd_tm_cblock"
CELL_CLASS = "dvmd_tm_tcell"
DIV_TABLE_PARTS = (CELL_CLASS,)

# Class names of a search-result page. They change often; pass your own.
SERP_CLASSES = {
    "main": "main", "path": "GyAeWb s6JM6d eqAnXb dURPMd", "description": "VwiC3b", "questions": "Wt5Tfe",
    "question": "CSkcDe", "videos": "uVMCKf", "video": "BVG0Nb", "forums": "Ww4FFb",
}


def div_tables(dom: Column) -> Column:
    """array<array<array<struct<key, value>>>>: tables, their columns, the pairs of each column.

    A cell with scope=row names the row, another cell is its value; a value under a name seen
    before replaces the earlier one. Columns without values are left out. Needs
    `parts_of_class=DIV_TABLE_PARTS`.
    """
    def column(c: Column) -> Column:
        return let(N.under(dom, c, lambda n: N.is_tag(n, "div") & N.has_class(n, CELL_CLASS)), pairs)

    def pairs(cells: Column) -> Column:
        names = F.filter(cells, lambda n: F.coalesce(N.attr(n, "scope") == "row", F.lit(False)))
        values = F.filter(cells, lambda n: ~F.coalesce(N.attr(n, "scope") == "row", F.lit(False)))
        return let(names, lambda ns: let(F.transform(values, lambda v: F.struct(
            let(last(F.filter(ns, lambda k: k["id"] < v["id"])), lambda k: N.stripped_text(k)).alias("key"),
            N.stripped_text(v).alias("value"))), latest))

    def latest(ps: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(ps, lambda p: p["key"])), lambda k: F.struct(
            k.alias("key"), last(F.filter(ps, lambda p: p["key"].eqNullSafe(k)))["value"].alias("value")))

    tables = F.filter(dom, lambda n: N.is_tag(n, "div") & (N.attr(n, "role") == "table") & N.has_class(n, TABLE_CLASS))
    return F.transform(tables, lambda t: F.filter(F.transform(
        N.under(dom, t, lambda n: N.is_tag(n, "div") & (F.array_join(N.classes(n), " ") == COLUMN_CLASS)), column),
        lambda c: F.size(c) > 0))


def div_table_rows(shredded: DataFrame) -> DataFrame:
    """Long form: (page_id, table_pos, column_pos, pair_pos, key, value)."""
    tables = shredded.select("page_id", F.posexplode(div_tables(F.col("dom"))).alias("table_pos", "t"))
    columns = tables.select("page_id", "table_pos", F.posexplode("t").alias("column_pos", "c"))
    return columns.select("page_id", "table_pos", "column_pos", F.posexplode("c").alias("pair_pos", "p")).select(
        "page_id", "table_pos", "column_pos", "pair_pos", "p.key", "p.value")


def serp_parts(names: Mapping[str, str] = SERP_CLASSES) -> dict:
    """`parts_of` and `parts_of_class` to shred search-result pages with."""
    return {"parts_of": ("h3",), "parts_of_class": (names["description"], names["question"])}


def search_results(dom: Column, names: Mapping[str, str] = SERP_CLASSES) -> Column:
    """array<struct<type, title, description, url>>: one per linked element of each result block.

    A block is a div two levels below a result. With a described block, or of a known kind
    (related questions, videos, forums), rows carry that; a title stays in force for later
    elements of the block.
    """
    string = "string"

    def with_results(env: Column) -> Column:
        def is_block(n: Column) -> Column:
            up = F.get(dom, n["parent"])
            top = F.get(dom, up["parent"])
            return (
                N.is_tag(n, "div") & N.is_tag(up, "div") & N.is_tag(top, "div")
                & F.coalesce(F.array_contains(env["results"], top["parent"]), F.lit(False)))

        return F.flatten(F.transform(F.filter(dom, is_block), block))

    def children(n: Column, tag: str = "div") -> Column:
        return N.under(dom, n, lambda x: N.is_tag(x, tag) & (x["parent"] == n["id"]))

    def row(kind: Column, title_: Column, description: Column, url: Column) -> Column:
        return F.struct(kind.cast(string).alias("type"), title_.cast(string).alias("title"),
                        description.cast(string).alias("description"), url.cast(string).alias("url"))

    def block(b: Column) -> Column:
        described = first(N.under(dom, b, lambda n: N.is_tag(n, "div") & N.has_class(n, names["description"])))
        kind = (
            F.when(described.isNotNull(), F.lit(None))
            .when(F.array_join(N.classes(b), " ") == names["questions"], "People also ask")
            .when(F.array_join(N.classes(b), " ") == names["videos"], "YouTube Videos")
            .when(N.classes(b)[0].startswith(names["forums"]), "Discussions and forums")).cast(string)
        return let(F.struct(let(described, lambda d: N.stripped_text(d, " ")).alias("description"), kind.alias("kind")),
                   lambda head: rows(b, head))

    def rows(b: Column, head: Column) -> Column:
        none = F.lit(None)
        asked = F.when(head["kind"] == "People also ask", F.transform(
            N.under(dom, b, lambda n: N.is_tag(n, "span") & N.has_class(n, names["question"])),
            lambda q: N.stripped_text(q)))
        shown = F.when(head["kind"] == "YouTube Videos", F.transform(
            N.under(dom, b, lambda n: N.is_tag(n, "a") & N.has_class(n, names["video"]) & N.attr(n, "href").isNotNull()),
            lambda v: N.attr(v, "href")))
        # A type is only set once something of that kind was found.
        def with_lists(env: Column) -> Column:
            carried = F.when(
                (head["kind"] == "Discussions and forums") | (F.size(env["asked"]) > 0) | (F.size(env["shown"]) > 0), head["kind"])
            elements = F.flatten(F.transform(children(b), lambda c: children(c)))
            facts = F.transform(elements, lambda e: F.struct(
                let(first(N.under(dom, e, lambda n: N.is_tag(n, "h3"))), lambda h: N.stripped_text(h)).alias("title"),
                first(N.under(dom, e, lambda n: N.is_tag(n, "a") & N.attr(n, "href").isNotNull()))["attrs"]["href"].alias("url")))
            return F.concat(
                F.transform(F.coalesce(env["asked"], F.array().cast("array<string>")), lambda q: row(head["kind"], q, none, none)),
                F.transform(F.coalesce(env["shown"], F.array().cast("array<string>")), lambda u: row(head["kind"], none, none, u)),
                let(facts, lambda fs: F.filter(F.transform(fs, lambda f, i: row(
                    carried,
                    F.coalesce(last(F.filter(F.transform(F.slice(fs, F.lit(1), i + 1), lambda g: g["title"]),
                                             lambda t: t.isNotNull())), last(env["asked"])),
                    head["description"], f["url"])), lambda r: r["url"].isNotNull())))

        return let(F.struct(asked.alias("asked"), shown.alias("shown")), with_lists)

    def below(steps: list[str]) -> Column:
        """Ids of elements with the last class, each earlier class on an ancestor in turn.

        The steps are one fold over the elements of each class: nested in each other they take the analyzer more rounds than it makes.
        """
        def holding(name: str) -> Column:
            return F.transform(F.filter(dom, lambda n: (n["kind"] == "element") & N.has_class(n, name)), lambda n: F.struct(
                n["id"].cast("long").alias("id"), n["end"].cast("long").alias("end")))

        def inside(outer: Column, items: Column) -> Column:
            # An element is in one of the outer ones if more of them began before it than ended.
            ids = F.transform(items, lambda c: c["id"] * 2)
            return let(F.struct(
                count_before(F.transform(outer, lambda o: o["id"] * 2 + 1), ids).alias("began"),
                count_before(F.transform(outer, lambda o: o["end"] * 2 + 1), ids).alias("ended")),
                lambda m: F.filter(items, lambda c, j: F.get(m["began"], j) > F.get(m["ended"], j)))

        def chained(held: Column) -> Column:
            return F.transform(F.aggregate(F.slice(held, 2, len(steps)), first(held), inside), lambda c: c["id"])

        return let(F.array(*map(holding, steps)), chained)

    main = first(F.filter(dom, lambda n: N.is_tag(n, "div") & N.has_class(n, names["main"])))

    def inside_main(m: Column) -> Column:
        ids = F.filter(below(names["path"].split()), lambda i: (i > m["id"]) & (i <= m["end"]))
        return let(F.struct(ids.alias("results")), with_results)

    return F.coalesce(let(main, inside_main), F.array().cast(
        "array<struct<type:string,title:string,description:string,url:string>>"))


def search_result_rows(shredded: DataFrame, names: Mapping[str, str] = SERP_CLASSES) -> DataFrame:
    """(page_id, pos, type, title, description, url)."""
    found = shredded.select("page_id", F.posexplode(search_results(F.col("dom"), names)).alias("pos", "r"))
    return found.select("page_id", "pos", "r.*")

"""Text grouped by heading, lists, HTML tables: expressions over `dom`.

Shred with `text_nodes=True`, `parts_of=SECTION_PARTS` and `decode_twice=True`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import nodes as N
from pageloom.functions.lambdas import count_before, first, last_of_each, let, span
from pageloom.functions.text import ascii_text, collapse, strip
from pageloom.operators.elements import NO_TITLE, title
from pageloom.operators.shred import HEADINGS

SECTION_PARTS = ("title", "p", "a", "span", "pre", "li", "td", *HEADINGS)
NO_HEADING = "unassociated"
# Elements taken as one block; what is inside them is not visited again.
_BLOCKS = ("p", "a", "span", "pre", "ul", "ol", "li", "table")
_CODE_CLASSES = ("highlight", "code")


def _is_heading(n: Column) -> Column:
    return F.coalesce(n["tag"].startswith("h") & n["tag"].rlike("^h[0-9]+$"), F.lit(False))


def clean(n: Column) -> Column:
    return ascii_text(N.text(n))


def _paragraph(dom: Column, i: Column) -> Column:
    return F.coalesce(let(F.get(dom, i), clean), F.lit(""))


def _place(n: Column) -> Column:
    return F.struct(n["parent"].alias("parent"), n["id"].alias("id"))


def _paragraphs_around(dom: Column, ps: Column, lists: Column) -> Column:
    """For `N.of_node`: struct<before, after> with the ids of the nearest sibling p on either side of each list."""
    def body(env: Column) -> Column:
        def around(at: Column, n: Column) -> Column:
            before, after = F.get(env["ps"], n - 1), F.get(env["ps"], n)
            return F.struct(
                F.when(before["parent"] == at["parent"], before["id"]).alias("before"),
                F.when(after["parent"] == at["parent"], after["id"]).alias("after"))

        counts = count_before(env["ps"], env["lists"])
        return N.by_node(dom, F.transform(env["lists"], lambda at: at["id"]), let(counts, lambda ns: F.transform(
            env["lists"], lambda at, j: around(at, F.get(ns, j)))))

    return let(F.struct(F.sort_array(F.transform(ps, lambda n: _place(n))).alias("ps"),
                        F.sort_array(F.transform(lists, lambda n: _place(n))).alias("lists")), body)


def list_items(dom: Column, n: Column) -> Column:
    """Cleaned text of every li below, nested lists' included."""
    return F.transform(N.under(dom, n, lambda x: N.is_tag(x, "li")), clean)


def numbered(items: Column) -> Column:
    return F.transform(items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item))


def _lists(dom: Column, shown: Column, tag: str) -> Column:
    def body(around: Column) -> Column:
        def one(n: Column) -> Column:
            items = list_items(dom, n)
            return F.struct(
                n["id"].alias("id"), _paragraph(dom, N.of_node(around, n)["before"]).alias("pre"),
                (numbered(items) if tag == "ol" else items).alias("items"),
                _paragraph(dom, N.of_node(around, n)["after"]).alias("post"))

        return F.transform(F.filter(N.tagged(dom, tag), lambda n: _list_counts(dom, n, tag) & shown_at(shown, n)), one)

    return let(_paragraphs_around(dom, N.tagged(dom, "p"), N.tagged(dom, tag)), body)


def _list_counts(dom: Column, n: Column, tag: str) -> Column:
    if tag == "ol":
        return F.lit(True)
    return F.size(N.under(dom, n, lambda x: N.is_tag(x, "li") & (x["parent"] == n["id"]))) > 1


def shown_at(hidden_flags: Column, n: Column) -> Column:
    return ~N.flag(hidden_flags, n["id"])


def unordered_lists(dom: Column) -> Column:
    """array<struct<id, pre, items, post>>: visible ul with more than one direct li."""
    return let(N.hidden(dom), lambda hid: _lists(dom, hid, "ul"))


def ordered_lists(dom: Column) -> Column:
    """array<struct<id, pre, items, post>>: visible ol, items numbered from 1."""
    return let(N.hidden(dom), lambda hid: _lists(dom, hid, "ol"))


def _table(dom: Column, before: Column, n: Column) -> Column:
    """struct<pre, columns, rows>: columns are the first tr's td texts; a later row pairs its td
    texts with them, the longer side cut; a table without a tr has neither. `before` are the paragraphs beside and ahead of it."""
    def cells(tr: Column, separator: str) -> Column:
        return F.transform(N.under(dom, tr, lambda x: N.is_tag(x, "td")), lambda td: N.stripped_text(td, separator))

    def body(trs: Column) -> Column:
        columns = F.when(F.size(trs) > 0, cells(trs[0], "")).otherwise(F.array().cast("array<string>"))
        rest = F.when(F.size(trs) > 1, F.slice(trs, 2, F.greatest(F.size(trs) - 1, F.lit(1)))).otherwise(F.filter(trs, lambda _: F.lit(False)))
        return let(columns, lambda cols: F.struct(
            pre.alias("pre"), cols.alias("columns"),
            F.transform(rest, lambda tr: let(cells(tr, "\n"), lambda c: F.slice(
                c, F.lit(1), F.least(F.size(c), F.size(cols))))).alias("rows")))

    pre = F.array_join(F.transform(before, lambda p: N.stripped_text(p)), " ")
    return let(N.under(dom, n, lambda x: N.is_tag(x, "tr")), body)


def _paragraphs_before(dom: Column, ps: Column, tables: Column) -> Column:
    """For `N.of_node`: the sibling paragraphs ahead of each table, in order."""
    def body(env: Column) -> Column:
        # Among all paragraphs by parent and place, those ahead of a table end where it would stand and begin with its parent's first.
        upto = count_before(env["ps"], env["tables"])
        first_ = count_before(env["ps"], F.transform(env["tables"], lambda t: F.struct(t["parent"].alias("parent"), F.lit(-1).alias("id"), t["at"].alias("at"))))
        ahead = let(F.struct(first_.alias("lo"), upto.alias("hi")), lambda c: F.transform(env["tables"], lambda t, j: F.transform(
            F.slice(env["ps"], F.get(c["lo"], j) + 1, F.get(c["hi"], j) - F.get(c["lo"], j)), lambda p: F.get(env["nodes"], p["at"]))))
        return N.by_node(dom, F.transform(env["tables"], lambda t: t["id"]), ahead)

    def placed(nodes: Column) -> Column:
        return F.sort_array(F.transform(nodes, lambda n, i: F.struct(n["parent"].alias("parent"), n["id"].alias("id"), i.alias("at"))))

    return let(F.struct(ps.alias("nodes"), placed(ps).alias("ps"), placed(tables).alias("tables")), body)


def row_map(columns: Column, values: Column) -> Column:
    """map<column, value>; of repeated columns the last wins."""
    return last_of_each(F.slice(columns, F.lit(1), F.size(values)), values)


def html_tables(dom: Column) -> Column:
    """array<struct<id, pre, columns, rows>> of the visible tables not inside another block."""
    def with_env(body_node: Column, env: Column) -> Column:
        here = F.filter(N.tagged(dom, "table"), lambda n: _visited(n, body_node, env["taken"], env["hid"]))
        return let(here, lambda tables: let(_paragraphs_before(dom, env["ps"], tables), lambda before: F.transform(
            tables, lambda n: let(_table(dom, N.of_node(before, n), n), lambda t: F.struct(n["id"].alias("id"), t["pre"], t["columns"], t["rows"])))))

    return let(N.first_tag(dom, "body"), lambda body_node: let(F.struct(
        _taken(dom, body_node).alias("taken"), N.hidden(dom).alias("hid"), N.tagged(dom, "p").alias("ps")), lambda env: with_env(body_node, env)))


def _taken(dom: Column, body_node: Column) -> Column:
    """array<boolean> by node id: the node is a block or heading of the body, or in one."""
    return N.spread(dom, lambda n: N.inside(n, body_node) & (N.is_tag(n, *_BLOCKS) | _is_heading(n)))


def _visited(n: Column, body_node: Column, taken: Column, hid: Column) -> Column:
    here = F.when(n["kind"] == "text", n["parent"]).otherwise(n["id"])
    return (
        N.inside(n, body_node)
        & ((n["kind"] == "text") | N.is_tag(n, *_BLOCKS) | _is_heading(n))
        & ~N.flag(taken, n["parent"]) & ~N.flag(hid, here))


def table_rows(shredded: DataFrame) -> DataFrame:
    """Long form: (page_id, table_pos, row_idx, col_idx, col, value)."""
    tables = shredded.select("page_id", F.posexplode(html_tables(F.col("dom"))).alias("table_pos", "t"))
    rows = tables.select("page_id", "table_pos", F.col("t.columns").alias("cols"), F.posexplode("t.rows").alias("row_idx", "row"))
    cells = rows.select("page_id", "table_pos", "row_idx", "cols", F.posexplode("row").alias("col_idx", "value"))
    return cells.select("page_id", "table_pos", "row_idx", "col_idx", F.get("cols", F.col("col_idx")).alias("col"), "value")


def sections(dom: Column, dropped: N.NodeTest | None = None) -> Column:
    """array<struct<id, header, raw_header, kind, text, items, pre, post, table>> in document order.

    A pre-order walk of the body gives blocks: stray strings, p, a and span (kind `text`), ul
    with more than one li (`list`), ol (`ordered_list`), other li (`list_items`), code in pre
    (`code`), table (`table`). Hidden blocks and blank text are left out; the inside of a block
    is not visited. Each block goes under the latest visible heading before it, keyed
    `H2: cleaned text`, or `unassociated`.
    """
    none = F.lit(None)
    strings = "array<string>"
    table_type = "struct<pre:string,columns:array<string>,rows:array<array<string>>>"

    def with_body(body_node: Column) -> Column:
        return let(F.struct(_taken(dom, body_node).alias("taken"), N.hidden(dom, dropped).alias("hid"),
                            _paragraphs_before(dom, N.tagged(dom, "p"), N.tagged(dom, "table")).alias("before"), F.when(N.first_tag(dom, "pre").isNotNull(), N.nearest(dom, lambda n: N.is_tag(n, "div"))).alias("div"),
                            _paragraphs_around(dom, N.tagged(dom, "p"), N.tagged(dom, "ul", "ol")).alias("around")),
                   lambda env: with_env(body_node, env))

    def with_env(body_node: Column, env: Column) -> Column:
        def with_nodes(found: Column) -> Column:
            heads = F.filter(F.transform(F.filter(found, _is_heading), lambda n: F.struct(
                n["id"].alias("id"), n["tag"].alias("tag"), clean(n).alias("clean"), strip(N.text(n)).alias("raw"))),
                lambda h: h["clean"] != "")
            blocks = F.filter(F.transform(F.filter(found, lambda n: ~_is_heading(n)), block), lambda b: b["kind"].isNotNull())
            return let(F.struct(heads.alias("heads"), blocks.alias("blocks")), headed)

        def headed(e: Column) -> Column:
            # The heading in force is the last of those before the block.
            counts = count_before(F.transform(e["heads"], lambda h: h["id"]), F.transform(e["blocks"], lambda b: b["id"]))
            return let(counts, lambda ns: F.transform(e["blocks"], lambda b, j: let(
                F.get(e["heads"], F.get(ns, j) - 1), lambda h: F.struct(
                    b["id"].alias("id"),
                    F.coalesce(F.concat(F.upper(h["tag"]), F.lit(": "), h["clean"]), F.lit(NO_HEADING)).alias("header"),
                    h["raw"].alias("raw_header"),
                    b["kind"].alias("kind"), b["text"].alias("text"), b["items"].alias("items"),
                    b["pre"].alias("pre"), b["post"].alias("post"), b["table"].alias("table")))))

        def block(n: Column) -> Column:
            tag = n["tag"]
            around = N.of_node(env["around"], n)
            holder = F.get(dom, F.get(env["div"], n["id"]))
            coded = N.attr(n, "lang").isNotNull() | F.coalesce(
                let(holder, lambda d: F.arrays_overlap(N.classes(d), F.array(*map(F.lit, _CODE_CLASSES)))), F.lit(False))
            plain = F.when(n["kind"] == "text", ascii_text(N.string(n))).when(tag.isin("p", "a", "span", "li"), clean(n))
            return let(plain, lambda t: F.struct(
                n["id"].alias("id"),
                F.when((n["kind"] == "text") | tag.isin("p", "a", "span"), F.when(t != "", F.lit("text")))
                .when(tag == "li", F.when(t != "", F.lit("list_items")))
                .when(tag == "ul", F.when(_list_counts(dom, n, "ul"), F.lit("list")))
                .when(tag == "ol", F.lit("ordered_list"))
                .when(tag == "pre", F.when(coded, F.lit("code")))
                .otherwise(F.lit("table")).alias("kind"),
                F.when(tag == "pre", collapse(N.text(n))).when(F.coalesce(tag, F.lit("")) != "li", t).alias("text"),
                F.when(tag == "ul", list_items(dom, n)).when(tag == "ol", numbered(list_items(dom, n)))
                .when(tag == "li", F.array(t)).otherwise(none.cast(strings)).alias("items"),
                F.when(tag.isin("ul", "ol"), _paragraph(dom, around["before"])).alias("pre"),
                F.when(tag.isin("ul", "ol"), _paragraph(dom, around["after"])).alias("post"),
                F.when(tag == "table", _table(dom, N.of_node(env["before"], n), n).cast(table_type)).alias("table")))

        return let(F.filter(dom, lambda n: _visited(n, body_node, env["taken"], env["hid"])), with_nodes)

    return let(N.first_tag(dom, "body"), with_body)


def section_rows(shredded: DataFrame, dropped: N.NodeTest | None = None) -> DataFrame:
    """(page_id, pos, header, raw_header, kind, text, items, pre, post, table)."""
    found = shredded.select("page_id", F.posexplode(sections(F.col("dom"), dropped)).alias("pos", "b"))
    return found.select("page_id", "pos", *[f"b.{c}" for c in (
        "header", "raw_header", "kind", "text", "items", "pre", "post", "table")])


def section_keys(dom: Column, dropped: N.NodeTest | None = None) -> Column:
    """array<string>: the distinct heading keys of a page, h1s first, empty sections included.

    Headings that `dropped` drops, or that stand in an element it drops, are left out.
    """
    def named(out: Column | None) -> Column:
        def kept(tag: str) -> Column:
            nodes = N.tagged(dom, tag)
            return nodes if out is None else F.filter(nodes, lambda n: ~N.flag(out, n["id"]))

        return F.array_distinct(F.concat(*(
            F.transform(kept(t), lambda n: F.concat(F.lit(f"{t.upper()}: "), clean(n))) for t in HEADINGS)))

    if dropped is None:
        return named(None)
    return let(N.spread(dom, lambda n: (n["kind"] == "element") & dropped(n)), named)


# --- text until the next heading of the same or a higher rank
def content_by_headers(dom: Column) -> Column:
    """array<struct<level, header, content>> for every h1..h6, in document order.

    The content is the text of the siblings that follow, up to a heading of the same or a
    higher rank: one line per sibling with text, links marked. Needs `text_nodes` and the
    headings' parts.
    """
    def level(n: Column) -> Column:
        return F.substring(n["tag"], 2, 1).cast("int")

    def stops(heads: Column) -> Column:
        """For each heading, in order, the next sibling heading of its rank or above (NULL if none).

        Among the headings of a rank or above, sorted by parent and position, that is the next
        one, if it has the same parent.
        """
        def of_rank(rank: int) -> Column:
            ranked = F.sort_array(F.transform(F.filter(heads, lambda h: level(h) <= rank), lambda h: F.struct(
                h["parent"].alias("parent"), h["id"].alias("id"), level(h).alias("level"))))
            return F.filter(let(ranked, lambda hs: F.transform(hs, lambda h, i: F.struct(
                h["id"].alias("id"), h["level"].alias("level"),
                F.when(F.get(hs, i + 1)["parent"] == h["parent"], F.get(hs, i + 1)["id"]).alias("stop")))),
                lambda h: h["level"] == rank)

        return F.sort_array(F.concat(*[of_rank(rank) for rank in range(1, 7)]))

    def with_heads(heads: Column) -> Column:
        def one(h: Column, next_id: Column) -> Column:
            parent_end = F.coalesce(F.get(dom, h["parent"])["end"], F.size(dom) - 1)
            stop = F.coalesce(next_id - 1, parent_end)
            siblings = F.filter(F.transform(span(h["end"] + 1, stop), lambda i: F.get(dom, i)),
                                lambda n: n["parent"] == h["parent"])
            lines = F.filter(F.transform(siblings, line), lambda x: x != "")
            return F.struct(level(h).alias("level"), strip(N.text(h)).alias("header"),
                            F.array_join(lines, "\n").alias("content"))

        def line(m: Column) -> Column:
            strings = F.filter(F.transform(span(m["id"], m["end"]), lambda i: F.get(dom, i)), lambda t: t["kind"] == "text")
            words = F.filter(F.transform(strings, lambda t: strip(N.string(t))), lambda t: t != "")
            joined = F.array_join(words, " ")
            return F.when(N.is_tag(m, "a"), F.concat(F.lit("Link: "), joined)).otherwise(joined)

        return let(stops(heads), lambda ends: F.transform(heads, lambda h, i: one(h, F.get(ends, i)["stop"])))

    return let(N.tagged(dom, *HEADINGS), with_heads)


def content_map(contents: Column) -> Column:
    """map<header, content>; of repeated headers the last wins."""
    return let(contents, lambda found: last_of_each(
        F.transform(found, lambda c: c["header"]), F.transform(found, lambda c: c["content"])))


def content_text(contents: Column) -> Column:
    """Plain text: a `Header n: ..` line and its content for each heading."""
    return F.array_join(F.transform(contents, lambda c: F.concat(
        F.lit("\n\nHeader "), c["level"].cast("string"), F.lit(": "), c["header"], F.lit("\n"), c["content"], F.lit("\n"))), "")


# --- whole-page text
def clean_scrape(dom: Column) -> Column:
    """struct<clean_data, char_count, title>: distinct texts of h1..h6, p and li under
    `#main-content` (else the page) outside nav, footer, header and aside; by tag, then position."""
    def with_env(env: Column) -> Column:
        def usable(n: Column) -> Column:
            within = env["main"].isNull() | N.inside(n, env["main"])
            return within & ~N.flag(env["framed"], n["parent"])

        found = F.concat(*[
            F.transform(F.filter(N.tagged(dom, t), usable), lambda n: N.stripped_text(n)) for t in (*HEADINGS, "p", "li")])
        return let(F.array_distinct(F.filter(found, lambda t: t != "")), lambda texts: F.struct(
            F.array_join(texts, "\n").alias("clean_data"),
            F.aggregate(texts, F.lit(0), lambda acc, t: acc + F.length(t)).alias("char_count"),
            F.when(N.first_tag(dom, "title").isNull(), F.lit(NO_TITLE)).otherwise(title(dom)).alias("title")))

    main = first(F.filter(dom, lambda n: N.attr(n, "id") == "main-content"))
    framed = N.spread(dom, lambda n: N.is_tag(n, "nav", "footer", "header", "aside"))
    return let(F.struct(main.alias("main"), framed.alias("framed")), with_env)


def paragraphs(dom: Column) -> Column:
    """array<string>: text of every p, as it stands; nested p repeat their text."""
    return F.transform(N.tagged(dom, "p"), N.text)

"""Expressions over a page's `dom` array (see `operators.shred` for the node fields).

All of them are per-row. Lookups by id are constant time, subtrees are walked by id range,
so cost follows the size of what is looked at. A node's strings are read from the page's column `dom_strings`,
so expressions on text belong on frames that still have it.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.lambdas import first, last, let, match, span
from pageloom.functions.text import strip

NodeTest = Callable[[Column], Column]


def tagged(dom: Column, *tags: str) -> Column:
    return F.filter(dom, lambda n: is_tag(n, *tags))


def is_tag(n: Column, *tags: str) -> Column:
    hit = n["tag"] == tags[0] if len(tags) == 1 else n["tag"].isin(*tags)
    return F.coalesce(hit, F.lit(False))


def attr(n: Column, name: str) -> Column:
    """Attribute value; NULL when absent, empty when given without one."""
    return n["attrs"][name]


def attr_or_empty(n: Column, name: str) -> Column:
    return F.coalesce(attr(n, name), F.lit(""))


def classes(n: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(attr_or_empty(n, "class"), r"\s+", " ")), " ")


def has_class(n: Column, name: str) -> Column:
    return F.array_contains(classes(n), name)


def inside(n: Column, outer: Column) -> Column:
    """`n` is a descendant of `outer`."""
    return (n["id"] > outer["id"]) & (n["id"] <= outer["end"])


def node_at(dom: Column, i: Column) -> Column:
    return F.get(dom, i)


def under(dom: Column, outer: Column, test: NodeTest) -> Column:
    """Descendants of `outer` passing `test`, in order."""
    return F.filter(F.transform(span(outer["id"] + 1, outer["end"]), lambda i: F.get(dom, i)), test)


def _strings() -> Column:
    return F.col("dom_strings")


def parts(n: Column) -> Column:
    """The strings of the node's subtree, in order. Needs its tag in `parts_of`."""
    return F.slice(_strings(), n["first"] + 1, n["upto"] - n["first"])


def text(n: Column) -> Column:
    """The node's text as it stands. Needs its tag in `parts_of`."""
    return F.array_join(parts(n), "")


def lead(n: Column) -> Column:
    """The first string directly in the node. Needs its tag in `parts_of`."""
    return F.get(_strings(), n["lead"])


def string(n: Column) -> Column:
    """The string of a string node or comment; NULL for an element. Needs `text_nodes`."""
    return F.when(n["kind"] != "element", F.get(_strings(), n["first"]))


def stripped_text(n: Column, separator: str = "") -> Column:
    """The node's strings, each stripped, empty ones dropped."""
    return F.array_join(F.filter(F.transform(parts(n), strip), lambda p: p != ""), separator)


def only_string(dom: Column, n: Column) -> Column:
    """The string of an element holding just one, at whatever depth; else NULL. Needs `text_nodes`."""
    leaf = F.get(dom, n["end"])
    chain = (leaf["depth"] - n["depth"]) == (n["end"] - n["id"])
    return F.when(chain & leaf["kind"].isin("text", "raw"), string(leaf))


def source(html: Column, n: Column) -> Column:
    """The element as written in the page: start tag to end tag, or to where it was closed."""
    return F.substring(html, n["lo"] + 1, n["hi"] - n["lo"])


def first_tag(dom: Column, tag: str) -> Column:
    return first(tagged(dom, tag))


def spread(dom: Column, test: NodeTest) -> Column:
    """array<boolean> by node id: the node or one of its ancestors passes `test`.

    Only the nodes that pass are sorted, by their starts and ends. One is in no other if as many of them ended before
    it as began; the nodes of those are runs of the array, and what lies between is not in any.
    """
    def repeated(value: bool, n: Column) -> Column:
        return F.array_repeat(F.lit(value), n.cast("int"))

    def marked(hits: Column) -> Column:
        order = F.sort_array(F.concat(F.transform(hits, lambda h: h["id"] * 2), F.transform(hits, lambda h: h["end"] * 2 + 1)))
        places = F.filter(F.transform(order, lambda v, p: F.when(v % 2 == 0, p)), lambda p: p.isNotNull())
        return let(let(places, lambda at: F.filter(hits, lambda h, j: F.get(at, j) == j * 2)), runs)

    def runs(outer: Column) -> Column:
        covered = F.transform(outer, lambda o, j: F.concat(
            repeated(False, o["id"] - F.coalesce(F.get(outer, j - 1)["end"], F.lit(-1)) - 1), repeated(True, o["end"] - o["id"] + 1)))
        return F.flatten(F.concat(covered, F.array(repeated(False, F.size(dom) - last(outer)["end"] - 1))))

    found = F.transform(F.filter(dom, lambda n: F.coalesce(test(n), F.lit(False))), lambda n: F.struct(
        n["id"].cast("long").alias("id"), n["end"].cast("long").alias("end")))
    return let(found, lambda hits: F.when(F.size(hits) == 0, repeated(False, F.size(dom))).otherwise(marked(hits)))


def _rounds(dom: Column) -> Column:
    """The bit length of the page's depth."""
    return F.length(F.bin(F.coalesce(F.array_max(F.transform(dom, lambda n: n["depth"])), F.lit(0)).cast("long")))


def nearest(dom: Column, test: NodeTest) -> Column:
    """array<int> by node id: the node itself or else its nearest ancestor passing `test`; NULL if none does."""
    start = F.transform(dom, lambda n: F.struct(F.when(test(n), n["id"]).alias("f"), n["parent"].alias("p")))

    def double(acc: Column, _: Column) -> Column:
        return F.transform(acc, lambda a: F.struct(
            F.coalesce(a["f"], F.get(acc, a["p"])["f"]).alias("f"), F.coalesce(F.get(acc, a["p"])["p"], F.lit(-1)).alias("p")))

    return F.transform(F.aggregate(F.sequence(F.lit(1), _rounds(dom)), start, double), lambda a: a["f"])


def by_node(dom: Column, ids: Column, values: Column) -> Column:
    """struct<at, values>: what `of_node` needs to find the one of `values` that stands where a node's id does in `ids`."""
    def placed(rows: Column) -> Column:
        # An id's place among `ids` stands at the id; gaps are filled from one id to the next.
        return F.flatten(F.transform(rows, lambda r, i: F.concat(
            F.array_repeat(F.lit(None).cast("int"), r["id"] - F.coalesce(F.get(rows, i - 1)["id"], F.lit(-1)) - 1), F.array(r["at"]))))

    rows = F.sort_array(F.transform(ids, lambda v, i: F.struct(v.alias("id"), i.alias("at"))))
    return F.struct(let(rows, placed).alias("at"), values.alias("values"))


def of_node(table: Column, n: Column) -> Column:
    """The value for a node from `by_node`, in constant time (a lookup in a map scans its keys)."""
    return F.get(table["values"], F.get(table["at"], n["id"]))


def flag(flags: Column, i: Column) -> Column:
    return F.coalesce(F.get(flags, i), F.lit(False))


# What hides an element.
HIDING_STYLES = ("display: none", "visibility: hidden", "opacity: 0")
OFF_SCREEN = ("left: -9999px", "top: -9999px")


def contains_any(text_column: Column, needles: Collection[str]) -> Column:
    hits = [text_column.contains(x) for x in needles]
    total = hits[0]
    for h in hits[1:]:
        total = total | h
    return total


def _has_attributes(n: Column) -> Column:
    return F.coalesce(F.size(n["attrs"]) > 0, F.lit(False))


def _hides_itself(n: Column, relaxed: bool) -> Column:
    style = F.lower(attr_or_empty(n, "style"))
    if relaxed:  # tolerate any spacing around the colon
        style = F.regexp_replace(style, r"\s*:\s*", ": ")
    return _has_attributes(n) & (
        contains_any(style, HIDING_STYLES)
        | (style.contains("position: absolute") & contains_any(style, OFF_SCREEN))
        | (F.lower(attr_or_empty(n, "aria-hidden")) == "true")
        | attr(n, "hidden").isNotNull()
        | F.lower(attr_or_empty(n, "class")).contains("hidden")
    )


def _hides_parent(n: Column, relaxed: bool) -> Column:
    style = F.lower(attr_or_empty(n, "style"))
    if relaxed:
        style = F.regexp_replace(style, r"\s*:\s*", ": ")
    return (
        (n["kind"] == "element")
        & _has_attributes(n)
        & (F.lower(attr_or_empty(n, "aria-hidden")) != "true")
        & style.contains("display: none")
    )


def hidden(dom: Column, dropped: NodeTest | None = None, relaxed: bool = False) -> Column:
    """array<boolean> by node id: the element, or one above it, is hidden.

    Hidden means an inline style, attribute or class that hides it, or (except for svg and
    script) a direct child with `display: none` that is not aria-hidden. `dropped` adds a
    rule of the caller's. Styles are matched as written, with one space after the colon;
    `relaxed` accepts any spacing and leaves the child rule out.
    """
    def body(holders: Column) -> Column:
        def test(n: Column) -> Column:
            hit = _hides_itself(n, relaxed)
            if not relaxed:
                hit = hit | (~is_tag(n, "svg", "script") & F.get(holders, n["id"]).isNotNull())
            if dropped is not None:
                hit = hit | dropped(n)
            return (n["kind"] == "element") & hit

        return spread(dom, test)

    if relaxed:
        return body(F.lit(None))
    parents = F.transform(F.filter(dom, lambda n: _hides_parent(n, relaxed)), lambda n: n["parent"])
    return let(let(parents, lambda ps: F.when(F.size(ps) > 0, match(F.transform(dom, lambda n: n["id"]), ps))), body)

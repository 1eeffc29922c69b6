"""Helpers for higher-order functions over a page's node array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    An expression used inside a lambda is evaluated once per array element. Binding it to a
    lambda variable first keeps work proportional to the array, whatever the optimizer inlines.
    """
    return F.transform(F.array(value), body)[0]


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def span(lo: Column, hi: Column) -> Column:
    """The integers lo..hi, empty when lo > hi."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def count_before(marks: Column, items: Column) -> Column:
    """array<int>: for each of `items`, how many `marks` sort before it. Both sorted, no ties between them.

    An item's place in the merged order, less its place among the items, is that count: a sort
    instead of comparing every item with every mark.
    """
    both = F.sort_array(F.concat(
        F.transform(marks, lambda m: F.struct(m.alias("v"), F.lit(False).alias("item"))),
        F.transform(items, lambda m: F.struct(m.alias("v"), F.lit(True).alias("item")))))
    places = F.filter(F.transform(both, lambda b, i: F.when(b["item"], i)), lambda i: i.isNotNull())
    return F.transform(places, lambda place, j: place - j)


def match(keys: Column, table: Column) -> Column:
    """array<int>: for each of `keys` the place of the last of `table` equal to it; NULL where there is none, and for a NULL.

    Both are sorted and merged once, so the work is that of sorting, not a scan of the table per key.
    """
    def ranked(values: Column) -> Column:
        return F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    def sided(rows: Column, side: int) -> Column:
        return F.transform(rows, lambda r: F.struct(r["v"].alias("v"), F.lit(side).alias("side"), r["i"].alias("i")))

    def found(env: Column) -> Column:
        # In the merged order an entry's place less its place among the keys is how many of the table come before it.
        both = F.sort_array(F.concat(sided(env["t"], 0), sided(env["k"], 1)))
        places = F.filter(F.transform(both, lambda b, p: F.when(b["side"] == 1, p)), lambda p: p.isNotNull())
        return let(places, lambda ps: F.transform(F.sort_array(F.transform(env["k"], lambda k, j: let(
            F.get(env["t"], F.get(ps, j) - j - 1), lambda t: F.struct(k["i"].alias("at"), F.when(t["v"] == k["v"], t["i"]).alias("hit"))))),
            lambda h: h["hit"]))

    return let(F.struct(ranked(table).alias("t"), ranked(keys).alias("k")), found)


def grouped(items: Column, keys: Column) -> Column:
    """array<struct<key, items>>: `items` by the key at the same place of `keys`, groups by first appearance, items in order."""
    def with_rows(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda r, i: F.when(
            (i == 0) | ~r["k"].eqNullSafe(F.get(rows, i - 1)["k"]), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: let(F.sort_array(F.transform(at, lambda s, j: F.struct(
            F.get(rows, s)["i"].alias("first"), s.alias("lo"), F.coalesce(F.get(at, j + 1), F.size(rows)).alias("hi")))),
            lambda groups: F.transform(groups, lambda g: F.struct(
                F.get(rows, g["lo"])["k"].alias("key"),
                F.transform(F.slice(rows, g["lo"] + 1, g["hi"] - g["lo"]), lambda r: F.get(items, r["i"])).alias("items")))))

    return let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), with_rows)


def last_of_each(keys: Column, values: Column) -> Column:
    """map<key, value>: the keys by first appearance, each with the last of its values."""
    return let(F.struct(keys.alias("k"), values.alias("v")), lambda e: let(F.array_distinct(e["k"]), lambda names: let(
        match(names, e["k"]), lambda at: F.map_from_arrays(names, F.transform(at, lambda i: F.get(e["v"], i))))))

"""Exact deduplication by most-significant-digit radix partitioning of the texts.

Documents are split by their first bytes, then those still together by the bytes after these, and so on,
until a group has one member or its texts have ended. A digit is a number of successive bytes and stands beside the
number of the group it splits, so no beginning is looked at again. Equality is decided on bytes alone. Each
pass has seen `growth` times as many bytes as the one before, up to a bound of a digit's length; only texts that
still share their beginning with another go into the next, and without it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Steps, attach

# Bytes of the first digit, how many times more have been seen after each later one, and bytes of the longest.
FIRST_BYTES, GROWTH, MOST_BYTES = 64, 16, 1 << 18


def _digit(rest: Column, width: int) -> Column:
    """The first `width` bytes with A-Z lower-cased; a character per byte, so that any cut is a string."""
    return F.translate(F.decode(F.substring(rest, 1, width), "ISO-8859-1"), string.ascii_uppercase, string.ascii_lowercase)


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
    first_bytes: int = FIRST_BYTES, growth: int = GROWTH, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, the columns `carry`, keep_id, group_size and kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest id stays (null ids come last); of rows that repeat id and text, one. The
    columns in `carry` (the text may be among them) come through unchanged; others are left out.
    An empty table gives an empty result.
    """
    steps, width, seen, done = Steps(docs, "exact"), first_bytes, 0, []
    names = [f"c_{i}" for i in range(len(carry))]
    rest = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    live = docs.select(
        F.col(doc_id).alias("id"), *(F.col(c).alias(n) for n, c in zip(names, carry, strict=True)), rest.alias("rest"), F.lit(0).cast("long").alias("group"))
    while True:
        rows = live.withColumns({
            "digit": _digit(F.col("rest"), width), "ended": F.octet_length("rest") <= width, "row": F.monotonically_increasing_id()})
        # A group's number is that of one of its rows.
        rows = attach(rows, ["group", "digit", "ended"], {
            "group_size": (F.count(F.lit(1)), F.sum), "keep_id": (F.max("id"), F.max), "part": (F.min("row"), F.min)}, ["id", "row"])
        open_ = (F.col("group_size") > 1) & ~F.col("ended")
        table = steps.keep(rows.select(
            "id", *names, F.when(open_, F.substring("rest", width + 1, 1 << 30)).alias("rest"), "keep_id", "group_size", F.col("part").alias("group"),
            F.monotonically_increasing_id().alias("row"), open_.alias("open")))
        done.append(_settled(table.filter(~F.col("open")), names))
        live = table.filter("open").select("id", *names, "rest", "group")
        if live.isEmpty():
            break
        seen += width
        width = min(seen * (growth - 1), most_bytes)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    back = [F.col(n).alias(c) for n, c in zip(names, carry, strict=True) if c != doc_id]
    return result.select(F.col("id").alias(doc_id), *back, "keep_id", "group_size", "kept")


def _settled(table: DataFrame, names: list[str]) -> DataFrame:
    """Whether each row of finished groups stays; rows that repeat id and text are told apart by `row`."""
    keeper = (F.col("group_size") > 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    columns = ["id", *names, "keep_id", "group_size"]
    rest = table.filter(~keeper).select(*columns, (F.col("group_size") == 1).alias("kept"))
    first = table.filter(keeper).groupBy("group").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    top = table.filter(keeper).join(first, "row", "left")
    return rest.unionByName(top.select(*columns, F.coalesce("first", F.lit(False)).alias("kept")))

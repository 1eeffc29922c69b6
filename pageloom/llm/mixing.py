"""Mixing sources to target weights with a curriculum that changes over training.

Each source has a weight as a piecewise linear function of training progress, 0 to 1. Its area
gives the source's share of all tokens; its running area says how many of the source's tokens are
due by any moment. A document standing at some token of its source is trained on when that many
are due: the running area is inverted at the document's place. Sorting by that moment gives the
training order, in which every stretch holds the sources in the proportions of their weights there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.lambdas import let
from pageloom.llm.common import WORD, Steps

# Into how many stretches the shuffled documents of a source are cut. Each is summed by itself, so
# no task sorts or sums a whole source: choose it so that one stretch of the largest fits in memory.
STRETCHES = 4096


def order_key(doc_id: Column, seed: str = "") -> Column:
    """A fixed pseudo-random number of 60 bits per id: the order of a source's documents."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(table: DataFrame, column: str, name: str, steps: Steps) -> DataFrame:
    """`table` with the 0-based rank of each row by `column`, nulls last; values are distinct.

    Rows are dealt out by ranges; only one count per range is summed in one place.
    """
    order = F.col(column).asc_nulls_last()
    dealt = steps.keep(table.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_start")
    return dealt.join(starts, "_range").withColumn(name, place.cast("long")).drop("_range", "_start")


def area(knots: Column) -> Column:
    """The whole area under `knots`, an array of (at, weight) by rising `at` from 0 to 1."""
    pieces = F.transform(F.slice(knots, 2, F.greatest(F.size(knots) - 1, F.lit(0))), lambda right, i: let(F.get(knots, i), lambda left:
        (right["at"] - left["at"]) * (right["weight"] + left["weight"]) / 2))
    return F.aggregate(pieces, F.lit(0.0), lambda a, b: a + b)


def moment(knots: Column, share: Column) -> Column:
    """The progress at which the running area under `knots` reaches `share` of the whole."""
    def step(state: Column, right: Column) -> Column:
        width, left = right["at"] - state["at"], state["weight"]
        piece = width * (left + right["weight"]) / 2
        slope = F.when(width > 0, (right["weight"] - left) / width).otherwise(0.0)
        root = F.sqrt(F.greatest(left * left + 2 * slope * state["left"], F.lit(0.0)))
        inside = state["found"].isNull() & (state["left"] <= piece) & (piece > 0)
        found = F.least(state["at"] + F.when(left + root > 0, 2 * state["left"] / (left + root)).otherwise(0.0), right["at"])
        return F.struct(
            right["at"].alias("at"), right["weight"].alias("weight"), (state["left"] - piece).alias("left"),
            F.when(inside, found).otherwise(state["found"]).alias("found"))

    begin = F.struct(
        F.get(knots, F.lit(0))["at"].alias("at"), F.get(knots, F.lit(0))["weight"].alias("weight"),
        (share * area(knots)).alias("left"), F.lit(None).cast("double").alias("found"))
    rest = F.slice(knots, 2, F.greatest(F.size(knots) - 1, F.lit(0)))
    return F.coalesce(F.aggregate(rest, begin, step, lambda s: s["found"]), F.lit(1.0))


def targets(sources: DataFrame, total: int, most: float, steps: Steps) -> DataFrame:
    """`sources` (source_size, knots) with `target`: tokens shared out by area, none above `most` times its size.

    The excess of a source at its limit is shared among the others by weight until none is above.
    Each round asks for two sums; only those come to the driver.
    """
    sources = steps.keep(sources.withColumn("weight", area(F.col("knots"))))
    limit, rate, at_limit = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:
        over = limit <= F.col("weight") * F.lit(rate)
        sums = sources.agg(
            F.sum(F.when(over, limit)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("n")).first()
        if sums["n"] == at_limit or not sums["weight"]:
            break
        at_limit, rate = sums["n"], (total - (sums["taken"] or 0.0)) / sums["weight"]
    return sources.withColumn("target", F.when(over, limit).otherwise(F.col("weight") * F.lit(rate)))


def mix(
    docs: DataFrame, schedules: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source",
    total: int | None = None, share: float = 1.0, most: float = 3.0, seed: str = "", steps: Steps | None = None,
) -> DataFrame:
    """(doc: a struct of the row, size, source_size, target, moments): when, if at all, each row is trained on.

    `schedules` has a row per source: the source and `knots`, an array of (at, weight). `total` tokens
    are mixed, or `share` of all. A source is read in a fixed shuffled order, as many times over as its target
    needs and `most` allows; a reading counts when its middle token is due, so a source comes within half a
    document of its target. Null sizes count as 0, null sources are a source of their own, sources
    without a schedule get nothing, rows that repeat an id each count; an empty table stays empty.
    """
    steps = steps or Steps(docs, "mix")
    key = order_key(F.col(doc_id), seed)
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(doc_id).alias("id"), F.col(source).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"), key.alias("key"),
        F.pmod(F.shiftright(key, 24), F.lit(STRETCHES)).cast("int").alias("stretch"))
    sums = steps.keep(rows.groupBy("source", "stretch").agg(F.sum("size").alias("n")))
    whole = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    given = schedules.select(F.col(source).alias("given"), "knots")
    nothing = F.array(F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("weight")))
    known = whole.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given")
    known = known.withColumn("knots", F.coalesce("knots", nothing))
    if total is None:
        total = int((sums.agg(F.sum("n")).first()[0] or 0) * share)
    aims = targets(known, total, most, steps).withColumnRenamed("source", "given")
    ahead = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    # A struct is a key that may hold a null; the window and the join share one shuffle of the rows by it.
    whose = F.struct("source").alias("whose")
    starts = starts.join(aims, F.col("source").eqNullSafe(F.col("given"))).select(
        whose, "stretch", "before", "source_size", "target", "knots")
    rows = rows.select("doc", "id", "size", "key", whose, "stretch")
    along = Window.partitionBy("whose", "stretch").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("so_far", F.coalesce(F.sum("size").over(along), F.lit(0))).join(starts, ["whose", "stretch"])
    rows = rows.withColumn("middle", F.col("before") + F.col("so_far") + F.col("size") / 2)
    again = F.when(F.col("source_size") > 0, F.ceil((F.col("target") - F.col("middle")) / F.col("source_size"))).otherwise(0)
    readings = F.when(F.col("middle") < F.col("target"), again).otherwise(0).cast("int")
    due = lambda e: (F.col("middle") + e * F.col("source_size")) / F.col("target")
    epochs = F.when(readings > 0, F.sequence(F.lit(0), readings - 1)).otherwise(F.array().cast("array<int>"))
    moments = F.transform(epochs, lambda e: moment(F.col("knots"), due(e)))
    return rows.select("doc", "size", "source_size", "target", moments.alias("moments"))


def in_training_order(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc, moment): one row per reading of the rows of `mix`, range-sorted by its moment; ties by id."""
    order = ("moment", F.col("doc")[doc_id])
    return mixed.select("doc", F.explode("moments").alias("moment")).repartitionByRange(*order).sortWithinPartitions(*order)


# Base weights of the sources in order, repeating, and how each weight moves over training: sources with
# the largest come early, those with the smallest late. Each line has an average of 1.
BASE = (5.0, 2.0, 1.0)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def cycling_schedules(docs: DataFrame, source: str, steps: Steps) -> DataFrame:
    """Schedules for `mix`: sources by code point, null last, take the weights BASE and RAMPS in turn."""
    order = ranked(docs.select(source).distinct(), source, "_rank", steps)
    turn = F.col("_rank") % len(BASE)
    weight = lambda side: F.element_at(F.array(*(F.lit(b * r[side]) for b, r in zip(BASE, RAMPS, strict=True))), (turn + 1).cast("int"))
    knots = F.array(*(F.struct(F.lit(float(side)).alias("at"), weight(side).alias("weight")) for side in (0, 1)))
    return order.select(source, knots.alias("knots"))

"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Steps, attach


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """(node, root) for every node of `links` (a, b: any order, repeats allowed); root is the smallest node reachable.

    Each round hangs a node's larger neighbours under its smallest one, then its smaller ones, until
    nothing changes: a number of rounds that grows with the logarithm of the diameter; stars, as of an earlier result, need
    few. Only a count and a checksum of the links come to the driver. No links give no rows.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = steps.keep(links), None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = attach(both, ["a"], {"m": (F.min("b"), F.min)}, ["b"]).filter("b > a")
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = attach(large, ["a"], {"m": (F.min("b"), F.min)}, ["b"])
        pair = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        after = steps.keep(small.select(pair.alias("p")).select("p.a", "p.b").filter("a <> b").distinct())
        steps.forget(links)
        links = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

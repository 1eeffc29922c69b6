"""Which seeds reach which sitemap files, without a row per seed and file.

Files reached by the same seeds share one set of seeds, named by its content. Walking the links, what travels is the
name of a set: a file's new set is the union of the sets of the files that list it and of its own, and each distinct union is
made once, whatever the number of files that need it. Cycles end by themselves, as sets only grow.
So a map shared by S seeds costs its U files and one set of S rows, not S x U.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.sitemaps import sitemap_links
from pageloom.session import run_dir


class Reach(NamedTuple):
    """`urls`: (url, seeds) with the name of the set that reaches a URL; `sets`: (seeds, seed) with its members."""

    urls: DataFrame
    sets: DataFrame


def _name(member: str) -> Column:
    """The name of a set of distinct members: how many there are and 128 bits of their hashes, in whatever order."""
    return F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(F.xxhash64(member)), F.bit_xor(F.xxhash64(F.lit("again"), member)))


class _Walk:
    """The tables of one walk, a folder per kind and round, in the shared folder."""

    def __init__(self, seeds: DataFrame, links: DataFrame) -> None:
        self.spark, self.root, self.round = seeds.sparkSession, run_dir(seeds.sparkSession, "frontier"), 0
        self.links = self._kept("links", links.select("url", "listed").distinct())
        own = seeds.select("seed", F.col("seed").alias("url")).where("seed is not null").distinct()
        start = own.groupBy("url").agg(_name("seed").alias("seeds"))
        self.changed = self._kept("urls", start)
        self._kept("sets", own.join(start, "url").select("seeds", "seed"))

    def _kept(self, kind: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{kind}/round={self.round}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, kind: str, columns: str) -> DataFrame:
        """Every round's rows, with the round."""
        return self.spark.read.schema(f"{columns}, round int").parquet(f"{self.root}/{kind}")

    def latest(self, of: DataFrame | None = None) -> DataFrame:
        """(url, seeds) as they are now, of the URLs in `of` (url) if given."""
        urls = self.all("urls", "url string, seeds string")
        urls = urls if of is None else urls.join(of, "url", "left_semi")
        return urls.groupBy("url").agg(F.max_by("seeds", "round").alias("seeds"))

    def step(self) -> bool:
        """Hand the sets that changed one link further; false when nothing changes."""
        self.round += 1
        come = self._kept("come", self.links.join(self.changed, "url").select(F.col("listed").alias("url"), "seeds").distinct())
        if come.isEmpty():
            return False
        now = self.latest(come.select("url"))
        both = come.withColumn("own", F.lit(False)).unionByName(now.withColumn("own", F.lit(True)))
        both = self._kept("both", both.groupBy("url", "seeds").agg(F.max("own").alias("own")))
        # A file's parts have a name as a set of sets; files with the same parts get the same union.
        parts = both.groupBy("url").agg(
            F.count(F.lit(1)).alias("n"), F.max("own").alias("known"), F.min("seeds").alias("only"), F.max_by("seeds", "own").alias("before"), _name("seeds").alias("parts"))
        parts = self._kept("parts", parts.where(~((F.col("n") == 1) & F.col("known"))))
        several = parts.where("n > 1").groupBy("parts").agg(F.min("url").alias("url"))
        if several.isEmpty():  # sets only go on to files that have none
            self.changed = self._kept("urls", parts.select("url", F.col("only").alias("seeds")))
            return not self.changed.isEmpty()
        members = self._kept("members", several.join(both, "url").join(
            self.all("sets", "seeds string, seed string").select("seeds", "seed"), "seeds").select("parts", "seed").distinct())
        unions = self._kept("unions", members.groupBy("parts").agg(_name("seed").alias("union")))
        made = unions.groupBy("union").agg(F.min("parts").alias("parts")).join(
            self.all("sets", "seeds string, seed string").select(F.col("seeds").alias("union")).distinct(), "union", "left_anti")
        self._kept("sets", made.join(members, "parts").select(F.col("union").alias("seeds"), "seed"))
        new = parts.join(unions, "parts", "left").select(
            "url", F.coalesce("union", "only").alias("seeds"), F.when(F.col("known"), F.col("before")).alias("before"))
        self.changed = self._kept("urls", new.where(~F.col("seeds").eqNullSafe(F.col("before"))).select("url", "seeds"))
        return not self.changed.isEmpty()


def reach(seeds: DataFrame, files: DataFrame) -> Reach:
    """The sitemap files reachable from the URLs `seed` of `seeds`, themselves included, through `files` (url, body).

    Null seeds are left out; repeats, files that are not there and cycles are allowed. One round of joins per level of links.
    """
    walk = _Walk(seeds, sitemap_links(files).where("is_sitemap"))
    while walk.step():
        pass
    return Reach(walk._kept("reached", walk.latest()), walk.all("sets", "seeds string, seed string").select("seeds", "seed"))


def used_sets(found: Reach) -> DataFrame:
    """(seeds, seed): the sets some URL has in the end."""
    return found.sets.join(found.urls.select("seeds").distinct(), "seeds", "left_semi")


def listed_pages(found: Reach, files: DataFrame) -> DataFrame:
    """(seeds, url): the page URLs the sitemaps of a set list, each once per set; a seed's pages are those of its sets."""
    listed = sitemap_links(files).where("not is_sitemap").select("url", "listed")
    return found.urls.join(listed, "url").select("seeds", F.col("listed").alias("url")).distinct()


def pairs(found: Reach) -> DataFrame:
    """(seed, url) written out, where a consumer wants a row for each."""
    return found.urls.join(found.sets, "seeds").select("seed", "url")

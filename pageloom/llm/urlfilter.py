"""URL filters: host and path rules, then a blocked Bloom filter in front of an exact lookup in a list.

The filter is a table of blocks of 512 bits, built by a grouped `bit_or`, 16 bits a URL. While it is small it is broadcast;
the blocks of a longer list are looked up by their number. Only URLs it lets through meet the list itself in a join.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Steps, look_up

WORDS_PER_BLOCK, WORD_BITS = 8, 64
# A bound on what is broadcast: 65,536 blocks of 64 bytes with their keys, about 6 MB, for some two million URLs.
MOST_BLOCKS, BITS_PER_URL = 1 << 16, 16


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains, on paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without slashes at its end, and sorted parameters other than tracking ones; null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"(?s)^(utm_[^=]*|ref)(=|$)") & (p != "")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+$", ""), tail))


def matching_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # later wins
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The bit of `word` that stands for `key`: six bits of a second hash."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit("bits")), 6 * word).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A blocked Bloom filter over the column `key`: (block, w0..w7), and the number of blocks."""
    n = listed.count()
    blocks = 1
    while blocks * WORDS_PER_BLOCK * WORD_BITS < n * BITS_PER_URL:
        blocks *= 2
    words = [F.bit_or(_bit(F.col(key), w)).alias(f"w{w}") for w in range(WORDS_PER_BLOCK)]
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*words), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, possible) for every row of `pages`.

    The longest rule that fits decides. Other URLs are blocked when their canonical form is that of a
    URL in `listed` (url; repeats and nulls allowed), which `possible` says the Bloom filter had let
    through. Null URLs and those without :// have an empty host and path and are allowed.
    """
    keys = Steps(pages, "urls").keep(listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct())
    table, blocks = bloom(keys, "key")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("u"))
    rows = rows.select("id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), canonical(F.col("u")).alias("key"))
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "at": F.coalesce(_block(F.col("key"), blocks), F.lit(-1))})
    if blocks <= MOST_BLOCKS:
        rows = rows.join(F.broadcast(table), F.col("at") == F.col("block"), "left")
    else:
        rows = look_up(rows, ["at"], table.withColumn("at", F.col("block")), ["id", "key"])
    hit = F.col("block").isNotNull()
    for w in range(WORDS_PER_BLOCK):
        hit = hit & (F.col(f"w{w}").bitwiseAND(_bit(F.col("key"), w)) != 0)
    rows = rows.withColumn("possible", F.coalesce(F.col("verdict").isNull() & hit, F.lit(False)))
    rest = rows.filter(~F.col("possible")).select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "possible")
    exact = look_up(rows.filter("possible"), ["key"], keys.withColumn("listed", F.lit(True)), ["id"])
    exact = exact.select("id", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"), "possible")
    return rest.unionByName(exact).withColumnRenamed("id", page_id)

"""Facts of groups on every row, and lookups by key, where a key may hold a third of all rows.

A plain join sends all rows of a key to one task. Here rows are salted, each key is asked for once
per salt that occurs, and its answer comes back once per salt, so one task gets at most a salt's share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Into how many parts a group is split at most.
WAYS = 256


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with so many underscores before it that `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salted(rows: DataFrame, spread_by: list[str], name: str, ways: int = WAYS) -> DataFrame:
    """`rows` with a column `name`, 0 to ways - 1, by a hash of columns that differ within a group."""
    return rows.withColumn(name, F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int"))


def attach(
    rows: DataFrame, keys: list[str], facts: dict[str, tuple[Column, Callable[[Column], Column]]],
    spread_by: list[str], ways: int = WAYS,
) -> DataFrame:
    """`rows` with aggregates over their group as new columns.

    `facts` maps a column name to the aggregate over rows and the function that merges two of
    them. `keys` must not be null.
    """
    salt = free_name(rows, "_salt")
    rows = salted(rows, spread_by, salt, ways)
    parts = rows.groupBy(*keys, salt).agg(*(part.alias(name) for name, (part, _) in facts.items()))
    whole = parts.groupBy(*keys).agg(
        *(merge(F.col(name)).alias(name) for name, (_, merge) in facts.items()), F.collect_list(salt).alias(f"{salt}s"))
    per_salt = whole.select(*keys, *facts, F.explode(f"{salt}s").alias(salt))
    return rows.join(per_salt, [*keys, salt]).drop(salt)


def look_up(rows: DataFrame, keys: list[str], table: DataFrame, spread_by: list[str], ways: int = WAYS) -> DataFrame:
    """`rows` left-joined with `table`, which has one row per key. `keys` must not be null."""
    salt = free_name(rows.select("*", *(F.lit(0).alias(c) for c in table.columns if c not in keys)), "_salt")
    rows = salted(rows, spread_by, salt, ways)
    used = rows.select(*keys, salt).distinct().groupBy(*keys).agg(F.collect_list(salt).alias(f"{salt}s"))
    per_salt = table.join(used, keys).withColumn(salt, F.explode(f"{salt}s")).drop(f"{salt}s")
    return rows.join(per_salt, [*keys, salt], "left").drop(salt)


# Rows of a table up to which it may be broadcast; its rows must be short.
BROADCAST_ROWS = 100_000


def look_up_small(rows: DataFrame, keys: list[str], table: DataFrame, spread_by: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """`look_up` that leaves wide `rows` where they are when `table`, counted first, has at most `most` rows."""
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), keys, "left")
    return look_up(rows, keys, table, spread_by)

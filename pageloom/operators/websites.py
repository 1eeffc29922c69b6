"""Registrable domains from a public-suffix list given as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import host
from pageloom.operators.groups import look_up


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """One row per name with the kinds of rule it has: plain `com`, wildcard `*.ck`, exception `!www.ck`."""
    rule = F.lower(F.trim("suffix"))
    return (
        suffixes.select(F.regexp_replace(rule, r"^(\*\.|!)", "").alias("name"), rule.alias("rule"))
        .groupBy("name").agg(
            F.bool_or(~F.col("rule").rlike(r"^[*!]")).alias("plain"),
            F.bool_or(F.col("rule").startswith("*.")).alias("wildcard"),
            F.bool_or(F.col("rule").startswith("!")).alias("exception"))
    )


def suffixes_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, size): the number of labels in each host's suffix, 0 when no rule fits.

    Each host asks for all its tails, however long the rules are; a tail such as `com`, which
    half of the hosts share, is looked up in parts.
    """
    labels = F.split(F.lower("host"), r"\.")
    # An IPv4 address has no suffix.
    named = hosts.filter(~F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).select("host", labels.alias("labels"))
    place = F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k")
    tails = named.select("host", "labels", place).select(
        "host", "k", F.size("labels").alias("n"), F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), ".").alias("name"))
    found = look_up(tails, ["name"], rules, ["host"])
    size = (
        F.when(F.col("exception"), F.struct(F.lit(1).alias("final"), (F.col("k") - 1).alias("size")))
        .when(F.col("wildcard") & (F.col("n") > F.col("k")), F.struct(F.lit(0).alias("final"), (F.col("k") + 1).alias("size")))
        .when(F.col("plain"), F.struct(F.lit(0).alias("final"), F.col("k").alias("size"))))
    return found.groupBy("host").agg(F.coalesce(F.max(size)["size"], F.lit(0)).alias("size"))


def with_website(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Add `website` (registrable domain) and `suffix`; a host without a known suffix keeps its last label.

    Suffixes are looked up once per distinct host, rules of any number of labels; the longest match
    wins, an exception before all. Only the host's answer then meets the URLs, in parts where a host is hot.
    """
    taken = {c.lower() for c in urls.columns}
    name = next(n for n in ("_host", "__host", "___host") if n not in taken)
    rows = urls.withColumn(name, F.coalesce(host(F.col(url)), F.lit("")))
    sizes = suffixes_of(rows.select(F.col(name).alias("host")).distinct(), suffix_rules(suffixes))
    parts, size = F.split("host", r"\."), F.col("size")
    suffix = F.when(size == 0, "").otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - size + 1, F.lit(1)), F.greatest(size, F.lit(1))), "."))
    label = F.coalesce(F.get(parts, F.size(parts) - size - 1), F.lit(""))
    known = sizes.withColumn("suffix", suffix).select(
        F.col("host").alias(name), F.when(size == 0, label).otherwise(F.concat(label, F.lit("."), "suffix")).alias("website"), "suffix")
    joined = look_up(rows, [name], known, [url])
    missing = F.col(name).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return joined.select(
        *urls.columns, F.when(missing, F.col(name)).otherwise(F.col("website")).alias("website"), F.when(missing, "").otherwise(F.col("suffix")).alias("suffix"))

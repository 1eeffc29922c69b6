"""Saved pages: html behind a metadata header, and the manifest of what was saved when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import strip

# Fixed values of the file format.
START, END = "<!--METADATA_START", "METADATA_END-->"
FIELDS = ("url", "website", "path", "domain_type", "unique_page_name")
_INDENT = " " * 8


def snapshot_text(url: Column, html: Column, website: Column | None = None, path: Column | None = None,
                  domain_type: Column | None = None, unique_page_name: Column | None = None) -> Column:
    """A page as saved: five `key: value` lines between markers, then the html."""
    values = (url, website, path, domain_type, unique_page_name)
    lines = [F.concat(F.lit(f"{_INDENT}{name}: "), F.coalesce(v, F.lit("None")) if v is not None else F.lit("None"))
             for name, v in zip(FIELDS, values)]
    return F.concat(F.lit(START + "\n"), F.concat_ws("\n", *lines), F.lit(f"\n{_INDENT}{END}\n"), html)


def snapshot_name(unique_page_name: Column, saved_at: Column) -> Column:
    return F.concat(F.lit("soup_"), unique_page_name, F.lit("_"), F.date_format(saved_at, "yyMMdd_HHmm"), F.lit(".txt"))


def snapshots(pages: DataFrame, saved_at: Column) -> DataFrame:
    """(name, saved_at, content) for pages having url, website, suffix, path, unique_page_name, html."""
    return pages.select(
        snapshot_name(F.col("unique_page_name"), saved_at).alias("name"), saved_at.alias("saved_at"),
        snapshot_text(F.col("url"), F.col("html"), F.col("website"), F.col("path"), F.col("suffix"),
                      F.col("unique_page_name")).alias("content"))


def write_snapshots(saved: DataFrame, path: str) -> None:
    """Append to a Parquet table laid out by day; the names serve as the manifest."""
    saved.withColumn("day", F.to_date("saved_at")).write.mode("append").partitionBy("day").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The parsed snapshots of a table written by `write_snapshots`."""
    return parse_snapshots(spark.read.parquet(path))


def read_snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """The parsed snapshots of a folder of text files: (name, url, .., html)."""
    files = spark.read.text(path, wholetext=True)
    return parse_snapshots(files.select(F.input_file_name().alias("name"), F.col("value").alias("content")))


def parse_snapshots(saved: DataFrame) -> DataFrame:
    """Replace `content` by its metadata fields and `html`.

    Without a start marker all of it is html; without an end marker all is metadata and html is
    empty. A field's value is what follows the first `": "` of its line; the last line wins. The
    newline ending the header is not part of the html.
    """
    content = F.col("content")
    started = F.instr(content, F.lit(START))
    rest = F.substr(content, started + len(START))
    ended = F.instr(rest, F.lit(END))
    meta = F.when(started == 0, F.lit("")).when(ended == 0, rest).otherwise(F.substr(rest, F.lit(1), ended - 1))
    html = F.when(started == 0, content).when(ended == 0, F.lit("")).otherwise(
        F.regexp_replace(F.substr(rest, ended + len(END)), r"\A\n", ""))
    df = saved.withColumn("_meta", F.split(meta, "\n")).withColumn("html", html)
    for name in FIELDS:
        mine = F.filter("_meta", lambda line: strip(line).startswith(f"{name}: "))
        value = F.regexp_replace(strip(F.get(mine, F.size(mine) - 1)), f"^{name}: ", "")
        df = df.withColumn(name, strip(value))
    return df.drop("content", "_meta")


def manifest(saved: DataFrame) -> DataFrame:
    """(name, saved_at), newest first."""
    return saved.select("name", "saved_at").orderBy(F.desc("saved_at"), F.desc("name"))


def latest_snapshot(saved: DataFrame, key: str = "unique_page_name") -> DataFrame:
    """The newest snapshot name per page. Only names meet in the shuffle, after a partial maximum."""
    return saved.groupBy(key).agg(
        F.max(F.struct("saved_at", "name")).alias("m")).select(key, "m.saved_at", "m.name")

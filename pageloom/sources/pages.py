"""Readers for pages and URL lists, and the dispatch over input kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.urls import search_url

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html) from Parquet."""
    return spark.read.schema(PAGES).parquet(path)


def read_url_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """URLs from a headerless CSV's first column: (url).

    A blank line is an error when `strict`; otherwise it is left out here and can be had from
    `blank_lines`. The CSV reader would drop blank lines unseen, so lines are read as text;
    a quoted field must not span lines.
    """
    lines = spark.read.text(path)
    first = F.from_csv("value", "url string, rest string")["url"]
    blank = F.trim(F.regexp_replace("value", r"\r\z", "")) == ""
    if strict:
        first = F.when(blank, F.raise_error(F.lit("a row of the URL list is empty"))).otherwise(first)
        return lines.select(first.alias("url"))
    return lines.where(~blank).select(first.alias("url"))


def blank_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many blank lines each URL-list file has: (file, n_blank)."""
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), (F.trim(F.regexp_replace("value", r"\r\z", "")) == "").alias("blank"))
    return lines.groupBy("file").agg(F.count_if("blank").alias("n_blank"))


def read_html_files(
    spark: SparkSession, path: str, url: str | None = None, website: str | None = None,
    page_path: str | None = None, unique_page_name: str | None = None,
) -> DataFrame:
    """Whole HTML files with the caller's description: (file, url, website, path, unique_page_name, html).

    Without a `url` the file's own location stands in.
    """
    files = spark.read.text(path, wholetext=True)
    given = F.lit(url) if url is not None else F.input_file_name()
    return files.select(
        F.input_file_name().alias("file"), given.alias("url"), F.lit(website).alias("website"),
        F.lit(page_path).alias("path"), F.lit(unique_page_name).alias("unique_page_name"),
        F.col("value").alias("html"))


def _single_url(spark: SparkSession, url: str) -> DataFrame:
    return spark.range(1).select(F.lit(url).alias("url"))


def _search_results(spark: SparkSession, path: str) -> DataFrame:
    """One search URL per line of a text file of queries."""
    return spark.read.text(path).select(search_url(F.col("value")).alias("url"))


_KINDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "single_url": _single_url, "csv": read_url_list, "search_results": _search_results,
}


def load_urls(spark: SparkSession, kind: str, source: str) -> DataFrame:
    """URLs to scrape by input kind: `single_url`, `csv` or `search_results`."""
    if kind not in _KINDS:
        raise NotImplementedError(f"unknown input kind {kind!r}; known: {sorted(_KINDS)}")
    return _KINDS[kind](spark, source)

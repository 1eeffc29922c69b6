"""Streaming forms: continuous page ingest into the store, and deduplication of a URL frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions.urls import canonical_url
from pageloom.operators.store import (
    RESULT_UPDATES, heading_structure_rows, image_store_rows, latest_version, link_store_rows, merge_into, new_domains, new_webpages,
    replace_into, result_rows, sitemap_content_rows, sitemap_url_rows, structured_data_rows,
)
from pageloom.operators.sitemaps import sitemap_links
from pageloom.plans.crawl import crawl_items
from pageloom.sources.pages import PAGES
from pageloom.session import run_dir
from pageloom.sources.tables import create_store, fill, read_table, row_key


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 64, pattern: str | None = None) -> DataFrame:
    """Pages from Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


# The tables a page's item goes into. Sitemaps are files of a site, not of a page: see `ingest_sitemaps`.
ITEM_TABLES = ("domains", "webpages", "scrape_results", "links", "images", "heading_structures", "structured_data")


def store_pages(store: str, pages: DataFrame, as_of: Column, writers: int = 1) -> None:
    """Crawl items of a batch of pages in all of ITEM_TABLES: keyed rows upserted, a page's fan-out replaced.

    Items are made once, written to the shared folder and read from there for every table. Of several
    versions of a page in a batch the latest counts, in all tables: by `fetched_at` where the pages have it, then by page_id.
    """
    spark = pages.sparkSession
    folder = run_dir(spark, "items")
    order = [c for c in ("fetched_at", "page_id") if c in pages.columns]
    staged = pages.select("page_id", "url", "html", *(c for c in order if c != "page_id")).withColumn("_row", F.monotonically_increasing_id())
    staged.write.parquet(f"{folder}/pages")
    staged = spark.read.schema(staged.schema).parquet(f"{folder}/pages")
    latest_version(staged, ["url"], order, "_row").drop("_row").transform(crawl_items).write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")
    urls = items.select("url")
    merge_into(store, "domains", new_domains(read_table(spark, store, "domains"), urls, as_of), update=(), writers=writers)
    merge_into(store, "webpages", new_webpages(read_table(spark, store, "webpages"), urls, as_of), update=(), writers=writers)
    merge_into(store, "scrape_results", result_rows(items, as_of), update=RESULT_UPDATES, writers=writers)
    for table, rows in (("links", link_store_rows), ("images", image_store_rows)):
        replace_into(store, table, fill(table, rows(items), as_of), items.select(row_key("url").alias("page_id")), writers)
    for table, rows in (("heading_structures", heading_structure_rows), ("structured_data", structured_data_rows)):
        replace_into(store, table, fill(table, rows(items), as_of), items.select(row_key(row_key("url")).alias("result_id")), writers)


def ingest(pages: DataFrame, store: str, checkpoint: str, as_of: Column | None = None,
           trigger: dict | None = None, buckets: int | None = None) -> StreamingQuery:
    """Start writing a page stream into the store at `store`.

    Every write is keyed, so a batch repeated after a failure leaves the same rows.
    """
    stamp = F.current_timestamp() if as_of is None else as_of
    create_store(pages.sparkSession, store, ITEM_TABLES, buckets)

    def write(batch: DataFrame, _: int) -> None:
        store_pages(store, batch, stamp)

    return (pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


SITEMAP_TABLES = ("domains", "sitemap_urls", "sitemap_contents")
FILES = "url string, body string"


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Fetched robots.txt and sitemap files (url, body) from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def store_sitemaps(store: str, files: DataFrame, as_of: Column, writers: int = 1) -> None:
    """What a batch of files says, in all of SITEMAP_TABLES: the sitemaps a file lists, and the bodies of sitemap files.

    Rows belong to the file's site and are keyed by it and the URL, so a file that comes again changes nothing and a new body
    takes the place of the old.
    """
    spark = files.sparkSession
    folder = f"{run_dir(spark, 'sitemaps')}/files"
    files.select("url", "body").where("url is not null and body is not null").write.parquet(folder)
    files = spark.read.schema(FILES).parquet(folder)
    merge_into(store, "domains", new_domains(read_table(spark, store, "domains"), files.select("url"), as_of), update=(), writers=writers)
    listed = sitemap_links(files).where("is_sitemap").select(F.col("url").alias("sitemap_entry"), F.col("listed").alias("url"))
    merge_into(store, "sitemap_urls", sitemap_url_rows(listed), update=(), writers=writers)
    bodies = files.where("url not like '%/robots.txt'").select(F.col("url").alias("sitemap_entry"), "url", F.col("body").alias("content"))
    merge_into(store, "sitemap_contents", sitemap_content_rows(bodies, as_of), writers=writers)


def ingest_sitemaps(files: DataFrame, store: str, checkpoint: str, as_of: Column | None = None,
                    trigger: dict | None = None, buckets: int | None = None) -> StreamingQuery:
    """Start writing a stream of files (url, body) into the store at `store`; a replay leaves the same rows."""
    stamp = F.current_timestamp() if as_of is None else as_of
    create_store(files.sparkSession, store, SITEMAP_TABLES, buckets)
    return (files.writeStream.foreachBatch(lambda batch, _: store_sitemaps(store, batch, stamp)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def new_urls(urls: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """A stream of (url, event_time, ..) with URLs seen within the watermark dropped, by canonical form.

    State holds one key per URL for as long as `delay`, then lets it go: a URL that comes again later
    is given out again, and a row older than the watermark is dropped, as its key may be gone. `streaming.frontier`
    remembers every URL and loses none.
    """
    keyed = urls.withColumn("canonical_url", canonical_url(F.col("url")))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["canonical_url"])


def unseen(urls: DataFrame, given_out: DataFrame) -> DataFrame:
    """The rows of `urls` (a batch) whose canonical URL is not in `given_out` (canonical_url), one per URL."""
    keyed = urls.withColumn("canonical_url", canonical_url(F.col("url")))
    return keyed.dropDuplicates(["canonical_url"]).join(given_out.select("canonical_url"), "canonical_url", "left_anti")

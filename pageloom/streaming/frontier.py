"""The crawl frontier as a stream that never forgets: every canonical URL is given out once, however late it comes back.

What was given out is a table in buckets of canonical URLs, a folder per stream and batch; a batch reads only the buckets its URLs
fall in. A batch that is repeated writes its own folder again and does not see it, so it gives out the same rows; a
stream begun anew sees what others gave out. State is on disk and grows with the URLs; `compact` puts folders together.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions.urls import canonical_url
from pageloom.session import run_dir

ROW = "canonical_url string, url string, seen_at timestamp, late boolean"
SEEN, MARKS = f"{ROW}, source string, batch long, bucket int", "newest timestamp, source string, batch long"
BUCKETS = 64
# URLs a task writes, about.
URLS_PER_WRITER = 200_000


def _folder(store: str, kind: str, source: str, batch: int) -> str:
    return f"{store}/{kind}/source={source}/batch={batch}"


def source_of(checkpoint: str) -> str:
    """The name of the stream with that checkpoint."""
    return "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def given_out(spark: SparkSession, store: str) -> DataFrame:
    """Every URL given out: canonical_url, the url and time it was first met with, whether it came late, source, batch, bucket."""
    return spark.read.schema(SEEN).parquet(f"{store}/seen")


def _marks(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(MARKS).parquet(f"{store}/marks")


def on_time(spark: SparkSession, store: str) -> DataFrame:
    return given_out(spark, store).where("not late")


def late(spark: SparkSession, store: str) -> DataFrame:
    """URLs first met with more than the delay behind the newest time of the batches before: new, but set aside."""
    return given_out(spark, store).where("late")


def store_urls(store: str, urls: DataFrame, source: str, batch: int, event_time: str, delay: str, buckets: int = BUCKETS) -> None:
    """Give out the URLs of a batch that nothing before it has: of a URL's rows the earliest, by time and then by URL.

    Rows without a URL or time are left out.
    """
    spark, time = urls.sparkSession, F.col(event_time).cast("timestamp")
    # Empty folders, so that the first batch has tables to read.
    spark.createDataFrame([], SEEN).write.mode("ignore").partitionBy("source", "batch", "bucket").parquet(f"{store}/seen")
    spark.createDataFrame([], MARKS).write.mode("ignore").partitionBy("source", "batch").parquet(f"{store}/marks")
    staged = f"{run_dir(spark, 'urls')}/urls"
    rows = urls.select(canonical_url(F.col("url")).alias("canonical_url"), "url", time.alias("seen_at")).where("canonical_url is not null and seen_at is not null")
    rows = rows.groupBy("canonical_url").agg(F.min(F.struct("seen_at", "url")).alias("first")).select("canonical_url", "first.url", "first.seen_at")
    rows.withColumn("bucket", F.pmod(F.xxhash64("canonical_url"), F.lit(buckets)).cast("int")).write.parquet(staged)
    rows = spark.read.schema("canonical_url string, url string, seen_at timestamp, bucket int").parquet(staged)
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets
    earlier = (F.col("source") != source) | (F.col("batch") < batch)
    known = given_out(spark, store).where(earlier & F.col("bucket").isin(touched)).select("canonical_url", "bucket")
    newest = _marks(spark, store).where((F.col("source") == source) & (F.col("batch") < batch)).agg(F.max("newest")).first()[0]
    behind: Column = F.lit(False) if newest is None else F.col("seen_at") < F.lit(newest) - F.expr(f"INTERVAL {delay}")
    fresh = rows.join(known, ["canonical_url", "bucket"], "left_anti").select("canonical_url", "url", "seen_at", behind.alias("late"), "bucket")
    # Large batches are written by several tasks a bucket.
    part = F.pmod(F.xxhash64(F.lit("part"), "canonical_url"), F.lit(-(-rows.count() // URLS_PER_WRITER) or 1))
    fresh.repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(_folder(store, "seen", source, batch))
    urls.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(_folder(store, "marks", source, batch))


def frontier(urls: DataFrame, store: str, checkpoint: str, event_time: str = "seen_at", delay: str = "1 day",
             trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Start giving out the new URLs of a stream (url, `event_time`) into the store at `store`."""
    def write(batch: DataFrame, number: int) -> None:
        store_urls(store, batch, source_of(checkpoint), number, event_time, delay, buckets)

    return (urls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def compact(spark: SparkSession, store: str, checkpoint: str, upto: int) -> None:
    """Put the folders of a stream's batches up to `upto` into that one; later batches and readers of the whole notice nothing.

    For a time when no batch runs. The merged folder is written aside first; older ones are emptied only after it is in place.
    """
    source = source_of(checkpoint)
    mine = (F.col("source") == source) & (F.col("batch") <= upto)
    for kind, table, parts in (("seen", given_out(spark, store), ["bucket"]), ("marks", _marks(spark, store), [])):
        old = sorted(r["batch"] for r in table.where(mine).select("batch").distinct().collect())
        if len(old) < 2:
            continue
        aside = f"{run_dir(spark, 'compact')}/{kind}"
        rows = table.where(mine).drop("source", "batch")
        rows.write.parquet(aside)
        merged = spark.read.schema(rows.schema).parquet(aside)
        (merged.repartition(*parts) if parts else merged.coalesce(1)).write.mode("overwrite").partitionBy(*parts).parquet(_folder(store, kind, source, upto))
        for batch in old:
            if batch != upto:
                merged.limit(0).write.mode("overwrite").partitionBy(*parts).parquet(_folder(store, kind, source, batch))

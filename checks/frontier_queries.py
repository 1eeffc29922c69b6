"""Queries over shared sitemaps and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as D
from checks.registry import register
from pageloom.operators import audits as A
from pageloom.operators import frontier as R
from pageloom.operators import store as St
from pageloom.session import run_dir
from pageloom.sources import tables as T
from pageloom.streaming import frontier as Q
from pageloom.streaming import ingest as I

# A file is reached from the suppliers that list it or a file above it; files below the last part are listed and not there.
_ABOVE = f"""WITH RECURSIVE top AS (SELECT max(p_partkey) AS top FROM part),
node AS (SELECT unnest(range(0, {D.FAN_OUT} * top + {D.FAN_OUT} + 1)) AS p FROM top),
above(p, a) AS (SELECT p, p FROM node UNION ALL SELECT p, (a - 1) // {D.FAN_OUT} FROM above WHERE a > 0),
listed AS (SELECT DISTINCT s_suppkey AS s, unnest([s_suppkey % {D.MAPS}, s_suppkey * 7 % {D.MAPS}]) AS a FROM supplier),
reached AS (SELECT DISTINCT s, p FROM above JOIN listed USING (a))"""


def _seeds(files: DataFrame) -> DataFrame:
    return files.where("url like '%/robots.txt'").select(F.col("url").alias("seed"))


@register(f"""{_ABOVE}
SELECT 'https://maps.example.com/sitemap' || p || '.xml' AS url, count(*) AS n_seeds, min('https://sup' || s || '.example.com/robots.txt') AS first_seed,
  max('https://sup' || s || '.example.com/robots.txt') AS last_seed FROM reached GROUP BY p
UNION ALL SELECT 'https://sup' || s_suppkey || '.example.com/robots.txt', 1, 'https://sup' || s_suppkey || '.example.com/robots.txt',
  'https://sup' || s_suppkey || '.example.com/robots.txt' FROM supplier""")
def sitemap_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the seeds that reach it, told by one set for all files alike."""
    files = D.shared_maps(spark, sf_dir)
    found = R.reach(_seeds(files), files)
    sets = R.used_sets(found).groupBy("seeds").agg(F.count("*").alias("n_seeds"), F.min("seed").alias("first_seed"), F.max("seed").alias("last_seed"))
    return found.urls.join(sets, "seeds").drop("seeds")


@register(f"""{_ABOVE}
SELECT 'https://sup' || s || '.example.com/robots.txt' AS seed, count(*) AS n_pages, min('https://maps.example.com/part/' || p) AS first_page
FROM reached WHERE p IN (SELECT p_partkey FROM part) GROUP BY s""")
def sitemap_reach_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages each seed leads to: counted per set of seeds, then added up over a seed's sets, which share no page here."""
    files = D.shared_maps(spark, sf_dir)
    found = R.reach(_seeds(files), files)
    counts = R.listed_pages(found, files).groupBy("seeds").agg(F.count("*").alias("n"), F.min("url").alias("first"))
    return R.used_sets(found).join(counts, "seeds").groupBy("seed").agg(F.sum("n").alias("n_pages"), F.min("first").alias("first_page"))


# An event is a visit: its user and value make the URL, written in several ways. Batches follow the clock, but one visit in seven comes a batch
# late and one in eleven two batches. A URL is given out with its first batch, by its earliest time there.
_VISITS = """visit AS (SELECT ts, 'https://site' || user_id % 13 || '.example.com/u/' || user_id || '/' || (round(value)::BIGINT % 5) AS canonical_url,
  least(day(ts) // 6 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END, 5) AS batch FROM events),
first AS (SELECT canonical_url, min(batch) AS batch FROM visit GROUP BY 1),
met AS (SELECT f.canonical_url, f.batch, min(ts) AS seen_at FROM first f JOIN visit v ON v.canonical_url = f.canonical_url AND v.batch = f.batch GROUP BY 1, 2)"""


VISITS_PER_FILE = 25_000


def _visits(spark: SparkSession, sf_dir: str, path: str) -> int:
    """The visits written batch by batch, as files of a stream; how many files make a batch, the same for all."""
    n = F.col("event_id")
    url = F.concat(F.lit("https://site"), (F.col("user_id") % 13).cast("string"), F.lit(".example.com/u/"), F.col("user_id").cast("string"), F.lit("/"),
                   (F.round("value").cast("long") % 5).cast("string"))
    odd = F.when(n % 3 == 0, F.concat(url, F.lit("?a="), n.cast("string"))).when(n % 3 == 1, F.concat(url, F.lit("#x"))).otherwise(url)
    late = F.when(n % 7 == 0, 1).otherwise(0) + F.when(n % 11 == 0, 2).otherwise(0)
    visits = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        odd.alias("url"), F.col("ts").cast("timestamp").alias("seen_at"), F.least(F.floor(F.dayofmonth("ts") / 6).cast("int") + late, F.lit(5)).alias("batch"))
    sizes = {r["batch"]: r["count"] for r in visits.groupBy("batch").count().collect()}
    files = max(1, min(sizes.get(batch, 0) for batch in range(6)) // VISITS_PER_FILE)
    for batch in range(6):
        mine = visits.where(F.col("batch") == batch).drop("batch")
        (mine.repartition(files) if files > 1 else mine.coalesce(1)).write.mode("append").parquet(path)
    return files


@register(f"""WITH {_VISITS}, marks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM visit GROUP BY batch)
SELECT canonical_url, met.batch::BIGINT AS batch, seen_at, coalesce(seen_at < newest - INTERVAL 2 DAY, false) AS late FROM met JOIN marks USING (batch)""")
def frontier_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits streamed twice, the second time as another stream, which finds nothing new; folders are put together in between."""
    path = run_dir(spark, "frontier")
    files = _visits(spark, sf_dir, f"{path}/in")
    for run in ("first", "again"):
        urls = spark.readStream.schema("url string, seen_at timestamp").option("maxFilesPerTrigger", files).parquet(f"{path}/in")
        Q.frontier(urls, f"{path}/store", f"{path}/{run}", delay="2 days", trigger={"availableNow": True}, buckets=8).awaitTermination()
    found = Q.given_out(spark, f"{path}/store")
    first = found.where(F.col("source") == Q.source_of(f"{path}/first"))
    extra = found.where(F.col("source") != Q.source_of(f"{path}/first"))
    return first.unionByName(extra).select("canonical_url", "batch", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "late")


_FILES_SQL = f"""SELECT 'https://maps.example.com/sitemap' || p_partkey || '.xml' AS url, 'https://maps.example.com' AS site,
  list_transform(range(1, {D.FAN_OUT + 1}), lambda k: 'https://maps.example.com/sitemap' || (p_partkey * {D.FAN_OUT} + k) || '.xml') AS listed, true AS has_body FROM part
UNION ALL SELECT 'https://sup' || s_suppkey || '.example.com/robots.txt', 'https://sup' || s_suppkey || '.example.com',
  ['https://maps.example.com/sitemap' || s_suppkey % {D.MAPS} || '.xml', 'https://maps.example.com/sitemap' || s_suppkey * 7 % {D.MAPS} || '.xml'], false FROM supplier"""


@register(f"""SELECT site, n_urls, n_bodies, low FROM (
 SELECT site, count(DISTINCT u) AS n_urls, min(u) AS low FROM (SELECT site, unnest(listed) AS u FROM ({_FILES_SQL})) GROUP BY site) JOIN (
 SELECT site, count_if(has_body) AS n_bodies FROM ({_FILES_SQL}) GROUP BY site) USING (site)""")
def stream_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots and sitemap files through the stream into the store, twice, and read back by site."""
    path = run_dir(spark, "sitemap-stream")
    D.shared_maps(spark, sf_dir).write.parquet(f"{path}/in")
    for run in ("first", "again"):
        files = I.file_stream(spark, f"{path}/in")
        I.ingest_sitemaps(files, f"{path}/store", f"{path}/{run}", F.lit("2026-01-01 00:00:00").cast("timestamp"), {"availableNow": True}, buckets=4).awaitTermination()
    sites = T.read_table(spark, f"{path}/store", "domains").select(F.col("id").alias("domain_id"), F.col("url").alias("site"))
    urls = T.read_table(spark, f"{path}/store", "sitemap_urls").groupBy("domain_id").agg(F.count("*").alias("n_urls"), F.min("url").alias("low"))
    bodies = T.read_table(spark, f"{path}/store", "sitemap_contents").groupBy("domain_id").agg(F.count("*").alias("n_bodies"))
    return sites.join(urls, "domain_id").join(bodies, "domain_id", "left").select("site", "n_urls", F.coalesce("n_bodies", F.lit(0).cast("long")).alias("n_bodies"), "low")


def _whole_store(spark: SparkSession, sf_dir: str) -> str:
    """A store with rows in all 17 tables: sites are suppliers, pages parts of a supplier, and what hangs on them."""
    path = run_dir(spark, "store")
    T.create_store(spark, path, buckets=4)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    site = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), text("https://sup", "s_suppkey").alias("url"), F.col("s_nationkey").alias("nation"))
    sites = site.count()
    page = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), text("https://page/", "p_partkey").alias("url"), (F.col("p_partkey") % sites).alias("domain_id"))
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    i = F.col("id")
    rows = {
        "scrape_methods": name, "scrape_combinations": name.withColumn("description", F.lit("all")), "combination_methods": name.select(i.alias("combination_id"), i.alias("method_id")),
        "apis": name.select("id", "name", F.lit("{}").alias("details")), "domains": site, "domain_scrape_methods": site.select("id", F.col("url").alias("domain_url"), F.col("nation").alias("scrape_method_id")),
        "technology_stacks": site.select("id", i.alias("domain_id"), F.lit("cms").alias("category")), "webpages": page,
        "sitemap_urls": site.select("id", i.alias("domain_id"), "url"), "sitemap_contents": site.select("id", i.alias("domain_id"), F.lit("x").alias("content")),
        "links": page.select("id", i.alias("page_id"), F.lit("/").alias("href")), "images": page.select("id", i.alias("page_id"), F.lit("/i").alias("src")),
        "scrape_results": page.where("id % 2 = 0").select("id", i.alias("webpage_id"), F.lit("t").alias("title")),
        "heading_structures": page.where("id % 2 = 0").select("id", i.alias("result_id"), F.lit("{}").alias("data")),
        "structured_data": page.where("id % 2 = 0").select("id", i.alias("result_id"), F.lit("[]").alias("schema_org_data")),
        "scrape_tasks": page.select("id", F.col("url").alias("url_to_scrape"), i.alias("webpage_id"), F.when(i % 2 == 0, i).alias("scrape_result_id")),
        "scrape_histories": page.select("id", i.alias("task_id"), F.lit("completed").alias("status"))}
    for table in T.TABLES:
        St.merge_into(path, table, T.fill(table, rows[table], now))
    return path


@register("""SELECT * FROM (SELECT 'webpages' AS name, count_if(p_partkey % 6 <> 1) AS n, 0::BIGINT AS n_null FROM part
UNION ALL SELECT unnest(['links', 'images']), count_if(p_partkey % 6 <> 1), 0 FROM part
UNION ALL SELECT unnest(['scrape_results', 'heading_structures', 'structured_data']), count_if(p_partkey % 2 = 0), 0 FROM part
UNION ALL SELECT 'scrape_tasks', count(*), count_if(p_partkey % 6 = 1) FROM part UNION ALL SELECT 'scrape_histories', count(*), 0 FROM part
UNION ALL SELECT unnest(['domains', 'domain_scrape_methods', 'technology_stacks', 'sitemap_urls', 'sitemap_contents']), count(*), 0 FROM supplier
UNION ALL SELECT unnest(['scrape_methods', 'scrape_combinations', 'combination_methods', 'apis']), count(*), 0 FROM nation)""")
def delete_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 17 tables written; pages without a result deleted with what hangs on them, twice; a page with one may not be."""
    path = _whole_store(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    try:
        St.delete_stored(path, "webpages", T.read_table(spark, path, "webpages").where("id % 6 = 2"))
        raise AssertionError("pages with results were deleted")
    except ValueError:
        pass
    for _ in range(2):
        St.delete_stored(path, "webpages", pages.where("id % 6 = 1"))
    out = None
    for table in T.TABLES:
        rows = T.read_table(spark, path, table)
        null = F.count_if(F.col("webpage_id").isNull()) if table == "scrape_tasks" else F.lit(0).cast("long")
        one = rows.agg(F.count("*").alias("n"), null.alias("n_null")).select(F.lit(table).alias("name"), "n", "n_null")
        out = one if out is None else out.unionByName(one)
    return out


_SITE = "regexp_extract(url, '^https?://[^/?#]*')"


@register(f"""WITH p AS (SELECT page_id, url, {_SITE} AS site FROM pages), https AS (SELECT DISTINCT site FROM p WHERE site LIKE 'https%')
SELECT 'webpages' AS "table", 'foreign key' AS "check", 'domain_id' AS detail, (SELECT count(*) FROM p WHERE site NOT IN (SELECT site FROM https)) AS n
UNION ALL SELECT 'links', 'foreign key', 'page_id', (SELECT count(*) FROM p WHERE page_id % 3 = 0)
UNION ALL SELECT 'links', 'not null', 'href', (SELECT count(*) FROM p WHERE page_id % 4 = 0)
UNION ALL SELECT 'domains', 'not null', 'url', 0""")
def audit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three merges that leave references without rows and missing values, counted as they go; equal to the audit of all rows."""
    path = run_dir(spark, "audited")
    used = ["domains", "webpages", "links"]
    T.create_store(spark, path, used, buckets=4)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    site = F.regexp_extract("url", "^https?://[^/?#]*", 0)
    key = T.row_key("url")
    sites = pages.where("url like 'https%'").select(site.alias("url")).distinct()
    webpages = pages.select(key.alias("id"), "url", T.row_key(site).alias("domain_id"))
    stray = F.when(F.col("page_id") % 3 == 0, F.lit(-1) - F.col("page_id")).otherwise(key)
    links = pages.select(F.col("page_id").alias("id"), stray.alias("page_id"), F.when(F.col("page_id") % 4 > 0, F.lit("/x")).alias("href"))
    for table in used:
        A.recount(spark, path, table)
    A.merge_counted(path, "domains", T.fill("domains", sites.select(T.row_key("url").alias("id"), "url"), now))
    A.merge_counted(path, "webpages", T.fill("webpages", webpages, now))
    A.merge_counted(path, "links", T.fill("links", links, now))
    found = A.audit_stored(spark, path, used)
    whole = St.audit({t: T.read_table(spark, path, t).drop("bucket") for t in used})
    differ = found.exceptAll(whole).unionByName(whole.exceptAll(found)).agg(F.count("*").alias("n"))
    return found.unionByName(differ.select(F.lit("domains").alias("table"), F.lit("not null").alias("check"), F.lit("url").alias("detail"), "n"))

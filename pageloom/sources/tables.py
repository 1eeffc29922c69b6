"""The crawl store's tables: schemas, defaults and constraints, and creating them."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
NOW = "now"  # a default: the job's `as_of`


@dataclass(frozen=True)
class Table:
    columns: dict[str, str]  # name -> type; a trailing ! means not null
    unique: tuple[tuple[str, ...], ...] = ()
    # column -> (parent table, parent column, what happens on delete)
    foreign: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _TYPES[t.rstrip("!")]) for n, t in self.columns.items()])

    @property
    def not_null(self) -> list[str]:
        return [n for n, t in self.columns.items() if t.endswith("!")]


_DOMAIN = {"domain_id": ("domains", "id", "restrict")}
_PAGE = {"page_id": ("webpages", "id", "cascade")}
_RESULT = {"result_id": ("scrape_results", "id", "cascade")}

TABLES: dict[str, Table] = {
    "scrape_methods": Table({"id": "long", "name": "string!", "description": "string"}, unique=(("name",),)),
    "domains": Table(
        {"id": "long", "url": "string!", "server_type": "string", "robots_txt": "string", "rate_limit_info": "string",
         "security_policies": "string", "redirection_patterns": "string", "last_updated": "timestamp"},
        unique=(("url",),)),
    "domain_scrape_methods": Table(
        {"id": "long", "domain_url": "string!", "scrape_method_id": "long!"},
        unique=(("domain_url", "scrape_method_id"),),
        foreign={"domain_url": ("domains", "url", "restrict"), "scrape_method_id": ("scrape_methods", "id", "restrict")}),
    "sitemap_urls": Table({"id": "long", "domain_id": "long!", "url": "string!"}, foreign=_DOMAIN),
    "sitemap_contents": Table(
        {"id": "long", "domain_id": "long!", "content": "string!", "last_fetched": "timestamp"},
        foreign=_DOMAIN, defaults={"last_fetched": NOW}),
    "webpages": Table(
        {"id": "long", "url": "string!", "domain_id": "long!", "http_status": "long!", "access_timestamp": "timestamp!",
         "meta_tags": "string", "content_type": "string", "page_load_time": "double", "page_size": "long",
         "language": "string", "page_specific_cookies": "string", "redirection_info": "string",
         "link_headers": "string", "last_updated": "timestamp!"},
        unique=(("url",),), foreign=_DOMAIN,
        defaults={"http_status": 200, "access_timestamp": NOW, "last_updated": NOW}),
    "links": Table(
        {"id": "long", "page_id": "long!", "text": "string", "href": "string!", "class_attr": "string", "id_attr": "string"},
        foreign=_PAGE),
    "images": Table(
        {"id": "long", "page_id": "long!", "src": "string!", "alt": "string", "class_attr": "string", "id_attr": "string"},
        foreign=_PAGE),
    "scrape_tasks": Table(
        {"id": "long", "url_to_scrape": "string!", "force_new_scrape": "boolean!", "priority": "long!",
         "date_added": "timestamp", "preprocess_status": "string!", "scrape_status": "string!", "webpage_id": "long",
         "scrape_result_id": "long"},
        foreign={"webpage_id": ("webpages", "id", "set null"), "scrape_result_id": ("scrape_results", "id", "set null")},
        defaults={"force_new_scrape": False, "priority": 5, "date_added": NOW, "preprocess_status": "pending",
                  "scrape_status": "pending"}),
    "scrape_results": Table(
        {"id": "long", "webpage_id": "long!", "title": "string", "content": "string", "last_updated": "timestamp",
         "content_length": "long", "content_hash": "string"},
        unique=(("webpage_id",),), foreign={"webpage_id": ("webpages", "id", "restrict")},
        defaults={"last_updated": NOW, "content_length": 0}),
    "heading_structures": Table(
        {"id": "long", "result_id": "long!", "data": "string!"}, unique=(("result_id",),), foreign=_RESULT),
    "structured_data": Table(
        {"id": "long", "result_id": "long!", "schema_org_data": "string!"}, unique=(("result_id",),), foreign=_RESULT),
    "scrape_histories": Table(
        {"id": "long", "task_id": "long!", "date_scraped": "timestamp", "status": "string!"},
        foreign={"task_id": ("scrape_tasks", "id", "cascade")}, defaults={"date_scraped": NOW}),
    "scrape_combinations": Table({"id": "long", "name": "string!", "description": "string"}, unique=(("name",),)),
    "combination_methods": Table(
        {"combination_id": "long!", "method_id": "long!"}, unique=(("combination_id", "method_id"),),
        foreign={"combination_id": ("scrape_combinations", "id", "restrict"), "method_id": ("scrape_methods", "id", "restrict")}),
    "apis": Table({"id": "long", "name": "string!", "details": "string!", "documentation_url": "string"}),
    "technology_stacks": Table(
        {"id": "long", "domain_id": "long!", "cms_technology": "string", "category": "string!", "version": "string",
         "last_updated": "timestamp"},
        unique=(("domain_id", "category"),), foreign=_DOMAIN, defaults={"last_updated": NOW}),
}


def row_key(*natural: Column | str) -> Column:
    """Surrogate key from a natural key: the same on every run and every executor; NULL when all of it is NULL."""
    columns = [F.col(n) if isinstance(n, str) else n for n in natural]
    known = columns[0].isNotNull()
    for column in columns[1:]:
        known = known | column.isNotNull()
    return F.when(known, F.xxhash64(*columns))


def fill(table: str, rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows in the table's full shape: absent columns added, NULLs replaced by declared defaults."""
    spec = TABLES[table]
    columns = []
    for name, dtype in ((f.name, f.dataType) for f in spec.schema):
        value = F.col(name) if name in rows.columns else F.lit(None)
        if name in spec.defaults:
            default = spec.defaults[name]
            value = F.coalesce(value, as_of if default == NOW else F.lit(default))
        columns.append(value.cast(dtype).alias(name))
    return rows.select(*columns)


# Every table is laid out by a hash of one column, so that a write rewrites only the buckets it touches.
BUCKETED = {
    "domains": "url", "webpages": "url", "scrape_results": "webpage_id", "links": "page_id", "images": "page_id",
    "heading_structures": "result_id", "structured_data": "result_id", "sitemap_urls": "domain_id", "sitemap_contents": "domain_id",
    "scrape_methods": "name", "domain_scrape_methods": "domain_url", "scrape_tasks": "id", "scrape_histories": "task_id",
    "scrape_combinations": "name", "combination_methods": "combination_id", "apis": "id", "technology_stacks": "domain_id"}
# The key of an upsert where that column alone does not tell rows apart.
KEYS = {
    "links": ("page_id", "id"), "images": ("page_id", "id"), "sitemap_urls": ("domain_id", "id"), "sitemap_contents": ("domain_id", "id"),
    "domain_scrape_methods": ("domain_url", "scrape_method_id"), "scrape_histories": ("task_id", "id"),
    "combination_methods": ("combination_id", "method_id"), "technology_stacks": ("domain_id", "category")}
BUCKETS = 64


def upsert_key(table: str) -> tuple[str, ...]:
    return KEYS.get(table, (BUCKETED[table],))


def bucket(table: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(BUCKETED[table]), F.lit(buckets)).cast("int")


def bucket_count(spark: SparkSession, path: str) -> int:
    """The number of buckets the store at `path` was made with."""
    return spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]


def create_store(spark: SparkSession, path: str, only: Collection[str] | None = None, buckets: int | None = None) -> None:
    """An empty Parquet table per schema (or for the named ones) where there is none yet.

    The number of buckets is kept with the store; asking for another one later is an error.
    """
    layout = spark.createDataFrame([(buckets or BUCKETS,)], "buckets int")
    layout.write.mode("ignore").parquet(f"{path}/layout")
    there = bucket_count(spark, path)
    if buckets is not None and buckets != there:
        raise ValueError(f"the store has {there} buckets, not {buckets}: copy it into a new one")
    for name, spec in TABLES.items():
        if only is not None and name not in only:
            continue
        empty = spark.createDataFrame([], spec.schema).withColumn("bucket", F.lit(None).cast("int"))
        empty.write.mode("ignore").partitionBy("bucket").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = T.StructType([*TABLES[table].schema.fields, T.StructField("bucket", T.IntegerType())])
    # A row without a key only marks a bucket that has been emptied.
    return spark.read.schema(schema).parquet(f"{path}/{table}").where(F.col(BUCKETED[table]).isNotNull())

"""Jobs on the crawl store: keyed upserts, fan-out of items, audits, deletions, tasks.

Transformations return frames; `merge_into` is the one that writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import content_hash
from pageloom.functions.urls import domain_of, domain_url
from pageloom.session import run_dir
from pageloom.sources.tables import BUCKETED, TABLES, bucket, bucket_count, fill, read_table, row_key, upsert_key

RESULT_UPDATES = ("content", "content_hash", "title")
WEBPAGE_UPDATES = ("domain_id", "http_status", "access_timestamp", "content_type", "page_size", "language",
                   "page_specific_cookies", "redirection_info", "link_headers")
DOMAIN_UPDATES = ("last_updated", "server_type", "rate_limit_info", "security_policies")


# --- upserts
def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the greatest by `order`, then by content. Reduced before the shuffle too."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    picked = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("_row")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*rows.columns)


def latest_version(rows: DataFrame, keys: Sequence[str], order: Sequence[str], row: str) -> DataFrame:
    """The latest of `rows` by `order` for each key, told by narrow columns only: what else a row holds is in no aggregate.

    `row` numbers the rows, which must be stored, and decides between equals. Null keys are a key.
    """
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, row)).alias("_last")).select(F.col(f"_last.{row}").alias(row))
    return rows.join(last, row, "left_semi")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None,
           order: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """`target` after inserting new keys and updating known ones.

    Only the columns in `update` change on known keys (None: all but the keys); columns the
    source lacks are kept, or NULL in new rows. Of several source rows with a key the greatest
    by `order` counts; `unique` says there is but one. A source of unchanged rows changes
    nothing, so repeating is safe.
    """
    new = source if unique else latest_per_key(source, keys, order)
    update = [c for c in source.columns if c not in keys] if update is None else [c for c in update if c in source.columns]
    t = target.select(*keys, F.struct(*target.columns).alias("_t"))
    s = new.select(*keys, F.struct(*new.columns).alias("_s"))
    joined = t.join(s, list(keys), "full_outer")

    def column(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in new.columns:
            return F.col(f"_t.{name}")
        if name in update:
            return F.when(F.col("_s").isNotNull(), F.col(f"_s.{name}")).otherwise(F.col(f"_t.{name}"))
        return F.when(F.col("_t").isNotNull(), F.col(f"_t.{name}")).otherwise(F.col(f"_s.{name}"))

    return joined.select(*[column(c).alias(c) for c in target.columns])


def missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source's distinct keys not in the target: what get-or-create has to create."""
    return source.select(*keys).distinct().join(target.select(*keys), list(keys), "left_anti")


def new_domains(domains: DataFrame, urls: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append to `domains` for URLs of sites not there yet."""
    wanted = urls.select(domain_of(F.col("url")).alias("url")).where("url is not null")
    return fill("domains", missing(domains, wanted, ["url"]).withColumn("id", row_key("url")), as_of)


def new_webpages(webpages: DataFrame, urls: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append to `webpages` for URLs not there yet."""
    made = missing(webpages, urls, ["url"]).select(
        row_key("url").alias("id"), "url", row_key(domain_of(F.col("url"))).alias("domain_id"))
    return fill("webpages", made, as_of)


def result_rows(items: DataFrame, as_of: Column) -> DataFrame:
    """scrape_results rows of crawl items."""
    body = F.col("clean_body")
    return fill("scrape_results", items.select(
        row_key(row_key("url")).alias("id"), row_key("url").alias("webpage_id"), "title", body.alias("content"),
        F.length(body).alias("content_length"), content_hash(body).alias("content_hash")), as_of)


def response_rows(responses: DataFrame, as_of: Column) -> DataFrame:
    """webpages rows from responses (url, status, headers map, cookies, history, size).

    Cookies are `n=v` joined by `; `, redirects joined by ` -> ` or "No redirection".
    """
    cookies = F.transform("cookies", lambda c: F.concat(c["name"], F.lit("="), c["value"]))
    history = F.coalesce(F.col("history"), F.array().cast("array<string>"))
    return fill("webpages", responses.select(
        row_key("url").alias("id"), "url", row_key(domain_url(F.col("url"))).alias("domain_id"),
        F.col("status").alias("http_status"), as_of.alias("access_timestamp"),
        header("Content-Type").alias("content_type"), F.col("size").alias("page_size"),
        header("Content-Language").alias("language"),
        F.coalesce(F.array_join(cookies, "; "), F.lit("")).alias("page_specific_cookies"),
        F.when(F.size(history) == 0, "No redirection").otherwise(F.array_join(history, " -> ")).alias("redirection_info"),
        header("Link").alias("link_headers")), as_of)


def header(name: str) -> Column:
    """A response header's value, empty when absent; names match in any case."""
    hit = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit(""))


def domain_rows(responses: DataFrame, as_of: Column) -> DataFrame:
    """domains rows from responses: the server's headers."""
    return responses.select(
        row_key(domain_url(F.col("url"))).alias("id"), domain_url(F.col("url")).alias("url"),
        as_of.alias("last_updated"), header("Server").alias("server_type"),
        header("X-RateLimit-Limit").alias("rate_limit_info"),
        header("Content-Security-Policy").alias("security_policies"))


# Rows a task writes, about: of larger tables several tasks write a bucket.
ROWS_PER_WRITER = 100_000


def _rewrite(path: str, table: str, new: DataFrame, combine, writers: int) -> None:
    """Replace the buckets that `new` falls in by `combine(old rows, new rows)`.

    New rows and merged buckets are written aside in the shared folder first, then over the old ones:
    a failure in between leaves the old or the new rows, and the job can be repeated.
    """
    spark = new.sparkSession
    staged = f"{run_dir(spark, 'merge')}/{table}"
    new.withColumn("bucket", bucket(table, bucket_count(spark, path))).write.parquet(f"{staged}-new")
    new = spark.read.parquet(f"{staged}-new")
    # At most as many small integers as the store has buckets.
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    old = read_table(spark, path, table).where(F.col("bucket").isin(touched))
    combine(old, new).write.parquet(f"{staged}-merged")
    merged = spark.read.parquet(f"{staged}-merged")
    # Only buckets with rows are overwritten: one left empty gets a row of NULLs, which `read_table` leaves out.
    emptied = sorted(set(touched) - {r["bucket"] for r in merged.select("bucket").distinct().collect()})
    if emptied:
        marks = spark.createDataFrame([(b,) for b in emptied], "bucket int")
        merged = merged.unionByName(marks, allowMissingColumns=True)
    # By row and not by what the bucket is told from: all files of a site fall in one bucket.
    writers = max(writers, -(-merged.count() // ROWS_PER_WRITER))
    part = F.pmod(F.xxhash64(F.lit("part"), *upsert_key(table)), F.lit(writers))
    (merged.repartition("bucket", part).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{table}"))


def merge_into(path: str, table: str, source: DataFrame, update: Sequence[str] | None = None,
               order: Sequence[str] = (), writers: int = 1) -> None:
    """Upsert into a stored table by its key, reading and rewriting only the buckets the source falls in.

    `writers` tasks write a bucket, or more where the rows are many. Of two source rows with a key the greatest by the columns `order` counts, which need not be
    columns of the table.
    """
    keys, more = upsert_key(table), [c for c in order if c not in TABLES[table].columns]
    rows = latest_per_key(source.select(*TABLES[table].schema.names, *more), keys, order).drop(*more)
    _rewrite(path, table, rows, lambda old, new: upsert(old, new, [*keys, "bucket"], update, unique=True), writers)


def replace_into(path: str, table: str, rows: DataFrame, keys: DataFrame, writers: int = 1) -> None:
    """Put `rows` in place of all stored rows of the pages or results in `keys`, which may have no rows now."""
    key = BUCKETED[table]
    # A key without rows is a row of NULLs, so that its bucket is touched too.
    marked = rows.select(*TABLES[table].schema.names).withColumn("_row", F.lit(True))
    marked = marked.unionByName(keys.select(key).distinct().withColumn("_row", F.lit(False)), allowMissingColumns=True)

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        gone = new.where("not _row").select(key, "bucket")
        return old.join(gone, [key, "bucket"], "left_anti").select(*old.columns).unionByName(new.where("_row").select(*old.columns))

    _rewrite(path, table, marked, combine, writers)


# --- fan-out
def link_store_rows(items: DataFrame) -> DataFrame:
    """links rows of crawl items."""
    rows = items.select(row_key("url").alias("page_id"), F.posexplode("links").alias("pos", "l"))
    return rows.select(row_key("page_id", "pos").alias("id"), "page_id", "l.text", "l.href", "l.class_attr", "l.id_attr")


def image_store_rows(items: DataFrame) -> DataFrame:
    """images rows of crawl items."""
    rows = items.select(row_key("url").alias("page_id"), F.posexplode("images").alias("pos", "i"))
    return rows.select(row_key("page_id", "pos").alias("id"), "page_id", "i.src", "i.alt", "i.class_attr", "i.id_attr")


def heading_structure_rows(items: DataFrame) -> DataFrame:
    result = row_key(row_key("url"))
    return items.select(row_key(result).alias("id"), result.alias("result_id"), F.col("header_structure").alias("data"))


def structured_data_rows(items: DataFrame) -> DataFrame:
    """structured_data rows: each page's JSON-LD documents as one JSON array."""
    result = row_key(row_key("url"))
    data = F.concat(F.lit("["), F.array_join("schema_org_data", ", "), F.lit("]"))
    return items.select(row_key(result).alias("id"), result.alias("result_id"), data.alias("schema_org_data"))


def sitemap_url_rows(links: DataFrame) -> DataFrame:
    """sitemap_urls rows from (sitemap_entry, url)."""
    domain = row_key(domain_of(F.col("sitemap_entry")))
    return links.select(row_key(domain, "url").alias("id"), domain.alias("domain_id"), "url").distinct()


def sitemap_content_rows(contents: DataFrame, as_of: Column) -> DataFrame:
    """sitemap_contents rows from (sitemap_entry, url, content); of one file reached twice, one row."""
    domain = row_key(domain_of(F.col("sitemap_entry")))
    rows = contents.select(row_key(domain, "url").alias("id"), domain.alias("domain_id"), "content")
    return fill("sitemap_contents", latest_per_key(rows, ["id"]), as_of)


def replace_pages(table: DataFrame, rows: DataFrame, key: str = "page_id") -> DataFrame:
    """A fan-out table after a re-run: earlier rows of the same pages give way to the new ones."""
    pages = rows.select(key).distinct()
    return table.join(pages, key, "left_anti").select(*rows.columns).unionByName(rows)


# --- audits
def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """(value, n_rows): foreign keys without a parent. Values are counted first, so a hot one is one row."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    return used.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


def duplicates(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns.., n_rows): values of a unique key held by several rows; NULLs never clash."""
    whole = table
    for c in columns:
        whole = whole.where(F.col(c).isNotNull())
    return whole.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def null_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_nulls)."""
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_nulls")) for c in columns])).alias("r")).select("r.*")


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, check, detail, n): every declared constraint that rows of the given tables break."""
    found = []
    for name, df in tables.items():
        spec = TABLES[name]
        for column, (parent, parent_column, _) in spec.foreign.items():
            if parent in tables:
                bad = orphans(df, column, tables[parent], parent_column)
                found.append((name, "foreign key", column, bad.agg(F.sum("n_rows").alias("n"))))
        for key in spec.unique:
            found.append((name, "unique", ", ".join(key), duplicates(df, key).agg(F.sum("n_rows").alias("n"))))
        if spec.not_null:  # all of a table in one pass
            nulls = null_counts(df, spec.not_null).select("column", F.col("n_nulls").alias("n"))
            found.append((name, "not null", F.col("column"), nulls))
    result = None
    for name, check, detail, n in found:
        row = n.where("n > 0").select(F.lit(name).alias("table"), F.lit(check).alias("check"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), "n")
        result = row if result is None else result.unionByName(row)
    return result


def key_collisions(table: DataFrame, key: str, natural: Sequence[str]) -> DataFrame:
    """(key, n): surrogate keys standing for more than one natural key."""
    spelled = F.md5(F.to_json(F.struct(*natural)))
    return table.groupBy(key).agg(F.count_distinct(spelled).alias("n")).where("n > 1")


# --- deletions
def cascade(child: DataFrame, column: str, deleted: DataFrame, deleted_column: str = "id") -> DataFrame:
    """Child rows that survive the deletion of parents."""
    gone = deleted.select(F.col(deleted_column).alias(column)).distinct()
    return child.join(gone, column, "left_anti").select(*child.columns)


def set_null(child: DataFrame, column: str, deleted: DataFrame, deleted_column: str = "id") -> DataFrame:
    """Child rows with references to deleted parents cleared."""
    gone = deleted.select(F.col(deleted_column).alias(column), F.lit(True).alias("_gone")).distinct()
    marked = child.join(gone, column, "left")
    return marked.select(*[
        F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in child.columns])


def restricted(tables: dict[str, DataFrame], table: str, deleted: DataFrame) -> DataFrame:
    """(table, column, value, n_rows): references that forbid the deletion of rows of `table` by `id`."""
    result = deleted.sparkSession.createDataFrame([], "table string, column string, value long, n_rows long")
    for name, spec in TABLES.items():
        for column, (parent, parent_column, rule) in spec.foreign.items():
            if name in tables and (parent, parent_column, rule) == (table, "id", "restrict"):
                held = tables[name].join(deleted.select(F.col("id").alias(column)).distinct(), column, "left_semi")
                counted = held.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
                result = result.unionByName(counted.select(F.lit(name).alias("table"), F.lit(column).alias("column"), "value", "n_rows"))
    return result


def delete_rows(tables: dict[str, DataFrame], table: str, deleted: DataFrame, check: bool = True) -> dict[str, DataFrame]:
    """All given tables after deleting rows of one by `id`, following the declared rules down.

    Rows that others refer to under a `restrict` rule forbid it: a ValueError, unless `check` is off.
    """
    if check and not restricted(tables, table, deleted).isEmpty():
        raise ValueError(f"rows of {table} are still referred to; see restricted()")
    result = dict(tables)
    result[table] = cascade(tables[table], "id", deleted)
    for name, spec in TABLES.items():
        for column, (parent, parent_column, rule) in spec.foreign.items():
            if parent != table or parent_column != "id" or name not in result:
                continue
            if rule == "set null":
                result[name] = set_null(result[name], column, deleted)
            elif rule == "cascade":
                gone = result[name].join(deleted.select(F.col("id").alias(column)).distinct(), column, "left_semi")
                if "id" in spec.columns:
                    result.update(delete_rows(result, name, gone.select("id"), check))
                else:
                    result[name] = cascade(result[name], column, deleted)
    return result


# --- deletions in the stored tables
def deletions(tables: dict[str, DataFrame], table: str, deleted: DataFrame) -> list[tuple[str, str, DataFrame]]:
    """What the deletion of rows of `table` by `id` does to the given tables: (table, column, rows), children before parents.

    With an empty column the rows (the upsert key) go, else the rows (`column`'s values) have it set to NULL.
    """
    out = []
    for name, spec in TABLES.items():
        for column, (parent, parent_column, rule) in spec.foreign.items():
            if parent != table or parent_column != "id" or name not in tables:
                continue
            hit = deleted.select(F.col("id").alias(column)).distinct()
            if rule == "set null":
                out.append((name, column, tables[name].join(hit, column, "left_semi")))
            elif rule == "cascade":
                gone = tables[name].join(hit, column, "left_semi")
                out += deletions(tables, name, gone.select("id")) if "id" in spec.columns else [(name, "", gone)]
    return [*out, (table, "", tables[table].join(deleted.select("id").distinct(), "id", "left_semi"))]


def delete_stored(path: str, table: str, deleted: DataFrame, writers: int = 1) -> None:
    """Delete rows of a stored table by `id` with all that the declared rules bind to them, rewriting touched buckets only.

    References under a `restrict` rule, of rows at any depth, forbid it: a ValueError, and nothing is changed. Rows to go are
    worked out first and kept aside; children are rewritten before their parents, so a failure in between leaves no
    reference without its row, and repeating the call goes on. Deleting again changes nothing.
    """
    spark = deleted.sparkSession
    folder, plan = run_dir(spark, "delete"), []
    # The ids may come from the very tables that are rewritten.
    deleted.select(F.col("id").cast("long").alias("id")).distinct().write.parquet(f"{folder}/ids")
    deleted = spark.read.schema("id long").parquet(f"{folder}/ids")
    tables = {name: read_table(spark, path, name) for name in TABLES}
    for i, (name, column, rows) in enumerate(deletions(tables, table, deleted)):
        rows.write.parquet(f"{folder}/{i}")
        plan.append((name, column, spark.read.schema(rows.schema).parquet(f"{folder}/{i}")))
    for name, column, rows in plan:
        if not column and "id" in TABLES[name].columns and not restricted(_without(tables, plan), name, rows).isEmpty():
            raise ValueError(f"rows of {name} are still referred to; see restricted()")
    for name, column, rows in plan:
        keys = upsert_key(name)

        def combine(old: DataFrame, new: DataFrame, column: str = column, keys: tuple[str, ...] = keys) -> DataFrame:
            gone = new.select(*keys, "bucket")
            if not column:
                return old.join(gone, [*keys, "bucket"], "left_anti").select(*old.columns)
            hit = old.join(gone.withColumn("_hit", F.lit(True)), [*keys, "bucket"], "left")
            return hit.select(*(F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in old.columns))

        if not rows.isEmpty():
            _rewrite(path, name, rows.select(*TABLES[name].schema.names).dropDuplicates(list(keys)), combine, writers)


def _without(tables: dict[str, DataFrame], plan: list[tuple[str, str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables without the rows that a plan of deletions takes away."""
    out = dict(tables)
    for name, column, rows in plan:
        if not column:
            out[name] = out[name].join(rows.select(*upsert_key(name)).distinct(), list(upsert_key(name)), "left_anti")
    return out


# --- tasks, methods, changes
def pending(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("scrape_status") == "pending")


def route(tasks: DataFrame) -> DataFrame:
    """Add the `method` a task goes to: a browser when a new scrape is forced, else plain HTTP."""
    return tasks.withColumn("method", F.when(F.col("force_new_scrape"), "browser").otherwise("http"))


def complete(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks with the status of the finished ones (id) set."""
    return upsert(tasks, done.select("id").distinct().withColumn("scrape_status", F.lit("completed")), ["id"]).where(
        F.col("url_to_scrape").isNotNull())


def history_rows(done: DataFrame, as_of: Column) -> DataFrame:
    """scrape_histories rows for finished tasks (id)."""
    return fill("scrape_histories", done.select(
        row_key("id", as_of).alias("id"), F.col("id").alias("task_id"), F.lit("completed").alias("status")), as_of)


def methods_of_domains(domain_methods: DataFrame, methods: DataFrame) -> DataFrame:
    """(domain_url, method): names of the methods declared for each site."""
    names = methods.select(F.col("id").alias("scrape_method_id"), F.col("name").alias("method"))
    return domain_methods.join(names, "scrape_method_id").select("domain_url", "method")


def methods_of_combinations(combinations: DataFrame, links: DataFrame, methods: DataFrame) -> DataFrame:
    """(combination, method)."""
    named = combinations.select(F.col("id").alias("combination_id"), F.col("name").alias("combination"))
    names = methods.select(F.col("id").alias("method_id"), F.col("name").alias("method"))
    return links.join(named, "combination_id").join(names, "method_id").select("combination", "method")


def combinations_of_domains(domain_methods: DataFrame, combinations: DataFrame, links: DataFrame) -> DataFrame:
    """(domain_url, combination): combinations whose every method the site has.

    Counted per (site, combination) against the size of the combination, so only actual
    memberships are joined.
    """
    sizes = links.groupBy("combination_id").agg(F.count_distinct("method_id").alias("n_methods"))
    had = (domain_methods.select("domain_url", F.col("scrape_method_id").alias("method_id")).distinct()
           .join(links.distinct(), "method_id").groupBy("domain_url", "combination_id").agg(F.count("*").alias("n_had")))
    full = had.join(sizes, "combination_id").where("n_had = n_methods")
    named = combinations.select(F.col("id").alias("combination_id"), F.col("name").alias("combination"))
    return full.join(named, "combination_id").select("domain_url", "combination")


def changes(stored: DataFrame, scraped: DataFrame, key: str = "webpage_id") -> DataFrame:
    """(key, change): `new`, `changed` or `unchanged` by content hash, for each scraped page."""
    old = stored.select(key, F.col("content_hash").alias("_old"), F.lit(True).alias("_known"))
    kind = (F.when(F.col("_known").isNull(), "new")
            .when(F.col("_old").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("changed"))
    return scraped.select(key, "content_hash").join(old, key, "left").select(key, kind.alias("change"))


def exact_duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(content_hash, n, first_key): groups of rows with the same text, by hash; counted before the shuffle."""
    return (rows.select(content_hash(F.col(text)).alias("content_hash"), key).groupBy("content_hash")
            .agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1"))

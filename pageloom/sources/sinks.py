"""Documents for output: a page's sections as JSON or indented text, and writers.

Everything about a page sits in its row, so documents are built without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.lambdas import grouped, last, last_of_each, let, match
from pageloom.functions.text import page_title
from pageloom.operators import sections as S
from pageloom.operators.elements import title
from pageloom.session import run_dir

_OVERVIEW = ("uuid", "website", "url", "unique_page_name", "page_title")


def json_string(c: Column) -> Column:
    return let(F.to_json(F.array(c)), lambda j: F.substr(j, F.lit(2), F.length(j) - 2))


def _member(key: Column, value: Column) -> Column:
    return F.concat(json_string(key), F.lit(": "), value)


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def _row_maps(table: Column) -> Column:
    return F.to_json(F.transform(table["rows"], lambda r: S.row_map(table["columns"], r)))


def _block_json(b: Column) -> Column:
    def wrapped(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'{{"{name}": '), value, F.lit("}"))

    return (
        F.when(b["kind"] == "text", json_string(b["text"]))
        .when(b["kind"].isin("list", "ordered_list"), wrapped("list", F.to_json(b["items"])))
        .when(b["kind"] == "list_items", wrapped("list_items", F.to_json(b["items"])))
        .when(b["kind"] == "code", wrapped("code", json_string(b["text"])))
        .otherwise(wrapped("tables", _row_maps(b["table"]))))


def overview(url: Column, website: Column, unique_page_name: Column, dom: Column) -> Column:
    """struct<uuid, website, url, unique_page_name, page_title>; the uuid is the URL's md5."""
    return F.struct(
        F.md5(url).alias("uuid"), website.alias("website"), url.alias("url"),
        unique_page_name.alias("unique_page_name"), page_title(title(dom)).alias("page_title"))


def organized(dom: Column, about: Column, dropped=None) -> Column:
    """struct<about, title, keys, blocks>: what the page documents are made from."""
    return F.struct(about.alias("about"), title(dom).alias("title"), S.section_keys(dom, dropped).alias("keys"),
                    S.sections(dom, dropped).alias("blocks"))


def _contents(o: Column, groups: Column) -> Column:
    """array<struct<key, items>>: the blocks under each heading key of a page, keys without any included, `unassociated` last."""
    used = F.transform(groups, lambda g: g["key"])
    named = F.array_except(F.array_distinct(F.concat(o["keys"], used)), F.array(F.lit(S.NO_HEADING)))
    return let(F.concat(named, F.array(F.lit(S.NO_HEADING))), lambda keys: let(match(keys, used), lambda at: F.transform(
        keys, lambda k, i: F.struct(k.alias("key"), F.get(groups, F.get(at, i))["items"].alias("items")))))


def _by_header(blocks: Column) -> Column:
    return grouped(blocks, F.transform(blocks, lambda b: b["header"]))


def _each(group: Column, build) -> Column:
    """`build` for the blocks of a group; none for a key without."""
    return F.coalesce(F.transform(group["items"], build), F.array().cast("array<string>"))


def organized_members(o: Column, contents: Column) -> Column:
    """array<struct<key, value>>, values as JSON: overview, Title, then each heading's contents, `unassociated` last."""
    def member(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    title_ = F.filter(F.array(member(F.lit("Title"), json_string(o["title"]))), lambda _: o["title"].isNotNull())
    return F.concat(
        F.array(member(F.lit("overview"), F.to_json(o["about"]))), title_,
        F.transform(contents, lambda g: member(g["key"], _list(_each(g, _block_json)))))


def members_json(members: Column) -> Column:
    return _object(F.transform(members, lambda m: _member(m["key"], m["value"])))


def merged_members(old: Column, new: Column) -> Column:
    """A document's members after another run: earlier ones keep their places, later values win, `unassociated` stays last.

    An empty `unassociated` of the later run leaves the earlier one. Either side may be NULL.
    """
    nothing = F.array().cast("array<struct<key:string,value:string>>")
    old, new = F.coalesce(old, nothing), F.coalesce(new, nothing)
    loose = F.filter(F.concat(old, F.filter(new, lambda m: m["value"] != "[]")), lambda m: m["key"] == S.NO_HEADING)
    rest = F.filter(F.concat(old, new), lambda m: m["key"] != S.NO_HEADING)
    by_key = let(rest, lambda r: last_of_each(F.transform(r, lambda m: m["key"]), F.transform(r, lambda m: m["value"])))
    return F.concat(F.map_entries(by_key), F.array(F.struct(
        F.lit(S.NO_HEADING).alias("key"), F.coalesce(last(loose)["value"], F.lit("[]")).alias("value"))))


def organized_json(o: Column, contents: Column) -> Column:
    """JSON text: overview, Title, then each heading's contents, `unassociated` last."""
    return members_json(organized_members(o, contents))


def structured_json(o: Column, contents: Column) -> Column:
    """JSON text: overview, and tables, lists, ordered_lists as heading -> [{pre, ..}]."""
    def group(kind: str, build) -> Column:
        return let(F.filter(o["blocks"], lambda b: b["kind"] == kind), lambda blocks: _object(F.transform(
            _by_header(blocks), lambda g: _member(g["key"], _list(_each(g, build))))))

    def a_table(b: Column) -> Column:
        return F.concat(F.lit('{"pre": '), json_string(b["table"]["pre"]), F.lit(', "table": '), _row_maps(b["table"]), F.lit("}"))

    def a_list(b: Column) -> Column:
        return F.to_json(F.struct(b["pre"].alias("pre"), b["items"].alias("list"), b["post"].alias("post")))

    return _object(F.array(
        _member(F.lit("overview"), F.to_json(o["about"])),
        _member(F.lit("tables"), group("table", a_table)),
        _member(F.lit("lists"), group("list", a_list)),
        _member(F.lit("ordered_lists"), group("ordered_list", a_list))))


def rendered_text(o: Column, contents: Column) -> Column:
    """Indented text: headings flush left, their contents as bullets, list items and table rows one each."""
    bullet = F.lit("  - ")

    def lines(b: Column) -> Column:
        items = (
            F.when(b["kind"].isin("list", "ordered_list", "list_items"), b["items"])
            .when(b["kind"] == "table", F.transform(b["table"]["rows"], lambda r: F.to_json(S.row_map(b["table"]["columns"], r))))
            .otherwise(F.array(b["text"])))
        return F.transform(items, lambda i: F.concat(bullet, i))

    about = F.flatten(F.array(*[F.array(F.lit(""), F.lit(f"  {f}"), F.concat(
        F.lit("    "), F.coalesce(o["about"][f], F.lit("None")))) for f in _OVERVIEW]))
    heading = F.when(o["title"].isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("Title"), F.concat(F.lit("  "), o["title"])))
    under = F.flatten(F.transform(contents, lambda g: F.concat(
        F.array(g["key"]), F.coalesce(F.flatten(F.transform(g["items"], lines)), F.array().cast("array<string>")))))
    return F.array_join(F.concat(F.array(F.lit("overview")), about, heading, under), "\n")


# Documents that are texts; the members of an organized one are an array, to be merged before they are written out.
DOCUMENTS = {"organized": organized_json, "structured": structured_json, "text": rendered_text}
TEXTS = tuple(DOCUMENTS)
_MADE = {**DOCUMENTS, "members": organized_members}


def page_documents(shredded: DataFrame, dropped=None, kinds: tuple[str, ...] = TEXTS) -> DataFrame:
    """(page_id, unique_page_name, and those of organized, structured, text, members in `kinds`) for pages with url, website, unique_page_name."""
    dom = F.col("dom")
    about = overview(F.col("url"), F.col("website"), F.col("unique_page_name"), dom)
    # A column at a time: what is used more than once is computed once, and expressions stay small.
    page = shredded.select("page_id", "unique_page_name", organized(dom, about, dropped).alias("o"))
    page = page.withColumn("groups", _by_header(F.col("o.blocks"))).withColumn("contents", _contents(F.col("o"), F.col("groups")))
    return page.select("page_id", "unique_page_name", *(_MADE[kind](F.col("o"), F.col("contents")).alias(kind) for kind in kinds))


def write_documents(documents: DataFrame, column: str, path: str) -> None:
    """One document per record as text lines of JSON, or Parquet for the multi-line text."""
    if column == "text":
        documents.select("page_id", "unique_page_name", "text").write.mode("overwrite").parquet(path)
    else:
        documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


DOCUMENT = "unique_page_name string, members array<struct<key:string,value:string>>, bucket int"
BUCKETS = 64
# Documents a task writes, about: large buckets are written by several.
DOCUMENTS_PER_WRITER = 10_000


def read_organized(spark: SparkSession, path: str) -> DataFrame:
    """(unique_page_name, members, bucket) of the documents stored at `path`; `members_json` writes them out."""
    return spark.read.schema(DOCUMENT).parquet(f"{path}/documents")


def merge_organized(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Merge documents (unique_page_name, page_id, members) over those stored at `path`, member by member.

    Of several with one name that with the largest page_id counts. Only the buckets they fall in are rewritten, from tables
    written aside first, so a failed merge can be repeated; repeating it changes nothing. `buckets` is for the first write.
    """
    spark, folder = documents.sparkSession, run_dir(documents.sparkSession, "documents")
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("ignore").parquet(f"{path}/layout")
    spark.createDataFrame([], DOCUMENT).write.mode("ignore").partitionBy("bucket").parquet(f"{path}/documents")
    buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]
    new = documents.groupBy("unique_page_name").agg(F.max_by("members", "page_id").alias("members"))
    new.withColumn("bucket", F.pmod(F.xxhash64("unique_page_name"), F.lit(buckets)).cast("int")).write.parquet(f"{folder}/new")
    new = spark.read.schema(DOCUMENT).parquet(f"{folder}/new")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
    old = read_organized(spark, path).where(F.col("bucket").isin(touched)).withColumnRenamed("members", "before")
    both = old.join(new, ["unique_page_name", "bucket"], "full_outer")
    both.select("unique_page_name", merged_members(F.col("before"), F.col("members")).alias("members"), "bucket").write.parquet(f"{folder}/merged")
    merged = spark.read.schema(DOCUMENT).parquet(f"{folder}/merged")
    part = F.pmod(F.xxhash64(F.lit("part"), "unique_page_name"), F.lit(-(-merged.count() // DOCUMENTS_PER_WRITER) or 1))
    (merged.repartition("bucket", part).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/documents"))


def write_item_feed(items: DataFrame, path: str) -> None:
    """Crawl items as JSON lines, UTF-8."""
    items.write.mode("overwrite").option("encoding", "UTF-8").json(path)

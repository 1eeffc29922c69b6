"""Audits of a stored store that cost what a merge touched, not the store.

What every constraint needs to know is a count per key value: rows that refer to it, rows that are it, rows that share it, rows
without it. These counts are kept per table and bucket beside the store. After a merge only the touched buckets are counted again, over their
old counts, so repeating is safe; the audit adds up counts of all buckets, keys only, and never reads the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.store import merge_into
from pageloom.session import run_dir
from pageloom.sources.tables import TABLES, bucket, bucket_count, read_table

COUNTS = "of string, check string, detail string, value string, n_rows long, n_there long, bucket int"


def _counts(table: str, rows: DataFrame) -> DataFrame:
    """What rows of a table (with `bucket`) add to the counts of its own constraints and of those that refer to it."""
    spec = TABLES[table]

    def entry(of: str, check: str, detail: str, value: Column, there: bool = False) -> Column:
        return F.when(value.isNotNull(), F.struct(
            F.lit(of).alias("of"), F.lit(check).alias("check"), F.lit(detail).alias("detail"), value.cast("string").alias("value"),
            F.lit(int(not there)).cast("long").alias("n_rows"), F.lit(int(there)).cast("long").alias("n_there")))

    entries = [entry(table, "foreign key", column, F.col(column)) for column in spec.foreign]
    entries += [entry(child, "foreign key", column, F.col(parent_column), there=True)
                for child, other in TABLES.items() for column, (parent, parent_column, _) in other.foreign.items() if parent == table]
    for key in spec.unique:
        whole = F.lit(True)
        for c in key:
            whole = whole & F.col(c).isNotNull()
        entries.append(entry(table, "unique", ", ".join(key), F.when(whole, F.to_json(F.struct(*key)))))
    entries += [entry(table, "not null", column, F.when(F.col(column).isNull(), F.lit(""))) for column in spec.not_null]
    listed = rows.select("bucket", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("bucket", "e.*")
    return listed.groupBy("bucket", "of", "check", "detail", "value").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_there").alias("n_there"))


def recount(spark: SparkSession, path: str, table: str, touched: list[int] | None = None) -> None:
    """Count the given buckets of a stored table again, all by default."""
    rows = read_table(spark, path, table)
    touched = list(range(bucket_count(spark, path))) if touched is None else touched
    staged = f"{run_dir(spark, 'counts')}/{table}"
    _counts(table, rows.where(F.col("bucket").isin(touched))).write.parquet(staged)
    counts = spark.read.schema(COUNTS).parquet(staged)
    # A bucket without rows keeps a mark, so that its old counts go.
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
    whole = counts.unionByName(marks, allowMissingColumns=True)
    (whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(f"{path}/audit/{table}"))


def merge_counted(path: str, table: str, source: DataFrame, **options) -> None:
    """`merge_into`, and the counts of the buckets it touched."""
    spark = source.sparkSession
    buckets = bucket_count(spark, path)
    touched = [r[0] for r in source.select(bucket(table, buckets).alias("bucket")).distinct().collect()]  # at most as many as there are buckets
    merge_into(path, table, source, **options)
    recount(spark, path, table, touched)


def audit_stored(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """(table, check, detail, n): every declared constraint that rows of the given counted tables break, from the counts alone."""
    counts = None
    for table in tables:
        one = spark.read.schema(COUNTS).parquet(f"{path}/audit/{table}").where("value is not null")
        counts = one if counts is None else counts.unionByName(one)
    known = [(name, column, parent in tables) for name in tables for column, (parent, _, _) in TABLES[name].foreign.items()]
    told = {(name, column) for name, column, there in known if there}
    sums = counts.where(F.col("of").isin(tables)).groupBy("of", "check", "detail", "value").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_there").alias("n_there"))
    # A foreign key is judged where the table it refers to is counted too.
    judged = F.lit(False)
    for name, column in sorted(told):
        judged = judged | ((F.col("of") == name) & (F.col("detail") == column))
    broken = (
        ((F.col("check") == "foreign key") & judged & (F.col("n_there") == 0) & (F.col("n_rows") > 0))
        | ((F.col("check") == "unique") & (F.col("n_rows") > 1)) | (F.col("check") == "not null"))
    return sums.where(broken).groupBy(F.col("of").alias("table"), "check", "detail").agg(F.sum("n_rows").alias("n"))

"""Helpers the operators share: tables between steps, and what Python workers keep between tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from pageloom.operators.groups import attach, free_name, look_up  # noqa: F401
from pageloom.session import run_dir

WORD = r"[^\x20\x09-\x0D]+"

Thing = TypeVar("Thing")
_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], Thing]) -> Thing:
    """What a Python worker keeps from task to task: one thing at a time, so that stages do not add up their memory."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


# Spark's setting for removing a query's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here remove their shuffle files when they have ended, so that those of many steps do not add up."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Steps:
    """Tables written between the steps of one run, in the folder all executors share."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.root, self.count = df.sparkSession, run_dir(df.sparkSession, name), 0
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` written and read again: lineage ends here, and lost executors cost no earlier step.

        Nothing will read the shuffle files of what is written, so they go at once.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        with tidy(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((table, path))
        return table

    def forget(self, *tables: DataFrame | None) -> None:
        """Remove tables that `keep` gave, whose readers have all been written themselves; others are left alone."""
        for table in tables:
            for i, (kept, path) in enumerate(self.kept):
                if kept is table:
                    folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                    folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
                    del self.kept[i]
                    break

"""Shredded pages as a table: shred once, run any number of jobs on what they need of it.

The table has the pages' columns, `dom` with all nodes, attributes and spans, and the strings once per page. A job's
fields are read as leaf columns of the nested Parquet; what it does not name stays on disk.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.shred import DOM, NODE, STRINGS, STRINGS_TWICE, shred

# What the tree is made of, and the fields of a node a reader may leave out.
TREE = ("id", "parent", "end", "depth", "kind", "tag")
ATTRIBUTES, TEXT, SPANS = ("attrs",), ("first", "upto", "lead"), ("lo", "hi")


def write_shredded(pages: DataFrame, path: str, partitions: int | None = None, mode: str = "error") -> None:
    """Store `pages` (html and any other columns) shredded for every job: all nodes, attributes, strings and spans."""
    whole = shred(pages, parts_of=None, text_nodes=True, attrs=None, decode_twice="both", keep_html=True, partitions=partitions)
    whole.write.mode(mode).parquet(path)


def read_shredded(
    spark: SparkSession, path: str, fields: Collection[str] = (*ATTRIBUTES, *TEXT, *SPANS), decode_twice: bool = False, columns: Iterable[str] | None = None,
) -> DataFrame:
    """Stored pages as `shred` gives them, with the node fields of TREE and those named.

    Fields left out of `dom` are neither read nor there. `columns` are the page columns wanted, all by default.
    `decode_twice` chooses the strings for text that goes through a clean-up which decodes entities again.
    """
    stored = spark.read.parquet(path).schema
    own = [f for f in stored.fields if f.name not in ("dom", STRINGS, STRINGS_TWICE)]
    own = [f for f in own if columns is None or f.name in set(columns)]
    node = T.StructType([f for f in NODE.fields if f.name in TREE or f.name in fields])
    strings = [T.StructField(c, T.ArrayType(T.StringType())) for c in ((STRINGS, STRINGS_TWICE) if decode_twice else (STRINGS,))]
    strings = strings if set(fields) & set(TEXT) else []
    pages = spark.read.schema(T.StructType([*own, T.StructField("dom", T.ArrayType(node)), *strings])).parquet(path)
    return pages.withColumn(STRINGS, F.coalesce(STRINGS_TWICE, STRINGS)).drop(STRINGS_TWICE) if strings and decode_twice else pages


assert set(DOM.elementType.names) == {*TREE, *ATTRIBUTES, *TEXT, *SPANS}

"""Helpers that several operators share: the shared folder, written tables, graph components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.operators import graph
from tablescribe.sources.scratch import shared_folder

#: A word of a text, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


#: Tables that written() has made inside of `with tables_of(owner)`, by owner.
_TABLES: dict[str, list[str]] = {}
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession)
    if owner := _owner.get():
        _TABLES.setdefault(owner, []).append(folder)
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def tables_of(owner: str) -> Iterator[None]:
    """Tables written inside belong to owner, until drop_tables."""
    before = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(before)


#: How many rows pass to Python and back at once. Whole texts in batches of 10,000 take memory beside the heap and in the workers.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Tables written inside pass to Python and back so many rows at a time."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def drop_tables(spark: SparkSession, owner: str) -> None:
    """Deletes the tables of owner. Results that read them must have been written before."""
    for folder in _TABLES.pop(owner, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_of_id(doc_id: str | Column) -> Column:
    """Unsigned crc32 of the id written as text (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components (node, root) of the undirected edges (a, b), their working tables among the owner's."""
    return graph.components(edges, a, b, keep=written)

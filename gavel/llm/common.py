"""Settings, scratch tables and column helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gavel.session import scratch_path, tune

#: White space of the operators: ASCII only, so it is the same in bytes and in code points.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Python tasks get Arrow batches of so many rows, so that long texts stay small batches.
BATCH_ROWS = 256


def tuned(spark: SparkSession) -> SparkSession:
    """The library's settings, and small Arrow batches for tasks that hold whole texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and go on from the files.

    Cuts the lineage, fixes what later passes see, and survives lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle whose rows are dealt out by a computed number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def regrouped(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Join batches into tables of about ``limit`` bytes of ``column``, for vectorised work."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_dropped(
    docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame], label: str
) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, unchanged.

    ``decide`` gets the rows with a number of their own and its column's name, and returns row_id and kept
    for each. The numbers of dropped rows are written, so that Spark knows how many there are and
    sends few of them to the rows instead of shuffling all texts.
    """
    row = unused(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), f"{label}-rows")
    dropped = decide(numbered, row).filter("NOT kept").select(F.col("row_id").alias(row))
    return numbered.join(stored(dropped, f"{label}-dropped"), row, "left_anti").select(
        *[f"`{c}`" for c in docs.columns]
    )

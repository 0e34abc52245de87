"""Joins for hot keys that adaptive execution does not split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

SALTS = 16
#: Narrow rows that one task of a streamed join or a running total holds.
ROWS_PER_TASK = 300_000


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, salts: int = SALTS
) -> DataFrame:
    """Join ``left`` with a narrow ``right`` that is grouped by the join key.

    A side fresh from an aggregate or window on the key is already partitioned by it. Spark then
    joins in place, and its skew handling, which needs a shuffle right below the join on both
    sides, does not apply. So ``left`` is dealt out by the task that read a row and ``right``
    repeated for every salt. ``how`` is inner, left, left_semi or left_anti.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    dealt = left.withColumn("_salt", salt)
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def tasks_for(rows: int, spark: SparkSession, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Shuffle partitions that hold ``rows_per_task`` narrow rows at most on average."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def streamed_join(
    wide: DataFrame, narrow: DataFrame, on: str | Sequence[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Join ``wide`` rows with ``narrow`` ones, which are a written table with few rows per key.

    A sort-merge join sorts the wide side and holds it in memory. Here a task holds about
    ``rows_per_task`` narrow rows in a hash table and the wide ones stream by, so its memory depends neither
    on the size of the texts nor on that of the input. ``how`` is inner, left, left_semi or left_anti.
    """
    on = [on] if isinstance(on, str) else list(on)
    tasks = tasks_for(narrow.count(), narrow.sparkSession, rows_per_task)
    held = narrow.repartition(tasks, *on).hint("shuffle_hash")
    return wide.repartition(tasks, *on).join(held, on, how)

"""Queue depth kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gavel.operators.ordering import running_totals

DEPTH = "queue string, depth bigint"


def depth_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a stream of ``queue, id, ts, change`` (+1 asked, -1 answered).

    Writes the depth after every event to ``events`` and one row per queue to ``depth``, both per
    batch number and overwritten on a retry, so a batch replayed after a failure counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            before = spark.createDataFrame([], DEPTH)
        else:
            before = spark.read.schema(DEPTH).parquet(f"{folder}/depth/batch={number - 1}")
        ordered = running_totals(
            batch.withColumn("_step", -F.col("change")),
            ["ts", "_step", "id"],
            {"moved": F.col("change")},
            keys=["queue"],
            inclusive=True,
        ).drop("_step")
        events = ordered.join(before, "queue", "left").withColumn(
            "pending", F.col("moved") + F.coalesce("depth", F.lit(0))
        )
        events.drop("moved", "depth").write.mode("overwrite").parquet(
            f"{folder}/events/batch={number}"
        )
        moved = batch.select("queue", F.col("change").cast("bigint").alias("depth"))
        moved.unionByName(before).groupBy("queue").agg(F.sum("depth").alias("depth")).write.mode(
            "overwrite"
        ).parquet(f"{folder}/depth/batch={number}")

    return write

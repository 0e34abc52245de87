"""Good rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def split_rejects(
    df: DataFrame, reason: Column, on_error: str = "split"
) -> tuple[DataFrame, DataFrame]:
    """Part ``df`` into rows without a reason and rows with one (kept in ``reason``).

    With ``on_error="fail"`` the first row that has a reason fails the job instead.
    """
    if on_error not in ("split", "fail"):
        raise ValueError(f"on_error must be 'split' or 'fail', not {on_error!r}")
    marked = df.withColumn("reason", reason)
    if on_error == "fail":
        kept = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.col("reason")).cast("boolean")
        )
        return marked.filter(kept).drop("reason"), marked.filter(F.lit(False))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")

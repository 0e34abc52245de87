"""Job requests, from a batch or a stream of JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from gavel.functions.text import empty_if_null, strip
from gavel.sources.jsonl import BLANK, RecordSchema, parse_lines

JOB = RecordSchema(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("callback_url", T.StringType()),
            T.StructField("binary", T.StringType()),
            T.StructField("capture_pattern", T.StringType()),
            T.StructField("args", T.ArrayType(T.StringType())),
        ]
    )
)


def read_jobs(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(jobs, rejects)`` from a frame with a JSON ``line``, a ``queue`` and any other columns.

    Stateless, so the same call serves ``spark.read`` and ``spark.readStream`` frames.
    """
    others = [c for c in payloads.columns if c not in ("line", "queue")]
    parsed = parse_lines(payloads, JOB)
    encoded = empty_if_null(F.col("record.binary"))
    binary = F.try_to_binary(encoded, F.lit("base64"))
    undecodable = F.col("reason").isNotNull() & (F.col("reason") != BLANK)
    reason = (
        F.when(F.col("reason") == BLANK, "decode job payload: blank")
        .when(undecodable, F.concat(F.lit("decode job payload: "), F.col("reason")))
        .when(binary.isNull(), "decode job payload: binary is not base64")
        .when(F.octet_length(binary) == 0, "job binary is empty")
        .when(strip(F.col("queue")) == "", "queue name is required")
        .when(strip(empty_if_null(F.col("record.callback_url"))) == "", "missing callback URL")
    )
    typed = parsed.select(
        *others,
        "line",
        strip(F.col("queue")).alias("queue"),
        empty_if_null(F.col("record.id")).alias("id"),
        strip(empty_if_null(F.col("record.callback_url"))).alias("callback_url"),
        binary.alias("binary"),
        empty_if_null(F.col("record.capture_pattern")).alias("capture_pattern"),
        F.coalesce("record.args", F.array().cast("array<string>")).alias("args"),
        reason.alias("reason"),
    )
    return (
        typed.filter("reason IS NULL").drop("line", "reason"),
        typed.filter("reason IS NOT NULL").select(*others, "queue", "line", "reason"),
    )

"""Layout arithmetic of the packed case store, and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gavel.operators.contest import has_problem_key
from gavel.operators.joins import salted_join
from gavel.operators.ordering import keep_last_wide, running_totals
from gavel.operators.rejects import split_rejects

MAX_INDEX_BYTES = 255
KEY = ["contest_id", "index"]


def packed_entries(records: DataFrame, on_error: str = "split") -> tuple[DataFrame, DataFrame]:
    """``(entries, rejects)``: keyed records with their case count, over-long indexes refused."""
    keyed = records.filter(has_problem_key(F.col("contest_id"), F.col("index")))
    too_long = F.when(F.octet_length("index") > MAX_INDEX_BYTES, F.lit("index too long"))
    return split_rejects(
        keyed.withColumn("case_count", F.coalesce(F.nullif(F.size("test_cases"), F.lit(-1)), F.lit(0))),
        too_long,
        on_error,
    )


def case_index(entries: DataFrame) -> DataFrame:
    """Byte offsets of every input and output in write order (``seq``, then case number).

    Only lengths leave the scan: texts are measured before the shuffle. Repeated problems
    keep their place in the data.
    """
    sized = entries.select(
        "seq", *KEY, "case_count", F.posexplode("test_cases").alias("case_no", "case")
    ).select(
        "seq",
        *KEY,
        "case_count",
        "case_no",
        F.coalesce(F.octet_length("case.input"), F.lit(0)).cast("bigint").alias("input_length"),
        F.coalesce(F.octet_length("case.output"), F.lit(0)).cast("bigint").alias("output_length"),
    )
    placed = running_totals(
        sized,
        ["seq", "case_no"],
        {"input_offset": F.col("input_length") + F.col("output_length")},
    )
    return placed.withColumn("output_offset", F.col("input_offset") + F.col("input_length"))


def latest_problem_entry(entries: DataFrame) -> DataFrame:
    """The entry that counts when a problem was written more than once: the last."""
    return keep_last_wide(entries, KEY, ["seq"])


def store_summary(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Sizes per problem and one total row (NULL key).

    ``wasted_bytes`` belong to entries that a later one replaced. Entries are summed first,
    so a problem repeated a billion times is reduced before it is compared with its last one.
    """
    one_case = index.select(
        *KEY,
        "seq",
        F.lit(1).alias("cases"),
        "input_length",
        "output_length",
        "input_offset",
        (F.col("output_offset") + F.col("output_length")).alias("end_offset"),
    )
    # Entries without cases take part too: they can replace earlier ones.
    no_case = entries.filter("case_count = 0").select(
        *KEY,
        "seq",
        F.lit(0).alias("cases"),
        F.lit(0).cast("bigint").alias("input_length"),
        F.lit(0).cast("bigint").alias("output_length"),
        F.lit(None).cast("bigint").alias("input_offset"),
        F.lit(None).cast("bigint").alias("end_offset"),
    )
    per_entry = (
        one_case.unionByName(no_case)
        .groupBy(*KEY, "seq")
        .agg(
            F.sum("cases").alias("cases"),
            F.sum("input_length").alias("input_bytes"),
            F.sum("output_length").alias("output_bytes"),
            F.min("input_offset").alias("first_offset"),
            F.max("end_offset").alias("end_offset"),
        )
    )
    both = F.col("input_bytes") + F.col("output_bytes")
    per_problem = per_entry.groupBy(*KEY).agg(
        F.sum("cases").alias("cases"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("output_bytes").alias("output_bytes"),
        F.min("first_offset").alias("first_offset"),
        F.max("end_offset").alias("end_offset"),
        (F.sum(both) - F.max_by(both, F.col("seq"))).alias("wasted_bytes"),
    )
    return per_problem.groupingSets([[F.col(c) for c in KEY], []], *KEY).agg(
        F.sum("cases").alias("cases"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("output_bytes").alias("output_bytes"),
        F.min("first_offset").alias("first_offset"),
        F.max("end_offset").alias("end_offset"),
        F.sum("wasted_bytes").alias("wasted_bytes"),
    )


def packed_cases(latest: DataFrame) -> DataFrame:
    """Case texts of the entries that count."""
    return latest.select(*KEY, F.posexplode("test_cases").alias("case_no", "case")).select(
        *KEY, "case_no", "case.input", "case.output"
    )


def lookup_cases(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Answer ``request_id, contest_id, index, case_no`` requests from the latest entries.

    Requests for one popular case are spread in both joins: by salt against the counts, which
    are grouped by the key, and by Spark's own splitting against the cases.
    """
    counts = latest.select(*KEY, "case_count")
    answered = salted_join(requests, counts, KEY, "left").join(
        packed_cases(latest), [*KEY, "case_no"], "left"
    )
    out_of_range = (F.col("case_no") < 0) | (F.col("case_no") >= F.col("case_count"))
    status = (
        F.when(F.col("case_count").isNull(), "problem not found")
        .when(out_of_range, "case out of range")
        .otherwise("ok")
    )
    return answered.select(
        "request_id",
        *KEY,
        "case_no",
        "input",
        "output",
        F.coalesce("case_count", F.lit(0)).alias("total"),
        status.alias("status"),
    )


def list_problems(problems: DataFrame) -> DataFrame:
    """Distinct problems, sorted by contest and then by the bytes of the index."""
    return problems.select(*KEY).distinct().orderBy(*KEY)

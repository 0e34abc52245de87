"""The record files the library reads, with their schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gavel.functions.text import empty_if_null, lenient_int
from gavel.operators.planning import spec_seconds
from gavel.operators.rejects import split_rejects
from gavel.sources.jsonl import RecordSchema, rows_and_rejects, scan_jsonl

_CASES = "array<struct<input:string,output:string>>"
_TEXTS = ["time-limit", "memory-limit", "problem-description", "input-specification", "title", "demo-input", "demo-output"]

CONTEST = RecordSchema(
    f"contestId int, index string, code string, passedTestCount int, test_cases {_CASES}, "
    + ", ".join(f"`{name}` string" for name in _TEXTS),
    lenient_texts=_TEXTS,
)
PREPARED = RecordSchema(
    f"code string, contest_id int, index string, test_cases {_CASES}, time_limit string, memory_limit string"
)

# Years and scores are lenient, so they are read as text.
_OLYMPIAD_FIELDS = (
    "id: string, year: string, sample_solution: string, sub_tasks: array<struct<name:string,score:string,"
    "test_case_names:array<string>,limit:struct<time_limit:double,memory_limit:double>>>, "
    "grader_files: map<string,string>, test_cases: map<string,struct<input:string,output:string>>"
)
OLYMPIAD = RecordSchema(f"metadata: struct<{_OLYMPIAD_FIELDS}>, {_OLYMPIAD_FIELDS}")
SPEC = RecordSchema(
    "name string, input string, output string, memory_limit_mb int, memory_limit_in_mb int, time_limit string"
)


def read_contest(
    spark: SparkSession, paths: Sequence[str], on_error: str = "split", line_numbers: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Contest submissions or problems; a missing contest id is 0."""
    scanned = scan_jsonl(spark, paths, CONTEST, line_numbers)
    keyed = F.col("record").withField("contestId", F.coalesce("record.contestId", F.lit(0)))
    return rows_and_rejects(scanned.withColumn("record", keyed), on_error)


def read_prepared(
    spark: SparkSession, paths: Sequence[str], on_error: str = "split", line_numbers: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Prepared contest problems, the input of the packed store."""
    return rows_and_rejects(scan_jsonl(spark, paths, PREPARED, line_numbers), on_error)


def _whole_scores(tasks: Column) -> Column:
    return F.transform(
        tasks, lambda task: task.withField("score", lenient_int(task["score"]).try_cast("int"))
    )


def read_olympiad(
    spark: SparkSession, paths: Sequence[str], on_error: str = "split", line_numbers: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Olympiad problem records in either layout, with lenient years and scores made whole."""
    scanned = scan_jsonl(spark, paths, OLYMPIAD, line_numbers)
    bad_year, bad_score = F.lit(False), F.lit(False)
    for level in ("record", "record.metadata"):
        # Whole numbers beyond 32 bits are rejected too, instead of failing the load.
        bad_year = bad_year | lenient_int(F.col(f"{level}.year")).try_cast("int").isNull()
        wrong = F.exists(
            f"{level}.sub_tasks", lambda task: lenient_int(task["score"]).try_cast("int").isNull()
        )
        bad_score = bad_score | F.coalesce(wrong, F.lit(False))
    reason = F.coalesce(
        F.col("reason"),
        F.when(bad_year, "year is not an integer").when(bad_score, "score is not an integer"),
    )

    def whole(level: str) -> list[Column]:
        return [
            lenient_int(F.col(f"{level}.year")).alias("year"),
            _whole_scores(F.col(f"{level}.sub_tasks")).alias("sub_tasks"),
            *[F.col(f"{level}.{name}") for name in ("id", "sample_solution", "grader_files", "test_cases")],
        ]

    nested = F.when(F.col("record.metadata").isNotNull(), F.struct(*whole("record.metadata")))
    record = F.struct(nested.alias("metadata"), *whole("record"))
    return rows_and_rejects(
        scanned.withColumn("reason", reason).withColumn("record", record), on_error
    )


def read_test_specs(
    spark: SparkSession, paths: Sequence[str], on_error: str = "split"
) -> tuple[DataFrame, DataFrame]:
    """Judge test specifications; either spelling of the limits is taken."""
    rows, rejects = rows_and_rejects(scan_jsonl(spark, paths, SPEC, line_numbers=True), on_error)
    given, got = {}, F.lit(None).cast("string")
    for name in ("input", "output"):
        given[name] = F.try_to_binary(empty_if_null(F.col(name)), F.lit("base64"))
        got = F.coalesce(got, F.when(given[name].isNull(), f"{name} is not base64"))
    seconds = spec_seconds(F.col("time_limit"))
    got = F.coalesce(
        got, F.when(F.col("time_limit").isNotNull() & seconds.isNull(), "time limit is not a duration")
    )
    good, bad = split_rejects(rows, got, on_error)
    columns = ["seq", "path", "line_no"]
    return (
        good.select(
            *columns,
            empty_if_null(F.col("name")).alias("name"),
            given["input"].alias("input"),
            given["output"].alias("output"),
            seconds.alias("time_limit"),
            F.coalesce("memory_limit_mb", "memory_limit_in_mb").alias("memory_limit_mb"),
        ),
        rejects.unionByName(bad.select(*columns, "reason"), allowMissingColumns=True),
    )

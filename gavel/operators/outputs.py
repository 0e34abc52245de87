"""Captured files and what they say."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gavel.functions.text import JSON_LIMITS, is_blank, python_int, strip
from gavel.functions.verdicts import UNKNOWN_STATUS, run_status_name
from gavel.operators.rejects import split_rejects

# Capture patterns of the job kinds.
CAPTURE_PATTERNS = {
    "cpp_oj": r"^workspace/(judge_result\.jsonl|compile_errors\.txt)$",
    "compile_cpp": r"^workspace/(compile_errors\.txt|solution)$",
    "run_program": r"^workspace/(runprog\.result|program\.stdout|program\.stderr)$",
    "compile_ioi_binary": r"^workspace/(solution|checker|manager)$",
}
# Output column -> captured path.
OUTPUT_FILES = {
    "compile_errors": "workspace/compile_errors.txt",
    "judge_result": "workspace/judge_result.jsonl",
    "run_result": "workspace/runprog.result",
    "program_stdout": "workspace/program.stdout",
    "program_stderr": "workspace/program.stderr",
    "solution": "workspace/solution",
    "checker": "workspace/checker",
    "manager": "workspace/manager",
}

# Fixed value: four integers of at most 18 digits.
PLAIN_RUN_RESULT = r"^\s*[+-]?\d{1,18}(\s+[+-]?\d{1,18}){3}\s*$"

_NOT_LINEAR = re.compile(r"\(\?(=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")

JUDGE_RESULT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField(
            "details",
            T.StructType(
                [
                    T.StructField("time_ms", T.IntegerType()),
                    T.StructField("memory_kb", T.LongType()),
                    T.StructField("exit_code", T.IntegerType()),
                    T.StructField("status", T.StringType()),
                ]
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def check_pattern(pattern: str) -> str:
    """Refuse patterns a linear-time matcher would not take, and broken ones."""
    if _NOT_LINEAR.search(pattern):
        raise ValueError(f"look-around, back-references and possessive repeats: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"compile capture pattern: {error}") from error
    return pattern


def capture_files(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose relative ``path`` matches anywhere; an empty pattern keeps none."""
    if pattern == "":
        return files.filter(F.lit(False))
    return files.filter(F.col("path").rlike(check_pattern(pattern)))


def pivot_outputs(
    files: DataFrame, order_by: Column, wanted: Mapping[str, str] = OUTPUT_FILES
) -> DataFrame:
    """One row per ``job`` with a column per wanted file; the last of equal paths counts.

    The columns are a fixed list, so each is one partial aggregate and a job with any
    number of files is reduced inside the map tasks.
    """
    return files.groupBy("job").agg(
        *[
            F.max_by("content", F.when(F.col("path") == path, order_by)).alias(name)
            for name, path in wanted.items()
        ]
    )


def parse_run_results(runs: DataFrame, on_error: str = "split") -> tuple[DataFrame, DataFrame]:
    """``(runs, rejects)`` with status, time in seconds, memory in KB and exit code.

    Reads ``run_result`` (binary ``status time_ms memory_kb exit_code``) and ``job_exit_code``,
    the code that stands where no run result was written.
    """
    raw = F.col("run_result").cast("string")
    present = F.col("run_result").isNotNull()
    # One match settles nearly every row; only the others are taken apart to say why. The
    # reason is the filter of both results, so it has to stay cheap.
    plain = raw.rlike(PLAIN_RUN_RESULT)
    tokens = F.split(strip(raw), r"(?U)\s+")
    count = F.when(strip(raw) == "", 0).otherwise(F.size(tokens))
    slow = F.transform(tokens, python_int)
    reason = (
        F.when(~present | plain, F.lit(None).cast("string"))
        .when(~F.is_valid_utf8(raw), "run result is not valid utf-8")
        .when(count != 4, F.concat(F.lit("run result malformed: got "), count, F.lit(" tokens")))
        .when(F.exists(slow, lambda n: n.isNull()), "run result contains non-integer values")
    )
    good, bad = split_rejects(runs, reason, on_error)
    numbers = F.when(plain, F.transform(tokens, lambda n: n.cast("bigint"))).otherwise(slow)
    code = F.col("_numbers")[0]
    typed = (
        good.withColumn("_numbers", numbers)
        .withColumn(
            "status",
            F.when(present, run_status_name(F.when(code.between(0, 7), code))).otherwise(UNKNOWN_STATUS),
        )
        .withColumn("time_seconds", F.col("_numbers")[1] / 1000)
        .withColumn("memory_kb", F.col("_numbers")[2])
        .withColumn(
            "exit_code",
            F.when(present, F.col("_numbers")[3]).otherwise(F.col("job_exit_code").cast("bigint")),
        )
        .drop("_numbers")
    )
    return typed, bad


def compile_outcome(jobs: DataFrame, olympiad: bool = False) -> DataFrame:
    """Outcome of compile jobs: ``outcome``, ``message`` and, when compiled, the binaries.

    A captured compile-errors file is the answer whatever the exit code. Olympiad jobs have no
    such file; they must yield a solution.
    """
    text = F.col("compile_errors").cast("string")
    failed = F.col("exit_code") != 0
    streams = F.concat(
        F.lit("exit code "), F.col("exit_code"),
        F.lit("\nstdout: "), F.coalesce(F.col("stdout").cast("string"), F.lit("")),
        F.lit("\nstderr: "), F.coalesce(F.col("stderr").cast("string"), F.lit("")),
    )
    no_solution = F.col("solution").isNull()
    if olympiad:
        outcome = F.when(failed, "failed").when(no_solution, "no solution binary").otherwise("compiled")
        message = F.when(failed, streams)
    else:
        outcome = (
            F.when(text.isNotNull(), "compile error").when(failed, "failed")
            .when(no_solution, "no binary").otherwise("compiled")
        )
        message = F.when(text.isNotNull(), text).when(failed, streams)
    return jobs.withColumn("outcome", outcome).withColumn("message", message)


def judge_records() -> Column:
    """The parsed non-blank lines of ``judge_result``, an array."""
    lines = F.filter(
        F.split(F.col("judge_result").cast("string"), "\n"), lambda line: ~is_blank(line)
    )
    return F.transform(lines, lambda line: F.from_json(line, JUDGE_RESULT, JSON_LIMITS))


def broken_record(record: Column) -> Column:
    """Why a parsed line is no result, or null."""
    broken = record["_corrupt_record"].isNotNull() | record["name"].isNull()
    return F.when(broken, "invalid result line")


def explode_judge_results(jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(results, compile_errors, rejects)`` of online-judge jobs.

    One result row per non-blank line of ``judge_result``, with its position among them.
    """
    reason = F.when(F.col("exit_code") != 0, "execution failed").when(
        F.col("compile_errors").isNull() & F.col("judge_result").isNull(), "judge result file not found"
    )
    good, rejects = split_rejects(jobs, reason)
    errors = good.filter("compile_errors IS NOT NULL").select(
        "job", F.col("compile_errors").cast("string").alias("compile_error")
    )
    # Parsed inside the explode, so that the filters below do not parse each line again; outer,
    # as an inner one gets a filter of its own.
    parsed = (
        good.filter("compile_errors IS NULL")
        .select("job", F.posexplode_outer(judge_records()).alias("position", "r"))
        .filter("position IS NOT NULL")
    )
    results, bad_lines = split_rejects(parsed, broken_record(F.col("r")))
    return (
        results.select(
            "job", "position", F.col("r.name").alias("case_name"),
            F.col("r.error").alias("error"), F.col("r.details").alias("details"),
        ),
        errors,
        rejects.select("job", F.lit(None).cast("int").alias("position"), "reason").unionByName(
            bad_lines.select("job", "position", "reason")
        ),
    )

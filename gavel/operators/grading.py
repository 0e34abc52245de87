"""From outputs to verdicts and scores."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gavel.functions import verdicts as v
from gavel.functions.text import python_float, strip
from gavel.operators.outputs import broken_record, judge_records
from gavel.operators.planning import TASK_KEY

PREVIEW_BYTES = 64
FULL_SCORE = 100.0
SCORE_TOLERANCE = 1e-6


def preview(content: Column) -> Column:
    """The first bytes, as text where they are plain text and in hex where they are not."""
    head = F.substring(content, 1, PREVIEW_BYTES)
    text = head.cast("string")
    printable = F.is_valid_utf8(text) & ~text.rlike(r'[\x00-\x1f\x7f"\\]')
    shown = F.when(printable, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("0x"), F.hex(head))
    )
    size = F.octet_length(content)
    return F.when(size == 0, "<empty>").otherwise(
        F.concat(shown, F.when(size > PREVIEW_BYTES, "...").otherwise(""))
    )


def compare_outputs(outputs: DataFrame) -> DataFrame:
    """Byte-exact comparison of ``got`` with ``want``; a missing output is an empty one."""
    empty = F.lit("").cast("binary")
    got, want = F.coalesce("got", empty), F.coalesce("want", empty)
    message = F.concat(
        F.lit("output mismatch: got "), preview(got), F.lit(" (len="), F.octet_length(got),
        F.lit("), want "), preview(want), F.lit(" (len="), F.octet_length(want), F.lit(")"),
    )
    return outputs.withColumn("matches", got == want).withColumn(
        "mismatch", F.when(~F.col("matches"), message)
    )


def case_error(runs: DataFrame) -> DataFrame:
    """Add ``error``: the first that applies of timeout, exit code, launch failure, mismatch.

    Needs ``timed_out, wall_timeout, exit_code, stderr, launch_error`` and ``mismatch``.
    """
    stderr = strip(F.coalesce(F.col("stderr").cast("string"), F.lit("")))
    code = F.concat(F.lit("exit code "), F.col("exit_code"))
    error = (
        F.when(F.col("timed_out"), F.concat(F.lit("timeout after "), F.col("wall_timeout")))
        .when(
            F.col("launch_error").isNull() & (F.col("exit_code") != 0),
            F.when(stderr != "", F.concat(code, F.lit(": "), stderr)).otherwise(code),
        )
        .when(
            F.col("launch_error").isNotNull(),
            F.concat(F.lit("failed to execute binary: "), F.col("launch_error")),
        )
        .otherwise(F.col("mismatch"))
    )
    return runs.withColumn("error", error)


def verdict_of(error: Column, details_status: Column) -> Column:
    """The verdict of one result; null where its status is unknown."""
    status = F.coalesce(details_status, F.lit("Fatal Error"))
    return (
        F.when(error.isNull(), v.ACCEPTED)
        .when(status.isin(v.SYSTEM_FAULTS), v.SYSTEM_ERROR)
        .when(status == v.TIME_LIMIT, v.TIME_LIMIT)
        .when(status == v.MEMORY_LIMIT, v.MEMORY_LIMIT)
        .when(status == v.RUNTIME_ERROR, v.RUNTIME_ERROR)
        .when(status.isin(v.WRONG_OUTPUT), v.WRONG_ANSWER)
    )


def case_verdict(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(results with verdict, rejects)`` from ``error`` and ``details.status``."""
    verdict = verdict_of(F.col("error"), F.col("details.status"))
    judged = results.withColumn("verdict", verdict)
    return judged.filter("verdict IS NOT NULL"), judged.filter("verdict IS NULL").drop(
        "verdict"
    ).withColumn("reason", F.concat(F.lit("unknown status: "), F.col("details.status")))


def submission_verdict(
    jobs: DataFrame, results: DataFrame, compile_errors: DataFrame | None = None
) -> DataFrame:
    """One verdict per ``job``: compilation error, else the first case not accepted, else accepted."""
    # Position and verdict in one number keep this a hash aggregate; a text would need a sort.
    names = F.array(*[F.lit(name) for name in v.NOT_ACCEPTED])
    code = F.nullif(F.array_position(names, F.col("verdict")), F.lit(0))
    base = len(v.NOT_ACCEPTED) + 1
    first_bad = (
        results.groupBy("job")
        .agg(F.min(F.col("position").cast("bigint") * base + code).alias("first"))
        .select("job", F.get(names, (F.col("first") % base - 1).cast("int")).alias("first_bad"))
    )
    judged = jobs.select("job").join(first_bad, "job", "left")
    compiled = F.lit(True)
    if compile_errors is not None:
        flags = compile_errors.select("job", F.lit(True).alias("has_error"))
        judged = judged.join(flags, "job", "left")
        compiled = F.col("has_error").isNull()
    return judged.select(
        "job",
        F.when(~compiled, v.COMPILE_ERROR)
        .otherwise(F.coalesce("first_bad", F.lit(v.ACCEPTED)))
        .alias("verdict"),
    )


def suite_failed(cases: DataFrame) -> DataFrame:
    """Whether any case of a ``suite`` has an error."""
    return cases.groupBy("suite").agg(
        F.bool_or(F.coalesce(F.col("error"), F.lit("")) != "").alias("failed")
    )


def case_scores(runs: DataFrame) -> DataFrame:
    """Add ``kind``, ``score``, ``detail`` and ``memory_mb`` to finished runs.

    Needs ``status, stdout, stderr, time_seconds, memory_kb``.
    """
    number = python_float(F.col("stdout").cast("string"))
    scored = (F.col("status") == "Normal") & number.isNotNull()
    kind = (
        F.when(F.col("status").isNull(), "SystemError")
        .when(F.col("status") == v.TIME_LIMIT, "TimeLimitExceeded")
        .when(F.col("status") == v.MEMORY_LIMIT, "MemoryLimitExceeded")
        .when(scored, "JudgedScore")
        .otherwise("UnknownResult")
    )
    judged = F.col("kind") == "JudgedScore"
    return (
        runs.withColumn("kind", kind)
        .withColumn("score", F.when(judged, number).otherwise(0.0))
        .withColumn("detail", F.when(judged, strip(F.col("stderr").cast("string"))))
        .withColumn("time_seconds", F.when(judged, F.coalesce("time_seconds", F.lit(0.0))))
        .withColumn("memory_mb", F.when(judged, F.coalesce(F.col("memory_kb") / 1024, F.lit(0.0))))
    )


def one_result_per_task(scores: DataFrame, order_by: str | None = None) -> DataFrame:
    """Task key and score: the last result by ``order_by``, or the lowest where no order is given."""
    last = F.max_by("score", order_by) if order_by else F.min("score")
    return scores.groupBy(*TASK_KEY).agg(last.alias("score"))


def submission_verdicts(
    jobs: DataFrame, results: DataFrame, compile_errors: DataFrame, rejects: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(verdicts, rejects)`` of whole jobs, from what ``explode_judge_results`` made of them.

    A job with any line that cannot be judged has no verdict, whatever its other lines say;
    its reason is that of its first such line.
    """
    judged, unknown = case_verdict(results)
    lines = rejects.select("job", "position", "reason").unionByName(
        unknown.select("job", "position", "reason")
    )
    refused = lines.groupBy("job").agg(F.min(F.struct("position", "reason"))["reason"].alias("reason"))
    kept = jobs.join(refused.select("job"), "job", "left_anti")
    return submission_verdict(kept, judged, compile_errors), refused


def judged_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``submission_verdicts`` of whole jobs straight from their rows: ``(verdicts, rejects)``.

    A job's results are lines of one value, so its verdict needs no other row: every line is parsed
    once, where the job is read, and nothing is shuffled.
    """
    failed = F.when(F.col("exit_code") != 0, "execution failed").when(
        F.col("compile_errors").isNull() & F.col("judge_result").isNull(), "judge result file not found"
    )

    def judged(r: Column) -> Column:
        verdict = verdict_of(r["error"], r["details"]["status"])
        unknown = F.when(verdict.isNull(), F.concat(F.lit("unknown status: "), r["details"]["status"]))
        return F.struct(verdict.alias("verdict"), F.coalesce(broken_record(r), unknown).alias("reason"))

    lines = F.when(failed.isNull() & F.col("compile_errors").isNull(), F.transform(judge_records(), judged))
    # In an explode, so that a filter on the outcome does not parse the lines again.
    made = jobs.select(
        "job", F.col("compile_errors").isNotNull().alias("_compile"), failed.alias("_failed"),
        F.explode_outer(F.array(lines)).alias("_lines"),
    )
    bad = F.get(F.filter("_lines", lambda x: x["reason"].isNotNull()), F.lit(0))["reason"]
    first = F.get(F.filter("_lines", lambda x: x["verdict"] != v.ACCEPTED), F.lit(0))["verdict"]
    settled = made.select(
        "job",
        F.coalesce("_failed", bad).alias("reason"),
        F.when(F.col("_compile"), v.COMPILE_ERROR).otherwise(F.coalesce(first, F.lit(v.ACCEPTED))).alias("verdict"),
    )
    return (
        settled.filter("reason IS NULL").select("job", "verdict"),
        settled.filter("reason IS NOT NULL").select("job", "reason"),
    )


def sub_task_scores(
    cases: DataFrame, scores: DataFrame, order_by: str | None = None
) -> DataFrame:
    """Mean case score times the points of each sub-task.

    ``cases`` comes from ``sub_task_cases``; ``scores`` has the task key and ``score``. Of
    sub-tasks with one name the last counts, and of results for one task the last by ``order_by``.
    A sub-task with a case that was never run has no
    score but a reason. Sub-tasks without cases have no row here; see ``empty_sub_tasks``.
    """
    single = one_result_per_task(scores, order_by).withColumnsRenamed(
        {key: f"_{key}" for key in TASK_KEY}
    )
    # A limit that is not set is the same task as another that is not set.
    same = F.lit(True)
    for key in TASK_KEY:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    joined = cases.join(single, same, "left")
    summed = joined.groupBy("problem_id", "sub_task", "sub_task_position").agg(
        F.max("points").alias("points"),
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(F.col("score").isNull()).alias("n_missing"),
        F.sum("score").alias("case_total"),
    )
    # One max_by per number keeps this a hash aggregate; a struct would need a sort.
    last = summed.groupBy("problem_id", "sub_task").agg(
        F.max("sub_task_position").alias("last_position"),
        *[
            F.max_by(c, "sub_task_position").alias(c)
            for c in ("points", "n_cases", "n_missing", "case_total")
        ],
    )
    complete = F.col("n_missing") == 0
    return last.select(
        "problem_id",
        "sub_task",
        F.col("last_position").alias("sub_task_position"),
        "points",
        "n_cases",
        F.when(complete, F.try_divide("case_total", "n_cases") * F.col("points")).alias("score"),
        F.when(~complete, "case without result").alias("reason"),
    )


def empty_sub_tasks(sub_tasks: DataFrame) -> DataFrame:
    """Sub-tasks without cases, which have no mean: rejects of the scoring."""
    return sub_tasks.filter(F.coalesce(F.size("test_case_names"), F.lit(0)) <= 0).select(
        "problem_id",
        F.col("name").alias("sub_task"),
        F.lit("sub-task without cases").alias("reason"),
    )


def problem_scores(
    problems: DataFrame, sub_task_scores: DataFrame, rejects: DataFrame | None = None
) -> DataFrame:
    """Sum of the sub-task scores per problem, 0 where there are none.

    A problem with an unscored sub-task (or one in ``rejects``) has no score but a ``reason``.
    """
    parts = sub_task_scores.select("problem_id", "score")
    if rejects is not None:
        parts = parts.unionByName(
            rejects.select("problem_id", F.lit(None).cast("double").alias("score"))
        )
    totals = parts.groupBy("problem_id").agg(
        F.sum("score").alias("total"), F.count_if(F.col("score").isNull()).alias("unscored")
    )
    unscored = F.coalesce("unscored", F.lit(0))
    return problems.join(totals, "problem_id", "left").select(
        *problems.columns,
        F.when(unscored == 0, F.coalesce("total", F.lit(0.0))).alias("score"),
        F.when(unscored > 0, F.concat(unscored, F.lit(" sub-tasks without a score"))).alias("reason"),
    )


def score_audit(scored: DataFrame) -> DataFrame:
    """Problems that did not reach the full score or raised, with ``error`` and what tells their place.

    ``with_raw_lines`` of the scoring plan fetches the lines themselves.
    """
    # NaN compares greater than every number in Spark, so it is reported as well.
    off = F.abs(F.col("score") - FULL_SCORE) > SCORE_TOLERANCE
    error = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        off, F.concat(F.lit("expected score 100, got "), F.round("score", 6).cast("string"))
    )
    place = [c for c in scored.columns if c not in ("score", "reason")]
    return scored.select(*place, error.alias("error")).filter("error IS NOT NULL")


def audit_passed(scored: DataFrame) -> DataFrame:
    """One row: did every line reach the full score?"""
    off = F.coalesce(F.abs(F.col("score") - FULL_SCORE) > SCORE_TOLERANCE, F.lit(True))
    return scored.agg(
        (~F.coalesce(F.bool_or(F.col("reason").isNotNull() | off), F.lit(False))).alias("passed")
    )


def apply_solver(cases: DataFrame, solver: Callable[[bytes], bytes]) -> DataFrame:
    """Run a registered, trusted callable over every case ``input``: adds got, time_ms, launch_error.

    There is no sandbox and no limit: use it for checkers and model solutions of one's own. A
    worker is sent ``spark.sql.execution.arrow.maxRecordsPerBatch`` inputs at a time; lower that
    setting where inputs are large.
    """
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema.fields]
        + ["got binary", "time_ms double", "launch_error string"]
    )

    def one(content: bytes) -> tuple[bytes | None, float, str | None]:
        began = time.perf_counter()
        try:
            got, error = solver(bytes(content)), None
        except Exception as failure:  # a failing case is a result, not a failed job
            got, error = None, f"{type(failure).__name__}: {failure}"
        return got, (time.perf_counter() - began) * 1000, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [one(content) for content in batch["input"]]
            yield batch.assign(
                got=[a[0] for a in answers],
                time_ms=[a[1] for a in answers],
                launch_error=pd.Series([a[2] for a in answers], index=batch.index, dtype="object"),
            )

    return cases.mapInPandas(run, schema)

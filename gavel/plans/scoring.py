"""Scores from sub-tasks and execution results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gavel.operators import grading, planning
from gavel.operators.outputs import parse_run_results
from gavel.session import materialized


def score_problems(
    problems: DataFrame,
    sub_tasks: DataFrame,
    runs: DataFrame,
    outcomes: DataFrame | None = None,
    order_by: str | None = None,
) -> dict[str, DataFrame]:
    """Grade executed tasks and roll them up to sub-tasks and problems.

    ``runs`` has the task key, ``run_result``, ``job_exit_code``, ``stdout`` and ``stderr``; a
    run whose result cannot be read leaves its case without a result. With ``outcomes`` of the
    compile jobs, a problem that did not compile scores 0 and has the compiler's ``detail``.
    """
    cases = planning.sub_task_cases(sub_tasks)
    parsed, unreadable = parse_run_results(runs)
    scores = grading.case_scores(parsed)
    per_task = grading.sub_task_scores(cases, scores, order_by)
    empty = grading.empty_sub_tasks(sub_tasks)
    totals = grading.problem_scores(problems, per_task, empty)
    if outcomes is not None:
        failed = compile_failures(problems, outcomes).select(
            "problem_id", F.lit(True).alias("_failed"), "detail"
        )
        none = F.lit(None).cast("string")
        totals = (
            totals.join(failed, "problem_id", "left")
            .withColumn("score", F.when(F.col("_failed"), 0.0).otherwise(F.col("score")))
            .withColumn("reason", F.when(F.col("_failed"), none).otherwise(F.col("reason")))
            .drop("_failed")
        )
    return {
        "tasks": planning.judge_tasks(cases),
        "case_scores": scores,
        "sub_task_scores": per_task,
        "problem_scores": totals,
        "rejects": unreadable,
    }


def compile_failures(problems: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Problems whose compile job failed: score 0 with the compiler's message as detail."""
    failed = outcomes.filter("outcome <> 'compiled'").select(
        "problem_id", F.col("message").alias("detail")
    )
    return problems.join(failed, "problem_id").withColumn("score", F.lit(0.0))


def with_raw_lines(audit: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows that have ``file`` and ``line_no`` with the ``line`` that stands there.

    ``lines`` comes from ``with_line_numbers``. Raw lines are long and few are asked for, so they take no
    part in the scoring: the wanted places are written first, and the file is read once more.
    """
    wanted = materialized(audit)
    placed = lines.select(F.col("seq.file").alias("file"), "line_no", "line")
    return placed.join(wanted, ["file", "line_no"]).select(*audit.columns, "line")

"""Olympiad records flattened into relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gavel.functions.text import empty_if_null, float32
from gavel.operators.ordering import row_numbers
from gavel.operators.rejects import split_rejects


def _has_items(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def unify_layout(records: DataFrame) -> DataFrame:
    """One layout from fields at top level or under ``metadata``.

    Id, year and solution come from the top level only when ``metadata`` has no id; the
    nested collections come from the top level whenever they are not empty there.
    """
    nested_id = empty_if_null(F.col("metadata.id"))
    top_id = empty_if_null(F.col("id"))
    use_top = (nested_id == "") & (top_id != "")

    def collection(name: str) -> Column:
        return F.when(_has_items(F.col(name)), F.col(name)).otherwise(F.col(f"metadata.{name}"))

    def scalar(name: str) -> Column:
        return F.when(use_top, F.col(name)).otherwise(F.col(f"metadata.{name}"))

    taken = {"metadata", "id", "year", "sample_solution", "sub_tasks", "test_cases", "grader_files"}
    return records.select(
        *[c for c in records.columns if c not in taken],
        F.when(use_top, top_id).otherwise(nested_id).alias("name"),
        F.coalesce(scalar("year"), F.lit(0)).try_cast("int").alias("year"),
        scalar("sample_solution").alias("sample_solution"),
        collection("sub_tasks").alias("sub_tasks"),
        collection("test_cases").alias("test_cases"),
        collection("grader_files").alias("grader_files"),
    )


def reject_unkeyed(problems: DataFrame, on_error: str = "split") -> tuple[DataFrame, DataFrame]:
    """``(problems, rejects)`` by presence of a name and a year."""
    unkeyed = (empty_if_null(F.col("name")) == "") | (F.coalesce("year", F.lit(0)) == 0)
    return split_rejects(
        problems, F.when(unkeyed, F.lit("missing metadata id or year")), on_error
    )


def reject_sub_tasks(problems: DataFrame, on_error: str = "split") -> tuple[DataFrame, DataFrame]:
    """``(problems, rejects)`` by their sub-tasks: names unique in the problem, scores that fit.

    Arrays within the row decide, so nothing is shuffled.
    """
    names = F.transform("sub_tasks", lambda task: empty_if_null(task["name"]))
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    large = F.exists(
        "sub_tasks",
        lambda task: task["score"].isNotNull() & task["score"].try_cast("int").isNull(),
    )
    reason = F.when(F.coalesce(repeated, F.lit(False)), "repeated sub-task name").when(
        F.coalesce(large, F.lit(False)), "sub-task score out of range"
    )
    return split_rejects(problems, reason, on_error)


def _by_name(entries: str) -> Column:
    """Entries of a map with their place in the order of names."""
    return F.posexplode(F.sort_array(F.map_entries(entries))).alias("position", "entry")


def named_cases(problems: DataFrame) -> DataFrame:
    """One row per test case: ``problem_id, position, name, input, output``.

    ``position`` is the place of the name in the problem. Columns after ``problem_id`` that
    start with ``first_`` are passed on.
    """
    return problems.select("problem_id", *_offsets(problems), _by_name("test_cases")).select(
        "problem_id",
        *_offsets(problems),
        "position",
        F.col("entry.key").alias("name"),
        empty_if_null(F.col("entry.value.input")).alias("input"),
        empty_if_null(F.col("entry.value.output")).alias("output"),
    )


def case_names(problems: DataFrame) -> DataFrame:
    """The names and positions of :func:`named_cases` without the texts."""
    names = F.posexplode(F.sort_array(F.map_keys("test_cases"))).alias("position", "name")
    return problems.select("problem_id", *_offsets(problems), names)


def grader_files(problems: DataFrame) -> DataFrame:
    """One row per grader file in name order: ``problem_id, position, name, content``."""
    return problems.select("problem_id", *_offsets(problems), _by_name("grader_files")).select(
        "problem_id",
        *_offsets(problems),
        "position",
        F.col("entry.key").alias("name"),
        empty_if_null(F.col("entry.value")).alias("content"),
    )


def _offsets(problems: DataFrame) -> list[str]:
    return [c for c in problems.columns if c.startswith("first_")]


def sub_tasks(problems: DataFrame) -> DataFrame:
    """One row per sub-task with its position and its case names; limits in single precision."""
    return problems.select(
        "problem_id", *_offsets(problems), F.posexplode("sub_tasks").alias("position", "task")
    ).select(
        "problem_id",
        *_offsets(problems),
        "position",
        empty_if_null(F.col("task.name")).alias("name"),
        F.coalesce("task.score", F.lit(0)).try_cast("int").alias("score"),
        float32(F.coalesce("task.limit.time_limit", F.lit(0.0))).alias("time_limit"),
        float32(F.coalesce("task.limit.memory_limit", F.lit(0.0))).alias("memory_limit"),
        F.col("task.test_case_names").alias("test_case_names"),
    )


def case_references(sub_tasks: DataFrame) -> DataFrame:
    """Case names of every sub-task, with position; repeated names stay repeated.

    ``sub_tasks`` needs ``problem_id``, ``position``, ``test_case_names`` and, for links, ``id``.
    """
    carried = [c for c in ("problem_id", "position", "id") if c in sub_tasks.columns]
    return sub_tasks.select(
        *carried, F.posexplode("test_case_names").alias("case_position", "case_name")
    )


def record_links(names: Column) -> Column:
    """All case references of a record's ``sub_tasks``, in order: an array of ``sub_task``,
    ``case_position``, ``case_name`` and ``place``, from 1 among the record's case ``names``, 0 where it has
    no such case. A record holds both sides, so nothing is joined. ``names`` is read for every reference:
    pass a column that holds them, not an expression."""

    def of_task(task: Column, k: Column) -> Column:
        given = F.coalesce(task["test_case_names"], F.array().cast("array<string>"))
        return F.transform(
            given,
            lambda name, j: F.struct(
                k.alias("sub_task"),
                j.alias("case_position"),
                name.alias("case_name"),
                F.coalesce(F.array_position(names, name), F.lit(0)).alias("place"),
            ),
        )

    none = F.array().cast("array<struct<sub_task:int,case_position:int,case_name:string,place:bigint>>")
    return F.coalesce(F.flatten(F.transform("sub_tasks", of_task)), none)


def link_sub_tasks(sub_tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """``sub_task_id, case_position, test_case_id`` for every name found in the same problem."""
    known = cases.select(
        "problem_id", F.col("name").alias("case_name"), F.col("id").alias("test_case_id")
    )
    return (
        case_references(sub_tasks)
        .join(known, ["problem_id", "case_name"])
        .select(F.col("id").alias("sub_task_id"), "case_position", "test_case_id")
    )


def missing_case_refs(sub_tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """Sub-task references to cases the problem does not have."""
    known = cases.select("problem_id", F.col("name").alias("case_name"))
    return case_references(sub_tasks).join(known, ["problem_id", "case_name"], "left_anti")


def next_id(existing: DataFrame | None) -> int | Column:
    """One more than the largest id, 1 for an empty or absent table."""
    if existing is None:
        return 1
    return existing.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id")).scalar()


def assign_ids(
    df: DataFrame, order_by: list[str], existing: DataFrame | None = None
) -> DataFrame:
    """Dense ``id`` from the next free one, in the unique total order ``order_by``.

    Pass narrow rows: they are ranged and written once.
    """
    return row_numbers(df, order_by, "id", next_id(existing))

"""Checks for the unique and foreign keys that Spark does not enforce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gavel.session import materialized

# Declared keys of the catalogue tables.
UNIQUE_KEYS = {
    "problems": ["year", "name"],
    "test_cases": ["problem_id", "name"],
    "sub_tasks": ["problem_id", "name"],
    "grader_files": ["problem_id", "name"],
    "contest_problems": ["contest_id", "problem_index"],
    "contest_cases": ["problem_id", "case_offset"],
}
# Fixed values: (child table, column) -> parent table.
FOREIGN_KEYS = {
    ("test_cases", "problem_id"): "problems",
    ("sub_tasks", "problem_id"): "problems",
    ("sub_task_test_cases", "sub_task_id"): "sub_tasks",
    ("sub_task_test_cases", "test_case_id"): "test_cases",
    ("grader_files", "problem_id"): "problems",
    ("contest_cases", "problem_id"): "contest_problems",
}


def repeated_keys(
    df: DataFrame, keys: Sequence[str], existing: DataFrame | None = None
) -> DataFrame:
    """The keys that occur more than once in ``df`` and ``existing`` together, as a written table."""
    seen = df.select(*keys)
    if existing is not None:
        seen = seen.unionByName(existing.select(*keys))
    return materialized(seen.groupBy(*keys).count().filter("count > 1").select(*keys))


def unique_violations(
    df: DataFrame, keys: Sequence[str], existing: DataFrame | None = None
) -> DataFrame:
    """Rows of ``df`` whose key occurs more than once in ``df`` and ``existing`` together.

    The repeated keys are written first. There are few as a rule; Spark then knows it and sends them
    to the rows, and if there are many, it shuffles both sides and can split a hot key. Where there are
    none, the rows are not made again.
    """
    keys = list(keys)
    repeated = repeated_keys(df, keys, existing)
    if repeated.isEmpty():
        return df.filter(F.lit(False))
    return df.join(repeated, keys, "left_semi")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows of ``child`` whose ``column`` names no parent."""
    known = parent.select(F.col(parent_key).alias(column))
    return child.join(known, column, "left_anti")


def key_problems(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """One frame of offending rows per declared key whose tables are given."""
    found = {
        f"unique {table}({', '.join(keys)})": unique_violations(tables[table], keys)
        for table, keys in UNIQUE_KEYS.items()
        if table in tables
    }
    for (child, column), parent in FOREIGN_KEYS.items():
        if child in tables and parent in tables:
            found[f"orphan {child}({column})"] = orphan_rows(tables[child], column, tables[parent])
    return found

"""Batches of catalogue lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gavel.functions.text import empty_if_null, is_safe_file_name
from gavel.operators.joins import salted_join
from gavel.operators.ordering import keep_last_wide

# Accepted column names, first match wins.
NAME_COLUMNS = ["name", "filename", "file_name"]
CONTENT_COLUMNS = ["content", "data", "body", "source"]

OK = "ok"


def resolve_problems(requests: DataFrame, problems: DataFrame) -> DataFrame:
    """Add ``resolved_id``, ``status`` and ``years`` to ``problem_id?, name?, year?`` requests.

    Each request takes one of four ways (by id, by name and year, by name, or none), and each
    way is its own join, so requests that do not use a key never pile up on its NULL.
    """
    given_id = F.coalesce("problem_id", F.lit(0))
    given_name = empty_if_null(F.col("name"))
    given_year = F.coalesce("year", F.lit(0))
    by_id = given_id != 0
    named = ~by_id & (given_name != "")
    own = requests.columns
    no_years = F.lit(None).cast("array<int>")

    def answer(df: DataFrame, found, missing: str, years=no_years) -> DataFrame:
        return df.select(
            *own,
            found.alias("resolved_id"),
            F.when(found.isNull(), missing).otherwise(OK).alias("status"),
            years.alias("years"),
        )

    ids = problems.select(F.col("id").alias("problem_id"), F.col("id").alias("_id"))
    first = answer(
        requests.filter(by_id).join(ids, "problem_id", "left"), F.col("_id"), "problem id not found"
    )

    dated = problems.select("name", "year", F.col("id").alias("_id"))
    second = answer(
        requests.filter(named & (given_year > 0)).join(dated, ["name", "year"], "left"),
        F.col("_id"),
        "problem not found in year",
    )

    # (year, name) is unique, so the set of years is as small as the calendar.
    by_name = problems.groupBy("name").agg(
        F.min("id").alias("_id"),
        F.count(F.lit(1)).alias("_count"),
        F.sort_array(F.collect_set("year")).alias("_years"),
    )
    third = salted_join(
        requests.filter(named & (given_year <= 0)), by_name, ["name"], "left"
    ).select(
        *own,
        F.when(F.col("_count") == 1, F.col("_id")).alias("resolved_id"),
        F.when(F.col("_count").isNull(), "problem not found")
        .when(F.col("_count") > 1, "problem exists in multiple years")
        .otherwise(OK)
        .alias("status"),
        F.when(F.col("_count") > 1, F.col("_years")).alias("years"),
    )

    neither = requests.filter(~by_id & (given_name == "")).select(
        *own,
        F.lit(None).cast("bigint").alias("resolved_id"),
        F.lit("missing problem id or name").alias("status"),
        no_years.alias("years"),
    )
    return first.unionByName(second).unionByName(third).unionByName(neither)


def fetch_cases(resolved: DataFrame, cases: DataFrame) -> DataFrame:
    """Case texts for resolved requests that carry ``test_case``."""
    known = cases.select(
        F.col("problem_id").alias("resolved_id"),
        F.col("name").alias("test_case"),
        "input",
        "output",
        F.lit(True).alias("_found"),
    )
    status = (
        F.when(empty_if_null(F.col("test_case")) == "", "missing test case name")
        .when(F.col("status") != OK, F.col("status"))
        .when(F.col("_found").isNull(), "test case not found")
        .otherwise(OK)
    )
    able = (F.col("status") == OK) & (empty_if_null(F.col("test_case")) != "")
    return (
        _join_where(resolved, able, known, ["resolved_id", "test_case"])
        .withColumn("status", status)
        .drop("_found", "years")
    )


def _join_where(requests: DataFrame, able: Column, known: DataFrame, on: list[str]) -> DataFrame:
    """Left join of the requests that can have an answer by ``on``, an id first.

    The others are dealt out by a hash in place of the id, and meet nothing: neither do they pile up
    nor are the requests read twice. The keys of the join are those of ``on``, so a table bucketed by
    them stays where it is.
    """
    sided = requests.withColumn("_able", F.coalesce(able, F.lit(False))).withColumn(
        "_id", F.when(F.col("_able"), F.col(on[0])).otherwise(F.xxhash64(*requests.columns))
    )
    right = known.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = F.col("_able") & (F.col("_id") == F.col(f"_on_{on[0]}"))
    for c in on[1:]:
        same = same & (F.col(c) == F.col(f"_on_{c}"))
    joined = sided.join(right, same, "left")
    return joined.drop("_able", "_id", *[f"_on_{c}" for c in on])


def adapt_file_columns(files: DataFrame | None) -> DataFrame:
    """Rename whichever name and content columns a file table has to ``name`` and ``content``."""
    if files is None or not files.columns:
        raise ValueError("grader file table not found; write the catalogue with grader files")
    present = {c.lower(): c for c in files.columns}

    def pick(candidates: list[str]) -> str:
        return next((present[c] for c in candidates if c in present), candidates[0])

    return files.select(
        *[c for c in ("id", "problem_id") if c in present],
        F.col(pick(NAME_COLUMNS)).alias("name"),
        F.col(pick(CONTENT_COLUMNS)).alias("content"),
    )


def fetch_files(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Files of every resolved request; of files with one name in a problem the last counts.

    A request without files gets one row saying so; a file with an unsafe name has its
    content withheld.
    """
    latest = keep_last_wide(files, ["problem_id", "name"], ["id"]).select(
        F.col("problem_id").alias("resolved_id"), F.col("name").alias("file_name"), "content"
    )
    unsafe = F.col("file_name").isNotNull() & ~is_safe_file_name(F.col("file_name"))
    status = (
        F.when(F.col("status") != OK, F.col("status"))
        .when(F.col("file_name").isNull(), "no grader files")
        .when(unsafe, "unsafe file name")
        .otherwise(OK)
    )
    return (
        _join_where(resolved, F.col("status") == OK, latest, ["resolved_id"])
        .withColumn("content", F.when(~unsafe, F.col("content")))
        .withColumn("status", status)
        .drop("years")
    )

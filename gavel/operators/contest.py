"""Contest sets: curation, problem rows, keys, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gavel.functions.hashing import fnv1a64
from gavel.functions.text import null_if_empty
from gavel.operators.ordering import keep_first, keep_last_wide

# Record field -> catalogue column.
TEXT_FIELDS = {
    "time-limit": "time_limit",
    "memory-limit": "memory_limit",
    "problem-description": "problem_description",
    "input-specification": "input_specification",
    "title": "title",
    "demo-input": "demo_input",
    "demo-output": "demo_output",
}
PROBLEM_KEY = ["contest_id", "problem_index"]
PIECES_PER_PROBLEM = 32


def accepted_submissions(submissions: DataFrame) -> DataFrame:
    """Submissions that passed as many test cases as they have."""
    return submissions.filter(F.size("test_cases") == F.col("passedTestCount"))


def first_per_problem(submissions: DataFrame, seq: str = "seq") -> DataFrame:
    """The first submission of every problem in input order.

    Popular problems have many wide submissions, so each problem is reduced in pieces first.
    """
    return keep_first(submissions, ["contestId", "index"], [seq], salts=PIECES_PER_PROBLEM)


def problem_records(submissions: DataFrame) -> DataFrame:
    """Prepared problems; ``seq`` is kept where the input has one."""
    kept = ["seq"] if "seq" in submissions.columns else []
    return submissions.select(
        *kept,
        "code",
        F.col("contestId").alias("contest_id"),
        "index",
        "test_cases",
        F.col("time-limit").alias("time_limit"),
        F.col("memory-limit").alias("memory_limit"),
    )


def has_problem_key(contest_id: Column, index: Column) -> Column:
    return (F.coalesce(contest_id, F.lit(0)) != 0) & (F.coalesce(index, F.lit("")) != "")


def contest_problems(records: DataFrame) -> DataFrame:
    """Problem rows of the keyed records, empty texts as NULL."""
    kept = ["seq"] if "seq" in records.columns else []
    return records.filter(has_problem_key(F.col("contestId"), F.col("index"))).select(
        *kept,
        F.col("contestId").alias("contest_id"),
        F.col("index").alias("problem_index"),
        *[null_if_empty(F.col(f"`{field}`")).alias(name) for field, name in TEXT_FIELDS.items()],
    )


def problem_id(contest_id: Column, index: Column) -> Column:
    return fnv1a64(F.concat(contest_id.cast("string"), F.lit(":"), index))


def problem_keys(problems: DataFrame) -> DataFrame:
    """Distinct problems with their stable id."""
    keys = problems.select(*PROBLEM_KEY).distinct()
    return keys.withColumn("id", problem_id(*map(F.col, PROBLEM_KEY)))


def key_collisions(keyed: DataFrame) -> DataFrame:
    """Ids shared by different problems. ``keyed`` may hold a key many times."""
    key = F.struct(*PROBLEM_KEY)
    return (
        keyed.groupBy("id")
        .agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))
        .filter("first_key <> last_key")
    )


def contest_cases(records: DataFrame) -> DataFrame:
    """One row per test case of the keyed records with its 0-based offset."""
    kept = [c for c in ("seq", "problem_id") if c in records.columns]
    return (
        records.filter(has_problem_key(F.col("contestId"), F.col("index")))
        .select(
            *kept,
            F.col("contestId").alias("contest_id"),
            F.col("index").alias("problem_index"),
            F.posexplode("test_cases").alias("case_offset", "case"),
        )
        .select(
            *kept,
            *PROBLEM_KEY,
            "case_offset",
            null_if_empty(F.col("case.input")).alias("input"),
            null_if_empty(F.col("case.output")).alias("output"),
        )
    )


def upsert_problems(catalog: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Merge ``incoming`` problem rows into ``catalog`` (which has an ``id``).

    The last incoming row of a key replaces every non-key column, NULLs included, and the
    old id stays. Presence decides, not whether a value is NULL.
    """
    latest = keep_last_wide(incoming, PROBLEM_KEY, [seq])
    values = [c for c in catalog.columns if c not in ("id", *PROBLEM_KEY)]
    new = latest.select(
        *PROBLEM_KEY, F.struct(*values).alias("new"), F.lit(True).alias("is_new")
    )
    old = catalog.select(*PROBLEM_KEY, "id", F.struct(*values).alias("old"))
    merged = old.join(new, PROBLEM_KEY, "full_outer")
    fields = F.when(F.col("is_new"), F.col("new")).otherwise(F.col("old"))
    return merged.select(
        F.coalesce("id", problem_id(*map(F.col, PROBLEM_KEY))).alias("id"),
        *PROBLEM_KEY,
        fields.alias("fields"),
    ).select("id", *PROBLEM_KEY, "fields.*")


def replace_cases(cases: DataFrame, records: DataFrame, seq: str = "seq") -> DataFrame:
    """Give every problem in ``records`` the cases of its last record and nothing else.

    ``cases`` has ``problem_id, case_offset, input, output``. A last record without cases
    still clears the old ones.
    """
    keyed = records.filter(has_problem_key(F.col("contestId"), F.col("index")))
    latest = keep_last_wide(keyed, ["contestId", "index"], [seq])
    touched = keyed.select("contestId", "index").distinct().select(
        problem_id(F.col("contestId"), F.col("index")).alias("problem_id")
    )
    columns = ["problem_id", "case_offset", "input", "output"]
    # The id is hashed once per problem, not per case.
    fresh = contest_cases(
        latest.withColumn("problem_id", problem_id(F.col("contestId"), F.col("index")))
    )
    kept = cases.join(touched, "problem_id", "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns))

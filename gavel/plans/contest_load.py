"""Contest jobs: submissions to prepared problems, records to catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gavel.operators import contest, packed


def curate_submissions(submissions: DataFrame) -> DataFrame:
    """Accepted submissions only, then the first per problem, as prepared problems.

    The filter must come first: a rejected first submission does not hide an accepted second.
    """
    return contest.problem_records(
        contest.first_per_problem(contest.accepted_submissions(submissions))
    )


def load_contest(
    records: DataFrame, problems: DataFrame | None = None, cases: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Upsert records into the contest catalogue: its two tables, and ``collisions``.

    An id stands for its problem in both tables, so two problems with one id would replace each
    other's cases. ``collisions`` lists such ids, of old and new problems together; write the
    tables only if it is empty.
    """
    spark = records.sparkSession
    incoming = contest.contest_problems(records)
    if problems is None:
        columns = [c for c in incoming.columns if c != "seq"]
        problems = spark.createDataFrame([], "id bigint, " + ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in incoming.select(*columns).schema.fields
        ))
    if cases is None:
        cases = spark.createDataFrame(
            [], "problem_id bigint, case_offset int, input string, output string"
        )
    keys = incoming.select(*contest.PROBLEM_KEY).withColumn(
        "id", contest.problem_id(*map(F.col, contest.PROBLEM_KEY))
    )
    both = keys.unionByName(problems.select(*contest.PROBLEM_KEY, "id"))
    return {
        "collisions": contest.key_collisions(both),
        "contest_problems": contest.upsert_problems(problems, incoming),
        "contest_cases": contest.replace_cases(cases, records),
    }


def pack(prepared: DataFrame) -> dict[str, DataFrame]:
    """Layout of the packed store for prepared problems, with its summary and rejects."""
    entries, rejects = packed.packed_entries(prepared)
    index = packed.case_index(entries)
    return {
        "index": index,
        "summary": packed.store_summary(index, entries),
        "latest": packed.latest_problem_entry(entries),
        "rejects": rejects,
    }

"""Versions and buckets of stored catalogues."""

import pytest
from pyspark.sql import functions as F

from gavel.operators import lookup
from gavel.session import scratch_path
from gavel.sources.catalog_store import read_catalog, write_catalog

CASES = "problem_id long, name string, input string, output string"


def names(spark, path, table="problems"):
    return sorted(r.name for r in read_catalog(spark, path, [table])[table].collect())


@pytest.mark.parametrize("buckets", [None, 3])
def test_rows_are_added_or_replaced(spark, rows, buckets):
    path = scratch_path(spark, "catalog")
    one = {"problems": rows("id long, year int, name string", (1, 2000, "a"))}
    two = {"problems": rows("id long, year int, name string", (2, 2000, "b"))}
    write_catalog(one, path, buckets=buckets)
    write_catalog(two, path, buckets=buckets)
    assert names(spark, path) == ["a", "b"]
    write_catalog({"other": rows("x int", (1,))}, path)
    # Replaced by what is read from itself.
    kept = read_catalog(spark, path, ["problems"])["problems"].filter("id = 2")
    write_catalog({"problems": kept}, path, drop=True, buckets=buckets)
    assert names(spark, path) == ["b"] and read_catalog(spark, path, ["other"])["other"].count() == 1
    with pytest.raises(ValueError):
        read_catalog(spark, path, ["missing"])


def test_a_failure_half_way_leaves_the_version_before(spark, rows):
    path = scratch_path(spark, "catalog")
    good = rows("id long, year int, name string", (1, 2000, "a"))
    write_catalog({"problems": good}, path)
    broken = good.select("id", "year", F.raise_error(F.lit("no")).cast("string").alias("name"))
    with pytest.raises(Exception):
        write_catalog({"problems": good.withColumn("name", F.lit("new")), "other": broken}, path, drop=True)
    assert names(spark, path) == ["a"]


def test_bucketed_cases_are_not_shuffled(spark, rows):
    path = scratch_path(spark, "catalog")
    cases = rows(CASES, *[(p, f"c{n}", f"in{p}-{n}", "out") for p in range(1, 30) for n in range(5)])
    write_catalog({"test_cases": cases}, path, buckets=6)
    resolved = rows(
        "request_id int, resolved_id long, test_case string, status string, years array<int>",
        *[(n, n % 33 or None, f"c{n % 6}", "ok" if n % 33 else "problem not found", None) for n in range(200)],
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for session in (spark, spark.newSession()):
            session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            stored = read_catalog(session, path, ["test_cases"])["test_cases"]
            asked = session.createDataFrame(resolved.collect(), resolved.schema)
            found = lookup.fetch_cases(asked, stored)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan
            got = {r.request_id: (r.status, r.input) for r in found.collect()}
            for n in range(200):
                p, c = n % 33, n % 6
                want = ("problem not found", None) if not p else ("ok", f"in{p}-{c}") if p < 30 and c < 5 else ("test case not found", None)
                assert got[n] == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

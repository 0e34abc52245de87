"""One key holding half of all rows: joins on it are split by the plan Spark ends up with."""

import pytest
from pyspark.sql import functions as F

from gavel.operators import catalog, integrity, joins, lookup, packed, transport

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.shuffle.partitions": "32",
}
ROWS = 400_000


@pytest.fixture
def tight(spark):
    """Thresholds at which test data counts as large."""
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot(number="id", cold=5000):
    """The key 0 for half of the rows, spread keys for the rest."""
    return F.when(F.col("id") % 2 == 0, 0).otherwise(F.col(number) % cold + 1)


def final_plan(df):
    # Runs the very plan that is then looked at.
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().toString()


def base(spark):
    return spark.range(0, ROWS, 1, 8)


def test_match_responses(tight):
    answers = base(tight).select(
        hot().cast("string").alias("id"), F.timestamp_seconds(F.col("id")).alias("response_ts"), F.col("id").alias("seq")
    )
    asked = tight.range(5001).select(F.col("id").cast("string"), F.timestamp_seconds(F.col("id") * 0).alias("request_ts"))
    plan = final_plan(transport.match_responses(asked, answers, 10))
    assert "skew=true" in plan


def test_lookup_cases(tight):
    entries = tight.range(5001).select(
        F.col("id").alias("seq"), F.col("id").cast("int").alias("contest_id"), F.lit("A").alias("index"),
        F.array(F.struct(F.lit("i").alias("input"), F.lit("o").alias("output"))).alias("test_cases"), F.lit(1).alias("case_count"),
    )
    requests = base(tight).select(
        F.col("id").alias("request_id"), hot().cast("int").alias("contest_id"), F.lit("A").alias("index"), F.lit(0).alias("case_no")
    )
    found = packed.lookup_cases(requests, entries)
    assert "skew=true" in final_plan(found)
    assert found.filter("status = 'ok'").count() == ROWS


def test_resolve_and_fetch(tight):
    problems = tight.range(5001).select(F.col("id") + 1, F.lit(2024).alias("year"), F.col("id").cast("string").alias("name")).toDF("id", "year", "name")
    requests = base(tight).select(
        F.col("id").alias("request_id"), F.lit(None).cast("bigint").alias("problem_id"), hot().cast("string").alias("name"),
        F.lit(2024).alias("year"), F.lit("c").alias("test_case"),
    )
    resolved = lookup.resolve_problems(requests, problems)
    assert "skew=true" in final_plan(resolved)
    assert resolved.filter("status = 'ok'").count() == ROWS
    cases = problems.select(F.col("id").alias("problem_id"), F.lit("c").alias("name"), F.lit("i").alias("input"), F.lit("o").alias("output"))
    assert "skew=true" in final_plan(lookup.fetch_cases(resolved, cases))


def test_links_and_integrity(tight):
    tasks = base(tight).select(
        hot().alias("problem_id"), F.col("id"), F.lit(0).alias("position"), F.array(F.lit("c")).alias("test_case_names")
    )
    cases = tight.range(5001).select(F.col("id").alias("problem_id"), F.lit("c").alias("name"), "id")
    links = catalog.link_sub_tasks(tasks, cases)
    assert "skew=true" in final_plan(links)
    assert links.count() == ROWS
    orphans = integrity.orphan_rows(tasks, "problem_id", cases.filter("id > 0"), "problem_id")
    assert "skew=true" in final_plan(orphans)
    assert orphans.count() == ROWS // 2
    twice = integrity.unique_violations(tasks.select("id", "problem_id"), ["problem_id"])
    assert twice.count() == ROWS
    assert largest_share(tight, twice) < 0.35


def largest_share(spark, df):
    """The part of all rows that the fullest task ends up with."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return max(counts) / sum(counts)


def test_names_without_year(tight):
    problems = tight.range(5001).select(F.col("id") + 1, F.lit(2024).alias("year"), F.col("id").cast("string").alias("name")).toDF("id", "year", "name")
    requests = base(tight).select(
        F.col("id").alias("request_id"), F.lit(None).cast("bigint").alias("problem_id"), hot().cast("string").alias("name"),
        F.lit(None).cast("int").alias("year"),
    )
    resolved = lookup.resolve_problems(requests, problems)
    assert resolved.filter("status = 'ok'").count() == ROWS
    assert largest_share(tight, resolved) < 0.35


def test_salted_join_gives_what_a_join_gives(tight):
    left = base(tight).select(hot().alias("k"), F.col("id").alias("n"))
    right = tight.range(0, 4000, 3).groupBy(F.col("id").alias("k")).agg(F.max("id").alias("m"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, ["k"], how)
        got = joins.salted_join(left, right, ["k"], how)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()

"""Nothing is dropped, capped or failed by size, repeats, missing limits or odd keys."""

import json

from pyspark.sql import functions as F

from gavel.operators import grading, lookup
from gavel.operators.ordering import keep_first, keep_last_wide
from gavel.plans.catalog_load import load_catalog
from gavel.plans.contest_load import load_contest
from gavel.plans.scoring import score_problems
from gavel.sources import records
from gavel.sources.jobs import read_jobs
from test_judging import FULL, RUN, TASK, run
from test_records import olympiad, write


def test_long_strings_are_read(spark, tmp_path):
    long = "x" * 20_100_000
    path = write(tmp_path, "o.jsonl", olympiad(test_cases={"1": {"input": long, "output": "o"}}))
    good, bad = records.read_olympiad(spark, [path])
    assert bad.count() == 0
    assert good.select(F.octet_length(F.col("test_cases")["1"]["input"])).first()[0] == len(long)
    contest = {"contestId": 1, "index": "A", "test_cases": [{"input": long, "output": ""}]}
    good, bad = records.read_contest(spark, [write(tmp_path, "c.jsonl", contest)])
    assert (good.count(), bad.count()) == (1, 0)
    line = json.dumps({"id": "j", "binary": "QUJD" * 6_000_000, "callback": "http://c"})
    jobs, rejects = read_jobs(spark.createDataFrame([(line, "q")], "line string, queue string"))
    assert not rejects.filter("reason LIKE '%invalid JSON%'").count()
    assert jobs.count() + rejects.count() == 1


def test_large_numbers_are_rejects(spark, tmp_path):
    task = {"name": "s", "score": 3_000_000_000, "test_case_names": ["1"]}
    path = write(tmp_path, "o.jsonl", olympiad(year=3_000_000_000), olympiad(sub_tasks=[task]), olympiad(id="ok"))
    good, bad = records.read_olympiad(spark, [path], line_numbers=True)
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [
        (1, "year is not an integer"), (2, "score is not an integer")]
    assert [r["name"] for r in load_catalog(good).tables["problems"].collect()] == ["ok"]


def test_repeated_sub_task_names_are_rejects(spark, tmp_path):
    task = lambda name: {"name": name, "score": 50, "test_case_names": ["1"]}
    path = write(
        tmp_path, "o.jsonl", olympiad(id="bad", sub_tasks=[task("s"), task("s")]), olympiad(id="ok", sub_tasks=[task("s"), task("t")])
    )
    loaded = load_catalog(records.read_olympiad(spark, [path])[0])
    assert [r.reason for r in loaded.rejects["sub_tasks"].collect()] == ["repeated sub-task name"]
    assert [r["name"] for r in loaded.tables["problems"].collect()] == ["ok"]
    assert loaded.tables["sub_tasks"].count() == 2


def test_missing_limits_and_repeated_runs(rows):
    tasks = rows(TASK, (1, 0, "s", 100, None, None, ["a", "b"]))
    runs = [(1, c, None, None, FULL, 0, out, b"") for c, out in (("a", b"1"), ("a", b"1"), ("b", b"0"))]
    result = score_problems(rows("problem_id long", (1,)), tasks, rows(RUN, *runs))
    task = result["sub_task_scores"].first()
    assert (task.n_cases, task.score, task.reason) == (2, 50.0, None)
    scores = rows(
        "problem_id long, case_name string, time_limit double, memory_limit double, score double, seq int",
        (1, "a", None, None, 0.0, 1), (1, "a", None, None, 1.0, 2),
    )
    assert grading.one_result_per_task(scores, "seq").first().score == 1.0


def test_problems_that_do_not_compile_score_zero(rows):
    tasks = rows(TASK, (1, 0, "s", 100, 1.0, 1.0, ["a"]), (2, 0, "s", 100, 1.0, 1.0, ["a"]))
    outcomes = rows("problem_id long, outcome string, message string", (1, "compiled", None), (2, "compile error", "bad"))
    result = score_problems(rows("problem_id long", (1,), (2,)), tasks, rows(RUN, run("a", FULL)), outcomes)
    got = {r.problem_id: (r.score, r.reason, r.detail) for r in result["problem_scores"].collect()}
    assert got == {1: (100.0, None, None), 2: (0.0, None, "bad")}


def test_salted_pieces_share_a_hot_key(spark):
    """40 map tasks hold one key: they send a row each, and no piece gets more than its share."""
    df = spark.range(0, 4000, 1, 40).withColumn("key", F.lit(1))
    pieces = df.withColumn("part", F.spark_partition_id()).groupBy(
        F.pmod("part", F.lit(8)).alias("salt")
    ).agg(F.countDistinct("part").alias("n"))
    assert {r.n for r in pieces.collect()} == {5}
    assert keep_first(df, ["key"], ["id"], salts=8).collect()[0].id == 0
    assert keep_first(df, ["key"], ["id"], last=True, salts=8).collect()[0].id == 3999


def test_last_of_wide_rows(rows):
    df = rows("key int, seq int, text string", (1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 3, "d"))
    assert sorted(r.text for r in keep_last_wide(df, ["key"], ["seq"]).collect()) == ["b", "d"]


def test_unresolved_requests_stay_out_of_joins(spark, rows):
    asked = "id int, resolved_id long, status string, years array<int>, test_case string"
    requests = rows(asked, (1, 7, "ok", None, "a"), (2, None, "problem not found", None, "a"), (3, 7, "ok", None, None), (4, 7, "ok", None, "zz"))
    cases = rows("problem_id long, name string, input string, output string", (7, "a", "i", "o"))
    got = {r.id: (r.status, r.input) for r in lookup.fetch_cases(requests, cases).collect()}
    assert got == {1: ("ok", "i"), 2: ("problem not found", None), 3: ("missing test case name", None), 4: ("test case not found", None)}
    files = rows("id long, problem_id long, name string, content string", (1, 7, "f", "old"), (2, 7, "f", "new"))
    found = {r.id: (r.status, r.content) for r in lookup.fetch_files(requests.drop("test_case"), files).collect()}
    assert found == {1: ("ok", "new"), 2: ("problem not found", None), 3: ("ok", "new"), 4: ("ok", "new")}


def test_colliding_ids_are_reported(spark, tmp_path):
    one = {"contestId": 5, "index": "A", "test_cases": []}
    good, _ = records.read_contest(spark, [write(tmp_path, "c.jsonl", one)])
    fresh = load_contest(good)
    assert fresh["collisions"].count() == 0
    # Ids are hashes, so the collision is made in the table that is there.
    other = fresh["contest_problems"].withColumn("problem_index", F.lit("Z"))
    assert load_contest(good, problems=other)["collisions"].count() == 1

"""What a load and a live match hold and repeat as their input grows."""

import datetime
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from gavel.operators import integrity, ordering
from gavel.operators.joins import streamed_join, tasks_for
from gavel.operators.transport import settled_rows
from gavel.plans import catalog_load
from gavel.plans.catalog_load import load_catalog
from gavel.session import evaluated_once, materialized
from gavel.sources.jsonl import text_lines
from gavel.workload import inputs
from gavel.workload.catalogue import QUERIES
from gavel.workload.registry import Tables
from conftest import as_dicts
from test_catalog import PROBLEM, records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_load_sorts_no_texts(spark, no_broadcast):
    loaded = load_catalog(records(spark, PROBLEM, {**PROBLEM, "id": "q"}))
    for name in ("test_cases", "grader_files", "sub_tasks", "sub_task_test_cases"):
        assert "SortMergeJoin" not in plan(loaded.tables[name]), name
        assert "ShuffledHashJoin" in plan(loaded.tables[name]), name
    assert loaded.tables["test_cases"].count() == 4


def test_keys_are_those_of_the_load_and_no_text_is_written(spark, monkeypatch):
    bad = {**PROBLEM, "id": "bad", "sub_tasks": [*PROBLEM["sub_tasks"], *PROBLEM["sub_tasks"]]}
    given = records(spark, PROBLEM, {**PROBLEM, "id": "q"}, {"id": "empty", "year": 2000}, PROBLEM, bad, {**PROBLEM, "id": "r"})
    whole, keys = load_catalog(given), load_catalog(given, texts=False)
    assert set(whole.tables) == set(keys.tables) and whole.tables["test_cases"].count() == 4
    for name, table in keys.tables.items():
        assert as_dicts(whole.tables[name].select(*table.columns)) == as_dicts(table), name
    for name in ("repeated", "missing_case_refs"):
        assert as_dicts(whole.rejects[name]) == as_dicts(keys.rejects[name]), name
    written = []
    monkeypatch.setattr(catalog_load, "materialized", lambda df: written.append(dict(df.dtypes)) or materialized(df))
    QUERIES["catalog_integrity"](spark, "/root/testdata/sf0.001").collect()
    assert {written[0][c] for c in ("test_cases", "grader_files", "sub_tasks")} == {"array<string>"}
    assert {written[0][f"n_{c}"] for c in ("test_cases", "grader_files", "sub_tasks")} == {"int"}


def test_rows_without_violations_are_not_made_again(spark, rows):
    unique = rows("k int, v string", (1, "a"), (2, "b"))
    found = integrity.unique_violations(unique, ["k"])
    assert "Join" not in plan(found) and found.columns == ["k", "v"] and found.collect() == []
    assert integrity.unique_violations(unique.unionAll(unique), ["k"]).count() == 4


def test_records_are_built_by_compiled_arrays(spark):
    text = plan(inputs.olympiad_records(Tables(spark, "/root/testdata/sf0.001")))
    assert "filter(array" not in text
    assert "transform(CASE" in text and "map_from_entries(transform" not in text


def test_tasks_grow_with_the_narrow_rows(spark, no_broadcast):
    assert tasks_for(10, spark, 100) == 4
    assert tasks_for(1001, spark, 100) == 11
    wide, narrow = spark.range(2000), spark.range(0, 2000, 2).withColumn("n", F.col("id") + 1)
    assert streamed_join(wide, narrow, "id", rows_per_task=100).rdd.getNumPartitions() == 10
    assert streamed_join(wide, narrow, "id", "left_anti", rows_per_task=100).count() == 1000


def test_columns_are_computed_once_a_row(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def built(n):
        calls.add(1)
        return [str(n)] * 3

    rows = evaluated_once(spark.range(5).select(built("id").alias("names")))
    found = rows.select(F.transform("names", lambda name: F.array_position(F.col("names"), name)).alias("p"), "names")
    assert [r.p for r in found.collect()] == [[1, 1, 1]] * 5
    assert calls.value == 5
    text = plan(evaluated_once(spark.range(5).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))).select(
        F.transform(F.array("h", "h"), lambda x: F.concat(x, F.col("h"))).alias("x"), "h"))
    assert text.count("sha2(") == 1


def test_events_say_their_part_themselves(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    parts = inputs.event_parts(tables)
    asked = inputs.repeated_requests(tables).withColumn("part", parts("event_id", "request_ts"))
    assert "Join" not in plan(asked)
    assert {r.part for r in asked.select("part").distinct().collect()} == {0, 1, 2, 3}


def test_settled_rows_come_whole(spark, rows):
    ts = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    requests = rows(
        "id string, request_ts timestamp, deadline_ts timestamp, _number bigint, queue string",
        ("a", ts(10), None, 0, "q1"), ("a", ts(20), None, 1, "q2"), ("b", ts(10), ts(15), 2, "q3"),
    )
    responses = rows("id string, response_ts timestamp, seq bigint", ("a", ts(30), 7), ("b", ts(16), 8))
    matched, lost = settled_rows(requests, responses, 5, carry=["queue"])
    assert sorted((r.id, r._number, r.queue, r.request_ts, r.response_seq, r.how) for r in matched.collect()) == [
        ("a", 0, "q1", ts(10), 7, "arrived"), ("a", 1, "q2", ts(20), None, "rejected"), ("b", 2, "q3", ts(10), None, None)]
    assert [tuple(r) for r in lost.collect()] == [("b", ts(16), 8, "expired")]


def test_neighbours_write_no_values(spark, rows, monkeypatch):
    written = []
    monkeypatch.setattr(ordering, "materialized", lambda df: written.append(df.columns) or materialized(df))
    df = rows("k string, t int", ("a", 1), ("a", 2), ("b", 1))
    found = ordering.neighbours(df, ["k"], ["t"], before={"last": F.col("t")}, after={"next": F.col("t")})
    assert sorted((r.k, r.t, r.last, r.next) for r in found.collect()) == [
        ("a", 1, None, 2), ("a", 2, 1, None), ("b", 1, None, None)]
    assert written == [["k", "t", "_part", "_pos"]]


def test_compressed_lines_keep_their_order(spark):
    rows = spark.range(1000).select(F.col("id").alias("seq"), F.repeat(F.lit("text "), 100).alias("a"), F.col("id").alias("n"))
    sizes = {}
    for kind in ("none", "gzip"):
        path = inputs.as_json_lines(rows, "lines", kind)
        found = [json.loads(r.line)["n"] for r in text_lines(spark, [path]).orderBy("seq").collect()]
        assert found == list(range(1000))
        sizes[kind] = sum(p.stat().st_size for p in pathlib.Path(path.removeprefix("file:")).glob("part-*"))
    assert sizes["gzip"] * 10 < sizes["none"]

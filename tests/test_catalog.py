"""Olympiad records: layouts, loading, integrity, lookups."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from gavel.operators import catalog, integrity, lookup
from gavel.plans.catalog_load import load_catalog

TASKS = "array<struct<limit:struct<time_limit:double,memory_limit:double>,name:string,score:int,test_case_names:array<string>>>"
FIELDS = f"id:string,year:bigint,sample_solution:string,sub_tasks:{TASKS},grader_files:map<string,string>,test_cases:map<string,struct<input:string,output:string>>"
SCHEMA = "struct<seq:bigint,metadata:struct<" + FIELDS + ">," + FIELDS + ">"


def records(spark, *objects):
    lines = spark.createDataFrame([(json.dumps({"seq": i, **o}),) for i, o in enumerate(objects, 1)], "line string")
    return lines.select(F.from_json("line", SCHEMA).alias("r")).select("r.*")


def task(name, score, cases, seconds=1.0, memory=1024.0):
    return {"name": name, "score": score, "test_case_names": cases, "limit": {"time_limit": seconds, "memory_limit": memory}}


def case(text):
    return {"input": text, "output": text.upper()}


def test_layout_precedence(spark):
    nested = {"id": "m", "year": 2001, "sample_solution": "ms", "grader_files": {"g.cpp": "m"}, "test_cases": {"a": case("m")}}
    df = catalog.unify_layout(records(
        spark,
        {"metadata": nested},
        {"id": "t", "year": 2002, "sample_solution": "ts", "test_cases": {"b": case("t")}},
        {"metadata": nested, "id": "t", "year": 2002, "test_cases": {"b": case("t")}, "grader_files": {}},
        {"metadata": {"id": "", "year": 1999, "sub_tasks": [task("s", 1, [])]}, "id": "t", "year": 2002},
        {"metadata": {"id": "", "year": 1999}},
    ))
    got = [(r.name, r.year, r.sample_solution, sorted(r.test_cases or {}), sorted(r.grader_files or {}), len(r.sub_tasks or []))
           for r in df.orderBy("seq").collect()]
    assert got == [
        ("m", 2001, "ms", ["a"], ["g.cpp"], 0),
        ("t", 2002, "ts", ["b"], [], 0),
        ("m", 2001, "ms", ["b"], ["g.cpp"], 0),
        ("t", 2002, None, [], [], 1),
        ("", 1999, None, [], [], 0),
    ]


PROBLEM = {
    "id": "p", "year": 2020,
    "sub_tasks": [task("s1", 30, ["b", "a", "a"], 0.1), task("s2", 70, ["a", "nope"])],
    "test_cases": {"b": case("x"), "a": case("y")}, "grader_files": {"z.h": "1", "a.h": "2"},
}


def test_load_numbers_links_and_rejects(spark):
    loaded = load_catalog(records(
        spark, PROBLEM, {"metadata": {**PROBLEM, "id": "q"}}, {"id": "", "year": 2020}, {"id": "r", "year": 0},
        {"id": "twice", "year": 2021}, {"id": "twice", "year": 2021},
    ))
    tables = {name: as_dicts(df, "id") for name, df in loaded.tables.items()}
    assert [(r["id"], r["name"]) for r in tables["problems"]] == [(1, "p"), (2, "q")]
    assert [(r["id"], r["problem_id"], r["name"]) for r in tables["test_cases"]] == [
        (1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 2, "b")]
    assert [r["name"] for r in tables["grader_files"]] == ["a.h", "z.h", "a.h", "z.h"]
    assert [(r["id"], r["score"], r["time_limit"]) for r in tables["sub_tasks"]][:2] == [
        (1, 30, 0.10000000149011612), (2, 70, 1.0)]
    # "a" is named twice and links twice; "nope" is unknown and does not.
    assert [(r["sub_task_id"], r["test_case_id"]) for r in tables["sub_task_test_cases"]][:4] == [
        (1, 2), (1, 1), (1, 1), (2, 1)]
    assert {r.seq for r in loaded.rejects["unkeyed"].collect()} == {3, 4}
    assert {r.seq for r in loaded.rejects["repeated"].collect()} == {5, 6}
    assert [r.case_name for r in loaded.rejects["missing_case_refs"].collect()] == ["nope", "nope"]
    assert {name: df.count() for name, df in integrity.key_problems(loaded.tables).items() if df.count()} == {}


def test_load_continues_after_existing_rows(spark):
    first = load_catalog(records(spark, PROBLEM)).tables
    second = load_catalog(records(spark, PROBLEM, {**PROBLEM, "year": 2021}), first)
    assert [(r.id, r.year) for r in second.tables["problems"].collect()] == [(2, 2021)]
    assert min(r.id for r in second.tables["test_cases"].collect()) == 3
    assert [r.seq for r in second.rejects["repeated"].collect()] == [1]


def test_integrity_finds_breaches(rows):
    problems = rows("id long, year int, name string", (1, 2020, "a"), (2, 2020, "a"), (3, 2021, "a"))
    cases = rows("id long, problem_id long, name string", (1, 1, "x"), (2, 9, "x"))
    found = integrity.key_problems({"problems": problems, "test_cases": cases})
    assert {r.id for r in found["unique problems(year, name)"].collect()} == {1, 2}
    assert [r.id for r in found["orphan test_cases(problem_id)"].collect()] == [2]
    against = integrity.unique_violations(problems.filter("id = 3"), ["year", "name"], rows("year int, name string", (2021, "a")))
    assert against.count() == 1


@pytest.fixture
def problems(rows):
    return rows("id long, year int, name string", (1, 2020, "a"), (2, 2021, "a"), (3, 2021, "b"))


def test_resolve(rows, problems):
    requests = rows(
        "request_id int, problem_id long, name string, year int, test_case string",
        (1, 2, "ignored", 1999, "c"), (2, 7, None, None, "c"), (3, 0, "a", 2020, "c"), (4, None, "a", 1990, "c"),
        (5, None, "a", 0, "c"), (6, None, "b", None, "c"), (7, None, "zz", -1, "c"), (8, None, None, 2020, "c"), (9, 0, "", None, "c"),
    )
    got = {r.request_id: (r.resolved_id, r.status, r.years) for r in lookup.resolve_problems(requests, problems).collect()}
    assert got == {
        1: (2, "ok", None), 2: (None, "problem id not found", None), 3: (1, "ok", None),
        4: (None, "problem not found in year", None), 5: (None, "problem exists in multiple years", [2020, 2021]),
        6: (3, "ok", None), 7: (None, "problem not found", None),
        8: (None, "missing problem id or name", None), 9: (None, "missing problem id or name", None),
    }


def test_fetch(rows, problems):
    requests = rows(
        "request_id int, problem_id long, name string, year int, test_case string",
        (1, 1, None, None, "c"), (2, 1, None, None, "d"), (3, 3, None, None, ""), (4, 9, None, None, "c"),
    )
    resolved = lookup.resolve_problems(requests, problems)
    cases = rows("id long, problem_id long, name string, input string, output string", (1, 1, "c", "in", "out"))
    got = {r.request_id: (r.input, r.status) for r in lookup.fetch_cases(resolved, cases).collect()}
    assert got == {1: ("in", "ok"), 2: (None, "test case not found"), 3: (None, "missing test case name"), 4: (None, "problem id not found")}

    files = rows(
        "id long, problem_id long, File_Name string, Body string",
        (1, 1, "g.cpp", "old"), (2, 1, "g.cpp", "new"), (3, 1, "..", "bad"),
    )
    found = lookup.fetch_files(resolved, lookup.adapt_file_columns(files))
    assert {(r.request_id, r.file_name, r.content, r.status) for r in found.collect()} == {
        (1, "g.cpp", "new", "ok"), (1, "..", None, "unsafe file name"),
        (2, "g.cpp", "new", "ok"), (2, "..", None, "unsafe file name"),
        (3, None, None, "no grader files"), (4, None, None, "problem id not found"),
    }


def test_missing_file_table():
    with pytest.raises(ValueError, match="not found"):
        lookup.adapt_file_columns(None)

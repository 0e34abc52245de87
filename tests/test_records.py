"""Record files through to catalogue and store."""

import json

from conftest import as_dicts
from gavel.operators.planning import test_specs as spec_lines
from gavel.plans.catalog_load import load_catalog
from gavel.plans.contest_load import curate_submissions, load_contest, pack
from gavel.sources import records
from gavel.sources.jsonl import write_jsonl


def write(tmp_path, name, *objects):
    path = tmp_path / name
    path.write_text("\n".join(o if isinstance(o, str) else json.dumps(o) for o in objects) + "\n", encoding="utf-8")
    return str(path)


def olympiad(**changes):
    base = {
        "id": "p", "year": 2024, "sample_solution": None, "grader_files": {"grader.cpp": "g"},
        "test_cases": {"1": {"input": "i", "output": "o"}},
        "sub_tasks": [{"name": "s", "score": 100, "test_case_names": ["1"], "limit": {"time_limit": 0.1, "memory_limit": 5.0}}],
    }
    return {**base, **changes}


def test_olympiad_years_and_scores(spark, tmp_path):
    tasks = lambda score: [{"name": "s", "score": score, "test_case_names": ["1"], "limit": {"time_limit": 1, "memory_limit": 1}}]
    path = write(
        tmp_path, "o.jsonl", {"metadata": olympiad(year="2024")}, olympiad(year=2023.0, id="q"), olympiad(year=""), "",
        olympiad(year=2022.5), olympiad(year=2021, sub_tasks=tasks("12.5")), "{", olympiad(year=2020, sub_tasks=tasks("40")),
    )
    good, bad = records.read_olympiad(spark, [path], line_numbers=True)
    assert {r.line_no: r.reason for r in bad.collect()} == {
        5: "year is not an integer", 6: "score is not an integer", 7: "invalid JSON"}
    loaded = load_catalog(good)
    assert [(r["year"], r["name"]) for r in as_dicts(loaded.tables["problems"], "id")] == [(2024, "p"), (2023, "q"), (2020, "p")]
    assert [r["score"] for r in as_dicts(loaded.tables["sub_tasks"], "id")] == [100, 100, 40]
    assert loaded.tables["sub_task_test_cases"].count() == 3
    assert [r.line_no for r in loaded.rejects["unkeyed"].collect()] == [3]


def submission(index, passed, cases, **changes):
    return {"contestId": 9, "index": index, "code": "c", "passedTestCount": passed,
            "test_cases": [{"input": i, "output": o} for i, o in cases], "time-limit": "1 s", "memory-limit": 64, **changes}


def test_contest_files_to_store(spark, tmp_path):
    path = write(
        tmp_path, "c.jsonl", submission("A", 0, [("1", "2")]), submission("A", 1, [("é", "2")]),
        submission("B", 0, [], title=None), submission("C", "1", []), {"index": "Z", "test_cases": []},
    )
    good, bad = records.read_contest(spark, [path], line_numbers=True)
    assert [r.line_no for r in bad.collect()] == [4]
    tables = load_contest(good)
    assert sorted(r.problem_index for r in tables["contest_problems"].collect()) == ["A", "B"]
    assert [r.input for r in tables["contest_cases"].collect()] == ["é"]

    out = str(tmp_path / "prepared")
    write_jsonl(curate_submissions(good).drop("seq"), out)
    prepared, none = records.read_prepared(spark, [out])
    assert none.count() == 0
    assert sorted((r["index"], r.memory_limit) for r in prepared.collect()) == [("A", "64"), ("B", "64")]
    (entry,) = pack(prepared)["index"].collect()
    assert (entry.input_length, entry.output_offset) == (2, 2)


def test_specs_round_trip(spark, rows, tmp_path):
    cases = rows(
        "name string, position int, input binary, output binary, time_limit double, memory_limit_mb int",
        ("a", 0, b"\x00\xff", b"3\n", 1.5, 64), ("", 1, b"", b"", None, None),
    )
    lines = [r.spec for r in spec_lines(cases).orderBy("position").collect()]
    path = write(
        tmp_path, "s.jsonl", *lines, {"name": "ns", "input": "", "output": "", "time_limit": 2000000000, "memory_limit_mb": 5},
        {"name": "bad", "input": "*", "output": ""}, {"name": "slow", "time_limit": "soon"},
    )
    good, bad = records.read_test_specs(spark, [path])
    got = {r.name: (bytes(r.input), bytes(r.output), r.time_limit, r.memory_limit_mb) for r in good.collect()}
    assert got == {"a": (b"\x00\xff", b"3\n", 1.5, 64), "test-002": (b"", b"", None, None), "ns": (b"", b"", 2.0, 5)}
    assert {r.line_no: r.reason for r in bad.collect()} == {4: "input is not base64", 5: "time limit is not a duration"}

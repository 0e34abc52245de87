"""Curation, upsert and the packed store on hand-written rows."""

from conftest import as_dicts
from gavel.operators import contest, packed
from gavel.plans.contest_load import curate_submissions, load_contest, pack

CASES = "test_cases array<struct<input:string,output:string>>"
SUBMISSION = f"seq long, contestId int, index string, code string, passedTestCount int, {CASES}, `time-limit` string, `memory-limit` string"
RECORD = (
    f"seq long, contestId int, index string, {CASES}, `time-limit` string, `memory-limit` string, "
    "`problem-description` string, `input-specification` string, title string, `demo-input` string, `demo-output` string"
)


def record(seq, contest_id, index, cases, title="t", limit="1 s"):
    return (seq, contest_id, index, cases, limit, "", "", "", title, "", "")


def test_accepted_comes_before_first(rows):
    two = [("1", "2"), ("3", "4")]
    submissions = rows(
        SUBMISSION,
        (1, 7, "A", "rejected first", 1, two, "1", "64"),
        (2, 7, "A", "accepted second", 2, two, "1", "64"),
        (3, 7, "A", "accepted third", 2, two, "1", "64"),
        (4, 7, "B", "accepted", 0, [], "1", "64"),
        (5, 7, "B", "rejected", 1, [], "1", "64"),
    )
    kept = curate_submissions(submissions)
    assert sorted(r.code for r in kept.collect()) == ["accepted", "accepted second"]
    assert kept.columns == ["seq", "code", "contest_id", "index", "test_cases", "time_limit", "memory_limit"]


def test_unkeyed_records_are_skipped_and_empty_text_is_null(rows):
    records = rows(RECORD, record(1, 0, "A", []), record(2, 5, "", []), record(3, 5, "A", [("", "x")], title=""))
    (problem,) = contest.contest_problems(records).collect()
    assert (problem.contest_id, problem.title, problem.time_limit) == (5, None, "1 s")
    (case,) = contest.contest_cases(records).collect()
    assert (case.case_offset, case.input, case.output) == (0, None, "x")


def test_upsert_replaces_with_nulls_and_keeps_ids(rows):
    first = load_contest(rows(RECORD, record(1, 5, "A", [("a", "b"), ("c", "d")]), record(2, 6, "B", [("e", "f")])))
    again = rows(
        RECORD,
        record(3, 5, "A", [("z", "z"), ("y", "y"), ("x", "x")], title="old news"),
        record(4, 5, "A", [("n", "m")], title="", limit="2 s"),
        record(5, 8, "C", []),
    )
    ids = {(r.contest_id, r.problem_index): r.id for r in first["contest_problems"].collect()}
    second = load_contest(again, first["contest_problems"], first["contest_cases"])
    problems = {(r.contest_id, r.problem_index): r for r in second["contest_problems"].collect()}
    assert set(problems) == {(5, "A"), (6, "B"), (8, "C")}
    assert problems[5, "A"].title is None and problems[5, "A"].time_limit == "2 s"
    assert problems[6, "B"].title == "t"
    assert {k: problems[k].id for k in ids} == ids
    cases = as_dicts(second["contest_cases"], "problem_id", "case_offset")
    assert sorted((c["case_offset"], c["input"]) for c in cases if c["problem_id"] == ids[5, "A"]) == [(0, "n")]
    assert [c["input"] for c in cases if c["problem_id"] == ids[6, "B"]] == ["e"]


def test_last_record_without_cases_clears_them(rows):
    first = load_contest(rows(RECORD, record(1, 5, "A", [("a", "b")])))
    second = load_contest(rows(RECORD, record(2, 5, "A", [])), first["contest_problems"], first["contest_cases"])
    assert second["contest_cases"].count() == 0


def test_key_collisions(rows):
    keyed = rows("contest_id int, problem_index string, id long", (1, "A", 9), (1, "A", 9), (2, "B", 9), (3, "C", 4))
    (found,) = contest.key_collisions(keyed).collect()
    assert found.id == 9 and tuple(found.first_key) == (1, "A") and tuple(found.last_key) == (2, "B")


PREPARED = f"seq long, contest_id int, index string, {CASES}"


def prepared(rows):
    return rows(
        PREPARED,
        (1, 1, "A", [("é", "xy"), ("", "z")]),
        (2, 1, "B", []),
        (3, 1, "A", [("日本", "")]),
        (4, 2, "i" * 256, [("q", "q")]),
        (5, 3, "C", [("abc", "d")]),
        (6, 3, "C", []),
        (7, 0, "D", [("skip", "me")]),
    )


def test_offsets_are_bytes_and_duplicates_take_space(rows):
    store = pack(prepared(rows))
    got = [tuple(r) for r in store["index"].orderBy("seq", "case_no").select(
        "seq", "case_no", "input_offset", "input_length", "output_offset", "output_length").collect()]
    assert got == [
        (1, 0, 0, 2, 2, 2), (1, 1, 4, 0, 4, 1), (3, 0, 5, 6, 11, 0), (5, 0, 11, 3, 14, 1),
    ]
    assert [r.seq for r in store["rejects"].collect()] == [4]
    summary = {(r.contest_id, r["index"]): (r.cases, r.input_bytes + r.output_bytes, r.wasted_bytes)
               for r in store["summary"].collect()}
    # The later, empty entry of 3:C wastes all of the earlier one.
    assert summary == {(1, "A"): (3, 11, 5), (1, "B"): (0, 0, 0), (3, "C"): (1, 4, 4), (None, None): (4, 15, 9)}


def test_lookup(rows):
    latest = pack(prepared(rows))["latest"]
    requests = rows(
        "request_id int, contest_id int, index string, case_no int",
        (1, 1, "A", 0), (2, 1, "A", 1), (3, 1, "B", 0), (4, 9, "A", 0), (5, 1, "A", -1),
    )
    got = {r.request_id: (r.input, r.total, r.status) for r in packed.lookup_cases(requests, latest).collect()}
    assert got == {
        1: ("日本", 1, "ok"), 2: (None, 1, "case out of range"), 3: (None, 0, "case out of range"),
        4: (None, 0, "problem not found"), 5: (None, 1, "case out of range"),
    }


def test_list_problems_sorts_by_bytes(rows):
    names = rows("contest_id int, index string", (2, "A"), (1, "b"), (1, "B"), (1, "é"), (1, "B"))
    assert [tuple(r) for r in packed.list_problems(names).collect()] == [(1, "B"), (1, "b"), (1, "é"), (2, "A")]

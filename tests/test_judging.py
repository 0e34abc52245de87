"""Planning, parsing and grading rules."""

import json

import pytest
from pyspark.sql import functions as F

from gavel.operators import grading, outputs, planning
from gavel.plans.scoring import compile_failures, score_problems

TASK = "problem_id long, position int, name string, score int, time_limit double, memory_limit double, test_case_names array<string>"


def test_shared_cases_run_once_per_limits(rows):
    tasks = rows(
        TASK, (1, 0, "s1", 30, 1.0, 1048577.0, ["a", "b", "a"]), (1, 1, "s2", 30, 1.0, 1048577.0, ["a"]),
        (1, 2, "s3", 40, 2.0, 1048577.0, ["a"]), (1, 3, "none", 0, 1.0, 1.0, []),
    )
    cases = planning.sub_task_cases(tasks)
    assert cases.count() == 5
    got = sorted((r.case_name, r.time_limit, r.memory_limit_mb) for r in planning.judge_tasks(cases).collect())
    assert got == [("a", 1.0, 2), ("a", 2.0, 2), ("b", 1.0, 2)]


def test_limits(rows):
    df = rows("time_limit double, memory_limit_mb int", (None, None), (0.0, 0), (1.5, 64))
    got = [tuple(r)[2:] for r in planning.effective_limits(df).collect()]
    assert got == [(2.0, 8.0, 256, 1.0, 256), (0.0, 0.0, 0, 1.0, 256), (3.0, 12.0, 64, 1.5, 64)]


def test_specs(rows):
    df = rows(
        "name string, position int, input binary, output binary, time_limit double, memory_limit_mb int",
        (" test1 ", 0, b"1 2\n", b"3\n", 1.0, 64), ("  ", 1, b"x" * 200, b"", None, None),
    )
    first, second = [json.loads(r.spec) for r in planning.test_specs(df).orderBy("position").collect()]
    assert first == {"name": "test1", "input": "MSAyCg==", "output": "Mwo=", "time_limit": "1.0000s", "memory_limit_in_mb": 64}
    assert second["name"] == "test-002" and "time_limit" not in second and "\r\n" not in second["input"]


def test_spec_seconds_takes_both_forms(rows):
    df = rows("t string", ("1.5000s",), ("2000000000",), ("soon",), (None,))
    assert [r[0] for r in df.select(planning.spec_seconds(F.col("t"))).collect()] == [1.5, 2.0, None, None]


def test_compile_plan(rows):
    files = rows(
        "problem_id int, name string", (1, "stub.cpp"), (1, "grader.cpp"), (1, "checker.cpp"), (2, "grader.cpp"),
        (2, "manager.cpp"), (2, "testlib.h"), (3, "main.c"),
    )
    got = {r.problem_id: (r.main_source, r.builds_checker, r.builds_manager, r.has_testlib, r.error)
           for r in planning.compile_plan(files).collect()}
    assert got == {
        1: ("stub.cpp", True, False, False, None), 2: ("grader.cpp", False, True, True, None),
        3: (None, False, False, False, "no stub.cpp or grader.cpp found"),
    }


@pytest.mark.parametrize(
    "year, name, checker, manager, testlib, solution, mode",
    [
        (2022, "insects", False, False, False, False, "manager, stdio"),
        (2024, "message", True, True, True, True, "manager, two solutions, background"),
        (2023, "message", True, False, False, True, "batch, checker"),
        (2020, "stations", False, True, True, True, "manager, fifo arguments"),
        (2020, "stations", False, True, False, True, "manager, two solutions, fifo arguments"),
        (2021, "stations", False, True, False, True, "manager, two solutions, stdio"),
        (2021, "x", True, True, False, True, "manager, then checker"),
        (2021, "x", True, True, False, False, "unsupported"),
        (2021, "x", False, False, True, True, "unsupported"),
    ],
)
def test_run_mode(rows, year, name, checker, manager, testlib, solution, mode):
    df = rows(
        "year int, name string, builds_checker boolean, builds_manager boolean, has_testlib boolean, has_solution boolean",
        (year, name, checker, manager, testlib, solution),
    )
    assert planning.run_mode(df).first().run_mode == mode


def test_solutions(rows):
    problems = rows(
        "problem_id int, year int, name string, sample_solution string",
        (1, 2023, "longesttrip", "s"), (2, 2020, "x", None), (3, 2020, "y", None), (4, 2020, "z", "s"),
    )
    good, bad = planning.solution_sources(problems, rows("problem_id int, solution string", (2, "mine")))
    assert {r.problem_id: r.solution for r in good.collect()} == {1: "#include <ctime>\ns", 2: "mine", 4: "s"}
    assert [r.problem_id for r in bad.collect()] == [3]


def test_routes(rows):
    jobs = rows("id int, problem_type string", (1, "run_program"), (2, "cpp_oj"), (3, "rust"), (4, None))
    good, bad = planning.route_jobs(jobs, {"run_program": "gcc"})
    assert [(r.id, r.queue) for r in good.collect()] == [(1, "gcc")]
    assert {r.id: r.reason for r in bad.collect()} == {
        2: "no queue registered", 3: "unsupported problem type", 4: "unsupported problem type"}
    with pytest.raises(ValueError):
        planning.route_jobs(jobs, {"rust": "q"})


def test_capture_is_unanchored_and_guarded(rows):
    files = rows("path string", ("workspace/solution",), ("a/workspace/x",), ("other",))
    got = lambda pattern: sorted(r.path for r in outputs.capture_files(files, pattern).collect())
    assert got("workspace") == ["a/workspace/x", "workspace/solution"]
    assert got(outputs.CAPTURE_PATTERNS["compile_cpp"]) == ["workspace/solution"]
    assert got("") == []
    for bad in ("(", r"(a)\1", "(?=a)"):
        with pytest.raises(ValueError):
            outputs.capture_files(files, bad)


def test_last_captured_file_counts(rows):
    files = rows(
        "job int, path string, content binary, at int",
        (1, "workspace/solution", b"old", 1), (1, "workspace/solution", b"new", 2), (1, "noise", b"", 3), (2, "noise", b"", 1),
    )
    got = {r.job: r.solution for r in outputs.pivot_outputs(files, F.col("at")).collect()}
    assert got == {1: b"new", 2: None}


RUN = "problem_id long, case_name string, time_limit double, memory_limit double, run_result binary, job_exit_code int, stdout binary, stderr binary"


def run(case, result, stdout=b"1", exit_code=0, seconds=1.0):
    return (1, case, seconds, 1.0, result, exit_code, stdout, b" e ")


def test_run_results(rows):
    runs = rows(
        RUN, run("ok", b" 0 15\n2048\t0 "), run("tle", b"4 1000 2048 0"), run("odd", b"9 0 0 0"), run("none", None, exit_code=7),
        run("under", b"0 1_0 +5 -3"), run("three", b"1 2 3"), run("word", b"0 a 1 2"), run("utf", b"\xff 1 2 3"), run("empty", b" "),
        run("big", b"0 99999999999999999999 1 2"),
    )
    good, bad = outputs.parse_run_results(runs)
    assert {r.case_name: (r.status, r.time_seconds, r.memory_kb, r.exit_code) for r in good.collect()} == {
        "ok": ("Normal", 0.015, 2048, 0), "tle": ("Time Limit Exceeded", 1.0, 2048, 0), "odd": ("Unknown", 0.0, 0, 0),
        "none": ("Unknown", None, None, 7), "under": ("Normal", 0.01, 5, -3),
    }
    assert {r.case_name: r.reason for r in bad.collect()} == {
        "three": "run result malformed: got 3 tokens", "empty": "run result malformed: got 0 tokens",
        "word": "run result contains non-integer values", "utf": "run result is not valid utf-8",
        "big": "run result contains non-integer values",
    }


GOLDEN = b"""{"name":"test1","error":"exit code 1","details":{"time_ms":0,"memory_kb":256,"exit_code":0,"status":"Fatal Error"}}
{"name":"test2","error":"exit code 1","details":{"time_ms":0,"memory_kb":256,"exit_code":0,"status":"Fatal Error"}}
"""


def verdicts_of(rows, *jobs):
    df = rows("job int, exit_code int, compile_errors binary, judge_result binary", *jobs)
    results, errors, rejects = outputs.explode_judge_results(df)
    verdicts, refused = grading.submission_verdicts(df, results, errors, rejects)
    odd = grading.case_verdict(results)[1]
    return {r.job: r.verdict for r in verdicts.collect()}, {r.job: r.reason for r in refused.collect()}, odd


def test_golden_payload_is_a_system_error(rows):
    assert verdicts_of(rows, (1, 0, None, GOLDEN))[0] == {1: "System Error"}


def test_submission_verdicts(rows):
    def line(**fields):
        return json.dumps({"name": "t", **fields}).encode()

    def failed(status):
        return line(error="e", details={"status": status})

    verdicts, rejects, odd = verdicts_of(
        rows,
        (1, 0, b"", GOLDEN),
        (2, 0, None, b"\n  \n"),
        (3, 0, None, line() + b"\n" + failed("Time Limit Exceeded") + b"\n" + failed("Normal")),
        (4, 0, None, failed("Memory Limit Exceeded")),
        (5, 0, None, failed("Runtime Error")),
        (6, 0, None, failed("Output Limit Exceeded")),
        (7, 0, None, line(error="timeout after 10s")),
        (8, 0, None, line(details={"status": "Fatal Error"})),
        (9, 1, None, GOLDEN),
        (10, 0, None, None),
        (11, 0, None, b"{broken"),
        (12, 0, None, failed("Strange")),
        (13, 0, None, failed("Time Limit Exceeded") + b"\n" + failed("Strange") + b"\n" + failed("Odd")),
    )
    assert verdicts == {
        1: "Compilation Error", 2: "Accepted", 3: "Time Limit Exceeded", 4: "Memory Limit Exceeded", 5: "Runtime Error",
        6: "Wrong Answer", 7: "System Error", 8: "Accepted",
    }
    assert rejects == {
        9: "execution failed", 10: "judge result file not found", 11: "invalid result line",
        12: "unknown status: Strange", 13: "unknown status: Strange",
    }
    assert sorted(r.job for r in odd.collect()) == [12, 13, 13]


def test_compile_outcomes(rows):
    schema = "problem_id int, compile_errors binary, exit_code int, stdout binary, stderr binary, solution binary"
    jobs = rows(schema, (1, b"err", 1, None, None, None), (2, None, 2, b"o", b"e", None), (3, None, 0, None, None, b"bin"), (4, None, 0, None, None, None))
    got = outputs.compile_outcome(jobs)
    assert {r.problem_id: (r.outcome, r.message) for r in got.collect()} == {
        1: ("compile error", "err"), 2: ("failed", "exit code 2\nstdout: o\nstderr: e"), 3: ("compiled", None), 4: ("no binary", None)}
    olympiad = outputs.compile_outcome(jobs.filter("problem_id > 2"), olympiad=True)
    assert {r.problem_id: r.outcome for r in olympiad.collect()} == {3: "compiled", 4: "no solution binary"}
    zero = compile_failures(rows("problem_id int", (1,), (3,)), got)
    assert [(r.problem_id, r.score, r.detail) for r in zero.collect()] == [(1, 0.0, "err")]


def test_comparison_and_errors(rows):
    df = rows(
        "id int, got binary, want binary, timed_out boolean, wall_timeout string, exit_code int, stderr binary, launch_error string",
        (1, b"3\n", b"3\n", False, "10s", 0, b"", None), (2, b"3", b"3\n", False, "10s", 0, b"", None),
        (3, None, b"", False, "10s", 0, b"", None), (4, b"\xff" * 70, b"ok", False, "10s", 0, b"", None),
        (5, b"", b"", True, "10s", 1, b"", None), (6, b"", b"", False, "10s", 2, b" why\n", None),
        (7, b"", b"", False, "10s", 2, b" ", None), (8, b"", b"", False, "10s", 0, b"", "no file"),
    )
    got = {r.id: r.error for r in grading.case_error(grading.compare_outputs(df)).collect()}
    assert got == {
        1: None, 2: 'output mismatch: got "3" (len=1), want 0x330A (len=2)', 3: None,
        4: f'output mismatch: got 0x{"FF" * 64}... (len=70), want "ok" (len=2)',
        5: "timeout after 10s", 6: "exit code 2: why", 7: "exit code 2", 8: "failed to execute binary: no file",
    }
    suites = grading.suite_failed(rows("suite int, error string", (1, None), (1, "x"), (2, None), (2, "")))
    assert {r.suite: r.failed for r in suites.collect()} == {1: True, 2: False}


def test_case_scores(rows):
    schema = "id int, status string, stdout binary, stderr binary, time_seconds double, memory_kb long"
    df = rows(
        schema, (1, None, b"1", b"", 1.0, 1), (2, "Time Limit Exceeded", b"1", b"", 1.0, 1), (3, "Memory Limit Exceeded", b"1", b"", 1.0, 1),
        (4, "Normal", b" 0.5\n", b" good ", 0.25, 2048), (5, "Normal", b"100f", b"", 1.0, 1), (6, "Runtime Error", b"1", b"", 1.0, 1),
        (7, "Normal", b"1", b"", None, None), (8, "Normal", None, b"", 1.0, 1),
    )
    got = {r.id: (r.kind, r.score, r.detail, r.time_seconds, r.memory_mb) for r in grading.case_scores(df).collect()}
    none = (None, None, None)
    assert got == {
        1: ("SystemError", 0.0, *none), 2: ("TimeLimitExceeded", 0.0, *none), 3: ("MemoryLimitExceeded", 0.0, *none),
        4: ("JudgedScore", 0.5, "good", 0.25, 2.0), 5: ("UnknownResult", 0.0, *none), 6: ("UnknownResult", 0.0, *none),
        7: ("JudgedScore", 1.0, "", 0.0, 0.0), 8: ("UnknownResult", 0.0, *none),
    }


def scores(rows, tasks, runs):
    problems = rows("problem_id long", (1,), (2,))
    result = score_problems(problems, rows(TASK, *tasks), rows(RUN, *runs))
    return {r.problem_id: (r.score, r.reason) for r in result["problem_scores"].collect()}


FULL = b"0 1 1 0"
TWO_TASKS = [(1, 0, "s1", 30, 1.0, 1.0, ["a", "b"]), (1, 1, "s2", 70, 1.0, 1.0, ["c"])]


def test_full_and_partial_scores(rows):
    full = [run(c, FULL) for c in "abc"]
    assert scores(rows, TWO_TASKS, full) == {1: (100.0, None), 2: (0.0, None)}
    half = [run("a", FULL), run("b", FULL, b"0"), run("c", FULL)]
    assert scores(rows, TWO_TASKS, half)[1] == (85.0, None)


def test_shared_repeated_and_duplicate_sub_tasks(rows):
    shared = [(1, 0, "s1", 30, 1.0, 1.0, ["a", "a", "b"]), (1, 1, "s2", 70, 1.0, 1.0, ["a"]), (1, 2, "s2", 10, 1.0, 1.0, ["b"])]
    got = scores(rows, shared, [run("a", FULL), run("b", FULL, b"0")])
    assert got[1] == (20.0, None)  # 30 * 2/3; the later s2 replaces the earlier


def test_unscored_sub_tasks(rows):
    missing = scores(rows, TWO_TASKS, [run("a", FULL), run("b", b"bad"), run("c", FULL)])
    assert missing[1] == (None, "1 sub-tasks without a score")
    empty = scores(rows, [(1, 0, "s", 10, 1.0, 1.0, [])], [])
    assert empty[1] == (None, "1 sub-tasks without a score")


def test_audit(rows):
    scored = rows(
        "line_no int, score double, reason string, line string",
        (1, 100.0, None, "a"), (2, 100.0000001, None, "b"), (3, 85.0, None, "c"), (4, None, "boom", "d"), (5, float("nan"), None, "e"),
    )
    got = {r.line_no: r.error for r in grading.score_audit(scored).collect()}
    assert set(got) == {3, 4, 5} and got[4] == "boom"
    assert not grading.audit_passed(scored).first().passed
    assert grading.audit_passed(scored.filter("line_no < 3")).first().passed


def test_solver(rows):
    def double(content):
        return str(2 * int(content)).encode()

    got = {r.id: (r.got, r.launch_error) for r in grading.apply_solver(rows("id int, input binary", (1, b"4"), (2, b"x")), double).collect()}
    assert got[1] == (b"8", None)
    assert got[2][0] is None and got[2][1].startswith("ValueError")

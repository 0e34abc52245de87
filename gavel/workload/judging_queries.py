"""Planning, output parsing and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import catalog, grading, outputs, planning
from gavel.plans.scoring import score_problems, with_raw_lines
from gavel.sources import jsonl
from gavel.workload import inputs as i
from gavel.workload.registry import query


# --- planning ---

@query("sub_task_cases", f"""
WITH {i.JUDGED}
SELECT problem_id, CAST(position AS INTEGER) AS sub_task_position, name AS sub_task, CAST(score AS DOUBLE) AS points,
       CAST(time_limit AS DOUBLE) AS time_limit, CAST(memory_limit AS DOUBLE) AS memory_limit,
       CAST(case_position AS INTEGER) AS case_position, case_name
FROM sub_cases
""")
def sub_task_cases(t):
    return planning.sub_task_cases(i.judged_sub_tasks(t))


@query("judge_tasks", f"""
WITH {i.JUDGED}
SELECT DISTINCT problem_id, case_name, CAST(time_limit AS DOUBLE) AS time_limit,
       CAST(memory_limit AS DOUBLE) AS memory_limit, CAST(257 AS BIGINT) AS memory_limit_mb
FROM sub_cases
""")
def judge_tasks(t):
    return planning.judge_tasks(planning.sub_task_cases(i.judged_sub_tasks(t)))


@query("effective_limits", """
SELECT l_orderkey, l_linenumber, time_limit, memory_limit_mb, coalesce(time_limit, 1.0) * 2 AS run_seconds,
       coalesce(time_limit, 1.0) * 8 AS wall_seconds, coalesce(memory_limit_mb, 256) AS run_memory_mb,
       coalesce(nullif(time_limit, 0.0), 1.0) AS spec_seconds, coalesce(nullif(memory_limit_mb, 0), 256) AS spec_memory_mb
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax >= 0.03 THEN NULL ELSE l_tax * 10 END AS time_limit,
             CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity > 30 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS memory_limit_mb
      FROM lineitem)
""")
def effective_limits(t):
    quantity = F.col("l_quantity")
    tasks = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_tax") < 0.03, F.col("l_tax") * 10).alias("time_limit"),
        F.when(quantity > 30, F.when(quantity <= 40, 0)).otherwise(quantity.cast("int")).alias("memory_limit_mb"),
    )
    return planning.effective_limits(tasks)


@query("test_specs", """
SELECT conv_id, turn, name, '{"name":"' || name || '","input":"' || to_base64(encode(text)) || '","output":"'
       || to_base64(encode(role)) || '"' || CASE WHEN turn % 2 = 0 THEN ',"time_limit":"' || (turn + 1) || '.2500s"' ELSE '' END
       || CASE WHEN turn % 3 = 0 THEN ',"memory_limit_in_mb":' || (64 * (turn + 1)) ELSE '' END || '}' AS spec
FROM (SELECT *, CASE WHEN role = 'system' THEN 'sys' WHEN role = 'user' THEN printf('test-%03d', turn + 1) ELSE 'as ' || turn END AS name
      FROM conversations)
""")
def test_specs(t):
    turn = F.col("turn")
    cases = t.conversations.select(
        "conv_id",
        "turn",
        turn.alias("position"),
        F.when(F.col("role") == "system", " sys ")
        .when(F.col("role") == "user", " \t")
        .otherwise(F.concat(F.lit("as "), turn))
        .alias("name"),
        F.col("text").cast("binary").alias("input"),
        F.col("role").cast("binary").alias("output"),
        F.when(turn % 2 == 0, turn + 1.25).alias("time_limit"),
        F.when(turn % 3 == 0, 64 * (turn + 1)).alias("memory_limit_mb"),
    )
    return planning.test_specs(cases).select("conv_id", "turn", "name", "spec")


def _part_files(t):
    names = {
        "ECONOMY": "grader.cpp", "SMALL": "stub.cpp", "MEDIUM": "checker.cpp",
        "PROMO": "manager.cpp", "STANDARD": "testlib.h",
    }
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".c"))
    for kind, file in reversed(names.items()):
        name = F.when(F.col("p_type") == kind, file).otherwise(name)
    return t.part.select(F.floor(F.col("p_partkey") / 4).alias("problem_id"), name.alias("name"))


PART_PLAN = """
files AS (
  SELECT p_partkey // 4 AS problem_id, CASE p_type WHEN 'ECONOMY' THEN 'grader.cpp' WHEN 'SMALL' THEN 'stub.cpp'
    WHEN 'MEDIUM' THEN 'checker.cpp' WHEN 'PROMO' THEN 'manager.cpp' WHEN 'STANDARD' THEN 'testlib.h'
    ELSE replace(p_name, ' ', '_') || '.c' END AS name FROM part),
plan AS (
  SELECT problem_id, CASE WHEN bool_or(name = 'stub.cpp') THEN 'stub.cpp' WHEN bool_or(name = 'grader.cpp') THEN 'grader.cpp' END AS main_source,
         bool_or(name = 'checker.cpp') AS builds_checker, bool_or(name = 'manager.cpp') AS builds_manager,
         bool_or(name = 'testlib.h') AS has_testlib, CAST(count(*) FILTER (name LIKE '%.cpp' OR name LIKE '%.c') AS BIGINT) AS n_sources
  FROM files GROUP BY problem_id)
"""


@query("compile_plan", f"""
WITH {PART_PLAN} SELECT *, CASE WHEN main_source IS NULL THEN 'no stub.cpp or grader.cpp found' END AS error FROM plan
""")
def compile_plan(t):
    return planning.compile_plan(_part_files(t))


@query("generic_sources", f"WITH {PART_PLAN} SELECT problem_id, name FROM files WHERE name LIKE '%.cpp' OR name LIKE '%.c'")
def generic_sources(t):
    return planning.generic_sources(_part_files(t))


SPECIAL = ["insects", "towns", "sphinx", "message", "stations", "longesttrip", "other"]


@query("run_mode", f"""
WITH {PART_PLAN},
named AS (SELECT *, CAST(2020 + problem_id % 5 AS INTEGER) AS year, {SPECIAL}[problem_id % 7 + 1] AS name, problem_id % 3 > 0 AS has_solution FROM plan)
SELECT problem_id, year, name, CASE
  WHEN (year = 2022 AND name IN ('insects', 'towns')) OR (year = 2024 AND name = 'sphinx') THEN 'manager, stdio'
  WHEN year = 2024 AND name = 'message' THEN 'manager, two solutions, background'
  WHEN builds_checker AND NOT builds_manager THEN 'batch, checker'
  WHEN builds_manager AND NOT builds_checker THEN CASE WHEN has_testlib THEN 'manager, fifo arguments'
    WHEN year = 2020 AND name = 'stations' THEN 'manager, two solutions, fifo arguments' ELSE 'manager, two solutions, stdio' END
  WHEN builds_manager AND builds_checker AND has_solution THEN 'manager, then checker' ELSE 'unsupported' END AS run_mode
FROM named
""")
def run_mode(t):
    names = F.array(*[F.lit(n) for n in SPECIAL])
    key = F.col("problem_id")
    problems = (
        planning.compile_plan(_part_files(t))
        .withColumn("year", (2020 + key % 5).cast("int"))
        .withColumn("name", F.element_at(names, (key % 7 + 1).cast("int")))
        .withColumn("has_solution", key % 3 > 0)
    )
    return planning.run_mode(problems).select("problem_id", "year", "name", "run_mode")


def _solutions(t):
    names = F.array(*[F.lit(n) for n in SPECIAL])
    key = F.col("o_orderkey")
    problems = catalog.unify_layout(i.olympiad_records(t)).select(
        F.col("seq").alias("problem_id"),
        (2020 + F.col("seq") % 5).cast("int").alias("year"),
        F.element_at(names, (F.col("seq") % 7 + 1).cast("int")).alias("name"),
        "sample_solution",
    )
    submitted = t.orders.filter(key % 3 == 0).select(
        key.alias("problem_id"), F.concat(F.lit("submitted "), "o_orderpriority").alias("solution")
    )
    return planning.solution_sources(problems, submitted)


@query("solution_sources", f"""
WITH {i.OLYMPIAD},
chosen AS (SELECT seq AS problem_id, CAST(2020 + seq % 5 AS INTEGER) AS year, {SPECIAL}[seq % 7 + 1] AS name,
                  CASE WHEN seq % 3 = 0 THEN 'submitted ' || o_orderpriority ELSE sample_solution END AS solution FROM records)
SELECT problem_id, year, name, CASE WHEN year = 2023 AND name = 'longesttrip' THEN '#include <ctime>' || chr(10) ELSE '' END || solution AS solution,
       CASE WHEN solution IS NULL THEN 'no solution given or sampled' END AS reason
FROM chosen
""")
def solution_sources(t):
    good, rejects = _solutions(t)
    columns = ["problem_id", "year", "name", "solution"]
    return good.withColumn("reason", F.lit(None).cast("string")).select(*columns, "reason").unionByName(
        rejects.select(*columns, "reason")
    )


@query("route_jobs", """
SELECT event_id, problem_type, CASE problem_type WHEN 'cpp_oj' THEN 'oj_jobs' WHEN 'run_program' THEN 'gcc_jobs' WHEN 'compile_ioi_binary' THEN 'gcc_jobs' END AS queue,
  CASE WHEN problem_type = 'python' THEN 'unsupported problem type' WHEN problem_type = 'compile_cpp' THEN 'no queue registered' END AS reason
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'cpp_oj' WHEN 'view' THEN 'run_program' WHEN 'signup' THEN 'compile_cpp'
      WHEN 'error' THEN 'python' ELSE 'compile_ioi_binary' END AS problem_type FROM events)
""")
def route_jobs(t):
    kinds = {"click": "cpp_oj", "view": "run_program", "signup": "compile_cpp", "error": "python"}
    kind = F.lit("compile_ioi_binary")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    jobs = t.events.select("event_id", kind.alias("problem_type"))
    routed, rejects = planning.route_jobs(
        jobs, {"cpp_oj": "oj_jobs", "run_program": "gcc_jobs", "compile_ioi_binary": "gcc_jobs"}
    )
    return routed.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects)


@query("batch_requests", """
SELECT event_id, CAST(rn // 200 AS BIGINT) AS batch, CAST(rn % 200 AS BIGINT) AS batch_pos
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events)
""")
def batch_requests(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return planning.batch_requests(rows, ["ts", "event_id"]).drop("ts")


@query("batch_requests_by_delay", """
WITH RECURSIVE numbered AS (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n,
         count(*) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 57599999999 MICROSECOND FOLLOWING) AS in_time
  FROM events),
starts AS (
  SELECT 0::BIGINT AS rn, 0::BIGINT AS batch
  UNION ALL SELECT least(s.rn + 200, a.in_time), s.batch + 1 FROM starts s JOIN numbered a ON a.rn = s.rn
  WHERE least(s.rn + 200, a.in_time) < a.n)
SELECT event_id, batch, numbered.rn - starts.rn AS batch_pos FROM numbered ASOF JOIN starts ON numbered.rn >= starts.rn
""")
def batch_requests_by_delay(t):
    """Batches of 200 requests or of sixteen hours, so that either limit is met."""
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return planning.batch_requests(rows, ["ts", "event_id"], 200, 16 * 3600).drop("ts")


# --- outputs ---

PAGE_PATTERN = r"(en|fr)/[0-9]+5\.?"


def _pages(t):
    return t.pages.select(
        "page_id",
        (F.col("page_id") % 20).alias("job"),
        F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"),
        F.col("html").cast("binary").alias("content"),
    )


@query("capture_files", rf"""
SELECT page_id, path, md5(html) AS digest FROM (
  SELECT *, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
WHERE regexp_matches(path, '{PAGE_PATTERN}')
""")
def capture_files(t):
    return outputs.capture_files(_pages(t), PAGE_PATTERN).select(
        "page_id", "path", F.md5("content").alias("digest")
    )


_PAGE_FILES = {"solution": "workspace/en", "checker": "workspace/fr", "manager": "workspace/de", "program_stdout": "workspace/es"}
_PAGE_COLUMNS = ", ".join(
    f"md5(arg_max(html, page_id) FILTER (path = '{path}')) AS {name}" for name, path in _PAGE_FILES.items()
)


@query("pivot_outputs", f"""
SELECT page_id % 20 AS job, {_PAGE_COLUMNS} FROM (
  SELECT *, 'workspace/' || regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS path FROM pages) GROUP BY job
""")
def pivot_outputs(t):
    files = _pages(t).withColumn(
        "path", F.concat(F.lit("workspace/"), F.substring_index("path", "/", 1))
    )
    wide = outputs.pivot_outputs(files, F.col("page_id"), _PAGE_FILES)
    return wide.select("job", *[F.md5(name).alias(name) for name in _PAGE_FILES])


@query("parse_run_results", f"""
WITH {i.JUDGED}
SELECT problem_id, case_name, status, time_seconds, CAST(memory_kb AS BIGINT) AS memory_kb, CAST(exit_code AS BIGINT) AS exit_code FROM parsed
""")
def parse_run_results(t):
    return outputs.parse_run_results(i.judged_runs(t))[0].select(
        "problem_id", "case_name", "status", "time_seconds", "memory_kb", "exit_code"
    )


@query("run_result_rejects", f"""
WITH {i.JUDGED}
SELECT problem_id, case_name, CASE WHEN form = '1 2 3' THEN 'run result malformed: got 3 tokens'
       ELSE 'run result contains non-integer values' END AS reason
FROM runs WHERE form IS NOT NULL AND form <> 'ok'
""")
def run_result_rejects(t):
    return outputs.parse_run_results(i.judged_runs(t))[1].select("problem_id", "case_name", "reason")


@query("compile_outcome", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'compile error' WHEN p_size % 3 = 0 THEN 'failed'
    WHEN p_size % 7 = 0 THEN 'no binary' ELSE 'compiled' END AS outcome,
  CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 3 = 0 THEN 'exit code 1' || chr(10) || 'stdout: ' || p_type || chr(10) || 'stderr: ' END AS message
FROM part
""")
def compile_outcome(t):
    size = F.col("p_size")
    jobs = t.part.select(
        "p_partkey",
        F.when(size % 5 == 0, F.col("p_name").cast("binary")).alias("compile_errors"),
        F.when(size % 3 == 0, 1).otherwise(0).alias("exit_code"),
        F.col("p_type").cast("binary").alias("stdout"),
        F.lit(None).cast("binary").alias("stderr"),
        F.when(size % 7 != 0, F.col("p_brand").cast("binary")).alias("solution"),
    )
    return outputs.compile_outcome(jobs).select("p_partkey", "outcome", "message")


@query("explode_judge_results", f"""
WITH {i.JUDGE_JOBS}
SELECT job, CAST(position AS INTEGER) AS position, case_name, error, status, CAST(memory_kb AS BIGINT) AS memory_kb FROM result_lines
""")
def explode_judge_results(t):
    results, _, _ = outputs.explode_judge_results(i.judge_jobs(t))
    return results.select("job", "position", "case_name", "error", "details.status", "details.memory_kb")


@query("judge_result_rejects", f"""
WITH {i.JUDGE_JOBS}
SELECT job, CASE WHEN failed THEN 'execution failed' ELSE 'judge result file not found' END AS reason
FROM jobs WHERE failed OR (NOT bad_compile AND NOT has_result)
""")
def judge_result_rejects(t):
    return outputs.explode_judge_results(i.judge_jobs(t))[2].select("job", "reason")


# --- grading ---

@query("compare_outputs", f"""
WITH {i.PAIRS}
SELECT doc_id, want_id, CASE WHEN got = want THEN 1 ELSE 0 END AS same, mismatch FROM compared
""")
def compare_outputs(t):
    return grading.compare_outputs(i.document_pairs(t)).select(
        "doc_id", "want_id", F.col("matches").cast("int").alias("same"), "mismatch"
    )


def _errors(t):
    key = F.col("doc_id")
    runs = (
        grading.compare_outputs(i.document_pairs(t))
        .withColumn("timed_out", key % 11 == 0)
        .withColumn("wall_timeout", F.lit("10s"))
        .withColumn("exit_code", F.when(key % 7 == 0, 3).otherwise(0))
        .withColumn("stderr", F.when(key % 2 == 0, F.lit(" oops\n")).otherwise("  ").cast("binary"))
        .withColumn("launch_error", F.when(key % 13 == 0, "no such file"))
    )
    return grading.case_error(runs)


CASE_ERRORS = f"""
{i.PAIRS},
case_errors AS (
  SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN 'timeout after 10s'
    WHEN doc_id % 13 = 0 THEN 'failed to execute binary: no such file'
    WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'exit code 3: oops' ELSE 'exit code 3' END
    ELSE mismatch END AS error FROM compared)
"""


@query("case_error", f"WITH {CASE_ERRORS} SELECT doc_id, error FROM case_errors")
def case_error(t):
    return _errors(t).select("doc_id", "error")


@query("suite_failed", f"""
WITH {CASE_ERRORS}
SELECT source AS suite, max(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS failed FROM case_errors GROUP BY source
""")
def suite_failed(t):
    cases = _errors(t).withColumnRenamed("source", "suite")
    return grading.suite_failed(cases).withColumn("failed", F.col("failed").cast("int"))


@query("case_verdict", f"""
WITH {i.JUDGE_JOBS}
SELECT job, CAST(position AS INTEGER) AS position, case_name, verdict FROM verdicts WHERE verdict IS NOT NULL
""")
def case_verdict(t):
    results, _, _ = outputs.explode_judge_results(i.judge_jobs(t))
    return grading.case_verdict(results)[0].select("job", "position", "case_name", "verdict")


@query("case_verdict_rejects", f"""
WITH {i.JUDGE_JOBS}
SELECT job, CAST(position AS INTEGER) AS position, 'unknown status: ' || status AS reason FROM verdicts WHERE verdict IS NULL
""")
def case_verdict_rejects(t):
    results, _, _ = outputs.explode_judge_results(i.judge_jobs(t))
    return grading.case_verdict(results)[1].select("job", "position", "reason")


@query("submission_verdict", f"""
WITH {i.JUDGE_JOBS},
first_bad AS (SELECT job, arg_min(verdict, position) AS verdict FROM verdicts WHERE verdict <> 'Accepted' GROUP BY job)
SELECT j.job, CASE WHEN j.bad_compile THEN 'Compilation Error' ELSE coalesce(f.verdict, 'Accepted') END AS verdict
FROM jobs j LEFT JOIN first_bad f ON j.job = f.job
WHERE NOT j.failed AND (j.bad_compile OR j.has_result)
  AND NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.job = j.job AND v.verdict IS NULL)
""")
def submission_verdict(t):
    return _judged(t)[0]


def _judged(t):
    return grading.judged_jobs(i.judge_jobs(t))


@query("submission_verdict_rejects", f"""
WITH {i.JUDGE_JOBS},
odd AS (SELECT job, arg_min(status, position) AS status FROM verdicts WHERE verdict IS NULL GROUP BY job)
SELECT j.job, CASE WHEN j.failed THEN 'execution failed'
    WHEN NOT j.bad_compile AND NOT j.has_result THEN 'judge result file not found'
    ELSE 'unknown status: ' || o.status END AS reason
FROM jobs j LEFT JOIN odd o ON j.job = o.job
WHERE j.failed OR (NOT j.bad_compile AND NOT j.has_result) OR o.job IS NOT NULL
""")
def submission_verdict_rejects(t):
    return _judged(t)[1]


@query("case_scores", f"""
WITH {i.JUDGED}
SELECT problem_id, case_name, kind, score, CASE WHEN kind = 'JudgedScore' THEN stderr END AS detail,
       CASE WHEN kind = 'JudgedScore' THEN time_seconds END AS time_seconds,
       CASE WHEN kind = 'JudgedScore' THEN memory_kb / 1024.0 END AS memory_mb
FROM case_score
""")
def case_scores(t):
    parsed, _ = outputs.parse_run_results(i.judged_runs(t))
    return grading.case_scores(parsed).select(
        "problem_id", "case_name", "kind", "score", "detail", "time_seconds", "memory_mb"
    )


def scored(t):
    return score_problems(i.judged_problems(t), i.judged_sub_tasks(t), i.judged_runs(t))


@query("sub_task_scores", f"""
WITH {i.JUDGED}
SELECT problem_id, sub_task, CAST(position AS INTEGER) AS sub_task_position, CAST(points AS DOUBLE) AS points,
       CAST(n_cases AS BIGINT) AS n_cases, round(score, 6) AS score, reason FROM task_score
""")
def sub_task_scores(t):
    return scored(t)["sub_task_scores"].withColumn("score", F.round("score", 6))


@query("problem_scores", f"WITH {i.JUDGED} SELECT problem_id, round(score, 6) AS score, reason FROM problem_score")
def problem_scores(t):
    return scored(t)["problem_scores"].withColumn("score", F.round("score", 6))


@query("score_audit", f"""
WITH {i.JUDGED}
SELECT problem_id, '{{"problem_id":' || problem_id || ',"note":"' || o_orderpriority || '"}}' AS line,
       CASE WHEN reason IS NOT NULL THEN reason ELSE 'expected score 100, got ' || CAST(round(score, 6) AS VARCHAR) END AS error
FROM problem_score JOIN orders ON o_orderkey = problem_id
WHERE reason IS NOT NULL OR abs(round(score, 6) - 100) > 1e-6
""")
def score_audit(t):
    """Problems read from a file, scored, and those that fell short with their lines."""
    path = [i.as_json_lines(
        t.orders.select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("problem_id"), F.col("o_orderpriority").alias("note")),
        "audited",
    )]
    rows, _ = jsonl.read_jsonl(t.spark, path, jsonl.RecordSchema("problem_id long, note string"), line_numbers=True)
    problems = rows.select("problem_id", F.col("seq.file").alias("file"), "line_no")
    scores = score_problems(problems, i.judged_sub_tasks(t), i.judged_runs(t))["problem_scores"]
    lines = jsonl.with_line_numbers(jsonl.text_lines(t.spark, path))
    return with_raw_lines(grading.score_audit(scores), lines).select("problem_id", "line", "error")


@query("audit_passed", f"""
WITH {i.JUDGED}
SELECT CASE WHEN bool_or(reason IS NOT NULL OR coalesce(abs(score - 100) > 1e-6, true)) THEN 0 ELSE 1 END AS passed FROM problem_score
""")
def audit_passed(t):
    return grading.audit_passed(scored(t)["problem_scores"]).withColumn("passed", F.col("passed").cast("int"))


@query("apply_solver", """
SELECT conv_id, turn, md5(upper(CAST(strlen(text) AS VARCHAR) || ' bytes')) AS got,
       CASE WHEN role = 'system' THEN 'ValueError: no input wanted' END AS launch_error FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, turn, NULL, 'ValueError: no input wanted' FROM conversations WHERE role = 'system'
""")
def apply_solver(t):
    cases = t.conversations.select(
        "conv_id", "turn",
        F.concat(F.when(F.col("role") == "system", "!").otherwise(""), F.col("text")).cast("binary").alias("input"),
    )

    def byte_count(content: bytes) -> bytes:
        if content.startswith(b"!"):
            raise ValueError("no input wanted")
        return f"{len(content)} BYTES".encode()

    return grading.apply_solver(cases, byte_count).select(
        "conv_id", "turn", F.md5("got").alias("got"), "launch_error"
    )

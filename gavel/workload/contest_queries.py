"""Contest curation, catalogue upkeep and the packed store."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import contest, packed
from gavel.plans.contest_load import curate_submissions as curate_job, load_contest, pack
from gavel.sources.records import read_contest
from gavel.workload import inputs as i
from gavel.workload.registry import query

_KEY_SQL = "CAST(contest_id AS VARCHAR) || ':' || problem_index"
FNV_SQL = """
CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616
     ELSE CAST(h AS HUGEINT) END AS BIGINT)
"""
# FNV-1a over the characters of an ASCII key.
HASHED = f"""
hashed AS (
  SELECT contest_id, problem_index, {FNV_SQL} AS id FROM (
    SELECT contest_id, problem_index, list_reduce(
      list_transform(range(1, length(key_text) + 1), lambda i: CAST(ascii(key_text[i]) AS UHUGEINT)),
      lambda h, b: CAST(xor(h, b) * 1099511628211 % 18446744073709551616 AS UHUGEINT),
      CAST(14695981039346656037 AS UHUGEINT)) AS h
    FROM (SELECT DISTINCT contest_id, problem_index, {_KEY_SQL} AS key_text FROM submissions
          WHERE contest_id <> 0 AND problem_index <> '')))
"""


@query("accepted_submissions", f"""
WITH {i.SUBMISSIONS}
SELECT seq, contest_id, problem_index, code, n AS n_cases FROM submissions WHERE n = passed
""")
def accepted_submissions(t):
    return contest.accepted_submissions(i.submissions(t)).select(
        "seq", F.col("contestId").alias("contest_id"), F.col("index").alias("problem_index"), "code",
        F.size("test_cases").alias("n_cases"),
    )


@query("first_per_problem", f"""
WITH {i.SUBMISSIONS}
SELECT seq, contest_id, problem_index, code FROM submissions
QUALIFY row_number() OVER (PARTITION BY contest_id, problem_index ORDER BY seq) = 1
""")
def first_per_problem(t):
    return contest.first_per_problem(i.submissions(t)).select(
        "seq", F.col("contestId").alias("contest_id"), F.col("index").alias("problem_index"), "code"
    )


@query("problem_records", f"""
WITH {i.SUBMISSIONS}
SELECT seq, code, contest_id, problem_index AS "index", n AS n_cases, coalesce(time_limit, '') AS time_limit, memory_limit
FROM submissions
""")
def problem_records(t):
    return contest.problem_records(i.submissions(t)).withColumn(
        "n_cases", F.size("test_cases")
    ).drop("test_cases")


@query("curate_submissions", f"""
WITH {i.SUBMISSIONS},
kept AS (SELECT * FROM submissions WHERE n = passed
         QUALIFY row_number() OVER (PARTITION BY contest_id, problem_index ORDER BY seq) = 1),
sized AS (SELECT c.seq, CAST(sum(strlen(c.input) + strlen(c.output)) AS BIGINT) AS case_bytes
          FROM submission_cases c GROUP BY c.seq)
SELECT k.seq, code, contest_id, problem_index AS "index", n AS n_cases,
       coalesce(time_limit, '') AS time_limit, memory_limit, coalesce(case_bytes, 0) AS case_bytes
FROM kept k LEFT JOIN sized s ON k.seq = s.seq
""")
def curate_submissions(t):
    size = F.aggregate(
        "test_cases",
        F.lit(0).cast("bigint"),
        lambda total, c: total + F.octet_length(c["input"]) + F.octet_length(c["output"]),
    )
    return (
        curate_job(i.submissions(t))
        .withColumn("n_cases", F.size("test_cases"))
        .withColumn("case_bytes", size)
        .drop("test_cases")
    )


@query("contest_problems", f"""
WITH {i.SUBMISSIONS}
SELECT seq, contest_id, problem_index, time_limit, memory_limit, problem_description,
       input_specification, title, demo_input, demo_output
FROM submissions WHERE contest_id <> 0 AND problem_index <> ''
""")
def contest_problems(t):
    return contest.contest_problems(i.submissions(t))


@query("problem_keys", f"WITH {i.SUBMISSIONS}, {HASHED} SELECT contest_id, problem_index, id FROM hashed")
def problem_keys(t):
    return contest.problem_keys(contest.contest_problems(i.submissions(t)))


@query("problem_key_collisions", f"""
WITH {i.SUBMISSIONS}, {HASHED}
SELECT id, least_key.c || ':' || least_key.i AS first_key, most_key.c || ':' || most_key.i AS last_key
FROM (SELECT id % 1000 AS id, min({{'c': contest_id, 'i': problem_index}}) AS least_key,
             max({{'c': contest_id, 'i': problem_index}}) AS most_key
      FROM hashed GROUP BY id % 1000 HAVING count(*) > 1)
""")
def problem_key_collisions(t):
    """Full ids do not collide here, so the report is shown on ids cut to three digits."""
    keyed = contest.problem_keys(contest.contest_problems(i.submissions(t)))
    found = keyed.withColumn("id", F.col("id") % 1000)
    shown = lambda key: F.concat(F.col(f"{key}.contest_id"), F.lit(":"), F.col(f"{key}.problem_index")).alias(key)
    return contest.key_collisions(found).select("id", shown("first_key"), shown("last_key"))


@query("contest_cases", f"""
WITH {i.SUBMISSIONS}
SELECT seq, contest_id, problem_index, CAST(i AS INTEGER) AS case_offset,
       nullif(input, '') AS input, nullif(output, '') AS output
FROM submission_cases WHERE contest_id <> 0 AND problem_index <> ''
""")
def contest_cases(t):
    return contest.contest_cases(i.submissions(t))


def _split(t):
    everything = i.submissions(t)
    early = F.col("o_orderdate") < F.lit(i.SPLIT_DATE).cast("timestamp")
    return everything.filter(early), everything.filter(~early)


_SPLIT = f"""
kept AS (SELECT * FROM submissions WHERE contest_id <> 0 AND problem_index <> ''),
old AS (SELECT * FROM kept WHERE o_orderdate < TIMESTAMP '{i.SPLIT_DATE}'
        QUALIFY row_number() OVER (PARTITION BY contest_id, problem_index ORDER BY seq DESC) = 1),
new AS (SELECT * FROM kept WHERE o_orderdate >= TIMESTAMP '{i.SPLIT_DATE}'
        QUALIFY row_number() OVER (PARTITION BY contest_id, problem_index ORDER BY seq DESC) = 1),
merged AS (SELECT * FROM new UNION ALL
           SELECT * FROM old WHERE (contest_id, problem_index) NOT IN (SELECT (contest_id, problem_index) FROM new))
"""


@query("upsert_problems", f"""
WITH {i.SUBMISSIONS}, {_SPLIT}, {HASHED}
SELECT h.id, m.contest_id, m.problem_index, time_limit, memory_limit, problem_description,
       input_specification, title, demo_input, demo_output
FROM merged m JOIN hashed h ON m.contest_id = h.contest_id AND m.problem_index = h.problem_index
""")
def upsert_problems(t):
    old, new = _split(t)
    catalog = load_contest(old)["contest_problems"]
    return contest.upsert_problems(catalog, contest.contest_problems(new))


@query("replace_cases", f"""
WITH {i.SUBMISSIONS}, {_SPLIT}, {HASHED}
SELECT h.id AS problem_id, CAST(c.i AS INTEGER) AS case_offset, nullif(c.input, '') AS input, nullif(c.output, '') AS output
FROM merged m JOIN hashed h ON m.contest_id = h.contest_id AND m.problem_index = h.problem_index
JOIN submission_cases c ON c.seq = m.seq
""")
def replace_cases(t):
    old, new = _split(t)
    catalog = load_contest(old)["contest_cases"]
    return contest.replace_cases(catalog, new)


@query("load_contest_jsonl", f"""
WITH {i.SUBMISSIONS}, {_SPLIT}, {HASHED},
newest AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY contest_id, problem_index ORDER BY seq DESC) = 1)
SELECT h.id, n.contest_id, n.problem_index, time_limit, memory_limit, problem_description,
       input_specification, title, demo_input, demo_output
FROM newest n JOIN hashed h ON n.contest_id = h.contest_id AND n.problem_index = h.problem_index
""")
def load_contest_jsonl(t):
    """Submissions written as JSON lines and loaded from there."""
    path = i.as_json_lines(i.submissions(t).drop("o_orderdate"), "contest")
    good, _ = read_contest(t.spark, [path])
    return load_contest(good)["contest_problems"]


@query("latest_problem_entry", f"WITH {i.PACKED} SELECT contest_id, \"index\", seq, CAST(case_count AS INTEGER) AS case_count FROM latest")
def latest_problem_entry(t):
    entries, _ = packed.packed_entries(i.packed_documents(t))
    return packed.latest_problem_entry(entries).select("contest_id", "index", "seq", "case_count")


@query("packed_rejects", f"WITH {i.PACKED} SELECT seq, 'index too long' AS reason FROM packed WHERE strlen(\"index\") > 255")
def packed_rejects(t):
    return packed.packed_entries(i.packed_documents(t))[1].select("seq", "reason")


_OFFSETS = """
sized AS (SELECT *, strlen(input) AS input_length, strlen(output) AS output_length FROM entry_cases),
placed AS (
  SELECT *, coalesce(sum(input_length + output_length) OVER (ORDER BY seq, case_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS input_offset FROM sized)
"""


@query("case_index", f"""
WITH {i.PACKED}, {_OFFSETS}
SELECT seq, contest_id, "index", CAST(case_count AS INTEGER) AS case_count, CAST(case_no AS INTEGER) AS case_no,
       input_length, output_length, CAST(input_offset AS BIGINT) AS input_offset,
       CAST(input_offset + input_length AS BIGINT) AS output_offset FROM placed
""")
def case_index(t):
    entries, _ = packed.packed_entries(i.packed_documents(t))
    return packed.case_index(entries)


@query("store_summary", f"""
WITH {i.PACKED}, {_OFFSETS},
marked AS (SELECT p.*, p.seq = l.seq AS counts FROM placed p
           JOIN latest l ON p.contest_id = l.contest_id AND p."index" = l."index")
SELECT contest_id, "index", CAST(count(*) AS BIGINT) AS cases, CAST(sum(input_length) AS BIGINT) AS input_bytes,
       CAST(sum(output_length) AS BIGINT) AS output_bytes, CAST(min(input_offset) AS BIGINT) AS first_offset,
       CAST(max(input_offset + input_length + output_length) AS BIGINT) AS end_offset,
       CAST(coalesce(sum(input_length + output_length) FILTER (NOT counts), 0) AS BIGINT) AS wasted_bytes
FROM marked GROUP BY GROUPING SETS ((contest_id, "index"), ())
""")
def store_summary(t):
    return pack(i.packed_documents(t))["summary"]


@query("lookup_cases", f"""
WITH {i.PACKED}, {i.PACKED_REQUESTS}
SELECT r.request_id, r.contest_id, r."index", r.case_no, md5(c.input) AS input, c.output,
       CAST(coalesce(l.case_count, 0) AS INTEGER) AS total,
       CASE WHEN l.case_count IS NULL THEN 'problem not found'
            WHEN r.case_no >= l.case_count THEN 'case out of range' ELSE 'ok' END AS status
FROM requests r LEFT JOIN latest l ON r.contest_id = l.contest_id AND r."index" = l."index"
LEFT JOIN entry_cases c ON c.seq = l.seq AND c.case_no = r.case_no
""")
def lookup_cases(t):
    entries, _ = packed.packed_entries(i.packed_documents(t))
    latest = packed.latest_problem_entry(entries)
    return packed.lookup_cases(i.packed_requests(t), latest).withColumn("input", F.md5("input"))


@query("list_problems", f"WITH {i.PACKED} SELECT contest_id, \"index\" FROM latest ORDER BY contest_id, \"index\"")
def list_problems(t):
    entries, _ = packed.packed_entries(i.packed_documents(t))
    return packed.list_problems(entries)

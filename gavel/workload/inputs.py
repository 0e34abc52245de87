"""Operator inputs derived from the driver tables, as DataFrames and as SQL.

Nested fields are made inside each row, so no group is ever collected to build a record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gavel.session import scratch_path
from gavel.workload.registry import Tables


def upto(count: Column) -> Column:
    """0 .. count-1 as an array, empty for 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def as_json_lines(df: DataFrame, label: str, compression: str = "none") -> str:
    """Write rows with a ``seq`` as JSON lines in that order; returns the folder."""
    path = scratch_path(df.sparkSession, label)
    fields = [c for c in df.columns if c != "seq"]
    lines = df.select("seq", F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("value"))
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(path, compression)
    return path


# --- contest submissions, one per order ---

def submissions(t: Tables) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    count = ((key + customer) % 6).cast("int")
    case = lambda i: F.struct(
        F.when(i % 4 == 3, "").otherwise(text(key, " ", i)).alias("input"),
        text("é", customer * i).alias("output"),
    )
    return t.orders.select(
        key.alias("seq"),
        customer.cast("int").alias("contestId"),
        F.substring("o_orderpriority", 1, 1).alias("index"),
        text("code-", key).alias("code"),
        F.transform(upto(count), case).alias("test_cases"),
        (count - F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("passedTestCount"),
        F.when(key % 7 == 0, "").otherwise(text(1 + key % 3, " seconds")).alias("time-limit"),
        text(64 * (1 + key % 4)).alias("memory-limit"),
        F.col("o_orderpriority").alias("problem-description"),
        F.when(key % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("input-specification"),
        F.when(key % 5 == 0, "").otherwise(text("title ", key)).alias("title"),
        F.lit("").alias("demo-input"),
        text(customer % 10).alias("demo-output"),
        F.col("o_orderdate"),
    )


SUBMISSIONS = """
submissions AS (
  SELECT o_orderkey AS seq, CAST(o_custkey AS INTEGER) AS contest_id,
         substr(o_orderpriority, 1, 1) AS problem_index, 'code-' || o_orderkey AS code,
         CAST((o_orderkey + o_custkey) % 6 AS INTEGER) AS n, o_custkey,
         CAST((o_orderkey + o_custkey) % 6 AS INTEGER)
           - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS passed,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (1 + o_orderkey % 3) || ' seconds' END AS time_limit,
         CAST(64 * (1 + o_orderkey % 4) AS VARCHAR) AS memory_limit,
         o_orderpriority AS problem_description,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS input_specification,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'title ' || o_orderkey END AS title,
         CAST(NULL AS VARCHAR) AS demo_input, CAST(o_custkey % 10 AS VARCHAR) AS demo_output,
         o_orderdate
  FROM orders),
submission_cases AS (
  SELECT *, CASE WHEN i % 4 = 3 THEN '' ELSE seq || ' ' || i END AS input,
         'é' || (o_custkey * i) AS output
  FROM (SELECT *, unnest(range(n)) AS i FROM submissions))
"""

SPLIT_DATE = "1998-01-01"


# --- packed store, one entry per document ---

def packed_documents(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.select(
        F.col("doc_id").alias("seq"),
        (F.substring("source", 4, 10).cast("int") + 1).alias("contest_id"),
        F.when(F.col("doc_id") % 97 == 0, F.repeat("lang", F.lit(150)))
        .otherwise(F.col("lang"))
        .alias("index"),
        F.transform(
            lines,
            lambda line: F.struct(line.alias("input"), text("= ", line).alias("output")),
        ).alias("test_cases"),
    )


PACKED = """
packed AS (
  SELECT doc_id AS seq, CAST(substr(source, 4, 10) AS INTEGER) + 1 AS contest_id,
         CASE WHEN doc_id % 97 = 0 THEN repeat(lang, 150) ELSE lang END AS "index",
         string_split(text, chr(10)) AS lines
  FROM documents),
entries AS (SELECT *, len(lines) AS case_count FROM packed WHERE strlen("index") <= 255),
entry_cases AS (
  SELECT seq, contest_id, "index", case_count, i - 1 AS case_no, lines[i] AS input,
         '= ' || lines[i] AS output
  FROM (SELECT *, unnest(range(1, case_count + 1)) AS i FROM entries)),
latest AS (
  SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY contest_id, "index" ORDER BY seq DESC) = 1)
"""


def packed_requests(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    langs = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "zz")])
    return t.events.select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") % 24).cast("int").alias("contest_id"),
        F.element_at(langs, k % 5 + 1).alias("index"),
        k.alias("case_no"),
    )


PACKED_REQUESTS = """
requests AS (
  SELECT event_id AS request_id, CAST(user_id % 24 AS INTEGER) AS contest_id,
         ['en','fr','de','es','zz'][k % 5 + 1] AS "index", k AS case_no
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))
"""


# --- olympiad records, one per order ---

FILE_RULES = [
    ("grader.cpp", 3, 2),
    ("stub.cpp", 4, 1),
    ("checker.cpp", 5, 3),
    ("manager.cpp", 7, 3),
    ("testlib.h", 2, 1),
    ("a/b.txt", 23, 1),
]


def olympiad_records(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 53 == 0, "").otherwise(text("p", F.col("o_custkey")))
    year = F.when(key % 59 == 0, 0).otherwise(F.year("o_orderdate"))
    # Arrays of all that a record may have, cut to what it has: Spark compiles these, and would interpret
    # a lambda that makes the structs, for every element of every record.
    first = lambda n, *items: F.slice(F.array(*items), F.lit(1), n.cast("int"))
    task = lambda k: F.struct(
        F.struct(
            ((1 + (key + k) % 3) / 10.0).alias("time_limit"),
            F.lit(268435456.0).alias("memory_limit"),
        ).alias("limit"),
        F.lit(f"st{k}").alias("name"),
        F.lit(10 * (k + 1)).alias("score"),
        F.transform(
            upto(((key + k) % 4).cast("int")), lambda j: text("c", (k + 2 * j) % 6)
        ).alias("test_case_names"),
    )
    tasks = first(1 + key % 3, *[task(k) for k in range(3)])
    case = lambda i: F.struct(
        F.lit(f"c{i}").alias("key"),
        F.struct(text(key, f"/{i}").alias("input"), F.lit(f"ü{i * i}").alias("output")).alias("value"),
    )
    cases = F.map_from_entries(first(3 + key % 3, *[case(i) for i in range(5)]))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entry = lambda file: F.struct(
        F.lit(file).alias("key"), text(F.col("o_orderpriority"), f" {file} ", key).alias("value")
    )
    kept = [
        F.when(key % modulus < limit, F.array(entry(file))).otherwise(none)
        for file, modulus, limit in FILE_RULES
    ]
    files = F.map_from_entries(F.flatten(F.array(*kept)))
    solution = F.when(key % 11 != 0, text("int main(){} //", key))
    nested = key % 2 == 0
    fields = {
        "id": name,
        "year": year,
        "sample_solution": solution,
        "sub_tasks": tasks,
        "test_cases": cases,
        "grader_files": files,
    }
    return t.orders.select(
        key.alias("seq"),
        F.when(nested, F.struct(*[e.alias(n) for n, e in fields.items()])).alias("metadata"),
        *[F.when(~nested, e).alias(n) for n, e in fields.items()],
    )


_FILE_ROWS = "\n    UNION ALL ".join(
    f"SELECT seq, '{file}' AS name, o_orderpriority || ' {file} ' || seq AS content"
    f" FROM records WHERE seq % {modulus} < {limit}"
    for file, modulus, limit in FILE_RULES
)

OLYMPIAD = f"""
records AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE 'p' || o_custkey END AS name,
         CASE WHEN o_orderkey % 59 = 0 OR (o_orderkey % 53 = 0 AND o_orderkey % 2 = 1) THEN 0
              ELSE year(o_orderdate) END AS year,
         CASE WHEN o_orderkey % 11 <> 0 AND NOT (o_orderkey % 53 = 0 AND o_orderkey % 2 = 1) THEN 'int main(){{}} //' || o_orderkey END AS sample_solution,
         o_orderpriority, CAST(1 + o_orderkey % 3 AS INTEGER) AS n_tasks,
         CAST(3 + o_orderkey % 3 AS INTEGER) AS n_cases
  FROM orders),
keyed AS (SELECT * FROM records WHERE name <> '' AND year <> 0),
record_cases AS (
  SELECT seq, 'c' || i AS name, seq || '/' || i AS input, 'ü' || (i * i) AS output
  FROM (SELECT seq, unnest(range(n_cases)) AS i FROM records)),
record_files AS (
    {_FILE_ROWS}),
record_tasks AS (
  SELECT seq, k AS position, 'st' || k AS name, 10 * (k + 1) AS score,
         CAST(CAST((1 + (seq + k) % 3) / 10.0 AS FLOAT) AS DOUBLE) AS time_limit,
         CAST(268435456.0 AS DOUBLE) AS memory_limit, CAST((seq + k) % 4 AS INTEGER) AS n_names
  FROM (SELECT seq, unnest(range(n_tasks)) AS k FROM records)),
record_refs AS (
  SELECT *, 'c' || ((position + 2 * j) % 6) AS case_name, j AS case_position
  FROM (SELECT *, unnest(range(n_names)) AS j FROM record_tasks)),
fresh AS (
  SELECT *, row_number() OVER (ORDER BY seq) AS problem_id
  FROM (SELECT *, count(*) OVER (PARTITION BY year, name) AS copies FROM keyed) WHERE copies = 1)
"""


# --- judging: sub-tasks from orders, runs from order lines ---

def judged_problems(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("problem_id"))


def judged_sub_tasks(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    positions = F.posexplode(upto((1 + key % 3).cast("int"))).alias("position", "k")
    k = F.col("k")
    return t.orders.select(key, positions).select(
        key.alias("problem_id"),
        "position",
        text("st", k % 2).alias("name"),
        (10 * (k + 1)).alias("score"),
        (1.0 + key % 2).alias("time_limit"),
        F.lit(268435457.0).alias("memory_limit"),
        F.transform(
            upto(((key + k) % 4).cast("int")), lambda j: text("c", (k * 2 + j) % 7 + 1)
        ).alias("test_case_names"),
    )


def judged_runs(t: Tables) -> DataFrame:
    """Runs of each (order, line number); repeated pairs are reduced to one first."""
    key, line, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("s")
    code = F.when(s % 3 < 2, 0).otherwise(line % 9)
    result = (
        F.when(s % 31 == 0, F.lit(None).cast("string"))
        .when(s % 29 == 0, "x 1 2 3")
        .when(s % 37 == 0, "1 2 3")
        .otherwise(text(code, " ", (F.col("q") * 10).cast("int"), "  ", s * 16, " ", s % 2, "\n"))
    )
    stdout = (
        F.when(s % 10 == 0, "bad").when(s % 10 == 1, " 1_0 ").when(s % 10 == 2, "100f")
        .when(s % 10 == 3, "").when(s % 10 == 4, "1").otherwise(text(F.col("d").cast("string"), "\n"))
    )
    return (
        t.lineitem.groupBy(key, line)
        .agg(
            F.min("l_suppkey").alias("s"),
            F.max("l_quantity").alias("q"),
            F.max("l_discount").alias("d"),
        )
        .select(
            key.alias("problem_id"),
            text("c", line).alias("case_name"),
            (1.0 + key % 2).alias("time_limit"),
            F.lit(268435457.0).alias("memory_limit"),
            result.cast("binary").alias("run_result"),
            (s % 5).cast("int").alias("job_exit_code"),
            stdout.cast("binary").alias("stdout"),
            text(" err ", s, " ").cast("binary").alias("stderr"),
        )
    )


JUDGED = """
sub_tasks AS (
  SELECT o_orderkey AS problem_id, k AS position, 'st' || (k % 2) AS name, 10 * (k + 1) AS score,
         1.0 + o_orderkey % 2 AS time_limit, 268435457.0 AS memory_limit,
         CAST((o_orderkey + k) % 4 AS INTEGER) AS n_names
  FROM (SELECT o_orderkey, unnest(range(CAST(1 + o_orderkey % 3 AS INTEGER))) AS k FROM orders)),
sub_cases AS (
  SELECT *, 'c' || ((position * 2 + j) % 7 + 1) AS case_name, j AS case_position
  FROM (SELECT *, unnest(range(n_names)) AS j FROM sub_tasks)),
raw_runs AS (
  SELECT l_orderkey AS problem_id, l_linenumber AS line, min(l_suppkey) AS s, max(l_quantity) AS q,
         max(l_discount) AS d
  FROM lineitem GROUP BY ALL),
runs AS (
  SELECT problem_id, 'c' || line AS case_name, 1.0 + problem_id % 2 AS time_limit,
         CASE WHEN s % 31 = 0 THEN NULL
              WHEN s % 29 = 0 THEN 'x 1 2 3' WHEN s % 37 = 0 THEN '1 2 3'
              ELSE 'ok' END AS form,
         CASE WHEN s % 3 < 2 THEN 0 ELSE line % 9 END AS code,
         CAST(floor(q * 10) AS BIGINT) AS time_ms, s * 16 AS memory_kb, s % 2 AS program_exit,
         s % 5 AS job_exit, trim(' err ' || s || ' ') AS stderr,
         CASE s % 10 WHEN 0 THEN NULL WHEN 1 THEN 10.0 WHEN 2 THEN NULL WHEN 3 THEN NULL
                     WHEN 4 THEN 1.0 ELSE d END AS number
  FROM raw_runs),
parsed AS (
  SELECT problem_id, case_name, time_limit, stderr, number,
         CASE WHEN form IS NULL THEN 'Unknown' ELSE
           CASE code WHEN 0 THEN 'Normal' WHEN 1 THEN 'Invalid' WHEN 2 THEN 'Runtime Error'
             WHEN 3 THEN 'Memory Limit Exceeded' WHEN 4 THEN 'Time Limit Exceeded'
             WHEN 5 THEN 'Output Limit Exceeded' WHEN 6 THEN 'Disallowed Syscall'
             WHEN 7 THEN 'Fatal Error' ELSE 'Unknown' END END AS status,
         CASE WHEN form = 'ok' THEN time_ms / 1000.0 END AS time_seconds,
         CASE WHEN form = 'ok' THEN memory_kb END AS memory_kb,
         CASE WHEN form = 'ok' THEN program_exit ELSE job_exit END AS exit_code
  FROM runs WHERE form IS NULL OR form = 'ok'),
scored AS (
  SELECT *, CASE WHEN status = 'Time Limit Exceeded' THEN 'TimeLimitExceeded'
                 WHEN status = 'Memory Limit Exceeded' THEN 'MemoryLimitExceeded'
                 WHEN status = 'Normal' AND number IS NOT NULL THEN 'JudgedScore'
                 ELSE 'UnknownResult' END AS kind
  FROM parsed),
case_score AS (
  SELECT *, CASE WHEN kind = 'JudgedScore' THEN number ELSE 0.0 END AS score FROM scored),
task_sum AS (
  SELECT c.problem_id, c.name, c.position, max(c.score) AS points, count(*) AS n_cases,
         count(*) FILTER (r.score IS NULL) AS n_missing, sum(r.score) AS total
  FROM sub_cases c LEFT JOIN case_score r
    ON c.problem_id = r.problem_id AND c.case_name = r.case_name AND c.time_limit = r.time_limit
  GROUP BY ALL),
task_score AS (
  SELECT problem_id, name AS sub_task, position, points, n_cases,
         CASE WHEN n_missing = 0 THEN total / n_cases * points END AS score,
         CASE WHEN n_missing > 0 THEN 'case without result' END AS reason
  FROM task_sum QUALIFY row_number() OVER (PARTITION BY problem_id, name ORDER BY position DESC) = 1),
parts AS (
  SELECT problem_id, score, reason FROM task_score
  UNION ALL SELECT problem_id, NULL, 'sub-task without cases' FROM sub_tasks WHERE n_names = 0),
problem_score AS (
  SELECT o_orderkey AS problem_id,
         CASE WHEN count(reason) = 0 THEN coalesce(sum(score), 0.0) END AS score,
         CASE WHEN count(reason) > 0 THEN count(reason) || ' sub-tasks without a score' END AS reason
  FROM orders LEFT JOIN parts ON o_orderkey = problem_id GROUP BY o_orderkey)
"""


# --- online-judge jobs, one per order ---

STATUSES = ["Normal", "Invalid", "Runtime Error", "Memory Limit Exceeded", "Time Limit Exceeded",
            "Output Limit Exceeded", "Disallowed Syscall", "Fatal Error", "Unknown", "Odd"]


def judge_jobs(t: Tables) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(s) for s in STATUSES])

    def line(i: Column) -> Column:
        error = F.when((customer + i) % 3 != 0, text('"error":"e', i, '",')).otherwise("")
        details = F.when(
            (key + i) % 12 < 10,
            text('"details":{"time_ms":', i, ',"memory_kb":', customer, ',"exit_code":0,"status":"',
                 F.element_at(names, ((key + i) % 12 + 1).cast("int")), '"},'),
        ).otherwise("")
        return F.when(i == 5, "  ").otherwise(text("{", error, details, '"name":"t', i, '"}'))

    count = (key % 7).cast("int")
    lines = F.when(
        count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), line)
    ).otherwise(F.array().cast("array<string>"))
    return t.orders.select(
        key.alias("job"),
        F.when(key % 17 == 0, 1).otherwise(0).alias("exit_code"),
        F.when(key % 13 == 0, F.when(key % 2 == 0, "").otherwise("bad")).cast("binary").alias("compile_errors"),
        F.when(key % 19 != 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).cast("binary").alias("judge_result"),
    )


_STATUS_LIST = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"

JUDGE_JOBS = f"""
jobs AS (
  SELECT o_orderkey AS job, o_custkey, o_orderkey % 17 = 0 AS failed, o_orderkey % 13 = 0 AS bad_compile,
         o_orderkey % 19 <> 0 AS has_result, CAST(o_orderkey % 7 AS INTEGER) AS n
  FROM orders),
result_lines AS (
  SELECT job, i, row_number() OVER (PARTITION BY job ORDER BY i) - 1 AS position, 't' || i AS case_name,
         CASE WHEN (o_custkey + i) % 3 <> 0 THEN 'e' || i END AS error,
         CASE WHEN (job + i) % 12 < 10 THEN {_STATUS_LIST}[(job + i) % 12 + 1] END AS status,
         CASE WHEN (job + i) % 12 < 10 THEN o_custkey END AS memory_kb
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM jobs WHERE NOT failed AND NOT bad_compile AND has_result)
  WHERE i <> 5),
verdicts AS (
  SELECT *, CASE WHEN error IS NULL THEN 'Accepted'
    WHEN coalesce(status, 'Fatal Error') IN ('Fatal Error', 'Disallowed Syscall', 'Invalid', 'Unknown') THEN 'System Error'
    WHEN status IN ('Time Limit Exceeded', 'Memory Limit Exceeded', 'Runtime Error') THEN status
    WHEN status IN ('Normal', 'Output Limit Exceeded') THEN 'Wrong Answer' END AS verdict
  FROM result_lines)
"""


# --- compared outputs: each document against the lowest doc_id of its length ---

def document_pairs(t: Tables) -> DataFrame:
    lowest = t.documents.groupBy("n_chars").agg(F.min("doc_id").alias("want_id"))
    wanted = t.documents.select(
        F.col("doc_id").alias("want_id"), F.col("text").cast("binary").alias("want")
    )
    return (
        t.documents.join(lowest, "n_chars")
        .join(wanted, "want_id")
        .select("doc_id", "want_id", "source", F.col("text").cast("binary").alias("got"), "want")
    )


PAIRS = """
pairs AS (
  SELECT d.doc_id, d.source, w.doc_id AS want_id, d.text AS got, w.text AS want
  FROM documents d JOIN (SELECT n_chars, min(doc_id) AS want_id FROM documents GROUP BY n_chars) l
    ON d.n_chars = l.n_chars JOIN documents w ON w.doc_id = l.want_id),
heads AS (
  SELECT *, unhex(substr(hex(encode(got)), 1, 128)) AS got_head,
         unhex(substr(hex(encode(want)), 1, 128)) AS want_head FROM pairs),
shown AS (
  SELECT *, TRY(decode(got_head)) AS got_text, TRY(decode(want_head)) AS want_text FROM heads),
compared AS (
  SELECT *, CASE WHEN got <> want THEN
    'output mismatch: got ' || CASE WHEN strlen(got) = 0 THEN '<empty>' ELSE
      CASE WHEN got_text IS NOT NULL AND NOT regexp_matches(got_text, '[\\x00-\\x1f\\x7f"\\\\]')
           THEN '"' || got_text || '"' ELSE '0x' || hex(got_head) END
      || CASE WHEN strlen(got) > 64 THEN '...' ELSE '' END END
    || ' (len=' || strlen(got) || '), want ' || CASE WHEN strlen(want) = 0 THEN '<empty>' ELSE
      CASE WHEN want_text IS NOT NULL AND NOT regexp_matches(want_text, '[\\x00-\\x1f\\x7f"\\\\]')
           THEN '"' || want_text || '"' ELSE '0x' || hex(want_head) END
      || CASE WHEN strlen(want) > 64 THEN '...' ELSE '' END END
    || ' (len=' || strlen(want) || ')' END AS mismatch
  FROM shown)
"""


# --- transport: requests and responses from events ---

TTL_SECONDS = 3 * 24 * 3600


def _keyed_events(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "user_id",
        text(F.col("user_id"), "-", F.floor(k / 10).cast("int")).alias("id"),
        k.alias("k"),
    )


def requests(t: Tables) -> DataFrame:
    """The first view of each (user, tens of k)."""
    return (
        _keyed_events(t)
        .filter("event_type = 'view'")
        .groupBy("id", "user_id")
        .agg(F.min("ts").alias("request_ts"))
        .select(
            "id",
            text("q", F.col("user_id") % 5).alias("queue"),
            "request_ts",
            F.when(F.col("user_id") % 2 == 0, F.col("request_ts") + F.expr("INTERVAL 10 DAYS")).alias("deadline_ts"),
        )
    )


def responses(t: Tables) -> DataFrame:
    """Every click, purchase and error."""
    return (
        _keyed_events(t)
        .filter("event_type IN ('click', 'purchase', 'error')")
        .select("id", F.col("ts").alias("response_ts"), F.col("event_id").alias("seq"), "k", "event_type")
    )


TRANSPORT = f"""
keyed_events AS (
  SELECT *, user_id || '-' || CAST(floor(k / 10) AS INTEGER) AS id
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
requests AS (
  SELECT id, 'q' || (user_id % 5) AS queue, min(ts) AS request_ts,
         CASE WHEN user_id % 2 = 0 THEN min(ts) + INTERVAL 10 DAY END AS deadline_ts
  FROM keyed_events WHERE event_type = 'view' GROUP BY id, user_id),
responses AS (
  SELECT id, ts AS response_ts, event_id AS seq, k, event_type
  FROM keyed_events WHERE event_type IN ('click', 'purchase', 'error')),
candidates AS (
  SELECT r.id, r.response_ts, r.seq, r.response_ts <= q.request_ts AS waiting
  FROM responses r JOIN requests q ON r.id = q.id
  WHERE (r.response_ts <= q.request_ts AND r.response_ts + INTERVAL {TTL_SECONDS} SECOND >= q.request_ts)
     OR (r.response_ts > q.request_ts AND (q.deadline_ts IS NULL OR r.response_ts <= q.deadline_ts))),
taken AS (
  SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY id ORDER BY waiting DESC,
    CASE WHEN waiting THEN -epoch_us(response_ts) ELSE epoch_us(response_ts) END,
    CASE WHEN waiting THEN -seq ELSE seq END) = 1),
matched AS (
  SELECT q.*, t.response_ts, t.seq AS response_seq,
         CASE WHEN t.seq IS NULL THEN NULL WHEN t.waiting THEN 'waiting' ELSE 'arrived' END AS how
  FROM requests q LEFT JOIN taken t ON q.id = t.id)
"""


# --- transport with repeated requests, and as a stream in parts ---

DELAY_SECONDS = 24 * 3600
MAX_WAIT_DAYS = 90


def repeated_requests(t: Tables) -> DataFrame:
    """Every view and signup: an id is asked for many times."""
    return (
        _keyed_events(t)
        .filter("event_type IN ('view', 'signup')")
        .select(
            "event_id",
            "id",
            text("q", F.col("user_id") % 5).alias("queue"),
            F.col("ts").alias("request_ts"),
            F.when(F.col("user_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("deadline_ts"),
        )
    )


def event_parts(t: Tables) -> Callable[[str, str], Column]:
    """The part of an event by its number and time columns: four parts by time, where a fifth of the
    events comes up to a day too late for its part, and some only come with the last one.

    A row says its part itself, so no table of parts is joined to the events.
    """
    low, high = t.events.agg(*[f(F.unix_micros(F.col("ts").cast("timestamp"))) for f in (F.min, F.max)]).first()

    def part(number: str, ts: str) -> Column:
        moved = F.unix_micros(ts) + (F.col(number) % 5) * F.lit(6 * 3600 * 1_000_000) - F.lit(low)
        by_time = F.least(F.lit(3), F.floor(moved * 4 / F.lit(float(high - low + 1))))
        return F.when(F.col(number) % 97 == 0, 3).otherwise(by_time).cast("int")

    return part


def in_turn(live: bool) -> str:
    """The store one event of every id at a time; with ``live`` only for events that are not late."""
    until = f"request_ts + INTERVAL {MAX_WAIT_DAYS} DAY" if live else "TIMESTAMP 'infinity'"
    late = f"""
bounds AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events),
parts AS (
  SELECT e.*, CASE WHEN event_id % 97 = 0 THEN 3 ELSE least(3, floor(
           CAST(epoch_us(ts) + (event_id % 5) * 21600000000 - low AS DOUBLE) * 4 / CAST(high - low + 1 AS DOUBLE))) END AS part
  FROM events e, bounds),
ends AS (
  SELECT p.part, max(e.ts) - INTERVAL {DELAY_SECONDS} SECOND AS watermark
  FROM (SELECT DISTINCT part FROM parts) p JOIN parts e ON e.part < p.part GROUP BY p.part),
arrivals AS (SELECT p.*, coalesce(p.ts < ends.watermark, false) AS late FROM parts p LEFT JOIN ends ON p.part = ends.part),
"""
    return f"""
{late if live else "arrivals AS (SELECT *, false AS late FROM events),"}
keyed_events AS (
  SELECT *, user_id || '-' || CAST(floor(k / 10) AS INTEGER) AS id
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM arrivals)),
requests AS (
  SELECT event_id, id, 'q' || (user_id % 5) AS queue, ts AS request_ts,
         CASE WHEN user_id % 2 = 0 THEN ts + INTERVAL 10 DAY END AS deadline_ts
  FROM keyed_events WHERE event_type IN ('view', 'signup') AND NOT late),
responses AS (
  SELECT id, ts AS response_ts, event_id AS seq
  FROM keyed_events WHERE event_type IN ('click', 'purchase', 'error') AND NOT late),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, kind, number) AS k FROM (
    SELECT id, response_ts AS ts, 0 AS kind, seq AS number, NULL::TIMESTAMP AS until FROM responses
    UNION ALL SELECT id, request_ts, 1, event_id, coalesce(deadline_ts, {until}) FROM requests)),
store AS (
  SELECT DISTINCT id, 0::BIGINT AS k, NULL::BIGINT AS waiter, NULL::TIMESTAMP AS until, NULL::BIGINT AS held, NULL::TIMESTAMP AS held_ts,
         NULL::BIGINT AS request, NULL::BIGINT AS response, NULL::VARCHAR AS how, NULL::BIGINT AS gone, NULL::VARCHAR AS fate FROM turns
  UNION ALL
  SELECT id, k,
         CASE WHEN kind = 1 AND alive THEN waiter WHEN kind = 1 AND NOT fresh THEN number END,
         CASE WHEN kind = 1 AND alive THEN until WHEN kind = 1 AND NOT fresh THEN new_until END,
         CASE WHEN kind = 0 AND NOT alive THEN number END, CASE WHEN kind = 0 AND NOT alive THEN ts END,
         CASE WHEN kind = 0 AND alive THEN waiter WHEN kind = 1 AND (alive OR fresh) THEN number END,
         CASE WHEN kind = 0 AND alive THEN number WHEN kind = 1 AND fresh AND NOT alive THEN held END,
         CASE WHEN kind = 0 AND alive THEN 'arrived' WHEN kind = 1 AND alive THEN 'rejected' WHEN kind = 1 AND fresh THEN 'waiting' END,
         CASE WHEN NOT alive AND (kind = 0 OR NOT fresh) THEN held END,
         CASE WHEN kind = 0 AND fresh THEN 'overwritten' ELSE 'expired' END
  FROM (SELECT s.waiter, s.until, s.held, t.id, t.k, t.ts, t.kind, t.number, t.until AS new_until,
               coalesce(t.ts <= s.until, false) AS alive,
               coalesce(t.ts <= s.held_ts + INTERVAL {TTL_SECONDS} SECOND, false) AS fresh
        FROM store s JOIN turns t ON t.id = s.id AND t.k = s.k + 1)),
matched AS (
  SELECT q.*, r.response_ts, s.response AS response_seq, s.how
  FROM requests q LEFT JOIN (SELECT request, response, how FROM store WHERE request IS NOT NULL) s ON s.request = q.event_id
  LEFT JOIN responses r ON r.seq = s.response),
fates AS (
  SELECT r.*, coalesce(s.fate, 'expired') AS fate
  FROM responses r LEFT JOIN (SELECT gone, fate FROM store WHERE gone IS NOT NULL) s ON s.gone = r.seq
  WHERE r.seq NOT IN (SELECT response_seq FROM matched WHERE response_seq IS NOT NULL))
"""

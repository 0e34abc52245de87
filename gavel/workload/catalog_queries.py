"""Olympiad catalogue: flattening, keys, integrity and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import catalog as c, integrity, lookup
from gavel.plans.catalog_load import TABLES, load_catalog as load_job
from gavel.session import scratch_path
from gavel.sources.catalog_store import read_catalog, write_catalog as write_tables
from gavel.sources.records import read_olympiad
from gavel.workload import inputs as i
from gavel.workload.registry import query


def _unified(t):
    return c.unify_layout(i.olympiad_records(t))


def _by_seq(t):
    """Problems with ``seq`` standing in for the id, for operators shown one at a time."""
    return _unified(t).withColumnRenamed("seq", "problem_id")


@query("unify_layout", f"""
WITH {i.OLYMPIAD}
SELECT r.seq, name, CAST(year AS INTEGER) AS year, sample_solution, n_tasks, n_cases, CAST(coalesce(f.n, 0) AS INTEGER) AS n_files
FROM records r LEFT JOIN (SELECT seq, count(*) AS n FROM record_files GROUP BY seq) f ON r.seq = f.seq
""")
def unify_layout(t):
    return _unified(t).select(
        "seq", "name", "year", "sample_solution",
        F.size("sub_tasks").alias("n_tasks"), F.size("test_cases").alias("n_cases"),
        F.coalesce(F.size("grader_files"), F.lit(0)).alias("n_files"),
    )


@query("reject_unkeyed", f"""
WITH {i.OLYMPIAD}
SELECT seq, name, CAST(year AS INTEGER) AS year, 'missing metadata id or year' AS reason FROM records WHERE name = '' OR year = 0
""")
def reject_unkeyed(t):
    return c.reject_unkeyed(_unified(t))[1].select("seq", "name", "year", "reason")


@query("named_cases", f"WITH {i.OLYMPIAD} SELECT seq AS problem_id, name, input, output FROM record_cases")
def named_cases(t):
    return c.named_cases(_by_seq(t).drop("name")).drop("position")


@query("grader_files", f"""
WITH {i.OLYMPIAD}
SELECT seq AS problem_id, CAST(row_number() OVER (PARTITION BY seq ORDER BY name) - 1 AS INTEGER) AS position, name, content
FROM record_files
""")
def grader_files(t):
    return c.grader_files(_by_seq(t).drop("name"))


@query("sub_tasks", f"""
WITH {i.OLYMPIAD}
SELECT seq AS problem_id, CAST(position AS INTEGER) AS position, name, CAST(score AS INTEGER) AS score,
       time_limit, memory_limit, n_names FROM record_tasks
""")
def sub_tasks(t):
    return c.sub_tasks(_by_seq(t).drop("name")).withColumn(
        "n_names", F.size("test_case_names")
    ).drop("test_case_names")


def _tasks_and_cases(t):
    problems = _by_seq(t).drop("name")
    task_id = F.col("problem_id") * 10 + F.col("position")
    case_id = F.col("problem_id") * 10 + F.substring("name", 2, 2).cast("int")
    return (
        c.sub_tasks(problems).withColumn("id", task_id),
        c.named_cases(problems).withColumn("id", case_id),
    )


@query("link_sub_tasks", f"""
WITH {i.OLYMPIAD}
SELECT r.seq * 10 + r.position AS sub_task_id, CAST(r.case_position AS INTEGER) AS case_position,
       r.seq * 10 + CAST(substr(c.name, 2, 2) AS INTEGER) AS test_case_id
FROM record_refs r JOIN record_cases c ON r.seq = c.seq AND r.case_name = c.name
""")
def link_sub_tasks(t):
    return c.link_sub_tasks(*_tasks_and_cases(t))


@query("missing_case_refs", f"""
WITH {i.OLYMPIAD}
SELECT r.seq AS problem_id, CAST(r.position AS INTEGER) AS position, CAST(r.case_position AS INTEGER) AS case_position, r.case_name
FROM record_refs r ANTI JOIN record_cases c ON r.seq = c.seq AND r.case_name = c.name
""")
def missing_case_refs(t):
    return c.missing_case_refs(*_tasks_and_cases(t)).drop("id")


@query("assign_ids", """
SELECT event_type, ts_us, event_id, (SELECT max(o_orderkey) FROM orders)
       + row_number() OVER (ORDER BY event_type, ts_us, event_id) AS id
FROM (SELECT event_type, epoch_us(ts) AS ts_us, event_id FROM events)
""")
def assign_ids(t):
    """Numbers for every event in (type, time) order, after the largest order key."""
    existing = t.orders.select(F.col("o_orderkey").alias("id"))
    rows = t.events.select(
        "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id"
    )
    return c.assign_ids(rows, ["event_type", "ts_us", "event_id"], existing)


@query("unique_violations", f"""
WITH {i.OLYMPIAD}
SELECT seq, name, CAST(year AS INTEGER) AS year FROM keyed
QUALIFY count(*) OVER (PARTITION BY year, name) > 1
""")
def unique_violations(t):
    keyed, _ = c.reject_unkeyed(_unified(t))
    return integrity.unique_violations(keyed.select("seq", "name", "year"), ["year", "name"])


@query("orphan_rows", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
""")
def orphan_rows(t):
    """Lines whose order is not among the open ones."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return integrity.orphan_rows(lines, "l_orderkey", t.orders.filter("o_orderstatus <> 'F'"), "o_orderkey")


# Everything in the five tables, as (table, id, parent, other parent, text).
LOADED = f"""
WITH {i.OLYMPIAD},
p AS (SELECT problem_id AS id, year, name, seq FROM fresh),
tc AS (SELECT row_number() OVER (ORDER BY problem_id, c.name) AS id, problem_id, c.name, input, output, c.seq
       FROM record_cases c JOIN fresh f ON c.seq = f.seq),
st AS (SELECT row_number() OVER (ORDER BY problem_id, position) AS id, problem_id, k.name, score,
              time_limit, memory_limit, k.seq, position
       FROM record_tasks k JOIN fresh f ON k.seq = f.seq),
gf AS (SELECT row_number() OVER (ORDER BY problem_id, g.name) AS id, problem_id, g.name, content
       FROM record_files g JOIN fresh f ON g.seq = f.seq),
lk AS (SELECT row_number() OVER (ORDER BY st.id, r.case_position) AS id, st.id AS sub_task_id, tc.id AS test_case_id
       FROM record_refs r JOIN st ON r.seq = st.seq AND r.position = st.position
       JOIN tc ON tc.seq = r.seq AND tc.name = r.case_name)
"""
_ALL_ROWS = """
SELECT 'problems' AS table_name, id, CAST(year AS BIGINT) AS parent, CAST(NULL AS BIGINT) AS other, name AS content FROM p
UNION ALL SELECT 'test_cases', id, problem_id, NULL, name || ' ' || input || ' ' || output FROM tc
UNION ALL SELECT 'sub_tasks', id, problem_id, CAST(score AS BIGINT), name || ' ' || CAST(CAST(round(time_limit * 1000000000) AS BIGINT) AS VARCHAR) FROM st
UNION ALL SELECT 'sub_task_test_cases', id, sub_task_id, test_case_id, '' FROM lk
UNION ALL SELECT 'grader_files', id, problem_id, NULL, name || ' ' || content FROM gf
"""


def _all_rows(tables):
    def rows(name, parent, other, content):
        return tables[name].select(
            F.lit(name).alias("table_name"), "id", parent.cast("bigint").alias("parent"),
            other.cast("bigint").alias("other"), content.alias("content"),
        )

    none = F.lit(None)
    nanos = F.round(F.col("time_limit") * 1000000000).cast("bigint").cast("string")
    space = F.lit(" ")
    return (
        rows("problems", F.col("year"), none, F.col("name"))
        .unionByName(rows("test_cases", F.col("problem_id"), none, F.concat("name", space, "input", space, "output")))
        .unionByName(rows("sub_tasks", F.col("problem_id"), F.col("score"), F.concat("name", space, nanos)))
        .unionByName(rows("sub_task_test_cases", F.col("sub_task_id"), F.col("test_case_id"), F.lit("")))
        .unionByName(rows("grader_files", F.col("problem_id"), none, F.concat("name", space, "content")))
    )


@query("load_catalog", LOADED + _ALL_ROWS)
def load_catalog(t):
    return _all_rows(load_job(i.olympiad_records(t)).tables)


@query("load_catalog_jsonl", LOADED + _ALL_ROWS)
def load_catalog_jsonl(t):
    """The same records, written as compressed JSON lines and read back."""
    path = i.as_json_lines(i.olympiad_records(t), "olympiad", "gzip")
    good, _ = read_olympiad(t.spark, [path])
    return _all_rows(load_job(good).tables)


def _stored(t):
    path = scratch_path(t.spark, "catalog")
    write_tables(load_job(i.olympiad_records(t)).tables, path, drop=True)
    return read_catalog(t.spark, path, TABLES)


@query("write_catalog", LOADED + f"""
SELECT table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(id) AS BIGINT) AS id_sum,
       CAST(sum(strlen(content)) AS BIGINT) AS content_bytes
FROM ({_ALL_ROWS}) GROUP BY table_name
""")
def write_catalog(t):
    return _all_rows(_stored(t)).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"),
        F.sum(F.octet_length("content")).alias("content_bytes"),
    )


@query("catalog_integrity", LOADED + """
SELECT 'unique sub_task_test_cases' AS check_name, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT * FROM lk QUALIFY count(*) OVER (PARTITION BY sub_task_id, test_case_id) > 1)
UNION ALL SELECT 'unique problem name', count(*) FROM (
  SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY name) > 1)
UNION ALL SELECT 'orphan test_cases', 0
""")
def catalog_integrity(t):
    """Declared keys hold after a load; names alone and links may repeat. Keys hold no texts."""
    tables = load_job(i.olympiad_records(t), texts=False).tables

    def counted(name, rows):
        return rows.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n_rows"))

    return (
        counted("unique sub_task_test_cases", integrity.unique_violations(
            tables["sub_task_test_cases"], ["sub_task_id", "test_case_id"]))
        .unionByName(counted("unique problem name", integrity.unique_violations(tables["problems"], ["name"])))
        .unionByName(counted("orphan test_cases", integrity.orphan_rows(
            tables["test_cases"], "problem_id", tables["problems"])))
    )


# --- lookups: the catalogue has one problem per (name, year) of the orders ---

def _catalog_problems(t):
    """First order of each (customer, year): its key is the id."""
    return t.orders.groupBy(
        F.concat(F.lit("p"), F.col("o_custkey")).alias("name"), F.year("o_orderdate").alias("year")
    ).agg(F.min("o_orderkey").alias("id"))


def _requests(t):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_id") % 4
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.when(kind == 0, F.col("event_id") * 2).alias("problem_id"),
        F.when(kind.isin(1, 2), F.concat(F.lit("p"), F.col("user_id") * (1 + k % 13))).alias("name"),
        F.when(kind == 1, 1992 + k % 10).alias("year"),
        F.concat(F.lit("c"), k % 5).alias("test_case"),
    )


RESOLVED = """
problems AS (SELECT 'p' || o_custkey AS name, CAST(year(o_orderdate) AS INTEGER) AS year, min(o_orderkey) AS id
             FROM orders GROUP BY ALL),
requests AS (
  SELECT event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN nullif(event_id * 2, 0) END AS problem_id,
         CASE WHEN event_id % 4 IN (1, 2) THEN 'p' || (user_id * (1 + k % 13)) END AS name,
         CASE WHEN event_id % 4 = 1 THEN 1992 + k % 10 END AS year, 'c' || (k % 5) AS test_case
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
by_name AS (SELECT name, min(id) AS id, count(*) AS n, list_sort(list(year)) AS years FROM problems GROUP BY name),
resolved AS (
  SELECT r.*, CASE WHEN r.problem_id IS NOT NULL THEN i.id WHEN r.year IS NOT NULL THEN y.id
                   WHEN n.n = 1 THEN n.id END AS resolved_id,
    CASE WHEN r.problem_id IS NOT NULL THEN CASE WHEN i.id IS NULL THEN 'problem id not found' ELSE 'ok' END
         WHEN r.name IS NULL THEN 'missing problem id or name'
         WHEN r.year IS NOT NULL THEN CASE WHEN y.id IS NULL THEN 'problem not found in year' ELSE 'ok' END
         WHEN n.n IS NULL THEN 'problem not found' WHEN n.n > 1 THEN 'problem exists in multiple years'
         ELSE 'ok' END AS status,
    CASE WHEN r.problem_id IS NULL AND r.year IS NULL AND n.n > 1 THEN array_to_string(n.years, ',') END AS years
  FROM requests r LEFT JOIN problems i ON r.problem_id = i.id
  LEFT JOIN problems y ON r.name = y.name AND r.year = y.year LEFT JOIN by_name n ON r.name = n.name)
"""


@query("resolve_problems", f"WITH {RESOLVED} SELECT request_id, resolved_id, status, years FROM resolved")
def resolve_problems(t):
    return lookup.resolve_problems(_requests(t), _catalog_problems(t)).select(
        "request_id", "resolved_id", "status", F.array_join(F.col("years").cast("array<string>"), ",").alias("years")
    )


@query("fetch_cases", f"""
WITH {i.OLYMPIAD}, {RESOLVED}
SELECT r.request_id, r.resolved_id, r.test_case, c.input, c.output,
       CASE WHEN r.status <> 'ok' THEN r.status WHEN c.name IS NULL THEN 'test case not found' ELSE 'ok' END AS status
FROM resolved r LEFT JOIN record_cases c ON c.seq = r.resolved_id AND c.name = r.test_case
""")
def fetch_cases(t):
    resolved = lookup.resolve_problems(_requests(t), _catalog_problems(t))
    cases = c.named_cases(_by_seq(t).drop("name"))
    return lookup.fetch_cases(resolved, cases).select(
        "request_id", "resolved_id", "test_case", "input", "output", "status"
    )


@query("fetch_stored_cases", f"""
WITH {i.OLYMPIAD}, {RESOLVED}
SELECT r.request_id, r.resolved_id, r.test_case, c.input, c.output,
       CASE WHEN r.status <> 'ok' THEN r.status WHEN c.name IS NULL THEN 'test case not found' ELSE 'ok' END AS status
FROM resolved r LEFT JOIN record_cases c ON c.seq = r.resolved_id AND c.name = r.test_case
""")
def fetch_stored_cases(t):
    """The same from a stored catalogue whose cases are bucketed: their texts are not shuffled."""
    path = scratch_path(t.spark, "bucketed")
    cases = c.named_cases(_by_seq(t).drop("name"))
    write_tables({"problems": _catalog_problems(t), "test_cases": cases}, path, buckets=16)
    stored = read_catalog(t.spark, path, ["problems", "test_cases"])
    resolved = lookup.resolve_problems(_requests(t), stored["problems"])
    return lookup.fetch_cases(resolved, stored["test_cases"]).select(
        "request_id", "resolved_id", "test_case", "input", "output", "status"
    )


@query("fetch_files", f"""
WITH {i.OLYMPIAD}, {RESOLVED}
SELECT r.request_id, r.resolved_id, f.name AS file_name,
       CASE WHEN f.name <> 'a/b.txt' THEN f.content END AS content,
       CASE WHEN r.status <> 'ok' THEN r.status WHEN f.name IS NULL THEN 'no grader files'
            WHEN f.name = 'a/b.txt' THEN 'unsafe file name' ELSE 'ok' END AS status
FROM resolved r LEFT JOIN record_files f ON f.seq = r.resolved_id
""")
def fetch_files(t):
    resolved = lookup.resolve_problems(_requests(t), _catalog_problems(t))
    files = c.grader_files(_by_seq(t).drop("name")).withColumn("id", F.col("problem_id"))
    return lookup.fetch_files(resolved, files).select(
        "request_id", "resolved_id", "file_name", "content", "status"
    )


@query("adapt_file_columns", """
SELECT doc_id AS id, CAST(substr(source, 4, 10) AS BIGINT) AS problem_id, lang || '-' || doc_id AS name, md5(text) AS content
FROM documents
""")
def adapt_file_columns(t):
    files = t.documents.select(
        F.col("doc_id").alias("ID"), F.substring("source", 4, 10).cast("bigint").alias("problem_id"),
        F.concat("lang", F.lit("-"), "doc_id").alias("FileName"), F.col("text").alias("Body"),
        F.lit("unused").alias("source"),
    )
    return lookup.adapt_file_columns(files).withColumn("content", F.md5("content")).withColumnRenamed("ID", "id")

"""Record files: order, line numbers, rejects, round trips."""

import json
import pathlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from gavel.session import scratch_path
from gavel.sources import catalog_store, jobs, jsonl

SCHEMA = jsonl.RecordSchema(
    T.StructType(
        [
            T.StructField("contestId", T.IntegerType()),
            T.StructField("index", T.StringType()),
            T.StructField("year", T.StringType()),
            T.StructField("time-limit", T.StringType()),
        ]
    ),
    lenient_ints=["year"],
    lenient_texts=["time-limit"],
)

LINES = [
    '{"contestId": 1, "index": "A", "year": "2024", "time-limit": "2 s"}',
    "",
    '{"contestId": 2, "index": "B", "year": 2024.0, "time-limit": 2.5}',
    "not json",
    "   \t",
    '{"contestId": 0, "index": "C", "year": null, "time-limit": null}',
    '{"contestId": 3, "index": "", "time-limit": [1, 2]}',
    '{"contestId": "4", "index": "D"}',
    '{"contestId": 5, "index": "E", "year": 1.5}',
]


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_rows_and_rejects(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", LINES)
    good, bad = jsonl.read_jsonl(spark, [path], SCHEMA, line_numbers=True)
    got = [(r.line_no, r.contestId, r["index"], r.year, r["time-limit"]) for r in good.orderBy("seq").collect()]
    assert got == [
        (1, 1, "A", 2024, "2 s"), (3, 2, "B", 2024, "2.5"), (6, 0, "C", 0, ""), (7, 3, "", 0, "[1,2]"),
    ]
    assert [(r.line_no, r.reason) for r in bad.orderBy("seq").collect()] == [
        (4, "invalid JSON"), (8, "invalid JSON"), (9, "field year is not an integer"),
    ]
    assert {r.path for r in bad.collect()} == {path}


def test_fail_on_error(spark, tmp_path):
    good, _ = jsonl.read_jsonl(spark, [write(tmp_path, "a.jsonl", LINES)], SCHEMA, on_error="fail")
    with pytest.raises(PySparkException, match="invalid JSON"):
        good.collect()


def test_import_summary(spark, tmp_path):
    paths = [write(tmp_path, "a.jsonl", LINES), write(tmp_path, "b.jsonl", LINES[:3])]
    skipped = (F.col("record.contestId") == 0) | (F.col("record.index") == "")
    got = {
        r.path: (r.lines, r.blank, r.skipped, r.loaded, r.rejected)
        for r in jsonl.import_summary(jsonl.scan_jsonl(spark, paths, SCHEMA), skipped).collect()
    }
    assert got == {paths[0]: (9, 2, 2, 2, 3), paths[1]: (3, 1, 0, 2, 0), None: (12, 3, 2, 4, 3)}


def test_line_numbers_across_splits_and_paths(spark, tmp_path):
    schema = jsonl.RecordSchema(T.StructType([T.StructField("n", T.IntegerType())]))
    small = write(tmp_path, "small.jsonl", [json.dumps({"n": -i}) for i in range(1, 4)])
    big = write(tmp_path, "big.jsonl", [json.dumps({"n": i}) if i % 3 else "" for i in range(1, 4001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows, _ = jsonl.read_jsonl(spark, [small, big], schema, line_numbers=True)
        assert rows.rdd.getNumPartitions() > 4
        got = [(r.line_no, r.n) for r in rows.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(1, -1), (2, -2), (3, -3)] + [(i, i) for i in range(1, 4001) if i % 3]


def test_each_line_is_parsed_once(spark, tmp_path):
    good, _ = jsonl.read_jsonl(spark, [write(tmp_path, "a.jsonl", LINES)], SCHEMA)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_write_jsonl_keeps_nulls_and_escapes(spark, rows, tmp_path):
    one = rows("id int, text string, note string", (1, "é", None))
    two = rows("id int, text string", (2, "日本"))
    out = str(tmp_path / "out")
    jsonl.write_jsonl({"train": one, "test": two}, out)
    raw = "".join(p.read_text("ascii") for p in sorted(pathlib.Path(out).glob("part-*")))
    parsed = sorted((json.loads(line) for line in raw.splitlines()), key=lambda r: r["id"])
    assert parsed == [{"id": 1, "text": "é", "note": None}, {"id": 2, "text": "日本", "note": None}]
    assert "\\u" in raw


def test_write_catalog_appends_and_replaces(spark, rows, tmp_path):
    path = str(tmp_path / "catalog")
    table = {"problems": rows("id long, year int, name string", (1, 2024, "a"))}
    more = {"problems": rows("id long, year int, name string", (2, 2024, "b"))}
    catalog_store.write_catalog(table, path)
    catalog_store.write_catalog(more, path)
    read = lambda: sorted(r.name for r in catalog_store.read_catalog(spark, path, ["problems"])["problems"].collect())
    assert read() == ["a", "b"]
    catalog_store.write_catalog(more, path, drop=True)
    assert read() == ["b"]


def test_jobs(rows):
    lines = rows(
        "queue string, line string",
        (" gcc ", '{"id": "1", "callback_url": " http://c ", "binary": "aGk=", "args": ["-x"]}'),
        ("gcc", '{"id": "2", "callback_url": "http://c", "binary": ""}'),
        ("gcc", '{"id": "3", "callback_url": " ", "binary": "aGk="}'),
        ("", '{"id": "4", "callback_url": "http://c", "binary": "aGk="}'),
        ("gcc", '{"id": "5"'),
        ("gcc", '{"id": "6", "callback_url": "http://c", "binary": "???"}'),
    )
    good, bad = jobs.read_jobs(lines)
    (job,) = good.collect()
    assert (job.queue, job.id, job.callback_url, bytes(job.binary), job.args) == ("gcc", "1", "http://c", b"hi", ["-x"])
    assert sorted(r.reason for r in bad.collect()) == [
        "decode job payload: binary is not base64", "decode job payload: invalid JSON",
        "job binary is empty", "missing callback URL", "queue name is required",
    ]


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")

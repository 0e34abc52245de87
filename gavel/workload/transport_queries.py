"""Record files, job payloads, and requests matched to responses in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from gavel.operators import ordering, planning, transport
from gavel.session import materialized, scratch_path
from gavel.sources import jsonl
from gavel.sources.jobs import read_jobs as parse_jobs
from gavel.streaming.depth import depth_writer
from gavel.streaming.matching import first_response_stream, match_writer, transport_events
from gavel.workload import inputs as i
from gavel.workload.registry import query

# --- record files ---

NOTES = jsonl.RecordSchema(
    T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("k", T.StringType()),
            T.StructField("note", T.StringType()),
        ]
    ),
    lenient_ints=["k"],
    lenient_texts=["note"],
)


def _record_lines(t) -> DataFrame:
    """One line per event: some blank, some broken, ``k`` in every form a lenient int takes."""
    event, k = F.col("event_id"), F.get_json_object("props", "$.k")
    number = (
        F.when(event % 7 == 0, i.text('"', k, '"')).when(event % 7 == 1, i.text(k, ".0"))
        .when(event % 7 == 2, "null").when(event % 7 == 3, '""').when(event % 7 == 4, i.text(k, ".5"))
        .otherwise(k)
    )
    note = F.when(event % 3 == 0, i.text('"', F.col("event_type"), 'é"')).when(event % 3 == 1, "null").otherwise(k)
    line = (
        F.when(event % 50 == 0, F.when(event % 100 == 0, "").otherwise("   "))
        .when(event % 47 == 0, i.text('{"event_id": ', event, ', "k"'))
        .otherwise(i.text('{"event_id": ', event, ', "k": ', number, ', "note": ', note, "}"))
    )
    return t.events.select("event_id", line.alias("value"))


RECORD_LINES = """
lines AS (
  SELECT event_id, event_id % 50 = 0 AS blank, event_id % 47 = 0 AS broken, event_id % 7 = 4 AS bad_int, event_id % 2 AS part,
         CASE WHEN event_id % 7 IN (2, 3) THEN 0 ELSE k END AS k,
         CASE event_id % 3 WHEN 0 THEN event_type || 'é' WHEN 1 THEN '' ELSE CAST(k AS VARCHAR) END AS note
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
"""


def _record_paths(t) -> list[str]:
    """Even events in one folder, odd ones in another, each in event order."""
    lines = _record_lines(t)
    paths = []
    for part in (0, 1):
        path = scratch_path(t.spark, f"records-{part}")
        chosen = lines.filter(F.col("event_id") % 2 == part)
        chosen.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
        paths.append(path)
    return paths


@query("read_jsonl", f"""
WITH {RECORD_LINES}
SELECT event_id, k, note, row_number() OVER (ORDER BY part, event_id) AS position
FROM lines WHERE NOT blank AND NOT broken AND NOT bad_int
""")
def read_jsonl(t):
    rows, _ = jsonl.read_jsonl(t.spark, _record_paths(t), NOTES)
    return ordering.row_numbers(rows.select("seq", "event_id", "k", "note"), ["seq"], "position").drop("seq")


@query("read_jsonl_rejects", f"""
WITH {RECORD_LINES},
numbered AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id) AS line_no FROM lines)
SELECT part, line_no, CASE WHEN broken THEN 'invalid JSON' ELSE 'field k is not an integer' END AS reason
FROM numbered WHERE NOT blank AND (broken OR bad_int)
""")
def read_jsonl_rejects(t):
    """Line numbers of rejects, which need each folder written as one file per task and counted."""
    paths = _record_paths(t)
    _, rejects = jsonl.read_jsonl(t.spark, paths, NOTES, line_numbers=True)
    lines = jsonl.with_line_numbers(jsonl.text_lines(t.spark, paths))
    # A folder may hold many files: number on through them by the line counts of earlier ones.
    per_file = lines.groupBy("seq.path_rank", "seq.file").agg(F.max("line_no").alias("rows"))
    counted = ordering.running_totals(per_file, ["file"], {"before": F.col("rows")}, keys=["path_rank"])
    offsets = counted.select("file", "before")
    return (
        rejects.withColumn("file", F.col("seq.file"))
        .join(offsets, "file")
        .select(
            F.col("seq.path_rank").cast("bigint").alias("part"),
            (F.col("line_no") + F.col("before")).alias("line_no"),
            "reason",
        )
    )


@query("import_summary", f"""
WITH {RECORD_LINES}
SELECT CAST(part AS VARCHAR) AS part, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (blank) AS BIGINT) AS blank,
  CAST(count(*) FILTER (NOT blank AND NOT broken AND NOT bad_int AND k = 0) AS BIGINT) AS skipped,
  CAST(count(*) FILTER (NOT blank AND NOT broken AND NOT bad_int AND k <> 0) AS BIGINT) AS loaded,
  CAST(count(*) FILTER (NOT blank AND (broken OR bad_int)) AS BIGINT) AS rejected
FROM lines GROUP BY ROLLUP (part)
""")
def import_summary(t):
    scanned = jsonl.scan_jsonl(t.spark, _record_paths(t), NOTES)
    summary = jsonl.import_summary(scanned, F.col("record.k") == 0)
    part = F.nullif(F.regexp_extract("path", r"records-(\d)-[0-9a-f]+$", 1), F.lit(""))
    return summary.withColumn("path", part).withColumnRenamed("path", "part")


@query("write_jsonl", """
SELECT doc_id, md5(text) AS text, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents
""")
def write_jsonl(t):
    """Documents written as two splits, one without ``source``, and read back."""
    even = t.documents.filter("doc_id % 2 = 0").select("doc_id", "text", "lang", "source")
    odd = t.documents.filter("doc_id % 2 = 1").select("doc_id", "text", "lang")
    path = scratch_path(t.spark, "splits")
    jsonl.write_jsonl({"train": even, "test": odd}, path)
    rows, _ = jsonl.read_jsonl(t.spark, [path], jsonl.RecordSchema(even.schema))
    return rows.select("doc_id", F.md5("text").alias("text"), "lang", "source")


# --- job payloads ---

def _job_lines(t) -> DataFrame:
    event, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    binary = F.when(k % 10 == 0, "").when(k % 10 == 3, "***").otherwise(F.base64(F.col("props").cast("binary")))
    callback = F.when(k % 10 == 2, "  ").otherwise(i.text(" http://cb/", event, " "))
    payload = F.to_json(
        F.struct(
            event.cast("string").alias("id"), callback.alias("callback_url"), binary.alias("binary"),
            F.array(F.col("event_type")).alias("args"),
        )
    )
    line = F.when(k % 10 == 4, " ").when(k % 10 == 1, '{"id": "truncated').otherwise(payload)
    return t.events.select(event, i.text(" ", F.col("event_type"), " ").alias("queue"), line.alias("line"))


@query("read_jobs", """
SELECT event_id, event_type AS queue, CASE WHEN k % 10 NOT IN (0, 1, 2, 3, 4) THEN 'http://cb/' || event_id END AS callback_url,
  CASE WHEN k % 10 NOT IN (0, 1, 2, 3, 4) THEN CAST(strlen(props) AS INTEGER) END AS binary_bytes,
  CASE k % 10 WHEN 0 THEN 'job binary is empty' WHEN 1 THEN 'decode job payload: invalid JSON' WHEN 2 THEN 'missing callback URL'
    WHEN 3 THEN 'decode job payload: binary is not base64' WHEN 4 THEN 'decode job payload: blank' END AS reason
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def read_jobs(t):
    jobs, rejects = parse_jobs(_job_lines(t))
    good = jobs.select(
        "event_id", "queue", "callback_url", F.octet_length("binary").alias("binary_bytes"),
        F.lit(None).cast("string").alias("reason"),
    )
    bad = rejects.select(
        "event_id", "queue", F.lit(None).cast("string").alias("callback_url"),
        F.lit(None).cast("int").alias("binary_bytes"), "reason",
    )
    return good.unionByName(bad)


# --- callbacks and results ---

@query("validate_callbacks", """
SELECT event_id, CASE WHEN k % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS id,
  CASE WHEN k % 7 = 0 THEN 'missing job id' WHEN k % 7 = 1 THEN 'invalid payload' WHEN k % 7 = 2 THEN 'job id mismatch' END AS reason
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def validate_callbacks(t):
    k = F.get_json_object("props", "$.k").cast("int")
    calls = t.events.select(
        "event_id",
        F.when(k % 7 == 0, "  ").otherwise(i.text(" ", F.col("event_id"))).alias("path_id"),
        F.when(k % 7 == 2, "other").when(k % 7 == 3, F.col("event_id").cast("string")).alias("payload_id"),
        (k % 7 == 1).alias("bad_payload"),
    )
    good, rejects = transport.validate_callbacks(calls)
    return good.withColumn("reason", F.lit(None).cast("string")).select("event_id", "id", "reason").unionByName(
        rejects.select("event_id", "id", "reason")
    )


@query("response_outcome", """
SELECT event_id, CASE WHEN k % 5 = 0 THEN 'failed' WHEN k % 5 = 1 THEN 'empty response' ELSE 'ok' END AS status,
  CASE WHEN k % 5 = 0 THEN 'worker: ' || event_type END AS error,
  CASE WHEN k % 5 > 1 THEN CASE WHEN k % 5 = 2 THEN 4294967295 ELSE k END END AS exit_code
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
""")
def response_outcome(t):
    k = F.get_json_object("props", "$.k").cast("int")
    files = F.array().cast("array<struct<filename:string,content:binary>>")
    result = F.struct(
        F.lit(b"out").alias("stdout"), F.lit(b"").alias("stderr"),
        F.when(k % 5 == 2, -1).otherwise(k).alias("exit_code"), files.alias("files"),
    )
    answers = t.events.select(
        "event_id",
        F.struct(
            F.when(k % 5 == 0, i.text("worker: ", F.col("event_type"))).otherwise("").alias("error"),
            F.when(k % 5 != 1, result).alias("result"),
        ).alias("exec"),
    )
    return transport.response_outcome(answers).select("event_id", "status", "error", "exit_code")


def _batched(t):
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return materialized(planning.batch_requests(rows, ["event_id"]))


def _results(batched):
    k, pos = F.col("k"), F.col("batch_pos")
    raw = (
        F.when(k % 10 == 1, "").when(k % 10 == 2, i.text("x", pos)).when(k % 10 == 4, i.text(" +", pos, " "))
        .when(k % 10 == 6, (pos + 1000).cast("string")).otherwise(pos.cast("string"))
    )
    copies = F.explode(F.when(k % 10 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return batched.filter(k % 10 != 0).select(
        "batch", raw.alias("id"), F.when(k % 10 == 3, "boom").alias("error"),
        F.when(~k.isin(33, 77), i.text("r", F.col("event_id"))).alias("result"), "event_id", copies,
    ).withColumn("seq", F.col("event_id") * 2 + F.col("copy")).drop("copy", "event_id")


DEMUX = """
batched AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
                   (row_number() OVER (ORDER BY event_id) - 1) // 200 AS batch, (row_number() OVER (ORDER BY event_id) - 1) % 200 AS pos FROM events),
demuxed AS (
  SELECT batch, pos AS id, CASE WHEN k % 10 IN (0, 1, 2, 6) THEN NULL ELSE event_id * 2 END AS seq,
    CASE WHEN k % 10 IN (0, 1, 2, 6) THEN 'no result' WHEN k % 10 = 3 THEN 'error' WHEN k IN (33, 77) THEN 'empty response' ELSE 'ok' END AS status,
    CASE WHEN k % 10 = 3 THEN 'boom' END AS error,
    CASE WHEN k % 10 NOT IN (0, 1, 2, 6) AND k NOT IN (33, 77) THEN 'r' || event_id END AS result FROM batched
  UNION ALL SELECT batch, NULL, event_id * 2, CASE WHEN k % 10 = 1 THEN 'missing id' ELSE 'invalid request id' END, NULL, NULL
  FROM batched WHERE k % 10 IN (1, 2)
  UNION ALL SELECT batch, pos + 1000, event_id * 2, 'unknown request id', NULL, 'r' || event_id FROM batched WHERE k % 10 = 6
  UNION ALL SELECT batch, pos, event_id * 2 + 1, 'duplicate result', NULL, 'r' || event_id FROM batched WHERE k % 10 = 5)
"""


@query("demux_results", f"WITH {DEMUX} SELECT batch, id, seq, status, error, result FROM demuxed")
def demux_results(t):
    batched = _batched(t)
    asked = batched.select("batch", F.col("batch_pos").alias("id"))
    return transport.demux_results(asked, _results(batched))


@query("batch_count_mismatches", f"""
WITH {DEMUX}
SELECT batch, CAST(count(*) AS BIGINT) AS n_requests, CAST(sum(CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 5 THEN 2 ELSE 1 END) AS BIGINT) AS n_results
FROM batched GROUP BY batch HAVING n_requests <> n_results
""")
def batch_count_mismatches(t):
    batched = _batched(t)
    asked = batched.select("batch", F.col("batch_pos").alias("id"))
    return transport.batch_count_mismatches(asked, _results(batched))


# --- matching ---

def _matched(t):
    return transport.match_responses(i.requests(t), i.responses(t), i.TTL_SECONDS)


_MATCH_SQL = f"""
WITH {i.TRANSPORT}
SELECT id, epoch_us(request_ts) AS request_us, epoch_us(response_ts) AS response_us, response_seq, how AS outcome FROM matched
"""


def _micros(df):
    return df.select(
        "id", F.unix_micros("request_ts").alias("request_us"), F.unix_micros("response_ts").alias("response_us"),
        "response_seq", F.col("how").alias("outcome"),
    )


@query("match_responses", _MATCH_SQL)
def match_responses(t):
    return _micros(_matched(t))


@query("first_response", f"""
WITH {i.TRANSPORT}
SELECT id, seq, epoch_us(response_ts) AS response_us FROM responses
QUALIFY row_number() OVER (PARTITION BY id ORDER BY response_ts, seq) = 1
""")
def first_response(t):
    return transport.first_response(i.responses(t)).select(
        "id", "seq", F.unix_micros("response_ts").alias("response_us")
    )


FATES = f"""
{i.TRANSPORT},
phased AS (SELECT r.*, q.request_ts, coalesce(r.response_ts > q.request_ts, false) AS later
           FROM responses r LEFT JOIN requests q ON r.id = q.id),
followed AS (SELECT *, lead(response_ts) OVER (PARTITION BY id, later ORDER BY response_ts, seq) AS next_ts FROM phased),
fates AS (
  SELECT *, CASE WHEN next_ts <= response_ts + INTERVAL {i.TTL_SECONDS} SECOND THEN 'overwritten' ELSE 'expired' END AS fate
  FROM followed WHERE seq NOT IN (SELECT seq FROM taken))
"""


@query("expired_responses", f"WITH {FATES} SELECT seq, id, fate FROM fates")
def expired_responses(t):
    return transport.expired_responses(i.requests(t), i.responses(t), i.TTL_SECONDS).select("seq", "id", "fate")


_PENDING_SQL = f"""
WITH {i.TRANSPORT},
changes AS (SELECT queue, id, request_ts AS ts, 1 AS change FROM matched
            UNION ALL SELECT queue, id, greatest(request_ts, response_ts), -1 FROM matched WHERE response_ts IS NOT NULL)
SELECT queue, id, epoch_us(ts) AS us, change, CAST(sum(change) OVER (PARTITION BY queue ORDER BY ts, change DESC, id
       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pending FROM changes
"""


@query("pending_jobs", _PENDING_SQL)
def pending_jobs(t):
    return transport.pending_jobs(_matched(t)).select(
        "queue", "id", F.unix_micros("ts").alias("us"), "change", "pending"
    )


# --- matching where ids are asked for again ---

@query("match_repeated_requests", f"""
WITH RECURSIVE {i.in_turn(False)}
SELECT event_id, id, epoch_us(response_ts) AS response_us, response_seq, how AS outcome FROM matched
""")
def match_repeated_requests(t):
    matched = transport.match_responses(i.repeated_requests(t), _answers(t), i.TTL_SECONDS)
    return matched.select(
        "event_id", "id", F.unix_micros("response_ts").alias("response_us"), "response_seq", F.col("how").alias("outcome")
    )


@query("expired_repeated_responses", f"WITH RECURSIVE {i.in_turn(False)} SELECT seq, id, fate FROM fates")
def expired_repeated_responses(t):
    return transport.expired_responses(i.repeated_requests(t), _answers(t), i.TTL_SECONDS).select("seq", "id", "fate")


# --- streams: the same tables, replayed ---

def _answers(t) -> DataFrame:
    return i.responses(t).select("id", "response_ts", "seq")


def _live(t, depth: bool = False) -> str:
    """Match the events as they come in four parts, some late; one far ahead in the last ends the wait.

    Every part is a trigger of its own, as each run takes what is new and ends.
    """
    spark, source, folder = t.spark, scratch_path(t.spark, "live"), scratch_path(t.spark, "matched")
    part_of = i.event_parts(t)
    asked = i.repeated_requests(t).withColumn("part", part_of("event_id", "request_ts"))
    answered = _answers(t).withColumn("part", part_of("seq", "response_ts"))
    events = lambda part: transport_events(
        asked.filter(F.col("part") == part), answered.filter(F.col("part") == part), i.MAX_WAIT_DAYS * 86_400.0
    )
    last = t.events.select(
        F.lit("end").alias("id"), (F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 200 DAYS")).alias("request_ts")
    )
    inputs = [events(part) for part in range(4)]
    inputs[3] = inputs[3].unionByName(transport_events(last, _answers(t).limit(0)))
    progress = scratch_path(spark, "matched-progress")
    writer = match_writer(folder, i.TTL_SECONDS, i.DELAY_SECONDS, depth_writer(f"{folder}/depth") if depth else None)
    for rows in inputs:
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run = stream.writeStream.foreachBatch(writer).option("checkpointLocation", progress).trigger(availableNow=True).start()
        run.awaitTermination()
    return folder


def _replay(stream: DataFrame, label: str, **options) -> str:
    """Run a stream over all its input and return where it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    run = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", scratch_path(spark, label + "-progress"))
        .option("path", path).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return path


def _stream_of(t, batch: DataFrame, label: str) -> DataFrame:
    path = scratch_path(t.spark, label)
    batch.write.parquet(path)
    return t.spark.readStream.schema(batch.schema).parquet(path)


@query("match_responses_stream", f"""
WITH RECURSIVE {i.in_turn(True)}
SELECT id, epoch_us(request_ts) AS request_us, epoch_us(response_ts) AS response_us, response_seq, coalesce(how, 'unanswered') AS outcome
FROM matched
""")
def match_responses_stream(t):
    found = t.spark.read.parquet(f"{_live(t)}/outcomes").filter("request_ts IS NOT NULL")
    return found.select(
        "id", F.unix_micros("request_ts").alias("request_us"), F.unix_micros("response_ts").alias("response_us"),
        "response_seq", "outcome",
    )


@query("expired_responses_stream", f"WITH RECURSIVE {i.in_turn(True)} SELECT seq, id, fate FROM fates")
def expired_responses_stream(t):
    found = t.spark.read.parquet(f"{_live(t)}/outcomes").filter("request_ts IS NULL")
    return found.select(F.col("response_seq").alias("seq"), "id", F.col("outcome").alias("fate"))


@query("late_events_stream", f"""
WITH RECURSIVE {i.in_turn(True)}
SELECT id, epoch_us(ts) AS us, event_type IN ('view', 'signup') AS is_request FROM keyed_events WHERE late
""")
def late_events_stream(t):
    late = t.spark.read.parquet(f"{_live(t)}/late")
    return late.select("id", F.unix_micros("ts").alias("us"), "is_request")


@query("first_response_stream", f"""
WITH {i.TRANSPORT}
SELECT id, seq, epoch_us(response_ts) AS response_us FROM responses
QUALIFY row_number() OVER (PARTITION BY id ORDER BY response_ts, seq) = 1
""")
def first_response_stream_rows(t):
    """Deliveries in four triggers, each with events of all times; the last one ends the sessions."""
    spark, source, out = t.spark, scratch_path(t.spark, "deliveries"), scratch_path(t.spark, "first")
    answers = _answers(t)
    ahead = F.max("response_ts") + F.expr("INTERVAL 200 DAYS")
    last = answers.agg(F.lit("end").alias("id"), ahead.alias("response_ts"), F.lit(0).cast("bigint").alias("seq"))
    inputs = [answers.filter(F.col("seq") % 4 == part) for part in range(4)] + [last]
    progress = scratch_path(spark, "first-progress")
    for rows in inputs:
        rows.write.mode("append").parquet(source)
        stream = first_response_stream(spark.readStream.schema(answers.schema).parquet(source), within="90 days")
        run = (
            stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", progress).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out)
    return found.select("id", "seq", F.unix_micros("response_ts").alias("response_us"))


@query("pending_jobs_stream", f"""
WITH RECURSIVE {i.in_turn(True)},
asked AS (SELECT * FROM matched WHERE how IS DISTINCT FROM 'rejected'),
changes AS (SELECT queue, id, request_ts AS ts, 1 AS change FROM asked
            UNION ALL SELECT queue, id, greatest(request_ts, response_ts), -1 FROM asked WHERE response_ts IS NOT NULL)
SELECT queue, id, epoch_us(ts) AS us, change, CAST(sum(change) OVER (PARTITION BY queue ORDER BY ts, change DESC, id
       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pending FROM changes
""")
def pending_jobs_stream(t):
    """Depth from the live match: both keep state, in one query."""
    return t.spark.read.parquet(f"{_live(t, depth=True)}/depth/events").select(
        "queue", "id", F.unix_micros("ts").alias("us"), "change", "pending"
    )


@query("read_jobs_stream", """
SELECT event_id, event_type AS queue, CAST(strlen(props) AS INTEGER) AS binary_bytes
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WHERE k % 10 NOT IN (0, 1, 2, 3, 4)
""")
def read_jobs_stream(t):
    jobs, _ = parse_jobs(_stream_of(t, _job_lines(t), "jobs"))
    path = _replay(jobs.select("event_id", "queue", F.octet_length("binary").alias("binary_bytes")), "parsed")
    return t.spark.read.parquet(path)

"""Matching in batch and as a stream against a plain simulation of the store."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gavel.operators import transport
from gavel.session import scratch_path
from gavel.streaming.depth import depth_writer
from gavel.streaming.matching import first_response_stream, match_writer, transport_events

START = datetime.datetime(2024, 1, 1)
TTL = 300
REQUESTS = "id string, request_ts timestamp, deadline_ts timestamp, queue string"
RESPONSES = "id string, response_ts timestamp, seq long"


def at(second):
    return None if second is None else START + datetime.timedelta(seconds=second)


def simulate(requests, responses):
    """The store, one event at a time: matches by place of the request, fates by seq."""
    events = [(t, 1, n, i, deadline) for n, (i, t, deadline) in enumerate(requests)]
    events += [(t, 0, seq, i, None) for i, t, seq in responses]
    waiting, held, matches, fates = {}, {}, {}, {}

    def drop(i, now):
        t, seq = held.pop(i)
        fates[seq] = "overwritten" if now <= t + TTL else "expired"

    for t, is_request, number, i, deadline in sorted(events, key=lambda e: e[:3]):
        if i in waiting and waiting[i][1] is not None and t > waiting[i][1]:
            del waiting[i]
        if is_request:
            if i in waiting:
                matches[number] = (None, "rejected")
            elif i in held and t <= held[i][0] + TTL:
                matches[number] = (held.pop(i)[1], "waiting")
            else:
                if i in held:
                    drop(i, float("inf"))
                waiting[i] = (number, None if deadline is None else max(deadline, t))
        elif i in waiting:
            asked, end = waiting.pop(i)
            if requests[asked][2] is None or t <= requests[asked][2]:
                matches[asked] = (number, "arrived")
            else:
                held[i] = (t, number)
        else:
            if i in held:
                drop(i, t)
            held[i] = (t, number)
    for i in list(held):
        drop(i, float("inf"))
    return matches, fates


def hand_made():
    requests = [("before", 100, None), ("stale", 1000, None), ("after", 50, None), ("late", 0, 60), ("never", 5, None), ("same", 10, None),
                ("edge", 400, None)]
    responses = [
        ("before", 10, 1), ("before", 90, 2), ("before", 200, 3), ("before", 210, 4),
        ("stale", 1, 5), ("stale", 1100, 6), ("stale", 2000, 7), ("after", 60, 8), ("after", 60, 9),
        ("late", 61, 10), ("nobody", 0, 11), ("nobody", 300, 12), ("nobody", 601, 13), ("same", 10, 14), ("same", 11, 15), ("edge", 100, 16),
    ]
    return requests, responses


def random_case():
    draw = random.Random(3)
    requests = [(f"r{i}", draw.randrange(3000), draw.choice([None, None, 400]) ) for i in range(40)]
    requests = [(i, t, None if d is None else t + d) for i, t, d in requests]
    # Half of all copies belong to one id.
    responses = [
        (f"r{draw.randrange(50)}" if draw.random() < 0.5 else "r0", draw.randrange(4000), seq) for seq in range(600)
    ]
    return requests, responses


def asked_again():
    """Ids asked for many times, one of them by half of all requests, with and without deadlines."""
    draw = random.Random(8)
    requests = [(draw.choice(["r0", f"r{draw.randrange(40)}"]), draw.randrange(20_000), draw.choice([None, 50, 300, 1000])) for _ in range(300)]
    requests = [(i, t, None if d is None else t + d) for i, t, d in requests]
    requests += [("only", 5, 10), ("twice", 5, None), ("twice", 6, None), ("gone", 5, 9), ("gone", 9, 30), ("gone", 10, 30), ("past", 100, 50), ("past", 101, None)]
    responses = [(draw.choice(["r0", f"r{draw.randrange(40)}"]), draw.randrange(20_000), seq) for seq in range(250)]
    responses += [("gone", 20, 1001), ("past", 200, 1002), ("nobody", 7, 1003), ("nobody", 8, 1004)]
    # One event at a moment, so that the order needs no rule for ties.
    used, spaced = set(), []
    for i, t, d in requests:
        while (i, t) in used:
            t += 1
        used.add((i, t))
        spaced.append((i, t, d))
    return spaced, [(i, t, seq) for i, t, seq in responses if (i, t) not in used]


def frames(rows, requests, responses):
    asked = rows(REQUESTS, *[(i, at(t), at(d), str(n)) for n, (i, t, d) in enumerate(requests)])
    answers = rows(RESPONSES, *[(i, at(t), seq) for i, t, seq in responses])
    return asked, answers


@pytest.mark.parametrize("make", [hand_made, random_case, asked_again])
def test_batch_follows_the_store(rows, make):
    requests, responses = make()
    matches, fates = simulate(requests, responses)
    asked, answers = frames(rows, requests, responses)
    got = {int(r.queue): (r.response_seq, r.how) for r in transport.match_responses(asked, answers, TTL).collect()}
    assert got == {n: matches.get(n, (None, None)) for n in range(len(requests))}
    assert make is not asked_again or {how for _, how in got.values()} == {"waiting", "arrived", "rejected", None}
    found = {r.seq: r.fate for r in transport.expired_responses(asked, answers, TTL).collect()}
    assert found == fates


def replay(spark, df, column, label, batches):
    """Write ``df`` as files in time order, one after another, and stream one per trigger."""
    path = scratch_path(spark, label)
    data = df.orderBy(column).collect()
    size = -(-len(data) // batches)
    for start in range(0, len(data), size):
        part = spark.createDataFrame(data[start : start + size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def triggers(spark, parts, start):
    """Every part as a trigger of one stream, whose writer ``start`` sets up."""
    source, progress = scratch_path(spark, "parts"), scratch_path(spark, "progress")
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        start(stream).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def live(spark, rows, parts, delay, on_changes=None):
    """Outcomes of requests by queue, fates by seq and late events of parts (requests, responses)."""
    folder = scratch_path(spark, "live")
    parts[-1] = (parts[-1][0].unionByName(rows(REQUESTS, ("end", at(10**8), None, "-1"))), parts[-1][1])
    writer = match_writer(folder, TTL, delay, on_changes(folder) if on_changes else None)
    inputs = [transport_events(a, b, 10**7) for a, b in parts]
    triggers(spark, inputs, lambda stream: stream.writeStream.foreachBatch(writer))
    return [spark.read.parquet(f"{folder}/{name}").collect() for name in ("outcomes", "late")] + [folder]


@pytest.mark.parametrize("make", [hand_made, asked_again])
def test_stream_out_of_order_equals_batch(spark, rows, make):
    """Four triggers with events of all times: none is late, and the outcomes are those of the store."""
    requests, responses = make()
    matches, fates = simulate(requests, responses)
    asked, answers = frames(rows, requests, responses)
    quarter = F.pmod(F.xxhash64("id", F.col(answers.columns[1])), F.lit(4))
    parts = [
        (asked.filter(F.pmod(F.xxhash64("id", "request_ts"), F.lit(4)) == k), answers.filter(quarter == k)) for k in range(4)
    ]
    outcomes, late, _ = live(spark, rows, parts, 10**6)
    assert not late
    got = sorted((r.id, r.request_ts, r.response_seq, r.outcome) for r in outcomes if r.request_ts is not None)
    want = [(i, at(t), *matches.get(n, (None, "unanswered"))) for n, (i, t, _) in enumerate(requests)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r.response_seq: r.outcome for r in outcomes if r.request_ts is None} == fates


def test_late_events_come_out_and_the_rest_equals_batch(spark, rows):
    requests, responses = asked_again()
    events = sorted([(t, 1, n) for n, (_, t, _) in enumerate(requests)] + [(t, 0, n) for n, (_, t, _) in enumerate(responses)])
    size, delay = -(-len(events) // 4), 500
    chunks = [events[k : k + size] for k in range(0, len(events), size)]
    chunks[2] += chunks[0][5:12]  # far too late
    chunks[0] = chunks[0][:5] + chunks[0][12:]
    swapped = chunks[1].pop(), chunks[2].pop(0)  # a little out of order, which is allowed
    chunks[1].append(swapped[1])
    chunks[2].append(swapped[0])
    dropped = set(map(tuple, events[5:12]))
    parts = []
    for chunk in chunks:
        asked = [requests[n] for _, kind, n in chunk if kind]
        parts.append(frames(rows, asked, [responses[n] for _, kind, n in chunk if not kind]))
    outcomes, late, _ = live(spark, rows, parts, delay)
    assert sorted((r.ts, r.is_request) for r in late) == sorted((at(t), kind == 1) for t, kind, _ in dropped)
    kept = [requests[n] for n in range(len(requests)) if (requests[n][1], 1, n) not in dropped]
    others = [responses[n] for n in range(len(responses)) if (responses[n][1], 0, n) not in dropped]
    matches, fates = simulate(kept, others)
    got = [(r.id, r.request_ts, r.response_seq, r.outcome) for r in outcomes if r.request_ts is not None]
    want = [(i, at(t), *matches.get(n, (None, "unanswered"))) for n, (i, t, _) in enumerate(kept)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r.response_seq: r.outcome for r in outcomes if r.request_ts is None} == fates


def test_a_replayed_trigger_counts_once(spark, rows):
    folder = scratch_path(spark, "again")
    write = match_writer(folder, TTL, 10)
    first = transport_events(*frames(rows, [("a", 100, None), ("b", 10, None)], [("a", 50, 1)]))
    second = transport_events(*frames(rows, [("c", 5000, None), (None, 5000, None)], [("b", 140, 4), ("b", 150, 5)]))
    lost = transport_events(*frames(rows, [("d", None, None)], []))
    for number, batch in [(0, first), (0, first), (1, second.unionByName(lost)), (1, second.unionByName(lost)), (2, first.limit(0))]:
        write(batch, number)
    got = {(r.id, r.response_seq, r.outcome) for r in spark.read.parquet(f"{folder}/outcomes").collect()}
    assert got == {("a", 1, "waiting"), ("b", 4, "arrived"), ("b", 5, "expired")}
    assert [r.id for r in spark.read.parquet(f"{folder}/late").collect()] == ["d"]


def test_first_response(spark, rows):
    _, answers = frames(rows, [], [("a", 5, 1), ("a", 3, 2), ("a", 3, 3), ("b", 9, 4), ("a", 400, 7)])
    assert {r.id: r.seq for r in transport.first_response(answers).collect()} == {"a": 2, "b": 4}
    # The first copy comes in the second trigger.
    parts = [answers.filter("seq IN (1, 3, 7)"), answers.filter("seq IN (2, 4)"), rows(RESPONSES, ("end", at(10**6), 0))]
    out = scratch_path(spark, "first")
    triggers(
        spark, parts,
        lambda s: first_response_stream(s).writeStream.format("parquet").outputMode("append").option("path", out),
    )
    assert {(r.id, r.seq, r.response_ts) for r in spark.read.parquet(out).collect()} == {("a", 2, at(3)), ("b", 4, at(9))}


def test_depth_follows_the_live_match(spark, rows):
    requests, responses = asked_again()
    asked, answers = (df.withColumn("queue", F.lit("q")) if "queue" in df.columns else df for df in frames(rows, requests, responses))
    parts = [(asked.filter(F.pmod(F.xxhash64("id", "request_ts"), F.lit(2)) == k), answers.filter(F.col("seq") % 2 == k)) for k in range(2)]
    _, _, folder = live(spark, rows, parts, 10**6, lambda folder: depth_writer(f"{folder}/depth"))
    got = spark.read.parquet(f"{folder}/depth/events").filter("id <> 'end'").select("queue", "id", "ts", "change", "pending")
    want = transport.pending_jobs(transport.match_responses(asked, answers, TTL)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100


def test_pending_jobs_batch_and_stream(spark, rows):
    requests, responses = random_case()
    asked, answers = frames(rows, requests, responses)
    asked = asked.withColumn("queue", F.concat(F.lit("q"), F.col("queue").cast("int") % 2))
    matched = transport.match_responses(asked, answers, TTL)
    batch = {(r.queue, r.id, r.change): r.pending for r in transport.pending_jobs(matched).collect()}

    changes = sorted(
        [(r.queue, r.request_ts, -1, r.id) for r in matched.collect()]
        + [(r.queue, max(r.request_ts, r.response_ts), 1, r.id) for r in matched.collect() if r.response_ts]
    )
    depth, want = {}, {}
    for queue, _, step, i in changes:
        depth[queue] = depth.get(queue, 0) - step
        want[queue, i, -step] = depth[queue]
    assert batch == want

    frame = rows("queue string, id string, ts timestamp, change int", *[(q, i, ts, -step) for q, ts, step, i in changes])
    folder = scratch_path(spark, "depth")
    run = (
        replay(spark, frame, "ts", "changes", 3).writeStream.foreachBatch(depth_writer(folder))
        .option("checkpointLocation", scratch_path(spark, "depth-progress")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    streamed = spark.read.parquet(f"{folder}/events")
    assert streamed.count() == len(want)
    last = max(int(r.batch) for r in spark.read.parquet(f"{folder}/depth").select("batch").distinct().collect())
    assert last == 2
    final = {r.queue: r.depth for r in spark.read.parquet(f"{folder}/depth/batch={last}").collect()}
    assert final == depth


def test_callbacks(rows):
    df = rows(
        "n int, path_id string, payload_id string, bad_payload boolean",
        (1, " a ", "", False), (2, "a", "a", False), (3, "a", "b", False), (4, " ", "b", False), (5, "a", None, True), (6, "a", None, None),
    )
    good, bad = transport.validate_callbacks(df)
    assert {r.n: r.id for r in good.collect()} == {1: "a", 2: "a", 6: "a"}
    assert {r.n: r.reason for r in bad.collect()} == {3: "job id mismatch", 4: "missing job id", 5: "invalid payload"}


def test_outcomes(rows):
    result = "struct<stdout:binary,stderr:binary,exit_code:int,files:array<struct<filename:string,content:binary>>>"
    answer = (b"o", b"e", -1, [("f", b"x")])
    df = rows(
        f"id int, exec struct<error:string,result:{result}>",
        (1, ("boom", answer)), (2, ("", answer)), (3, (None, None)), (4, (None, (b"", b"", 3, []))),
    )
    got = {r.id: (r.status, r.error, r.exit_code, r.files) for r in transport.response_outcome(df).collect()}
    assert got == {
        1: ("failed", "boom", None, None), 2: ("ok", None, 4294967295, [("f", b"x")]), 3: ("empty response", None, None, None),
        4: ("ok", None, 3, []),
    }


def test_demux(rows):
    requests = rows("batch int, id int", (0, 0), (0, 1), (0, 2), (1, 0))
    results = rows(
        "batch int, id string, error string, result string, seq int",
        (0, "0", None, "a", 1), (0, " 1 ", "bad", "ignored", 2), (0, "", None, "x", 3), (0, "1.5", None, "x", 4),
        (1, "0", None, "b", 5), (1, "0", None, "c", 6), (1, "9", None, "d", 7), (1, None, "lost", None, 8),
    )
    got = {(r.batch, r.id, r.seq, r.status) for r in transport.demux_results(requests, results).collect()}
    assert got == {
        (0, 0, 1, "ok"), (0, 1, 2, "error"), (0, 2, None, "no result"), (0, None, 3, "missing id"), (0, None, 4, "invalid request id"),
        (1, 0, 5, "ok"), (1, 0, 6, "duplicate result"), (1, 9, 7, "unknown request id"), (1, None, 8, "missing id"),
    }
    counts = {r.batch: (r.n_requests, r.n_results) for r in transport.batch_count_mismatches(requests, results).collect()}
    assert counts == {0: (3, 4), 1: (1, 4)}

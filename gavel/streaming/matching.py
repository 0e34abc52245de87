"""Requests matched to responses while both are still arriving."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gavel.operators.transport import TTL_SECONDS, depth_changes, settled_rows
from gavel.session import materialized

DELAY_SECONDS = 60.0
#: How long a request without a deadline waits.
MAX_WAIT_SECONDS = 90 * 86_400.0

EVENTS = "id string, ts timestamp, is_request boolean, deadline_ts timestamp, queue string, number bigint"
_STATE = EVENTS + ", settled boolean, _number bigint"
_MARK = "watermark timestamp"


def transport_events(
    requests: DataFrame, responses: DataFrame, max_wait_seconds: float = MAX_WAIT_SECONDS
) -> DataFrame:
    """One stream (or table) of requests (``id, request_ts, deadline_ts?, queue?``) and responses
    (``id, response_ts, seq``). A request without a deadline is given up after ``max_wait_seconds``,
    so that nothing is kept for ever."""
    columns = requests.columns
    latest = F.col("request_ts") + F.make_dt_interval(secs=F.lit(max_wait_seconds))
    deadline = F.coalesce("deadline_ts", latest) if "deadline_ts" in columns else latest
    queue = F.col("queue") if "queue" in columns else F.lit(None).cast("string")
    return requests.select(
        "id", F.col("request_ts").alias("ts"), F.lit(True).alias("is_request"),
        deadline.alias("deadline_ts"), queue.alias("queue"), F.lit(None).cast("bigint").alias("number"),
    ).unionByName(
        responses.select(
            "id", F.col("response_ts").alias("ts"), F.lit(False).alias("is_request"),
            F.lit(None).cast("timestamp").alias("deadline_ts"), F.lit(None).cast("string").alias("queue"),
            F.col("seq").cast("bigint").alias("number"),
        )
    )


def match_writer(
    folder: str,
    ttl_seconds: float = TTL_SECONDS,
    delay_seconds: float = DELAY_SECONDS,
    on_changes: Callable[[DataFrame, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a stream of ``transport_events``.

    Every trigger settles the events older than the watermark, which is ``delay_seconds`` behind
    the newest event so far, by the batch operators. Their order is final, so the outcomes do not
    depend on how events fall into triggers: together they are what one batch over all events that
    were not late gives. Tables, one folder per batch number, overwritten on a retry:

    * ``outcomes``: ``id, request_ts, response_ts, response_seq, outcome``. A request ends as
      ``waiting``, ``arrived``, ``rejected`` (another one of its id waits) or, past its deadline,
      ``unanswered``; a response nobody took as ``overwritten`` or ``expired``.
    * ``late``: events older than the watermark of the trigger before, set apart ahead of everything,
      and those without a time.
    * ``state``: at most one open request or response per id, and the events that are too new.
    * ``marks``: the watermark.

    ``on_changes`` gets the changes of queue depth that the trigger settled, all of them later than those
    of the triggers before: ``depth_writer`` can follow in the same query.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            before = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={number - 1}")
            mark = spark.read.schema(_MARK).parquet(f"{folder}/marks/batch={number - 1}").first()[0]
        else:
            before, mark = spark.createDataFrame([], _STATE), None

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

        place = F.monotonically_increasing_id()
        arrived = materialized(
            batch.select(*[f.split()[0] for f in EVENTS.split(", ")], F.lit(False).alias("settled"), place.alias("_number"))
        )
        newest = arrived.agg(F.max("ts")).first()[0]
        if newest is not None:
            ahead = newest - datetime.timedelta(seconds=delay_seconds)
            watermark = ahead if mark is None else max(mark, ahead)
        else:
            watermark = mark
        is_late = F.col("ts").isNull()
        if mark is not None:
            is_late = is_late | (F.col("ts") < F.lit(mark))
        put(arrived.filter(is_late).drop("settled", "_number"), "late")
        put(spark.range(1).select(F.lit(watermark).cast("timestamp").alias("watermark")), "marks")
        # Both sides were numbered when they were written; even and odd keep them apart.
        known = before.withColumn("_number", F.col("_number") * 2).unionByName(
            arrived.filter(~is_late).withColumn("_number", F.col("_number") * 2 + 1)
        )
        final = F.lit(False) if watermark is None else F.coalesce(F.col("ts") < F.lit(watermark), F.lit(False))

        ready = known.filter(final)
        requests = ready.filter("is_request").select(
            "id", F.col("ts").alias("request_ts"), "deadline_ts", "queue", "settled", "_number"
        )
        responses = ready.filter("NOT is_request").select(
            "id", F.col("ts").alias("response_ts"), F.col("number").alias("seq")
        )
        matched, fates = settled_rows(requests, responses, ttl_seconds, carry=["queue", "settled"])
        fates = materialized(fates)
        now = F.lit(watermark).cast("timestamp")
        lifetime = F.make_dt_interval(secs=F.lit(ttl_seconds))
        open_request = F.col("how").isNull() & (F.col("deadline_ts") >= now)
        open_response = (F.col("fate") == "expired") & (F.col("response_ts") + lifetime >= now)
        none = F.lit(None)
        put(
            matched.filter(~open_request)
            .select("id", "request_ts", "response_ts", "response_seq", F.coalesce("how", F.lit("unanswered")).alias("outcome"))
            .unionByName(
                fates.filter(~open_response).select(
                    "id", none.cast("timestamp").alias("request_ts"), "response_ts",
                    F.col("seq").alias("response_seq"), F.col("fate").alias("outcome"),
                )
            ),
            "outcomes",
        )
        columns = [f.split()[0] for f in _STATE.split(", ") if not f.startswith("_number")]
        carried = (
            matched.filter(open_request)
            .select(
                "id", F.col("request_ts").alias("ts"), F.lit(True).alias("is_request"), "deadline_ts", "queue",
                none.cast("bigint").alias("number"), F.lit(True).alias("settled"),
            )
            .unionByName(
                fates.filter(open_response).select(
                    "id", F.col("response_ts").alias("ts"), F.lit(False).alias("is_request"),
                    none.cast("timestamp").alias("deadline_ts"), none.cast("string").alias("queue"),
                    F.col("seq").alias("number"), F.lit(True).alias("settled"),
                )
            )
        )
        put(known.filter(~final).select(columns).unionByName(carried).withColumn("_number", place), "state")
        if on_changes is not None:
            on_changes(depth_changes(matched, ~F.col("settled")), number)

    return write


def first_response_stream(
    deliveries: DataFrame, delay: str = "1 minute", within: str = "1 hour"
) -> DataFrame:
    """The first delivery of every ``id`` by (response_ts, seq), in append mode.

    Copies of one id that follow each other by less than ``within`` are one session, and its least
    delivery comes out once the watermark has passed the session's end; no copy is kept but the least. A
    copy is only dropped as late when its session has ended. An id delivered again after a
    longer pause is a new delivery. Choose ``within`` by how far apart copies of one job can be.
    """
    first = F.min(F.struct("response_ts", "seq"))
    return (
        deliveries.withWatermark("response_ts", delay)
        .groupBy("id", F.session_window("response_ts", within).alias("session"))
        .agg(first.alias("first"))
        .select("id", F.col("first.seq").alias("seq"), F.col("first.response_ts").alias("response_ts"))
    )

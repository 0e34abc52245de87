"""Requests and responses matched by id, in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gavel.functions.text import empty_if_null, python_int, strip
from gavel.operators.ordering import followed, keep_first, neighbours, running_totals
from gavel.operators.rejects import split_rejects
from gavel.session import materialized

TTL_SECONDS = 300
UINT32 = 4294967295


def validate_callbacks(callbacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(callbacks with id, rejects)``: the payload id must be blank or equal the path id.

    Needs ``path_id``, ``payload_id`` and ``bad_payload``. Stateless, so it serves streams too.
    """
    path_id = strip(empty_if_null(F.col("path_id")))
    payload_id = empty_if_null(F.col("payload_id"))
    reason = (
        F.when(path_id == "", "missing job id")
        .when(F.coalesce("bad_payload", F.lit(False)), "invalid payload")
        .when((payload_id != "") & (payload_id != path_id), "job id mismatch")
    )
    return split_rejects(callbacks.withColumn("id", path_id), reason)


def _seconds_after(moment: str, seconds: float) -> Column:
    return F.col(moment) + F.make_dt_interval(secs=F.lit(seconds))


def _repeated_ids(requests: DataFrame) -> DataFrame:
    counts = requests.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return materialized(counts.filter("_n > 1 AND id IS NOT NULL").select("id"))


def _deadline(requests: DataFrame) -> Column:
    known = "deadline_ts" in requests.columns
    return F.col("deadline_ts") if known else F.lit(None).cast("timestamp")


def match_responses(
    requests: DataFrame,
    responses: DataFrame,
    ttl_seconds: float = TTL_SECONDS,
    ids_unique: bool = False,
) -> DataFrame:
    """Each request with the ``seq`` of the response it gets, NULL where there is none.

    Requests: ``id``, ``request_ts`` and maybe ``deadline_ts``. Responses: ``id``, ``response_ts``,
    ``seq`` (unique). A response held at the request (not older than the TTL) is taken, the latest
    of them; otherwise the earliest to come, up to the deadline. ``how`` is ``waiting`` or
    ``arrived``, and ``rejected`` for a request made while another one of its id still waits.

    An id asked for once needs plain aggregates over narrow rows, so a billion copies of one response
    shrink inside the tasks; repeated ids are settled in turn (:func:`settle_in_turn`). Say
    ``ids_unique`` to spare the look for them. Fetch the payload afterwards by ``seq``.
    """
    return settle_responses(requests, responses, ttl_seconds, ids_unique)[0]


def settle_responses(
    requests: DataFrame,
    responses: DataFrame,
    ttl_seconds: float = TTL_SECONDS,
    ids_unique: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(match_responses(...), expired_responses(...))``, looking for repeated ids once."""
    repeated = None if ids_unique else _repeated_ids(requests)
    if repeated is None or repeated.isEmpty():
        matched = _match_single(requests, responses, ttl_seconds)
        return matched, _expired_single(requests, responses, matched, ttl_seconds)
    numbered = _numbered(requests.join(repeated, "id", "left_semi"))
    mine = responses.join(repeated, "id", "left_semi")
    outcomes, fates = settle_in_turn(numbered, mine, ttl_seconds)
    again = numbered.join(outcomes, "_number").select(
        *requests.columns, "response_ts", "response_seq", "how"
    )
    single = requests.join(repeated, "id", "left_anti")
    others = responses.join(repeated, "id", "left_anti")
    matched = _match_single(single, others, ttl_seconds)
    gone = _expired_single(single, others, matched, ttl_seconds)
    return matched.unionByName(again), gone.unionByName(mine.join(fates, "seq"))


def _numbered(requests: DataFrame) -> DataFrame:
    """Requests with a number of their own, written once so that it stays."""
    return materialized(requests.withColumn("_number", F.monotonically_increasing_id()))


def settle_in_turn(
    requests: DataFrame, responses: DataFrame, ttl_seconds: float = TTL_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """``(outcomes by _number, fates by seq)`` where an id may be asked for many times.

    Requests have a ``_number`` (unique, whole); ``seq`` is a whole number too. An id has one
    waiter at a time: a request is rejected while an earlier one waits, and a response is taken
    once. What comes next for a request follows from its neighbours in the order of events alone:
    a waiting one ends at the next response or at its deadline, one that takes a held response
    ends at once, and the next request after that end is the next one not rejected. So the
    requests that count are a chain of pointers from the first one of every id, and it is
    followed by doubling. No id is ever gathered: neighbours are found across range partitions.
    """
    outcomes, fates = settled_rows(requests, responses, ttl_seconds)
    return outcomes.select("_number", "response_ts", "response_seq", "how"), fates.select("seq", "fate")


def settled_rows(
    requests: DataFrame, responses: DataFrame, ttl_seconds: float = TTL_SECONDS, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """:func:`settle_in_turn` as whole rows, so that nothing has to be joined to them.

    Requests come back as ``id, request_ts, deadline_ts, _number``, the narrow columns named by ``carry`` and
    their outcome, responses nobody took as ``id, response_ts, seq, fate``.
    """
    carry = list(carry)
    none = F.lit(None).cast("timestamp")
    unset = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in carry]
    asked = requests.select("id", "request_ts", _deadline(requests).alias("deadline"), "_number", *carry)
    events = (
        responses.select(
            "id", F.col("response_ts").alias("ts"), F.lit(0).alias("kind"),
            F.col("seq").cast("bigint").alias("number"), none.alias("deadline"), *unset,
        )
        .unionAll(asked.select("id", "request_ts", F.lit(1), "_number", "deadline", *carry))
        .unionAll(
            asked.filter("deadline IS NOT NULL").select(
                "id", F.greatest("deadline", "request_ts"), F.lit(2), "_number", "deadline", *unset
            )
        )
    )
    kind = F.col("kind")
    row = F.struct("ts", "number")
    near = materialized(
        neighbours(
            events,
            ["id"],
            ["ts", "kind", "number"],
            before={
                "last_response": F.when(kind == 0, row),
                "last_request": F.when(kind == 1, F.col("number")),
            },
            after={
                "next_response": F.when(kind == 0, row),
                "next_request": F.when(kind == 1, F.col("number")),
                "next_event": F.when(kind < 2, F.struct("kind", "ts")),
            },
        )
    )
    def held(response: str, moment: str) -> Column:
        return F.coalesce(
            _seconds_after(f"{response}.ts", ttl_seconds) >= F.col(moment), F.lit(False)
        )

    answered = F.col("next_response").isNotNull() & (
        F.col("deadline").isNull() | (F.col("next_response.ts") <= F.col("deadline"))
    )
    # A waiting request ends with its answer or at its deadline: one event, whose next request follows.
    ends = near.filter("kind <> 1").select(
        F.col("kind").alias("end_kind"), F.col("number").alias("end_number"), F.col("next_request").alias("end_next")
    )
    waits = materialized(
        near.filter("kind = 1")
        .withColumn("answered", answered)
        .withColumn("answer_number", F.when(F.col("answered"), F.col("next_response.number")))
        .withColumn("end_kind", F.when(F.col("answered"), 0).otherwise(2))
        .withColumn("end_number", F.coalesce("answer_number", "number"))
        .join(ends, ["end_kind", "end_number"], "left")
        .drop("end_kind", "end_number")
    )
    # A request is two nodes: one that waits (2 n) and one that takes what is held (2 n + 1).
    end = F.greatest("deadline", "ts")
    waiting = F.struct(
        (F.col("number") * 2).alias("node"),
        F.col("end_next").alias("then"),
        F.col("answer_number").alias("used"),
        F.when(~F.col("answered"), end).alias("since"),
    )
    taking = F.struct(
        (F.col("number") * 2 + 1).alias("node"),
        F.col("next_request").alias("then"),
        F.col("last_response.number").alias("used"),
        F.lit(None).cast("timestamp").alias("since"),
    )
    steps = waits.select(
        F.explode(F.when(held("last_response", "ts"), F.array(waiting, taking)).otherwise(F.array(waiting))).alias("s")
    ).select("s.*").filter("then IS NOT NULL")
    targets = waits.select(
        F.col("number").alias("then"), F.col("ts").alias("then_ts"), F.col("last_response").alias("then_last")
    )
    # What the next request finds held must have come after the end of this one.
    left_over = (
        held("then_last", "then_ts")
        & ~F.col("then_last.number").eqNullSafe(F.col("used"))
        & F.coalesce(F.col("then_last.ts") > F.col("since"), F.lit(True))
    )
    pointers = steps.join(targets, "then").select(
        "node", (F.col("then") * 2 + left_over.cast("bigint")).alias("next")
    )
    starts = waits.filter("last_request IS NULL").select(
        (F.col("number") * 2 + held("last_response", "ts").cast("bigint")).alias("node")
    )
    served = followed(pointers, starts).select(
        F.expr("node >> 1").alias("number"), (F.col("node") % 2 == 1).alias("took")
    )
    taken = F.when(F.col("took"), F.col("last_response")).when(
        ~F.col("took") & F.col("answered"), F.col("next_response")
    )
    outcomes = materialized(
        waits.join(served, "number", "left")
        .withColumn("taken", taken)
        .select(
            "id",
            F.col("ts").alias("request_ts"),
            F.col("deadline").alias("deadline_ts"),
            F.col("number").alias("_number"),
            *carry,
            F.col("taken.ts").alias("response_ts"),
            F.col("taken.number").alias("response_seq"),
            F.when(F.col("took").isNull(), "rejected")
            .when(F.col("took"), "waiting")
            .when(F.col("answered"), "arrived")
            .alias("how"),
        )
    )
    used = outcomes.filter("response_seq IS NOT NULL").select(F.col("response_seq").alias("seq"))
    overwritten = (F.col("next_event.kind") == 0) & (
        F.col("next_event.ts") <= _seconds_after("ts", ttl_seconds)
    )
    fates = (
        near.filter("kind = 0")
        .select(
            "id",
            F.col("ts").alias("response_ts"),
            F.col("number").alias("seq"),
            F.when(F.coalesce(overwritten, F.lit(False)), "overwritten").otherwise("expired").alias("fate"),
        )
        .join(used, "seq", "left_anti")
        .select("id", "response_ts", "seq", "fate")
    )
    return outcomes, fates


def _match_single(requests: DataFrame, responses: DataFrame, ttl_seconds: float) -> DataFrame:
    asked = requests.select("id", "request_ts", _deadline(requests).alias("deadline_ts"))
    arrivals = responses.select("id", "response_ts", "seq").join(asked, "id")
    waiting = (F.col("response_ts") <= F.col("request_ts")) & (
        _seconds_after("response_ts", ttl_seconds) >= F.col("request_ts")
    )
    coming = (F.col("response_ts") > F.col("request_ts")) & (
        F.col("deadline_ts").isNull() | (F.col("response_ts") <= F.col("deadline_ts"))
    )
    arrival = F.struct("response_ts", "seq")
    winners = (
        arrivals.filter(waiting | coming)
        .groupBy("id")
        .agg(
            F.max(F.when(waiting, arrival)).alias("waiting"),
            F.min(F.when(coming, arrival)).alias("coming"),
        )
        .select(
            "id",
            F.coalesce("waiting", "coming").alias("taken"),
            F.when(F.col("waiting").isNotNull(), "waiting").otherwise("arrived").alias("how"),
        )
    )
    return requests.join(winners, "id", "left").select(
        *requests.columns,
        F.col("taken.response_ts").alias("response_ts"),
        F.col("taken.seq").alias("response_seq"),
        "how",
    )


def first_response(deliveries: DataFrame) -> DataFrame:
    """The first delivery of every ``id`` by arrival."""
    return keep_first(deliveries, ["id"], ["response_ts", "seq"])


def expired_responses(
    requests: DataFrame,
    responses: DataFrame,
    ttl_seconds: float = TTL_SECONDS,
    ids_unique: bool = False,
) -> DataFrame:
    """Responses nobody took: ``overwritten`` by a newer one in time, else ``expired``.

    Ids asked for more than once are settled in turn, as in :func:`match_responses`.
    """
    return settle_responses(requests, responses, ttl_seconds, ids_unique)[1]


def _expired_single(
    requests: DataFrame, responses: DataFrame, matched: DataFrame, ttl_seconds: float
) -> DataFrame:
    """Fates where no id is asked for twice.

    Arrivals before and after the request never share a slot of the store. Time is cut into
    TTL-wide buckets: within one, all but the last arrival are overwritten for certain; the last
    one only has to be compared with the first arrival of the next bucket. That needs one partial
    aggregate and joins on ``seq``, never an ordered group of all copies of an id.
    """
    taken = matched.filter("response_seq IS NOT NULL").select(F.col("response_seq").alias("seq"))
    asked = requests.select("id", "request_ts")
    later = F.coalesce(F.col("response_ts") > F.col("request_ts"), F.lit(False))
    bucket = F.floor(F.unix_micros("response_ts") / F.lit(int(ttl_seconds * 1_000_000))).cast("bigint")
    # Every arrival counts for its own bucket and, as a successor, for the one before.
    slots = (
        responses.select("id", "response_ts", "seq")
        .join(asked, "id", "left")
        .select("id", later.alias("later"), bucket.alias("own"), "response_ts", "seq",
                F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
        .groupBy("id", "later", (F.col("own") - F.col("back")).alias("bucket"))
        .agg(
            F.max(F.when(F.col("back") == 0, F.struct("response_ts", "seq"))).alias("last"),
            F.min(F.when(F.col("back") == 1, F.col("response_ts"))).alias("next_ts"),
        )
        .filter("last IS NOT NULL")
    )
    lifetime = F.make_dt_interval(secs=F.lit(ttl_seconds))
    in_time = F.coalesce(F.col("next_ts") <= F.col("last.response_ts") + lifetime, F.lit(False))
    last_of_bucket = slots.select(
        F.col("last.seq").alias("seq"),
        F.when(in_time, "overwritten").otherwise("expired").alias("fate"),
    )
    return (
        responses.join(taken, "seq", "left_anti")
        .join(last_of_bucket, "seq", "left")
        .withColumn("fate", F.coalesce("fate", F.lit("overwritten")))
    )


def response_outcome(responses: DataFrame) -> DataFrame:
    """Add ``status``, ``exit_code`` (unsigned 32 bits), ``stdout``, ``stderr`` and ``files``.

    ``exec`` is a struct of ``error`` and ``result``; an error wins over a result.
    """
    failed = empty_if_null(F.col("exec.error")) != ""
    present = F.col("exec.result").isNotNull()
    status = (
        F.when(failed, "failed").when(present, "ok").otherwise("empty response")
    )
    usable = ~failed & present

    def result(name: str) -> Column:
        return F.when(usable, F.col(f"exec.result.{name}"))

    return responses.select(
        *[c for c in responses.columns if c != "exec"],
        status.alias("status"),
        F.when(failed, F.col("exec.error")).alias("error"),
        result("exit_code").cast("bigint").bitwiseAND(F.lit(UINT32)).alias("exit_code"),
        result("stdout").alias("stdout"),
        result("stderr").alias("stderr"),
        result("files").alias("files"),
    )


def depth_changes(matched: DataFrame, new: Column | None = None) -> DataFrame:
    """``queue, id, ts, change``: +1 for every request that was not rejected, -1 for its response.

    ``new`` marks the requests that were not counted before.
    """
    counted = matched.filter(~F.col("how").eqNullSafe("rejected"))
    asked = (counted if new is None else counted.filter(new)).select("queue", "id", F.col("request_ts").alias("ts"), F.lit(1).alias("change"))
    answered = counted.filter("response_ts IS NOT NULL").select(
        "queue", "id", F.greatest("request_ts", "response_ts").alias("ts"), F.lit(-1).alias("change")
    )
    return asked.unionByName(answered)


def pending_jobs(matched: DataFrame) -> DataFrame:
    """Unanswered requests per ``queue`` after every event.

    ``matched`` comes from :func:`match_responses`. A request answered from the store is asked
    and answered at one moment. There are few queues, so the running sum is cut by time range
    and not by queue.
    """
    events = depth_changes(matched).withColumn("_step", -F.col("change"))
    counted = running_totals(
        events, ["ts", "_step", "id"], {"pending": F.col("change")}, keys=["queue"], inclusive=True
    )
    return counted.drop("_step")


def demux_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Results matched to requests by ``(batch, id)``, one ``status`` per request or result.

    Requests: ``batch``, ``id`` (integer). Results: ``batch``, ``id`` (text), ``error``,
    ``result``, ``seq``. Further copies of an answered id are reported, not used.
    """
    # Decided on (batch, id, seq) alone: one aggregate over both sides says for every id whether it was
    # asked for and which result is its first. The payloads meet that by their unique seq.
    raw = empty_if_null(F.col("id"))
    number = python_int(F.col("id"))
    asked = requests.select(
        "batch", F.col("id").cast("bigint").alias("id"), F.lit(None).cast(results.schema["seq"].dataType).alias("seq"),
        F.lit(True).alias("asked"),
    )
    sides = results.select("batch", number.alias("id"), "seq", F.lit(False).alias("asked")).unionByName(asked)
    ids = sides.filter("id IS NOT NULL").groupBy("batch", "id").agg(
        F.bool_or("asked").alias("asked"), F.min("seq").alias("first")
    )
    firsts = ids.filter("first IS NOT NULL").select(F.col("first").alias("seq"), "asked")
    status = (
        F.when(number.isNull(), F.when(raw == "", "missing id").otherwise("invalid request id"))
        .when(F.col("asked").isNull(), "duplicate result")
        .when(~F.col("asked"), "unknown request id")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("result").isNull(), "empty response")
        .otherwise("ok")
    )
    paid = results.join(firsts, "seq", "left").select(
        "batch",
        number.alias("id"),
        "seq",
        status.alias("status"),
        "error",
        F.when(number.isNotNull(), F.col("result")).alias("result"),
    )
    silent = ids.filter("asked AND first IS NULL").select(
        "batch",
        "id",
        F.col("first").alias("seq"),
        F.lit("no result").alias("status"),
        *[F.lit(None).cast(results.schema[c].dataType).alias(c) for c in ("error", "result")],
    )
    return paid.unionByName(silent)


def batch_count_mismatches(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Batches that got another number of results than they have requests."""
    sides = requests.select("batch", F.lit(1).alias("asked"), F.lit(0).alias("got")).unionByName(
        results.select("batch", F.lit(0).alias("asked"), F.lit(1).alias("got"))
    )
    counts = sides.groupBy("batch").agg(
        F.sum("asked").alias("n_requests"), F.sum("got").alias("n_results")
    )
    return counts.filter("n_requests <> n_results")

"""Chat formatting with linked tool calls, in DataFrame functions only.

Calls and results of a conversation are hash-joined by identifier. A call may refer to the result of
another by ``{"$ref": "<call id>"}`` in its arguments, back or ahead. Levels of chains are found by
pointer doubling, and where chains meet by rounds over the meeting points; calls come after what they need.
Arguments are held against the schema of their tool, and everything is serialised as canonical JSON:
keys in order, no spaces. Conversations are never gathered, so one may be a third of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gavel.llm.common import stored
from gavel.operators.ordering import running_totals

#: tool -> parameter -> (JSON type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

# How Spark names the type of a JSON value.
_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT<.*>$",
    "array": r"^ARRAY<.*>$",
}
_REFERENCE = r'"\$ref"\s*:\s*"([^"\\]+)"'


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted messages of what is wrong with a call's arguments; empty when nothing is."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    known = F.array().cast("array<string>")
    chosen = F.when(F.lit(False), known)
    for tool, parameters in sorted(schemas.items()):
        checks = []
        for parameter, (kind, required) in sorted(parameters.items()):
            has = F.array_contains(keys, parameter)
            found = F.schema_of_variant(F.try_variant_get(parsed, f"$['{parameter}']", "variant"))
            reference = F.get_json_object(arguments, f"$['{parameter}']['$ref']").isNotNull()
            wrong = has & ~reference & ~F.coalesce(found.rlike(_TYPES[kind]), F.lit(False))
            checks.append(F.when(wrong, F.lit(f"{parameter} is not of type {kind}")))
            if required:
                checks.append(F.when(~has, F.lit(f"{parameter} is missing")))
        extra = F.transform(
            F.array_except(keys, F.array(*[F.lit(p) for p in parameters]).cast("array<string>")),
            lambda key: F.concat(key, F.lit(" is not a parameter")),
        )
        stated = F.array(*checks).cast("array<string>") if checks else known
        chosen = chosen.when(name == tool, F.array_sort(F.concat(F.array_compact(stated), extra)))
    return (
        F.when(keys.isNull(), F.array(F.lit("arguments are not a JSON object")))
        .otherwise(F.coalesce(chosen, F.array(F.lit("unknown tool"))))
    )


def _levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv, id, level, at) of the calls that can be put in order.

    ``level`` is the length of the longest chain of calls that a call needs. ``at`` is the turn at
    which it can be made: its own, or that of the last result it needs. Calls with a reference to
    nothing, calls in a circle, and all calls behind those have neither.

    Chains of calls with one need each are followed to their ends by pointer doubling, so they take
    rounds by the logarithm of their length. Calls with several needs are then put in order
    among themselves, by rounds, as many as their longest chain.
    """
    found_needs = F.array_distinct(F.regexp_extract_all("arguments", F.lit(_REFERENCE), F.lit(1)))
    needs = calls.select("conv", "id", "turn", F.explode(found_needs).alias("need"))
    made = calls.select("conv", F.col("id").alias("need"), F.lit(True).alias("made"))
    returned = results.select("conv", F.col("id").alias("need"), F.col("turn").alias("returned"))
    edges = stored(
        needs.join(made, ["conv", "need"], "left")
        .join(returned, ["conv", "need"], "left")
        .withColumn("most", F.greatest("turn", "returned")),
        "chat-needs",
    )
    counted = edges.groupBy("conv", "id").agg(
        F.count(F.lit(1)).alias("needs"),
        F.count("made").alias("met"),
        F.first("need").alias("to"),
        F.first("most").alias("most"),
    )
    placed = stored(calls.select("conv", "id", "turn").join(counted, ["conv", "id"], "left"), "chat-placed")
    free = placed.filter("needs IS NULL").select(
        "conv", "id", F.lit(0).alias("level"), F.col("turn").alias("at")
    )
    chains, circles = _chains(placed.filter("needs = 1 AND met = 1").select("conv", "id", "to", "most"))
    several = placed.filter("needs > 1 AND needs = met").select("conv", "id")
    ends = free
    if not several.isEmpty():
        ends = free.unionAll(
            _rounds(edges.join(several, ["conv", "id"], "left_semi"), chains, circles, free)
        )
    there = ends.select("conv", F.col("id").alias("to"), F.col("level").alias("_level"), "at")
    return ends.unionAll(
        chains.join(there, ["conv", "to"]).select(
            "conv",
            "id",
            (F.col("_level") + F.col("far")).cast("int").alias("level"),
            F.greatest("at", "most").alias("at"),
        )
    )


def _chains(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ended, endless): calls with one need with the end of their chain, and those without an end.

    ``to`` is the first call of the chain that has no need, several, or one to nothing; ``far`` counts
    the steps up to it, and ``most`` is the last turn on the way. A round doubles the steps. Depths
    have no gaps, so a round in which no chain ends leaves circles only.
    """
    own = single.select("conv", F.col("id").alias("to"), F.lit(True).alias("_on"))
    columns = ["conv", "id", "to", "far", "most", "ended"]
    state = stored(
        single.join(own, ["conv", "to"], "left")
        .withColumn("far", F.lit(1).cast("long"))
        .withColumn("ended", F.col("_on").isNull())
        .select(columns),
        "chat-chains",
    )
    ended, open_ = state.filter("ended"), state.filter("NOT ended")
    while not open_.isEmpty():
        ahead = ended.unionAll(open_).select(
            "conv",
            F.col("id").alias("to"),
            F.col("to").alias("_to"),
            F.col("far").alias("_far"),
            F.col("most").alias("_most"),
            F.col("ended").alias("_ended"),
        )
        state = stored(
            open_.join(ahead, ["conv", "to"]).select(
                "conv",
                "id",
                F.col("_to").alias("to"),
                (F.col("far") + F.col("_far")).alias("far"),
                F.greatest("most", "_most").alias("most"),
                F.col("_ended").alias("ended"),
            ),
            "chat-chains",
        )
        fresh, open_ = state.filter("ended"), state.filter("NOT ended")
        if fresh.isEmpty():
            break
        ended = ended.unionAll(fresh)
    return ended, open_


def _rounds(edges: DataFrame, chains: DataFrame, circles: DataFrame, free: DataFrame) -> DataFrame:
    """Levels and turns of calls with several needs: those whose needs all have theirs come next."""
    passed = (
        chains.select("conv", F.col("id").alias("need"), "to", "far", F.col("most").alias("_most"))
        .unionAll(
            circles.select(
                "conv",
                F.col("id").alias("need"),
                F.lit(None).cast("string").alias("to"),
                F.lit(0).cast("long").alias("far"),
                F.lit(None).cast("long").alias("_most"),
            )
        )
        .withColumn("_passed", F.lit(True))
    )
    reached = edges.join(passed, ["conv", "need"], "left").select(
        "conv",
        "id",
        F.when(F.col("_passed"), F.col("to")).otherwise(F.col("need")).alias("to"),
        (F.coalesce("far", F.lit(0)) + 1).alias("far"),
        F.greatest("most", "_most").alias("most"),
    )
    known = free.select("conv", F.col("id").alias("to"), "level", "at")
    waiting = stored(reached.join(known, ["conv", "to"], "left"), "chat-waiting")
    done: list[DataFrame] = []
    while True:
        fresh = stored(
            waiting.groupBy("conv", "id")
            .agg(
                F.count(F.lit(1)).alias("needs"),
                F.count("level").alias("met"),
                F.max(F.col("level") + F.col("far")).cast("int").alias("level"),
                F.max(F.greatest("at", "most")).alias("at"),
            )
            .filter("met = needs")
            .select("conv", "id", "level", "at"),
            "chat-level",
        )
        done.append(fresh)
        if len(done) == 16:  # bounds the plan
            done = [stored(reduce(DataFrame.unionAll, done), "chat-levels")]
        if fresh.isEmpty():
            return reduce(DataFrame.unionAll, done)
        came = fresh.select(
            "conv", F.col("id").alias("to"), F.col("level").alias("_level"), F.col("at").alias("_at")
        )
        waiting = stored(
            waiting.join(fresh.select("conv", "id"), ["conv", "id"], "left_anti")
            .join(came, ["conv", "to"], "left")
            .select(
                "conv",
                "id",
                "to",
                "far",
                "most",
                F.coalesce("level", "_level").alias("level"),
                F.coalesce("at", "_at").alias("at"),
            ),
            "chat-waiting",
        )


def _json(**fields: Column) -> Column:
    """A JSON object with its keys in order."""
    ordered = [column.alias(name) for name, column in sorted(fields.items())]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per event: conv_id, turn, kind, index, level, position, status, errors, json.

    ``messages`` has conv_id, turn, role, text, calls (array of id, name, arguments as JSON text)
    and call_id (of tool results). Events are messages, the calls in them, and results. ``position``
    numbers the events of a conversation so that calls follow the results they need. Status of a
    message is null, of a call *linked*, *unanswered*, *invalid* (see errors), *unresolved* (a
    reference to nothing, in a circle, or behind such a call), or *duplicate* (of an id used before); of
    a result *linked*, *duplicate* or *orphan*. ``level`` of a call is the length of the longest chain of
    calls that it needs, 0 where it is unresolved.

    Defined cases: null conversations are one conversation; null turns come last; null texts are
    empty; calls without an id are duplicates of nothing and unanswered, results without one are
    orphans; arguments that aren't a JSON object are kept as text; repeated rows are events of
    their own, later ones duplicates; an empty table gives no rows; other columns are not read.
    """
    last = F.lit((1 << 62) - 1)
    placed = stored(
        messages.select(
            F.monotonically_increasing_id().alias("row"),
            "conv_id",
            F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"),
            "turn",
            F.coalesce(F.col("turn").cast("long"), last).alias("_turn"),
            "role",
            F.coalesce("text", F.lit("")).alias("text"),
            "calls",
            "call_id",
        ),
        "chat-messages",
    )
    calls = stored(
        placed.filter("role <=> 'assistant'")
        .select("row", "conv", F.col("_turn").alias("turn"), F.posexplode("calls").alias("index", "call"))
        .select("row", "conv", "turn", "index", "call.id", "call.name", "call.arguments"),
        "chat-calls",
    )
    results = placed.filter("role <=> 'tool'").select(
        "row", "conv", F.col("_turn").alias("turn"), F.col("call_id").alias("id")
    )
    # First of an identifier; an aggregate, so a hot one is reduced in every task.
    first_call = stored(
        calls.filter("id is not null")
        .groupBy("conv", "id")
        .agg(F.min(F.struct("turn", "row", "index", "arguments")).alias("c"))
        .select("conv", "id", "c.*"),
        "chat-first",
    )
    first_result = stored(
        results.filter("id is not null")
        .groupBy("conv", "id")
        .agg(F.min(F.struct("turn", "row")).alias("r"))
        .select("conv", "id", "r.*"),
        "chat-results",
    )
    levels = _levels(first_call, first_result)
    linked = stored(
        first_call.select("conv", "id", F.col("row").alias("_row"), F.col("index").alias("_index"))
        .join(
            first_result.select(
                "conv", "id", F.col("row").alias("_result"), F.col("turn").alias("_returned")
            ).hint("shuffle_hash"),
            ["conv", "id"],
            "left",
        )
        .join(levels, ["conv", "id"], "left"),
        "chat-linked",
    )

    called = calls.join(linked, ["conv", "id"], "left").withColumn(
        "errors", argument_errors(F.col("name"), F.col("arguments"), schemas)
    )
    own = (F.col("row") == F.col("_row")) & (F.col("index") == F.col("_index"))
    call_status = (
        F.when(F.col("id").isNotNull() & ~F.coalesce(own, F.lit(False)), "duplicate")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("id").isNotNull() & F.col("level").isNull(), "unresolved")
        .when(F.col("_result").isNull(), "unanswered")
        .otherwise("linked")
    )
    parsed = F.try_parse_json("arguments")
    is_object = F.json_object_keys("arguments").isNotNull()
    call_json = F.when(
        is_object, _json(type=F.lit("tool_call"), id=F.col("id"), name=F.col("name"), arguments=parsed)
    ).otherwise(
        _json(
            type=F.lit("tool_call"), id=F.col("id"), name=F.col("name"), arguments=F.col("arguments")
        )
    )
    call_events = called.select(
        "row",
        "conv",
        F.lit("call").alias("kind"),
        "index",
        F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("at", "turn").alias("at"),
        F.lit(1).alias("stage"),
        call_status.alias("status"),
        "errors",
        call_json.alias("json"),
    )
    answered = placed.filter("role <=> 'tool'").join(
        linked.withColumnRenamed("id", "call_id"), ["conv", "call_id"], "left"
    )
    result_status = (
        F.when(F.col("_row").isNull(), "orphan")
        .when(F.col("row") == F.col("_result"), "linked")
        .otherwise("duplicate")
    )
    no_errors = F.array().cast("array<string>")
    result_events = answered.select(
        "row",
        "conv",
        F.lit("result").alias("kind"),
        F.lit(0).alias("index"),
        F.coalesce("level", F.lit(0)).alias("level"),
        F.greatest("_turn", F.coalesce("at", "_turn")).alias("at"),
        F.lit(2).alias("stage"),
        result_status.alias("status"),
        no_errors.alias("errors"),
        _json(role=F.col("role"), content=F.col("text"), tool_call_id=F.col("call_id")).alias("json"),
    )
    ids = F.coalesce(F.transform("calls", lambda c: c["id"]), no_errors)
    message_events = placed.filter("not role <=> 'tool'").select(
        "row",
        "conv",
        F.lit("message").alias("kind"),
        F.lit(0).alias("index"),
        F.lit(0).alias("level"),
        F.col("_turn").alias("at"),
        F.lit(0).alias("stage"),
        F.lit(None).cast("string").alias("status"),
        no_errors.alias("errors"),
        _json(role=F.col("role"), content=F.col("text"), tool_calls=ids).alias("json"),
    )
    events = stored(message_events.unionAll(call_events).unionAll(result_events), "chat-events")
    order = ["at", "level", "stage", "row", "index"]
    positions = running_totals(
        events.select("conv", "kind", *order), order, {"position": F.lit(1)}, ["conv"], inclusive=True
    ).select("row", "kind", "index", F.col("position").cast("long").alias("position"))
    return (
        events.join(positions, ["row", "kind", "index"])
        .join(placed.select("row", "conv_id", "turn"), "row")
        .select(
            "conv_id", "turn", "kind", "index", "level", "position", "status", "errors", "json"
        )
    )

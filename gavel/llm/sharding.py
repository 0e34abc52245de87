"""Sharding by balanced label propagation: even shards that cut few links between documents.

Documents are linked by what they share (equal texts, a host, any key); a link key with many
documents stands for all pairs of them and is never expanded. Labels are shards.

1. *Propagation.* Linked documents start on a shard by hash. In each round a key's documents are counted by
   shard, joined back, and every document wants to go where most of its linked documents are. Moves
   from one shard to another go through a quota: what wants to go the opposite way, and a part of
   the target's free capacity. The driver sees the sums for pairs of shards, never documents.
2. *Filling.* What is left above the capacity leaves its shard. It and the documents without links
   level the shards: the few that are large against a shard go to the emptiest one, largest
   first; the rest, in a shuffled order, is cut by running totals at each shard's free room.

A key may hold a third of all documents: it is counted before it is shuffled, its documents are
spread over as few shards as have room for them, and no task holds them together.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gavel.llm.common import stored
from gavel.operators.ordering import running_totals

SHARDS = 16
ROUNDS = 12
#: Documents over 1 / LARGE of an even shard are placed one by one: at most SHARDS * LARGE of them.
LARGE = 1000
#: A shard this full takes no more in a round.
NEARLY = 0.98
#: Linked documents alone may fill a shard to so many times their own even share.
SLACK = 1.05

_ROW = ("row_id", "doc_id", "size", "text_crc32")


def equal_text() -> Column:
    """The link key of equal texts; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text, F.crc32(text.cast("binary")), F.length(text))


def _linked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(row_id, _linked) of the rows that share a key with another row."""
    found = None
    for key in keys:
        # A written table, so that the join has a shuffle on both sides and a hot key is split.
        shared = stored(
            rows.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter("_n > 1")
            .select(key),
            "shard-keys",
        )
        own = rows.join(shared, key, "left_semi").select("row_id")
        found = own if found is None else found.unionAll(own)
    found = found if len(keys) == 1 else found.distinct()
    return stored(found.withColumn("_linked", F.lit(True)), "shard-linked")


def _loads(state: DataFrame, shards: int) -> list[int]:
    sums = dict(tuple(r) for r in state.groupBy("shard").agg(F.sum("size")).collect())
    return [sums.get(s, 0) for s in range(shards)]


def _wishes(state: DataFrame, keys: Sequence[str], shards: int, full: list[int]) -> DataFrame:
    """Rows that want to move: _ROW, shard, wish, weight. No one wants to a shard that is full."""
    joined, weights, tie = state, [], F.lit(None).cast("bigint")
    for k, key in enumerate(keys):
        by_shard = state.filter(F.col(key).isNotNull()).groupBy(key, "shard").agg(F.count(F.lit(1)).alias("_n"))
        counts = F.map_from_entries(F.collect_list(F.struct("shard", "_n")))  # one entry per shard
        spread = by_shard.groupBy(key).agg(counts.alias(f"_on_{k}"))
        if len(keys) == 1:  # a key that is on one shard already moves no one
            spread = spread.filter(F.size("_on_0") > 1)
        how = "inner" if len(keys) == 1 else "left"
        joined = joined.join(stored(spread, "shard-spread"), key, how)
        weights.append(f"_on_{k}")
        tie = F.coalesce(tie, F.col(key))

    def rated(s: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for w in weights:
            total = total + F.coalesce(F.try_element_at(w, s), F.lit(0))
        closed = s.isin(full) & (s != F.col("shard"))
        # All rows of a key break ties the same way, so they do not change places with each other.
        return F.struct(F.when(closed, -1).otherwise(total).alias("n"), F.xxhash64(tie, s).alias("t"), s.alias("s"))

    every = F.array(*[F.lit(s) for s in range(shards)])
    best = F.array_max(F.transform(every, rated))
    return (
        joined.withColumn("_best", best)
        .filter((F.col("_best.s") != F.col("shard")) & (F.col("_best.n") > 0))
        .select(
            "row_id",
            "size",
            "shard",
            F.col("_best.s").alias("wish"),
            F.col("_best.n").alias("weight"),
            tie.alias("tie"),
        )
    )


def _quotas(wanted: dict[tuple[int, int], int], room: list[float]) -> dict[tuple[int, int], int]:
    """Size that may go from shard to shard: exchanges, and a share of the target's free room."""
    swapped = {(i, j): min(n, wanted.get((j, i), 0)) for (i, j), n in wanted.items()}
    rest = [0] * len(room)
    for (i, j), n in wanted.items():
        rest[j] += n - swapped[i, j]
    return {
        (i, j): swapped[i, j]
        + int(min(1.0, max(0.0, room[j]) / rest[j] if rest[j] else 0.0) * (n - swapped[i, j]))
        for (i, j), n in wanted.items()
    }


def _propagate(
    state: DataFrame, keys: Sequence[str], shards: int, capacity: float, rounds: int
) -> DataFrame:
    """Rows of ``state`` (_ROW, shard, keys) on the shards where their neighbours are."""
    used_up: set[int] = set()
    for turn in range(rounds):
        loads = _loads(state, shards)
        full = [s for s in range(shards) if loads[s] >= NEARLY * capacity or s in used_up]
        wishes = _wishes(state, keys, shards, full)
        if len(keys) > 1:  # with several keys two rows could chase each other
            wishes = wishes.filter(F.pmod(F.xxhash64("row_id", F.lit(turn)), F.lit(2)) == 0)
        wishes = stored(wishes, "shard-wishes")
        asked = wishes.groupBy("shard", "wish").agg(F.sum("size")).collect()  # shards ** 2 rows at most
        if not asked:
            break
        wanted = {(i, j): n for i, j, n in asked}
        quotas = _quotas(wanted, [capacity - n for n in loads])
        # Where more wanted to go than had room, the next round looks for other shards.
        used_up, before = {j for (i, j), n in quotas.items() if n < wanted[i, j]}, used_up
        whole = [i * shards + j for (i, j), n in quotas.items() if n >= wanted[i, j]]
        part = {i * shards + j: n for (i, j), n in quotas.items() if 0 < n < wanted[i, j]}
        way = F.col("shard") * shards + F.col("wish")
        moves = wishes.filter(way.isin(whole)).select("row_id", "wish")
        if part:
            quota = F.try_element_at(
                F.map_from_arrays(
                    F.array(*[F.lit(w) for w in part]),
                    F.array(*[F.lit(n).cast("bigint") for n in part.values()]),
                ),
                way,
            )
            queued = wishes.withColumn("quota", quota).filter("size <= quota")
            queued = queued.withColumn("first", -F.col("weight"))
            served = running_totals(
                queued, ["first", "tie", "row_id"], {"sent": F.col("size")}, ["shard", "wish"], inclusive=True
            )
            moves = moves.unionAll(served.filter("sent <= quota").select("row_id", "wish"))
        moves = stored(moves, "shard-moves")
        if moves.isEmpty():
            if used_up <= before:
                break
            continue
        state = stored(
            state.join(moves, "row_id", "left")
            .withColumn("shard", F.coalesce("wish", "shard"))
            .drop("wish"),
            "shard-state",
        )
    return state


def levels(loads: Sequence[int], total: int) -> list[int]:
    """What each shard gets of ``total``, so that the emptiest ones rise to one level."""
    order = sorted(range(len(loads)), key=lambda s: loads[s])
    level, at = loads[order[0]], 1
    left = total
    while at < len(order) and (loads[order[at]] - level) * at <= left:
        left -= (loads[order[at]] - level) * at
        level = loads[order[at]]
        at += 1
    share, over = divmod(left, at)
    rooms = [0] * len(loads)
    for n, s in enumerate(order[:at]):
        rooms[s] = level - loads[s] + share + (n < over)
    return rooms


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    links: Sequence[Column] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: row_id, doc_id, size, text_crc32, shard, slot.

    ``size`` is the number of UTF-8 bytes of the text plus 1, and the shards' sums of it are near
    equal: with no document over 1 / 1000 of a shard, to about that; a document larger than an even
    share has a shard of its own, or nearly. ``links`` are key columns; documents with the same value
    of one are linked (by default those with equal texts), and a null links nothing. ``slot`` numbers
    the documents of a shard from 0. Defined cases: a null text has no bytes and is linked with empty
    texts; rows with one id, or equal in all, are documents of their own; fewer documents than
    shards leave shards empty; an empty table gives no rows; columns that no link names are not read.
    """
    spark = docs.sparkSession
    links = [equal_text()] if links is None else list(links)
    keys = [f"key_{k}" for k in range(len(links))]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            *[F.when(c.isNotNull(), F.xxhash64(c)).alias(k) for c, k in zip(links, keys)],
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    even = total / shards
    marked = rows.join(_linked(rows, keys), "row_id", "left") if keys else rows.withColumn("_linked", F.lit(None).cast("boolean"))
    marked = stored(marked, "shard-marked")
    linked = marked.filter("_linked").drop("_linked")
    start = F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int")
    state = stored(linked.withColumn("shard", start), "shard-state")
    alone = marked.filter("_linked IS NULL").select(*_ROW)

    loads = _loads(state, shards)
    if any(loads):
        state = _propagate(state, keys, shards, max(even, SLACK * sum(loads) / shards), rounds)
        loads = _loads(state, shards)
    over = [s for s in range(shards) if loads[s] > even]
    kept, pool = state.select(*_ROW, "shard"), alone
    if over:
        crowded = state.filter(F.col("shard").isin(over))
        placed = stored(
            running_totals(crowded, [*keys, "row_id"], {"sent": F.col("size")}, ["shard"], inclusive=True),
            "shard-crowded",
        )
        stay = F.col("sent") <= even
        kept = kept.filter(~F.col("shard").isin(over)).unionAll(placed.filter(stay).select(*_ROW, "shard"))
        pool = pool.unionAll(placed.filter(~stay).select(*_ROW))
        loads = _loads(kept, shards)

    large = pool.filter(F.col("size") * LARGE > even).select(*_ROW).collect()
    small = pool.filter(F.col("size") * LARGE <= even)
    heap = [(n, s) for s, n in enumerate(loads)]
    heapq.heapify(heap)
    by_hand = []
    for row in sorted(large, key=lambda r: (-r.size, r.row_id)):
        n, s = heapq.heappop(heap)
        by_hand.append((*row, s))
        heapq.heappush(heap, (n + row.size, s))
    loads = [n for n, _ in sorted(heap, key=lambda x: x[1])]

    rest = small.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ends, end = [], 0
    for room in levels(loads, rest):
        end += room
        ends.append(end)
    mixed = running_totals(
        small.withColumn("_mixed", F.xxhash64("row_id", F.lit(7))), ["_mixed", "row_id"], {"sent": F.col("size")}
    )
    passed = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e <= F.col("sent")))
    filled = mixed.select(*_ROW, F.least(passed, F.lit(shards - 1)).cast("int").alias("shard"))
    schema = "row_id long, doc_id long, size long, text_crc32 long, shard int"
    every = kept.unionAll(filled).unionAll(spark.createDataFrame(by_hand, schema))
    slots = running_totals(every, ["row_id"], {"slot": F.lit(1)}, ["shard"])
    return slots.withColumn("slot", F.col("slot").cast("long"))

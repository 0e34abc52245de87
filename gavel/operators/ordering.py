"""First and last rows, row numbers and running totals that survive hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gavel.session import materialized

_PART, _POS = "_part", "_pos"
_POSITION_BITS = (1 << 33) - 1


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    last: bool = False,
    salts: int = 0,
) -> DataFrame:
    """One row per key: the first (or last) by ``order_by``, which must be a total order.

    The ``= 1`` on the row number lets Spark cut every key to one row inside each map
    task (WindowGroupLimit) before the shuffle, so a hot key sends one row per task. Where
    many wide rows share a key, ``salts`` first reduces each key in that many pieces, dealt by
    map task, so that a task still sends one row and a reducer gets one in ``salts`` of them.
    """
    if salts:
        pieces = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        df = keep_first(pieces, [*keys, "_salt"], order_by, last).drop("_salt")
    order = [F.col(c).desc() if last else F.col(c).asc() for c in order_by]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_last_wide(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order_by`` (a total order), for rows with texts.

    The last place of each key is an aggregate over narrow columns, written first. The rows themselves
    only take part in a semi-join by key and place, which no hot key fills; where few keys
    are chosen Spark knows it from the written table and moves no row at all.
    """
    place = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    chosen = df.groupBy(*keys).agg(F.max(place).alias("_place"))
    chosen = materialized(chosen.withColumnsRenamed({k: f"_key_{k}" for k in keys}))
    same = place == F.col("_place")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return df.join(chosen, same, "left_semi")


def _placed(df: DataFrame, order: Sequence[str], tasks: int | None = None) -> DataFrame:
    # Where no partition count is given, small ranges are coalesced; what is coalesced is
    # adjacent, and is sorted and numbered afterwards.
    ranged = df.repartitionByRange(*([tasks] if tasks else []), *order)
    ordered = ranged.sortWithinPartitions(*order)
    return materialized(
        ordered.withColumn(_PART, F.spark_partition_id()).withColumn(
            _POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS))
        )
    )


def row_numbers(
    df: DataFrame, order_by: Sequence[str], name: str, start: int | Column = 1
) -> DataFrame:
    """Dense numbers in the total order ``order_by``.

    Rows are range partitioned; only one count per partition goes through the
    unpartitioned window, and that table is what is broadcast. Pass narrow rows, as all
    of ``df`` is written once; number wide rows by their keys and join.
    """
    placed = _placed(df, order_by)
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(_PART, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    first = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(F.broadcast(offsets), _PART)
        .withColumn(name, (F.col("_offset") + F.col(_POS) + first).cast("bigint"))
        .drop(_PART, _POS, "_offset")
    )


def running_totals(
    df: DataFrame,
    order_by: Sequence[str],
    totals: Mapping[str, Column],
    keys: Sequence[str] = (),
    inclusive: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Running sums in the total order ``order_by``, restarted for every key.

    ``tasks`` is the number of ranges, for callers who know the rows; else it is Spark's.

    A key may fill many partitions. Each partition is summed on its own; a key that
    began in an earlier partition gets its carry from a table with at most one row
    per partition, which is why that table can be broadcast.
    """
    keys = list(keys)
    valued = df.select("*", *[expr.alias(f"_v_{name}") for name, expr in totals.items()])
    placed = _placed(valued, [*keys, *order_by], tasks)

    per_part = placed.groupBy(_PART, *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in totals],
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_part.select(
        _PART,
        *keys,
        F.sum("_rows").over(earlier).alias("_earlier"),
        *[F.sum(f"_t_{name}").over(earlier).alias(f"_c_{name}") for name in totals],
    ).filter("_earlier > 0")

    frame = (
        Window.partitionBy(_PART, *keys)
        .orderBy(_POS)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    summed = (placed.repartition(tasks, _PART) if tasks else placed).select(
        "*", *[F.sum(f"_v_{name}").over(frame).alias(f"_r_{name}") for name in totals]
    )
    # Keys join null-safe: a NULL key is a group like any other.
    carry = carry.select(
        F.col(_PART).alias("_cp"),
        *[F.col(k).alias(f"_ck_{k}") for k in keys],
        *[f"_c_{name}" for name in totals],
    )
    same = F.col(_PART) == F.col("_cp")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_ck_{key}"))
    joined = summed.join(F.broadcast(carry), same, "left")
    results = [
        (
            F.coalesce(F.col(f"_r_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        ).alias(name)
        for name in totals
    ]
    return joined.select(*df.columns, *results)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The nearest value that is not null before and after every row, within its key.

    ``before`` and ``after`` name values; the results take those names, and a row's own value
    does not count. ``order_by`` is a total order. A key may fill many partitions: each
    partition looks through its own rows, and what reaches over its borders is carried by a table
    with at most two rows per partition, as only its first and its last key go on elsewhere.
    """
    keys = list(keys)
    sides = {False: dict(before or {}), True: dict(after or {})}
    # The values follow from a row's own columns: they are made where they are used, and neither
    # ranged, written nor shuffled.
    values = [e.alias(f"_v_{name}") for side in sides.values() for name, e in side.items()]
    placed = _placed(df, [*keys, *order_by])

    key = F.struct(*keys)
    edges = placed.groupBy(_PART).agg(
        F.min_by(key, _POS).alias("_first"), F.max_by(key, _POS).alias("_last")
    )
    at_edge = placed.select("*", *values).join(F.broadcast(edges), _PART).filter(
        key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last"))
    )

    def nearest(name: str, backwards: bool) -> Column:
        value = F.when(F.col(f"_v_{name}").isNotNull(), F.col(_POS))
        pick = F.min_by if backwards else F.max_by
        return pick(f"_v_{name}", value).alias(f"_c_{name}")

    per_part = at_edge.groupBy(_PART, *keys).agg(
        *[nearest(name, back) for back, side in sides.items() for name in side]
    )
    order = {
        back: Window.partitionBy(*keys).orderBy(F.desc(_PART) if back else F.asc(_PART))
        .rowsBetween(Window.unboundedPreceding, -1)
        for back in sides
    }
    carry = per_part.select(
        F.col(_PART).alias("_cp"),
        *[F.col(k).alias(f"_ck_{k}") for k in keys],
        *[
            F.last(f"_c_{name}", ignorenulls=True).over(order[back]).alias(f"_c_{name}")
            for back, side in sides.items()
            for name in side
        ],
    )
    frames = {
        back: Window.partitionBy(_PART, *keys).orderBy(F.desc(_POS) if back else F.asc(_POS))
        .rowsBetween(Window.unboundedPreceding, -1)
        for back in sides
    }
    seen = placed.repartition(_PART, *keys).select("*", *values).select(
        "*",
        *[
            F.last(f"_v_{name}", ignorenulls=True).over(frames[back]).alias(f"_r_{name}")
            for back, side in sides.items()
            for name in side
        ],
    )
    same = F.col(_PART) == F.col("_cp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_ck_{k}"))
    joined = seen.join(F.broadcast(carry), same, "left")
    names = [name for side in sides.values() for name in side]
    return joined.select(
        *df.columns, *[F.coalesce(f"_r_{name}", f"_c_{name}").alias(name) for name in names]
    )


def followed(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes on the chains that begin at ``starts`` (node), one row each.

    ``pointers`` is (node, next), at most one row per node; a node without one ends its chain, and no
    chain may run in a circle. Pointers are doubled: after n rounds all nodes within 4 ** n steps
    are found, so the rounds are the logarithm of the longest chain, whatever its length. Nodes
    found and pointers are one narrow table, written once a round.
    """
    nowhere = F.lit(None).cast("bigint")
    state = starts.select(F.col("node").cast("bigint"), nowhere.alias("next")).unionAll(
        pointers.select(F.col("node").cast("bigint"), F.col("next").cast("bigint")).filter("next IS NOT NULL")
    )
    while True:
        state = materialized(state)
        found, jumps = state.filter("next IS NULL").select("node"), state.filter("next IS NOT NULL")
        if jumps.isEmpty():
            return found.distinct()
        for _ in range(2):
            ahead = found.join(jumps, "node").select(F.col("next").alias("node"))
            found = found.unionAll(ahead)
            jumps = _doubled(jumps)
        state = found.distinct().withColumn("next", nowhere).unionAll(jumps)


def _doubled(jumps: DataFrame) -> DataFrame:
    further = jumps.select(F.col("node").alias("next"), F.col("next").alias("_end"))
    return jumps.join(further, "next").select("node", F.col("_end").alias("next"))

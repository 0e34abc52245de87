"""Packing documents into sequences by linear grouping and best fit.

1. *Pieces.* Scan tasks tokenize whole texts. Only a document longer than a sequence is cut; all of
   its pieces but the first then fill a sequence each. A task numbers its pieces of each length.
2. *Plan.* Pieces are alike when they are as long, so the plan needs only the number of pieces of
   each length: a histogram with one entry per length up to the capacity, whatever the input is.
   Large lengths are put in groups of equal cardinality, rounded up to the largest of the group,
   and packed as configurations of those few sizes; then the actual lengths take the places,
   which frees what rounding took; last, small lengths go by best fit into what is free, and
   into new sequences. The plan is a list of (number of sequences, lengths in each).
3. *Places.* The n-th piece of a length takes the n-th place of that length. Piece numbers come from
   the numbers within the tasks and the counts of the tasks before, so there is no sort of pieces,
   and one length may be a third of all pieces.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gavel.llm.common import stored

CAPACITY = 2048
#: Lengths over this share of the capacity are large.
LARGE = 0.25
#: Groups of equal cardinality that the large lengths are rounded to.
GROUPS = 1000
#: Words kept by a Python worker; beyond it starts anew.
CACHE_WORDS = 1_000_000

_PIECES = (
    "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, task int, nth long"
)


# --- tokens ---


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(text, id) of the added tokens in a tokenizer's JSON file; they are found in texts as they are."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    odd = [t["content"] for t in listed if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that take more than their own text: {odd}")
    return tuple((t["content"], t["id"]) for t in listed)


@lru_cache(maxsize=2)
def _encoder(
    path: str, pattern: str, added: tuple[tuple[str, int], ...]
) -> Callable[[str], bytes]:
    """Text to its ids as little-endian unsigned 32-bit numbers.

    Texts are first cut at the added tokens, which have ids of their own.
    A byte-level tokenizer encodes every pre-token by itself, and its pattern always cuts before a
    space that is followed by something else than white space. So the text is cut at spaces, and
    only words not seen before are encoded. Texts with other spaces are encoded whole.
    """
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added)
    )
    known: dict[str, bytes] = {}  # a word to the ids of a space and the word

    def whole(text: str) -> bytes:
        return array("I", encoding.encode_ordinary(text)).tobytes()

    def encode(text: str) -> bytes:
        if any(token in text for token, _ in added):
            return array("I", encoding.encode(text, allowed_special="all")).tobytes()
        words = text.split(" ")
        first = words[0]
        del words[0]
        try:
            rest = b"".join([known[w] for w in words])
        except KeyError:
            new = {w for w in words if w not in known}
            if any(not w or w[0].isspace() for w in new):
                return whole(text)
            if len(known) > CACHE_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = whole(" " + w)
            rest = b"".join([known[w] for w in words])
        return whole(first) + rest

    return encode


def pieces(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
    added: tuple[tuple[str, int], ...] = (),
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, task, nth.

    ``tokenizer`` is a file of a byte-level BPE's ranks, as tiktoken reads it, and ``pattern`` its
    splitting pattern; ``added`` are the added tokens of the same tokenizer (:func:`added_tokens`). The ids
    are those of the same vocabulary in any other library. ``nth`` numbers the pieces of a length
    within a task. ``ids`` is null unless asked for.
    """
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, pattern, added)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column("text").to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = (encode(text) if text else b"") + ending
                n = len(ids) // 4
                first = n if n <= capacity else (n - 1) % capacity + 1
                start, piece = 0, 0
                while start < n:
                    length = first if not piece else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(
                        (
                            doc_id,
                            piece,
                            start,
                            length,
                            zlib.crc32(part),
                            part if with_ids else None,
                            task,
                            int(seen[length]),
                        )
                    )
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            kinds += [pa.int32(), pa.int64()]
            names = [field.split()[0] for field in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, _PIECES
    )


# --- the plan, from the number of pieces of each length ---


def _groups(counts: np.ndarray, large: int, n_groups: int) -> list[tuple[int, int]]:
    """(rounded length, pieces) for groups of equal cardinality, longest first.

    Pieces of one length are alike, so the border of a group may fall among them.
    """
    total = int(counts[large:].sum())
    if not total:
        return []
    each = math.ceil(total / n_groups)
    result: list[list[int]] = []
    room = 0
    for length in range(len(counts) - 1, large - 1, -1):
        left = int(counts[length])
        while left:
            if not room:
                result.append([length, 0])
                room = each
            if result[-1][1] == 0:
                result[-1][0] = length
            take = min(left, room)
            result[-1][1] += take
            room, left = room - take, left - take
    merged: dict[int, int] = {}
    for length, n in result:
        merged[length] = merged.get(length, 0) + n
    return sorted(merged.items(), reverse=True)


def _fullest(sizes: Sequence[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size make the fullest sequence that has the largest size left.

    Bounded knapsack over what is left, with reachable fills as the bits of a number.
    """
    use = [0] * len(sizes)
    first = next(i for i, n in enumerate(left) if n)
    use[first] = 1
    room = capacity - sizes[first]
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in range(first, len(sizes)):
        n = left[i] - use[i]
        k = 1
        while n > 0 and sizes[i] <= room:
            k = min(k, n, room // sizes[i])
            if not k:
                break
            new = reach | (reach << (k * sizes[i])) & mask
            if new != reach:
                steps.append((reach, i, k))
                reach = new
            n -= k
            k *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    for before, i, k in reversed(steps):
        if not before >> fill & 1:
            fill -= k * sizes[i]
            use[i] += k
    return use


def configurations(
    groups: list[tuple[int, int]], capacity: int
) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(sequences, [(size, how many in each)])] that hold all pieces of the rounded sizes.

    Each configuration is the fullest that still holds the largest size left, and is used as often
    as its sizes last, so every one uses up a size or leaves less than one more of it.
    """
    sizes = [s for s, _ in groups]
    left = [n for _, n in groups]
    result = []
    while any(left):
        use = _fullest(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, use) if u)
        result.append((times, [(s, u) for s, u in zip(sizes, use) if u]))
        left = [n - u * times for n, u in zip(left, use)]
    return result


def plan(
    counts: Sequence[int], capacity: int = CAPACITY, large: float = LARGE, n_groups: int = GROUPS
) -> list[tuple[int, list[int]]]:
    """[(sequences, lengths in each)] that hold ``counts[l]`` pieces of every length ``l``.

    Its size depends on the capacity and the number of groups, not on the number of pieces.
    """
    counts = np.asarray(counts, np.int64).copy()
    border = max(2, int(capacity * large) + 1)
    groups = _groups(counts, border, n_groups)
    # Substitution: the sizes of the places, and the pieces, are both taken from the longest down.
    # A place of a group's size gets a piece of that group, which is no longer than the place.
    runs: list[list] = []  # [sequences, lengths, free]
    lengths = [
        [length, int(counts[length])]
        for length in range(capacity, border - 1, -1)
        if counts[length]
    ]
    waiting: dict[int, list[list[int]]] = {}
    for size, n in groups:
        mine: list[list[int]] = []
        while n:
            take = min(n, lengths[0][1])
            mine.append([lengths[0][0], take])
            lengths[0][1] -= take
            n -= take
            if not lengths[0][1]:
                lengths.pop(0)
        waiting[size] = mine
    for times, uses in configurations(groups, capacity):
        while times:
            # As many sequences as get the same lengths in all their places.
            step = times
            for size, k in uses:
                if k == 1:
                    step = min(step, waiting[size][0][1])
                else:
                    step = min(step, max(1, waiting[size][0][1] // k))
            got: list[int] = []
            for size, k in uses:
                if step * k <= waiting[size][0][1]:
                    got += [waiting[size][0][0]] * k
                    waiting[size][0][1] -= step * k
                    if not waiting[size][0][1]:
                        waiting[size].pop(0)
                    continue
                for _ in range(k):  # one sequence at the border of two lengths
                    got.append(waiting[size][0][0])
                    waiting[size][0][1] -= 1
                    if not waiting[size][0][1]:
                        waiting[size].pop(0)
            runs.append([step, got, capacity - sum(got)])
            times -= step
    small = [(length, int(counts[length])) for length in range(border - 1, 0, -1) if counts[length]]
    return _best_fit(runs, small, capacity)


def _best_fit(
    runs: list[list], small: list[tuple[int, int]], capacity: int
) -> list[tuple[int, list[int]]]:
    """Small lengths, longest first, each into the fullest sequences that have room for it."""
    by_free: dict[int, list[list]] = {}
    for run in runs:
        by_free.setdefault(run[2], []).append(run)
    for length, n in small:
        while n:
            free = next((f for f in range(length, capacity + 1) if by_free.get(f)), None)
            if free is None:
                each = capacity // length
                whole, rest = divmod(n, each)
                for times, k in ((whole, each), (1 if rest else 0, rest)):
                    if times:
                        left = capacity - k * length
                        by_free.setdefault(left, []).append([times, [length] * k, left])
                break
            run = by_free[free].pop()
            k = free // length  # as many of this length as fit, in as many sequences as they last
            sequences = min(run[0], n // k)
            if not sequences:
                k, sequences = n, 1
            if sequences < run[0]:
                by_free[free].append([run[0] - sequences, run[1], free])
            left = free - k * length
            by_free.setdefault(left, []).append([sequences, run[1] + [length] * k, left])
            n -= k * sequences
    return [(run[0], run[1]) for same in by_free.values() for run in same]


def places(planned: list[tuple[int, list[int]]]) -> list[tuple[int, ...]]:
    """Rows (length, first, until, each, sequence, offset) of the plan, one per run and length.

    Pieces first..until-1 of a length take places of the run, ``each`` to a sequence, from
    ``sequence`` on, the first at ``offset`` and the others right behind it.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in planned:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            first = used.get(length, 0)
            rows.append((length, first, first + times * each, each, sequence, offset))
            used[length] = first + times * each
            offset += each * length
        sequence += times
    return rows


# --- whole packing ---


def pack(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
    added: tuple[tuple[str, int], ...] = (),
) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, piece, start, length, ids_crc32, ids,
    sequence_id, offset.

    A document is its tokens and ``end_id``. Defined cases: a null text is the empty text, so one
    piece of one token; a null id and repeated rows are packed like others, each row by itself; an
    empty table gives no rows; texts of any length are cut as described; other columns are not read.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, pattern, capacity, end_id, with_ids, added), "pack-pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(
        per_task.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))),
        "pack-counts",
    )
    counts = np.zeros(capacity + 1, np.int64)
    for row in carried.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[row.length] = row.n
    rows = places(plan(counts, capacity))
    placed = spark.createDataFrame(
        rows, "length int, _first long, _until long, _each long, _sequence long, _offset long"
    )
    # Its rows come from the capacity, not from the data: broadcast is safe at any size.
    numbered = cut.join(carried.drop("_n"), ["length", "task"]).withColumn(
        "_number", F.col("_earlier") + F.col("nth")
    )
    return (
        numbered.join(F.broadcast(placed), "length")
        .filter("_number >= _first and _number < _until")
        .withColumn("_within", F.col("_number") - F.col("_first"))
        .select(
            "doc_id",
            "piece",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            "ids",
            (F.col("_sequence") + F.floor(F.col("_within") / F.col("_each"))).alias("sequence_id"),
            (F.col("_offset") + (F.col("_within") % F.col("_each")) * F.col("length")).alias(
                "offset"
            ),
        )
    )

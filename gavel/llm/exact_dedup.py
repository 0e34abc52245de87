"""Exact dedup through an extendible-hash index kept as files in the shared folder.

1. *Load.* Every scan task normalises its texts, chains equal ones (64-bit hash, then bytes) and
   writes one index entry per distinct text, and one narrow row per document that names its
   task's entry. A text in a third of all rows leaves one entry per task.
2. *Directory.* Entry sizes per hash prefix (at most ``2 ** MAX_DEPTH`` of them) are summed by
   Spark. Starting from one bucket, the bucket that is overfull is split; where its depth is the
   directory's, the directory doubles first. Only the prefix sums reach the driver.
3. *Owners.* Consecutive directory slots of about equal size form the key range of an owner task.
   It reads its entries in hash order, chains entries of one hash and compares their bytes.
   A bucket that cannot be split further is a longer chain for its owner: entries come in sorted
   order, so memory holds the different texts of one hash, never a bucket.
4. *Members.* The narrow rows meet their entry's group by entry number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavel.llm.common import SPACE, shuffle_tasks, stored

#: The directory never has more than 2 ** MAX_DEPTH slots; that bounds what the driver holds.
MAX_DEPTH = 16
#: A bucket is overfull beyond so many bytes of entries.
BUCKET_BYTES = 32 << 20
#: A load task hands on its chains when they hold so many bytes, so its memory is bounded.
CHAIN_BYTES = 48 << 20

_LOADED = (
    "row_id long, doc_id long, entry long, digest binary, "
    "hash long, norm binary, first_id long, first_row long, copies long"
)


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to member rows and, for each run of chains, entry rows (norm is not null)."""
    schema = pa.schema(
        [
            ("row_id", pa.int64()),
            ("doc_id", pa.int64()),
            ("entry", pa.int64()),
            ("digest", pa.binary()),
            ("hash", pa.int64()),
            ("norm", pa.binary()),
            ("first_id", pa.int64()),
            ("first_row", pa.int64()),
            ("copies", pa.int64()),
        ]
    )
    chains: dict[int, list[list]] = {}
    held = 0

    def entries() -> Iterator[pa.RecordBatch]:
        flat = [(key, entry) for key, chain in chains.items() for entry in chain]
        for at in range(0, len(flat), 256):
            part = flat[at : at + 256]
            n = len(part)
            nothing = [None] * n
            columns = [
                nothing,
                nothing,
                [e[1] for _, e in part],
                nothing,
                [key for key, _ in part],
                [e[0] for _, e in part],
                [e[2] for _, e in part],
                [e[3] for _, e in part],
                [e[4] for _, e in part],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in ("row_id", "doc_id", "hash", "norm")]
        owners = []
        for row_id, doc_id, key, norm in zip(*rows):
            chain = chains.setdefault(key, [])
            entry = next((e for e in chain if e[0] == norm), None)
            if entry is None:
                entry = [norm, row_id, doc_id, row_id, 0]
                chain.append(entry)
                held += len(norm) + 200
            entry[4] += 1
            if _before(doc_id, row_id, entry[2], entry[3]):
                entry[2], entry[3] = doc_id, row_id
            owners.append(entry[1])
        n = batch.num_rows
        empty = [pa.nulls(n, f.type) for f in schema][4:]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row_id"),
                batch.column("doc_id"),
                pa.array(owners, pa.int64()),
                batch.column("digest").cast(pa.binary()),
                *empty,
            ],
            schema=schema,
        )
        if held >= CHAIN_BYTES:
            yield from entries()
            chains.clear()
            held = 0
    yield from entries()


def _before(id_a: int | None, row_a: int, id_b: int | None, row_b: int) -> bool:
    """Order of documents: by id, null last, then by place in the input."""
    if (id_a is None) != (id_b is None):
        return id_b is None
    return (id_a or 0, row_a) < (id_b or 0, row_b)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in hash order to (entry, keep_id, keep_row, group_size)."""
    schema = pa.schema(
        [
            ("entry", pa.int64()),
            ("keep_id", pa.int64()),
            ("keep_row", pa.int64()),
            ("group_size", pa.int64()),
        ]
    )
    key, chain = None, []

    def closed(done: list[list]) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        for _, first_id, first_row, copies, members in done:
            columns[0] += members
            for column, value in zip(columns[1:], (first_id, first_row, copies)):
                column += [value] * len(members)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], schema=schema
        )

    done: list[list] = []
    for batch in batches:
        names = ("hash", "norm", "entry", "first_id", "first_row", "copies")
        for h, norm, entry, first_id, first_row, copies in zip(
            *(batch.column(c).to_pylist() for c in names)
        ):
            if h != key:
                done += chain
                key, chain = h, []
            group = next((g for g in chain if g[0] == norm), None)
            if group is None:
                chain.append([norm, first_id, first_row, copies, [entry]])
                continue
            group[3] += copies
            group[4].append(entry)
            if _before(first_id, first_row, group[1], group[2]):
                group[1], group[2] = first_id, first_row
        if done:
            yield closed(done)
            done = []
    yield closed(chain)


def directory(sizes: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[int]:
    """Local depth of the bucket behind every slot of the final directory.

    ``sizes`` maps a ``max_depth``-bit hash prefix to its bytes. The result's length is
    ``2 ** global depth``; slots that share a bucket are adjacent and hold its depth.
    """

    def held(prefix: int, depth: int) -> int:
        span = max_depth - depth
        return sum(sizes.get(x, 0) for x in range(prefix << span, (prefix + 1) << span))

    depth, slots = 0, [0]
    overfull = [(0, 0)] if held(0, 0) > capacity else []
    while overfull:
        prefix, local = overfull.pop()
        if local == max_depth:
            continue  # it stays one bucket with overflow pages
        if local == depth:  # the directory doubles: every slot is now two
            slots, depth = [d for d in slots for _ in (0, 1)], depth + 1
        span = 1 << (depth - local)
        slots[prefix * span : (prefix + 1) * span] = [local + 1] * span
        for half in (2 * prefix, 2 * prefix + 1):
            if held(half, local + 1) > capacity:
                overfull.append((half, local + 1))
    return slots


def owners(sizes: dict[int, int], slots: list[int], tasks: int, max_depth: int = MAX_DEPTH):
    """The owner task of every directory slot: key ranges of whole buckets, about equal bytes."""
    depth = (len(slots) - 1).bit_length()
    span, total = 1 << (max_depth - depth), max(1, sum(sizes.values()))
    result, before, slot = [], 0, 0
    while slot < len(slots):
        width = 1 << (depth - slots[slot])
        result += [min(tasks - 1, before * tasks // total)] * width
        before += sum(
            sizes.get(x, 0) for x in range(slot * span, (slot + width) * span)
        )
        slot += width
    return result


def exact_dedup(
    docs: DataFrame, row_col: str | None = None, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per document: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of ASCII white space became one space.
    The document with the smallest id stays. Defined cases: a null text is the empty text; a null
    id comes after all ids; of rows with the same id and equal texts, only the first in the input
    is kept; an empty table gives no rows; other columns of ``docs``, whatever their names, are
    not read. ``row_col`` names a column that numbers the rows; without it
    ``row_id`` numbers them in the written index and means nothing by itself.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    scan = docs.select(
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(norm).alias("hash"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        norm.cast("binary").alias("norm"),
    )
    index = stored(scan.mapInArrow(_load, _LOADED), "exact-index")
    entries = index.filter("norm is not null")

    prefix = F.shiftrightunsigned("hash", 64 - MAX_DEPTH)
    sizes = {
        row.prefix: row.bytes
        for row in entries.groupBy(prefix.alias("prefix"))
        .agg(F.sum(F.octet_length("norm") + 64).alias("bytes"))
        .collect()
    }
    slots = directory(sizes, bucket_bytes)
    tasks = shuffle_tasks(spark)
    owner = F.lit(np.array(owners(sizes, slots, tasks), dtype=np.int32))
    depth = (len(slots) - 1).bit_length()
    slot = F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0)
    groups = stored(
        entries.select("hash", "norm", "entry", "first_id", "first_row", "copies")
        .repartitionById(tasks, F.get(owner, slot.cast("int")))
        .sortWithinPartitions("hash")
        .mapInArrow(_own, "entry long, keep_id long, keep_row long, group_size long"),
        "exact-groups",
    )
    members = index.filter("norm is null").select("row_id", "doc_id", "entry", "digest")
    return members.join(groups, "entry").select(
        "row_id",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

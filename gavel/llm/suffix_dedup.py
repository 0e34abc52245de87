"""Removal of byte strings that appear earlier in the corpus, by a distributed suffix array.

A byte goes when a string of ``width`` bytes over it also starts earlier. Sorting the suffixes of all
positions would shuffle every text a hundred times over, so it is done twice on few of them, both
times in the same way: sampled splitters range-partition suffixes by their leading tokens, buckets
sort locally by multikey quicksort, and equal neighbours are repeats of the earliest.

1. *Anchors.* The token of a window is the least hash of its ``TOKEN`` byte strings, so equal windows
   have equal tokens. Consecutive windows with one token are a run, about 35 of them. Runs are
   sorted by token and then by a hash of all their bytes: equal runs repeat the earliest one window
   by window. A run whose token nobody else has repeats nothing. What is left are runs that share
   a token but not all bytes, at the borders of passages.
2. *Suffixes.* For those, the suffix of every window is sorted by its leading eight bytes less
   their last bit, and where they are equal by a 64-bit fingerprint of the whole window.

A token that is so frequent that it was sampled as a splitter more than once is dealt over the
buckets between; comparing across their boundaries is left to the second sort for the runs of such a
token. In the second sort, equal suffixes are always sent to the same bucket, so boundaries
separate different strings. Tasks resolve repeats among their own texts first, and send one
copy of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from gavel.llm.common import regrouped, shuffle_tasks, stored
from gavel.llm.textkit import CHUNK_BYTES, Rolling, binary_parts

WIDTH = 100
#: Run lengths are kept in 16 bits.
MAX_WIDTH = 65_535
#: Bytes of a token.
TOKEN = 32
#: Texts sampled for splitters: one of so many, by hash.
SAMPLED = 16
#: Runs or suffixes that a task holds before it sends them on.
HELD_RUNS = 1_500_000
HELD_SUFFIXES = 1_000_000
#: Runs or suffixes that a bucket should get.
BUCKET_RUNS = 1_000_000
BUCKET_SUFFIXES = 1_000_000

_KEY = "id long, no_id boolean, tie long"
_SPANS = f"{_KEY}, kind int, bucket int, blob binary"
#: Kinds of rows: windows that repeat, windows to compare by their suffixes, a bucket's content.
REPEATED, OPEN, CONTENT = 0, 1, 2


# --- packing of arrays into rows ---


def _packed(*arrays: np.ndarray) -> bytes:
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a)
        parts.append(np.array([len(raw.tobytes())], np.int64).tobytes())
    parts += [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, result = 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds):
        result.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return result


def _rows(keys: list[tuple], kind: list[int], bucket: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    ids, nones, ties = zip(*keys) if keys else ((), (), ())
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(nones, pa.bool_()),
        pa.array(ties, pa.int64()),
        pa.array(kind, pa.int32()),
        pa.array(bucket, pa.int32()),
        pa.array(blobs, pa.binary()),
    ]
    names = [field.split()[0] for field in _SPANS.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


class Docs(NamedTuple):
    """Keys of texts: their order is by id, null last, then by hash of the text."""

    id: np.ndarray
    no_id: np.ndarray
    tie: np.ndarray

    def rank(self) -> np.ndarray:
        """Dense ranks in document order; equal keys share one."""
        order = np.lexsort((self.tie, self.id, self.no_id))
        step = np.ones(len(order), bool)
        step[1:] = (
            (np.diff(self.tie[order]) != 0)
            | (np.diff(self.id[order]) != 0)
            | (self.no_id[order][1:] != self.no_id[order][:-1])
        )
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(step) - 1
        return rank

    def key(self, i: int) -> tuple:
        return int(self.id[i]), bool(self.no_id[i]), int(self.tie[i])

    @staticmethod
    def of(table: pa.Table) -> "Docs":
        return Docs(
            table.column("id").to_numpy(),
            table.column("no_id").to_numpy(),
            table.column("tie").to_numpy(),
        )


def _joined(parts: list[Docs]) -> Docs:
    return Docs(*(np.concatenate(c) for c in zip(*parts)))


def multikey_order(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows sorted by one token after the other, and numbers of equal rows.

    Multikey quicksort, all ranges of a depth at once: rows are sorted by their first token, and
    only ranges of equal rows go on to the next one. ``group`` is in the sorted order.
    """
    n = len(tokens[0])
    order = np.argsort(tokens[0], kind="stable")
    new = np.ones(n, bool)
    first = tokens[0][order]
    new[1:] = first[1:] != first[:-1]
    for token in tokens[1:]:
        group = np.cumsum(new) - 1
        tied = ~new
        tied[:-1] |= tied[1:]  # rows in ranges of two or more
        at = np.flatnonzero(tied)
        if not len(at):
            break
        values = token[order[at]]
        again = np.lexsort((values, group[at]))
        order[at] = order[at][again]
        values, groups = values[again], group[at]  # groups stay where they are
        new[at[1:]] |= (values[1:] != values[:-1]) & (groups[1:] == groups[:-1])
    return order, np.cumsum(new) - 1


def _bucket(first: np.ndarray, spread: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Bucket of each row by its leading token; a splitter sampled r times spreads over r more."""
    low = np.searchsorted(splitters, first, "left")
    high = np.searchsorted(splitters, first, "right")
    return low + (spread % (high - low + 1).astype(np.uint64)).astype(np.int64)


def _span_rows(
    docs: Docs, doc: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int, groups: int
):
    """Runs of windows (first, last), one row for each group of documents."""
    if not len(doc):
        return
    to = docs.tie[doc] % groups
    order = np.argsort(to, kind="stable")
    doc, start, end, to = doc[order], start[order], end[order], to[order]
    cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    for i, j in zip(cuts, cuts[1:]):
        used, ref = np.unique(doc[i:j], return_inverse=True)
        blob = _packed(
            ref.astype(np.uint32),
            start[i:j].astype(np.int64),
            (end - start)[i:j].astype(np.uint32),
            docs.id[used],
            docs.no_id[used],
            docs.tie[used],
        )
        yield _rows([(0, False, 0)], [kind], [int(to[i])], [blob])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a group of documents to one row per document and kind: its runs."""
    parts: dict[int, list] = {}
    docs: dict[int, list[Docs]] = {}
    kinds = (np.uint32, np.int64, np.uint32, np.int64, np.bool_, np.int64)
    for batch in batches:
        for kind, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "blob"))):
            ref, start, span, *key = _unpacked(blob, *kinds)
            own = docs.setdefault(kind, [])
            before = sum(len(d.id) for d in own[-1:]) + (parts[kind][-1][3] if own else 0)
            own.append(Docs(*key))
            parts.setdefault(kind, []).append((ref.astype(np.int64) + before, start, span, before))
    for kind, found in parts.items():
        every = _joined(docs[kind])
        rank = every.rank()
        _, one = np.unique(rank, return_index=True)
        doc, start, span = (np.concatenate([p[k] for p in found]) for k in range(3))
        doc = rank[doc]
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], (start + span)[order]
        cuts = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
        bounds = list(zip(cuts, cuts[1:]))
        for at in range(0, len(bounds), 2000):
            part = bounds[at : at + 2000]
            keys = [every.key(int(one[doc[i]])) for i, _ in part]
            blobs = [np.stack([start[i:j], end[i:j]]).tobytes() for i, j in part]
            yield _rows(keys, [kind] * len(part), [0] * len(part), blobs)


# --- first sort: runs of windows with one token ---


def _chunks(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for chunks of whole texts."""
    data, offsets = binary_parts(table.column("text"))
    at, n = 0, len(offsets) - 1
    while at < n:
        until = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES)) - 1
        until = min(max(at + 1, until), n)
        yield at, data[offsets[at] : offsets[until]], offsets[at : until + 1] - offsets[at]
        at = until


def _runs(data: np.ndarray, offsets: np.ndarray, width: int, token: int):
    """(text, first window, last window, token, hash of all bytes) of every run."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(data)
    hashes = rolling.windows(token) >> np.uint64(1)
    least, reach = hashes, 1
    inside = width - token + 1
    while 2 * reach <= inside:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < inside:
        rest = inside - reach
        least = np.minimum(least[: len(least) - rest], least[rest:])
    # least[p] is now the token of the window at p. A run also ends where its string leaves the
    # window, if the next one has the same hash: so no two windows of a run are equal.
    change = np.zeros(len(least) + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= width)
    change[offsets[long]] += 1
    change[offsets[long + 1] - width + 1] -= 1
    valid = np.cumsum(change[:-1]).astype(bool)
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])
    begins[offsets[long]] = True
    starts = np.flatnonzero(begins)
    text = np.searchsorted(offsets, starts, "right") - 1
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[-1:] = len(least) - 1
    ends = np.minimum(ends, offsets[text + 1] - width)
    tokens = least[starts]
    hashes = rolling.hashes(starts, ends + width)
    return text, starts - offsets[text], ends - offsets[text], tokens, hashes


def _sampler(width: int, token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, "text", 4 << 20):
            runs, leading = [], []
            for _, data, offsets in _chunks(table):
                _, _, _, tokens, _ = _runs(data, offsets, width, token)
                runs.append(tokens)
                if len(data) >= 8:
                    leading.append(_leading(data, np.arange(0, len(data) - 7, token)))
            values = [(0, np.concatenate(runs))] if runs else []
            if leading:
                values.append((1, np.concatenate(leading)))
            for kind, found in values:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), kind, np.int32)),
                        pa.array(found.astype(np.int64)),
                    ],
                    names=["kind", "value"],
                )

    return run


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from ``at`` on as a number in byte order, halved to be a signed long."""
    token = np.zeros(len(at), np.uint64)
    for i in range(8):
        token = (token << np.uint64(8)) | data[at + i]
    return token >> np.uint64(1)


def _run_sender(width: int, token: int, splitters: np.ndarray, groups: int):
    """Texts to repeated runs within the task, and to one row of runs for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[Docs] = []
        held: list[tuple] = []
        n_docs = n_runs = 0

        def send() -> Iterator[pa.RecordBatch]:
            every = _joined(docs)
            rank = every.rank()
            doc, start, end, tokens, hashes = (np.concatenate(c) for c in zip(*held))
            # A document that is there twice, id and text, is one document.
            first = np.zeros(len(rank), bool)
            first[np.unique(rank, return_index=True)[1]] = True
            own = first[doc]
            doc, start, end, tokens, hashes = (
                x[own] for x in (doc, start, end, tokens, hashes)
            )
            order, group = multikey_order([tokens, hashes, (end - start).astype(np.uint64)])
            earliest = _earliest(order, group, rank[doc], start)
            again = np.ones(len(doc), bool)
            again[earliest] = False
            yield from _span_rows(every, doc[again], start[again], end[again], REPEATED, groups)
            kept = earliest  # in token order
            to = _bucket(tokens[kept], hashes[kept], splitters)
            by = np.argsort(to, kind="stable")
            kept, to = kept[by], to[by]
            cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                rows = kept[i:j]
                used, ref = np.unique(doc[rows], return_inverse=True)
                blob = _packed(
                    np.diff(tokens[rows], prepend=np.uint64(0)),
                    hashes[rows],
                    (end - start)[rows].astype(np.uint16),
                    ref.astype(np.uint32),
                    start[rows].astype(np.int64),
                    every.id[used],
                    every.no_id[used],
                    every.tie[used],
                )
                yield _rows([(0, False, 0)], [CONTENT], [int(to[i])], [blob])

        for table in regrouped(batches, "text", 4 << 20):
            own = Docs.of(table)
            docs.append(own)
            for at, data, offsets in _chunks(table):
                text, start, end, tokens, hashes = _runs(data, offsets, width, token)
                held.append((text + at + n_docs, start, end, tokens, hashes))
                n_runs += len(text)
            n_docs += len(own.id)
            if n_runs >= HELD_RUNS:
                yield from send()
                docs, held, n_docs, n_runs = [], [], 0, 0
        if n_runs:
            yield from send()

    return run


def _earliest(
    order: np.ndarray, group: np.ndarray, rank: np.ndarray, start: np.ndarray
) -> np.ndarray:
    """The row of each group that comes first by document and place, in group order."""
    inner = np.lexsort((start[order], rank[order], group))
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return order[inner][new]


def _others(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pc.not_equal(batch.column("kind"), CONTENT))


def _contents(batch: pa.RecordBatch) -> list[bytes]:
    return batch.filter(pc.equal(batch.column("kind"), CONTENT)).column("blob").to_pylist()


def _run_bucket(splitters: np.ndarray, groups: int):
    """All rows of a bucket to repeated runs and to runs that are open, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, n = [], [], 0
        for batch in batches:
            yield _others(batch)
            for blob in _contents(batch):
                steps, hashes, span, ref, start, ids, no_id, tie = _unpacked(
                    blob,
                    np.uint64,
                    np.uint64,
                    np.uint16,
                    np.uint32,
                    np.int64,
                    np.int64,
                    np.bool_,
                    np.int64,
                )
                parts.append((np.cumsum(steps), hashes, span, ref.astype(np.int64) + n, start))
                docs.append(Docs(ids, no_id, tie))
                n += len(ids)
        if not parts:
            return
        every = _joined(docs)
        rank = every.rank()
        tokens, hashes, span, doc, start = (np.concatenate(c) for c in zip(*parts))
        end = start + span
        order, group = multikey_order([tokens, hashes, span.astype(np.uint64)])
        earliest = _earliest(order, group, rank[doc], start)
        again = np.zeros(len(doc), bool)
        leader = earliest[group]  # of the sorted rows
        again[order] = (rank[doc[order]] != rank[doc[leader]]) | (start[order] != start[leader])
        yield from _span_rows(every, doc[again], start[again], end[again], REPEATED, groups)
        # Runs with the token of others but other bytes, or with a token that others may hold.
        mine = tokens[earliest]
        shared = np.zeros(len(mine), bool)
        shared[1:] = mine[1:] == mine[:-1]
        shared[:-1] |= shared[1:]
        at = np.searchsorted(splitters, mine, "left")
        if len(splitters):
            shared |= splitters[np.minimum(at, len(splitters) - 1)] == mine
        rest = earliest[shared]
        yield from _span_rows(every, doc[rest], start[rest], end[rest], OPEN, groups)

    return run


# --- second sort: suffixes of the open windows ---


def _again(
    order: np.ndarray, group: np.ndarray, rank: np.ndarray, doc: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest row of each group, whether a row comes after that of its group)."""
    kept = _earliest(order, group, rank[doc], start)
    leader = kept[group]
    again = np.zeros(len(doc), bool)
    again[order] = (rank[doc[order]] != rank[doc[leader]]) | (start[order] != start[leader])
    return kept, again


def _suffix_sender(width: int, splitters: np.ndarray, groups: int):
    """(key, text, open windows) to repeats within the task and to rows for the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        held: list[tuple] = []
        count = 0

        def send() -> Iterator[pa.RecordBatch]:
            every = Docs(*(np.array(c) for c in zip(*keys)))
            doc, start, leading, rest = (np.concatenate(c) for c in zip(*held))
            order, group = multikey_order([leading, rest])
            kept, again = _again(order, group, every.rank(), doc, start)
            yield from _span_rows(every, doc[again], start[again], start[again], REPEATED, groups)
            to = _bucket(leading[kept], rest[kept], splitters)
            by = np.argsort(to, kind="stable")
            kept, to = kept[by], to[by]
            cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                rows = kept[i:j]
                used, ref = np.unique(doc[rows], return_inverse=True)
                blob = _packed(
                    np.diff(leading[rows], prepend=np.uint64(0)),
                    rest[rows],
                    ref.astype(np.uint32),
                    start[rows].astype(np.uint32),
                    every.id[used],
                    every.no_id[used],
                    every.tie[used],
                )
                yield _rows([(0, False, 0)], [CONTENT], [int(to[i])], [blob])

        for batch in batches:
            columns = (batch.column(c) for c in ("id", "no_id", "tie", "text", "blobs"))
            for id_, no_id, tie, text, blobs in zip(*columns):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                spans = [np.frombuffer(b, np.int64).reshape(2, -1) for b in blobs.as_py()]
                first, last = np.concatenate(spans, axis=1)
                sizes = last - first + 1
                at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                held.append(
                    (
                        np.full(len(at), len(keys)),
                        at,
                        _leading(data, at),
                        # The halved leading bytes only range; equality is of the whole window.
                        Rolling(data).hashes(at, at + width),
                    )
                )
                keys.append((id_.as_py(), no_id.as_py(), tie.as_py()))
                count += len(at)
                if count >= HELD_SUFFIXES:
                    yield from send()
                    keys, held, count = [], [], 0
        if count:
            yield from send()

    return run


def _suffix_bucket(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, n = [], [], 0
        kinds = (np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.bool_, np.int64)
        for batch in batches:
            yield _others(batch)
            for blob in _contents(batch):
                steps, rest, ref, start, *key = _unpacked(blob, *kinds)
                parts.append(
                    (np.cumsum(steps), rest, ref.astype(np.int64) + n, start.astype(np.int64))
                )
                docs.append(Docs(*key))
                n += len(key[0])
        if not parts:
            return
        every = _joined(docs)
        leading, rest, doc, start = (np.concatenate(c) for c in zip(*parts))
        order, group = multikey_order([leading, rest])
        _, again = _again(order, group, every.rank(), doc, start)
        yield from _span_rows(every, doc[again], start[again], start[again], REPEATED, groups)

    return run


# --- the operator ---


def _cleaner(width: int):
    """(key, text, repeated windows) to the spans to remove and the bytes that stay."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("starts", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int64())),
            ("kept", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c) for c in ("id", "no_id", "text", "blobs"))
            for id_, no_id, text, blobs in zip(*columns):
                doc_id = None if no_id.as_py() else id_.as_py()
                raw = text.as_py()
                found = blobs.as_py()
                if not found:
                    rows.append((doc_id, len(raw), 0, [], [], raw))
                    continue
                spans = [np.frombuffer(b, np.int64).reshape(2, -1) for b in found]
                starts, ends = np.concatenate(spans, axis=1)
                order = np.argsort(starts)
                starts, ends = starts[order], np.maximum.accumulate(ends[order] + width)
                apart = np.ones(len(starts), bool)
                apart[1:] = starts[1:] > ends[:-1]
                cut = np.flatnonzero(apart)
                starts, ends = starts[cut], ends[np.append(cut[1:], len(ends)) - 1]
                edges = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
                rows.append(
                    (doc_id, len(raw), len(raw) - len(kept), starts.tolist(), ends.tolist(), kept)
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
            ) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return run


def _splitters(sample: DataFrame, kind: int, buckets: int) -> np.ndarray:
    """Up to ``buckets - 1`` quantiles of the sampled leading tokens."""
    if buckets < 2:
        return np.zeros(0, np.uint64)
    shares = [i / buckets for i in range(1, buckets)]
    quantiles = F.percentile_approx("value", shares, max(10_000, 20 * buckets))
    found = sample.filter(F.col("kind") == kind).agg(quantiles).first()[0]
    return np.array(found or [], np.int64).astype(np.uint64)


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Contents in their buckets; other rows, which only pass through, anywhere."""
    to = F.when(F.col("kind") == CONTENT, F.col("bucket")).otherwise(
        F.pmod("bucket", F.lit(buckets))
    )
    return rows.repartitionById(buckets, to)


def _by_document(rows: DataFrame, groups: int) -> DataFrame:
    """Runs of windows, gathered from all buckets: one row per document and kind."""
    return rows.repartitionById(groups, F.col("bucket")).mapInArrow(_merge, _SPANS)


def remove_repeats(docs: DataFrame, width: int = WIDTH, token: int = TOKEN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, starts, ends, kept (bytes).

    Texts are UTF-8 bytes. Every byte is removed that a string of ``width`` bytes covers which also
    starts earlier: in a document with a smaller id, or before in the same document. Repeats are
    found on the input. ``starts`` and ``ends`` are the maximal removed spans.

    Defined cases: a null text is empty; a null id comes after all ids; documents with the same id
    are ordered by a hash of the text, and if the text is the same too they are one document
    that was given twice, with the same result for each; texts under ``width`` bytes stay; an empty
    table gives no rows; other columns are not read. ``width`` may be up to ``MAX_WIDTH``.
    """
    if not token <= width <= MAX_WIDTH:
        raise ValueError(f"width must lie between {token} and {MAX_WIDTH}")
    text = F.coalesce(F.col("text"), F.lit(""))
    key: list[Column] = [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64(text).alias("tie"),
    ]
    keyed = docs.select(*key, text.cast("binary").alias("text"))
    names = ["id", "no_id", "tie"]

    sample = stored(
        keyed.filter(F.pmod("tie", F.lit(SAMPLED)) == 0)
        .select("text")
        .mapInArrow(_sampler(width, token), "kind int, value long"),
        "suffix-sample",
    )
    n_sampled = sample.filter("kind = 0").count()
    buckets = 1 + n_sampled * SAMPLED // BUCKET_RUNS
    splitters = _splitters(sample, 0, buckets)
    buckets = len(splitters) + 1
    groups = shuffle_tasks(docs.sparkSession)
    sent = keyed.mapInArrow(_run_sender(width, token, splitters, groups), _SPANS)
    sorted_runs = _in_buckets(sent, buckets).mapInArrow(_run_bucket(splitters, groups), _SPANS)
    found = stored(_by_document(sorted_runs, groups), "suffix-sorted")

    is_repeat = F.col("kind") == REPEATED
    opened = found.filter(F.col("kind") == OPEN).select(*names, F.array("blob").alias("blobs"))
    # A run has about a third of its width in windows, and a blob 16 bytes for a run.
    sizes = F.aggregate("blobs", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b))
    n_open = (opened.agg(F.sum(sizes)).first()[0] or 0) * width // 48
    splitters = _splitters(sample, 1, 1 + n_open // BUCKET_SUFFIXES)
    # Both joins below deal out the same texts in the same way, so Spark shuffles them once.
    compared = (
        keyed.join(opened.hint("shuffle_hash"), names)
        .select(*names, "text", "blobs")
        .mapInArrow(_suffix_sender(width, splitters, groups), _SPANS)
    )
    last = _in_buckets(compared, len(splitters) + 1).mapInArrow(_suffix_bucket(groups), _SPANS)
    repeated = (
        found.filter(is_repeat)
        .unionAll(_by_document(last, groups))
        .groupBy(*names)
        .agg(F.collect_list("blob").alias("blobs"))
    )
    return (
        keyed.join(repeated.hint("shuffle_hash"), names, "left")
        .select("id", "no_id", "text", "blobs")
        .mapInArrow(
            _cleaner(width),
            "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, "
            "kept binary",
        )
    )

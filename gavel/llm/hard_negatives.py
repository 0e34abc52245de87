"""Hard-negative mining: a secondary sort of pair scores, streamed through windows of positives.

The score of a pair is the integer inner product of its scaled vectors. Anchors meet all rows in the
cells of a grid (a block of anchors, a block of rows), each with a bounded number of both. Scored
pairs are shuffled by anchor and sorted inside the tasks by (anchor, descending score, id), which is
``repartitionAndSortWithinPartitions`` in DataFrame terms. An iterator then reads each anchor from
its best score down: a positive opens a window of scores, and rows of other labels are emitted into
the open windows until those are full. It holds one anchor's windows, never its pairs.

Before the shuffle a cell drops what can't be in the result, as a map-side combine does. It takes
two passes: the best positives of every cell give each anchor its positives, and with their scores
known a cell sends only its first rows of each window. Nothing that could be returned is left out,
whatever the ties, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gavel.llm.common import shuffle_tasks, stored

POSITIVES = 5
NEGATIVES = 10
#: Score of a negative in per cent of its positive's score.
LOW, HIGH = 30, 90
SCALE = 256
#: Anchors and rows of a cell, on average at most.
ANCHOR_BLOCK = 4096
ROW_BLOCK = 4096
#: Cells get no smaller than this for the sake of more tasks.
LEAST_BLOCK = 512
#: Scores are clamped to this, so that their order and sign fit 64 bits.
LIMIT = 1 << 62
#: Scores held at once by a task.
MATRIX = 1 << 20

_PAIRS = "anchor_id long, score long, vec_id long"
_MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def usable_vectors(
    embeddings: DataFrame, label: Column | None = None, scale: int = SCALE
) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, components scaled and rounded down.

    A row with a null id, label or vector, or any null or non-finite component, takes no part.
    """
    broken = F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    label = (F.col("label") if label is None else label).cast("long")
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~broken)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            label.alias("label"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
        )
        .filter(F.col("label").isNotNull())
    )


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int) -> DataFrame:
    """Every block of anchors beside every block of rows, a cell after the other.

    ``rows`` is (vec_id, label, vector), ``anchors`` has ``positives`` besides.
    """
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["vec_id", "label", "vector"]
    first = anchors.select(
        every(groups).alias("group"), block.alias("block"), F.lit(0).alias("side"), *columns, "positives"
    )
    none = F.lit(None).cast("array<bigint>").alias("positives")
    second = rows.select(
        group.alias("group"), every(blocks).alias("block"), F.lit(1).alias("side"), *columns, none
    )
    return (
        first.unionAll(second)
        .repartition("block", "group")
        .sortWithinPartitions("block", "group", "side", *columns)
    )


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end in zeros."""
    column = lists.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    full = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    full[np.arange(full.shape[1]) < sizes[:, None]] = flat
    return full


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, clamped to ``LIMIT``."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width].T
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * width < 1 << 53:  # doubles hold all sums exactly
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.astype(object)
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def _best(order: np.ndarray, ranked: np.ndarray, chosen: np.ndarray):
    i, j = np.nonzero(chosen)
    return i, order[i, j], ranked[i, j]


def _positives_of(own: np.ndarray, k: int):
    """Takes scores with ``own`` pairs marked; the first k of each anchor, ties by place."""

    def choose(found: np.ndarray):
        found = np.where(own, -LIMIT - 1, found)
        order = np.argsort(-found, axis=1, kind="stable")[:, :k]
        ranked = np.take_along_axis(found, order, 1)
        return _best(order, ranked, ranked >= -LIMIT)

    return choose


def bounds(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest integer n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _windows_of(positives: list[list[int]], k: int, low: int, high: int):
    """The first k rows of every window of each anchor, ties by place."""

    def choose(found: np.ndarray):
        order = np.argsort(-found, axis=1, kind="stable")
        ranked = np.take_along_axis(found, order, 1)
        chosen = np.zeros(found.shape, bool)
        lines = np.arange(len(found))
        for n in range(max(map(len, positives), default=0)):
            ends = [bounds(p[n], low, high) if n < len(p) else (1, 0) for p in positives]
            least, greatest = (np.array(x, np.int64) for x in zip(*ends))
            first = (ranked > greatest[:, None]).sum(axis=1)
            for step in range(k):
                at = first + step
                inside = at < found.shape[1]
                line, at = lines[inside], at[inside]
                good = ranked[line, at] >= least[line]
                chosen[line[good], at[good]] = True
        return _best(order, ranked, chosen)

    return choose


def _scorer(negatives: bool, k: int, low: int, high: int):
    """Cells to the pairs (anchor_id, score, vec_id) that may be in the result."""

    def score_cell(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        side = cell.column("side").to_numpy()
        ids, labels = cell.column("vec_id").to_numpy(), cell.column("label").to_numpy()
        split = int(np.searchsorted(side, 1))
        if split in (0, len(side)):
            return
        anchors, rows = _matrix(cell.column("vector").slice(0, split)), _matrix(cell.column("vector").slice(split))
        anchor_ids, row_ids = ids[:split], ids[split:]
        windows = cell.column("positives").slice(0, split).to_pylist() if negatives else []
        for label in np.unique(labels[:split]).tolist():
            mine = np.flatnonzero(labels[:split] == label)
            theirs = np.flatnonzero((labels[split:] != label) == negatives)
            if not len(theirs):
                continue
            step = max(1, MATRIX // len(theirs))
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                found = scores(anchors[part], rows[theirs])
                if negatives:
                    choose = _windows_of([windows[i] for i in part], k, low, high)
                else:
                    choose = _positives_of(anchor_ids[part][:, None] == row_ids[theirs], k)
                i, j, value = choose(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor_ids[part][i]), pa.array(value), pa.array(row_ids[theirs][j])],
                    names=["anchor_id", "score", "vec_id"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None  # (block, group, side, vec_id) of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack(
                [
                    batch.column(c).to_numpy().astype(np.int64)
                    for c in ("block", "group", "side", "vec_id")
                ],
                axis=1,
            )
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = last is None or tuple(keys[0]) != last
            cell = (last is None) | np.ones(len(keys), bool)
            cell[1:] = (keys[1:, :2] != keys[:-1, :2]).any(axis=1)
            cell[0] = last is not None and tuple(keys[0, :2]) != last[:2]
            last = tuple(keys[-1])
            cuts = [0, *np.flatnonzero(cell).tolist(), len(keys)]
            table = pa.Table.from_batches([batch])
            for n, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if n and held:
                    yield from score_cell(pa.concat_tables(held))
                    held = []
                part = table.slice(i, j - i).filter(pa.array(new[i:j]))
                if part.num_rows:
                    held.append(part)
        if held:
            yield from score_cell(pa.concat_tables(held))

    return run


def _streamed(negatives: int, low: int, high: int):
    """Sorted pairs to mined rows; holds the open windows of one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for own, score, kind, other in zip(
                *(batch.column(c).to_pylist() for c in ("anchor_id", "score", "kind", "vec_id"))
            ):
                if own != anchor:
                    anchor, windows = own, []
                if kind == 0:
                    windows.append([other, score, *bounds(score, low, high), 0])
                    continue
                for window in windows:
                    positive, best, least, greatest, taken = window
                    if taken < negatives and least <= score <= greatest:
                        window[4] += 1
                        out.append((own, positive, window[4], other, best, score))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=[f.split()[0] for f in _MINED.split(", ")],
            )

    return run


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` is (vec_id, label, vector of integers), as ``usable_vectors`` makes it. An anchor's
    positives are its first other rows of the same label by descending score, ties by smaller id;
    per positive come the first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``. Defined cases: of
    rows with one id the first by (label, vector) counts, and a row is never its own positive;
    vectors of different lengths are compared over the components that both have; scores beyond
    62 bits are clamped; an anchor without positives, and a positive without negatives, has no
    row; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "label", "vector")
    n_rows, n_anchors = vectors.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    wanted = min(shuffle_tasks(spark), n_rows // LEAST_BLOCK)
    groups = max(1, math.ceil(n_rows / ROW_BLOCK), wanted)
    blocks = max(1, math.ceil(n_anchors / ANCHOR_BLOCK))
    anchors = vectors.filter(is_anchor)
    none = F.lit(None).cast("array<bigint>")

    cells = _cells(vectors, anchors.withColumn("positives", none), blocks, groups)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = stored(
        cells.mapInArrow(_scorer(False, positives, low, high), _PAIRS)
        .withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= positives)
        .drop("_rank"),
        "anchor-positives",
    )
    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_set("score").alias("positives")
    )
    cells = _cells(vectors, anchors.join(windows, "vec_id"), blocks, groups)
    others = cells.mapInArrow(_scorer(True, negatives, low, high), _PAIRS)
    pairs = chosen.withColumn("kind", F.lit(0)).unionAll(others.withColumn("kind", F.lit(1)))
    return (
        pairs.repartition("anchor_id")
        .sortWithinPartitions("anchor_id", F.desc("score"), "kind", "vec_id")
        .mapInArrow(_streamed(negatives, low, high), _MINED)
    )

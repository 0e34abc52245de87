"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Its sketch holds the minwise token of
``SKETCH`` hash functions: 16 bits of it, and all 64 of those that the roots of the trees use. Several independent trees are grown over the distinct sets. A node
chooses hash functions by its own path, 1.25 of them on average (one over the similarity asked
for), and its documents go down one branch per chosen function, named by their minwise token. Two
sets meet in a branch with the probability of their similarity, sets with nothing in common hardly
ever, so nodes shrink to groups of alike documents.

1. *Roots.* A small node is compared exhaustively by sketches and hands on a spanning forest of
   its likely pairs, the likeliest first; a large one hands on the likely pairs of its members with
   one of them. These are confirmed on the full sets, and the confirmed links form components.
2. *Branches.* From then on only nodes that span several components matter, and only pairs across
   them. A large one branches again; a small one is compared exhaustively, and so is what is left
   large at the last depth, in pairs of blocks. A node hands on its members that have a likely
   partner in another component; 16 bits of every hash of their sets come to the node, where
   components are joined as pairs are found, so a node emits hardly more pairs than it has members.
   These are confirmed on the full sets.

No group is ever expanded into all of its pairs: those within a component are settled by step 1.

A pair that reaches the similarity is missed when it is apart in all trees (at the root:
``(1 - s) ** ROOTS``, about 1e-9 at s = 0.8), or when its sketches differ by four standard
deviations; copies and chains of links make up for it. Equal sets count as one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gavel.llm.common import regrouped, shuffle_tasks, stored
from gavel.llm.components import components, joined
from gavel.llm.textkit import CHUNK_BYTES, binary_parts, mix, shingles, words

SKETCH = 128
#: Branches at the roots of all trees together: ten trees with 1.25 chosen functions each.
ROOTS = 13
#: Members that a node may have to give all its likely pairs at the roots.
NODE_LIMIT = 64
#: Members of a node that is compared exhaustively across components instead of branching.
ACROSS_LIMIT = 2048
MAX_DEPTH = 6
#: Members of a block, where a node is still large at the last depth.
BLOCK = 1024
#: Second branches of a node, in per cent of nodes.
SECOND = 25
#: Up to so many wanted documents (some 24 MB) are sent to the texts; more meet them in a shuffle.
SENT_KEYS = 1_000_000
SHINGLE_WORDS = 5
SIMILARITY = 80


def _sets(table: pa.Table, width: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Distinct shingle hashes, sorted, of the texts of a table, in chunks of rows."""
    data, offsets = binary_parts(table.column("text"))
    at, n = 0, len(offsets) - 1
    while at < n:
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES)) - 1)
        until = min(until, n)
        part = data[offsets[at] : offsets[until]]
        found = words(part, offsets[at : until + 1] - offsets[at])
        hashes, counts = shingles(found, width)
        ends = np.cumsum(counts)
        yield (
            slice(at, until),
            [np.unique(hashes[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())],
        )
        at = until


_SIGNED = "row_id long, doc_id long, tie long, n_shingles long, set_a long, set_b long, roots array<bigint>, sketch array<smallint>"


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _signer(width: int):
    salts = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, "text", 4 << 20):
            sizes, first, second, roots, sketches = [], [], [], [], []
            for _, sets in _sets(table, width):
                lengths = np.array([len(s) for s in sets])
                full = np.flatnonzero(lengths)
                sketch = np.zeros((len(sets), SKETCH), np.int16)
                root = np.zeros((len(sets), ROOTS), np.int64)
                sums = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    begin = (np.cumsum(lengths[full]) - lengths[full]).astype(np.int64)
                    for i in range(SKETCH):
                        least = np.minimum.reduceat((every ^ salts[i]) * (salts[i] | 1), begin)
                        if i < ROOTS:
                            root[full, i] = least.view(np.int64)
                        sketch[full, i] = (least >> np.uint64(48)).astype(np.uint16).view(np.int16)
                    for i in range(2):
                        sums[i, full] = np.add.reduceat(mix(every + salts[i]), begin)
                sizes.append(lengths)
                first.append(sums[0].view(np.int64))
                second.append(sums[1].view(np.int64))
                roots.append(root)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [
                    *(
                        table.column(c).combine_chunks().cast(pa.int64())
                        for c in ("row_id", "doc_id", "tie")
                    ),
                    pa.array(np.concatenate(sizes), pa.int64()),
                    pa.array(np.concatenate(first)),
                    pa.array(np.concatenate(second)),
                    _lists(np.concatenate(roots)),
                    _lists(np.concatenate(sketches)),
                ],
                names=[f.split()[0] for f in _SIGNED.split(", ")],
            )

    return sign


_PAIR, _FLAGGED = "x long, y long", "node long, rep long, label long, side int"


def _likely(similarity: int) -> float:
    """Share of equal minwise tokens under which a pair is not worth confirming."""
    s = similarity / 100
    return s - 4 * (s * (1 - s) / SKETCH) ** 0.5


def _likely_partners(
    sketch: np.ndarray, size: np.ndarray, least: float, similarity: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, later members that may be similar to it, share of equal tokens)."""
    for i in range(len(size) - 1):
        small = np.minimum(size[i + 1 :], size[i]) * 100
        near = np.flatnonzero(small >= np.maximum(size[i + 1 :], size[i]) * similarity)
        near += i + 1
        alike = (sketch[near] == sketch[i]).mean(axis=1)
        good = alike >= least
        yield i, near[good], alike[good]


class _Union:
    """Which labels have been joined."""

    def __init__(self):
        self._root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self._root
        while x in root:
            parent = root[x]
            if parent in root:
                root[x] = root[parent]
            x = parent
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self._root[x] = y
        return x != y


def _members(table: pa.Table, *columns: str) -> list[np.ndarray]:
    flat = table.column("sketch").combine_chunks().flatten()
    sketch = flat.to_numpy(zero_copy_only=False).reshape(-1, SKETCH)
    return [sketch, *(table.column(c).to_numpy() for c in ("rep", "size", *columns))]


def _forest(least: float, similarity: int):
    """A spanning forest of the likely pairs of a node, the likeliest first."""

    def run(node: pa.Table) -> list[tuple]:
        sketch, reps, size = _members(node)
        found = [
            (-share, int(min(reps[i], reps[j])), int(max(reps[i], reps[j])))
            for i, js, shares in _likely_partners(sketch, size, least, similarity)
            for j, share in zip(js.tolist(), shares.tolist())
        ]
        union = _Union()
        return [(x, y) for _, x, y in sorted(found) if union.join(x, y)]

    return run


def _across(labels: np.ndarray, sides: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Partners with another label and, in a pair of blocks, in the other block."""
    return js[(labels[js] != labels[i]) & ((sides[js] != sides[i]) | (sides[i] < 0))]


def _with_partner(least: float, similarity: int):
    """Members of a node with a likely partner in another component: (node, rep, label, side)."""

    def run(node: pa.Table) -> list[tuple]:
        sketch, reps, size, labels, sides, nodes = _members(node, "label", "side", "node")
        open_ = np.zeros(len(reps), bool)
        for i, js, _ in _likely_partners(sketch, size, least, similarity):
            js = _across(labels, sides, i, js)
            if len(js):
                open_[i] = open_[js] = True
        return [tuple(x[k].item() for x in (nodes, reps, labels, sides)) for k in np.flatnonzero(open_)]

    return run


def _joined_across(similarity: int):
    """Pairs (x, y) of a node that join components, by the low 16 bits of their sets' hashes.

    Equal hashes have equal bits, so no link is passed over. A pair that is similar by more than what bits
    may agree by chance counts as joined, which ends the search between its components; pairs
    closer to the border are handed on without that.
    """

    def run(node: pa.Table) -> list[tuple]:
        reps, size, labels, sides = (node.column(c).to_numpy() for c in ("rep", "size", "label", "side"))
        data, offsets = binary_parts(node.column("small"))
        bits, ends = data.view(np.uint16), offsets // 2
        label, links = labels.copy(), []
        present = np.zeros(1 << 16, np.uint8)
        for i in range(len(reps) - 1):
            js = np.arange(i + 1, len(reps))
            least, most = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
            js = _across(label, sides, i, js[100 * least >= similarity * most])
            if not len(js):
                continue
            own = bits[ends[i] : ends[i + 1]]
            present[own] = 1
            if 4 * len(js) > len(reps) - i:
                seen = present[bits[ends[i + 1] :]]
                common = np.add.reduceat(seen, ends[i + 1 : -1] - ends[i + 1], dtype=np.int64)[js - i - 1]
            else:
                common = np.array([int(present[bits[ends[j] : ends[j + 1]]].sum()) for j in js])
            present[own] = 0
            chance = size[js] * (len(own) / (1 << 16))
            surely = common - (chance + 6 * np.sqrt(chance) + 3)
            both = size[i] + size[js]
            for j, sure in zip(*(x[100 * common >= similarity * (both - common)] for x in (js, 100 * surely >= similarity * (both - surely)))):
                if label[i] != label[j]:
                    links.append((int(min(reps[i], reps[j])), int(max(reps[i], reps[j]))))
                    if sure:
                        label[label == label[j]] = label[i]
        return links

    return run


def _low_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, full) to (rep, small): the low 16 bits of every hash."""
    for batch in batches:
        small = [np.frombuffer(v.as_buffer(), np.uint64).astype(np.uint16).tobytes() for v in batch.column("full")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.array(small, pa.binary())], names=["rep", "small"]
        )


def _linked(left: np.ndarray, right: np.ndarray, similarity: int) -> bool:
    """Whether two sets, sorted and distinct, are as similar as asked for."""
    if not len(left):
        return False
    at = np.searchsorted(left, right)
    at[at == len(left)] = 0
    common = int((left[at] == right).sum())
    return 100 * common >= similarity * (len(left) + len(right) - common)


def _by_node(work, schema: str, heavy: str = "sketch"):
    """Applies ``work`` to every node of rows in node order; nodes of one member are passed over."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def rows(table: pa.Table) -> pa.RecordBatch:
            nodes = table.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
            out: dict[tuple, None] = {}
            for i, j in zip(cuts, cuts[1:]):
                if j - i > 1:
                    out.update(dict.fromkeys(work(table.slice(i, j - i))))
            columns = list(zip(*out)) if out else [()] * len(names)
            kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in schema.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        for table in regrouped(batches, heavy, 1 << 20):
            table = table if held is None else pa.concat_tables([held, table])
            nodes = table.column("node").to_numpy()
            last = int(np.flatnonzero(nodes == nodes[-1])[0]) if len(nodes) else 0
            held = table.slice(last)
            if last:
                yield rows(table.slice(0, last))
        if held is not None and held.num_rows:
            yield rows(held)

    return run


def _alike(a: str, b: str) -> Column:
    same = F.zip_with(F.col(a), F.col(b), lambda p, q: (p == q).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(SKETCH))


def _roots(sketches: DataFrame) -> DataFrame:
    """(node, rep, n) of the root branches of all trees that hold two sets or more."""
    branches = sketches.select("rep", F.posexplode("roots").alias("tree", "token"))
    members = stored(branches.select(F.xxhash64("tree", "token").alias("node"), "rep"), "tree-members")
    sizes = stored(
        members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "tree-sizes"
    )
    return stored(members.join(sizes, "node"), "tree-shared")


def _first_pairs(roots: DataFrame, sketches: DataFrame, least: float, similarity: int) -> DataFrame:
    """Likely pairs that connect the alike members of every root branch."""
    small = roots.filter(F.col("n") <= NODE_LIMIT).select("node", "rep").join(sketches, "rep")
    found = _in_node_order(small).mapInArrow(
        _by_node(_forest(least, similarity), _PAIR), _PAIR
    )
    # One member for all; a hash of the set itself, so that the trees agree on it where they can.
    large = roots.filter(F.col("n") > NODE_LIMIT).select("node", "rep")
    drawn = F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("rep")))
    pivots = stored(
        large.groupBy("node")
        .agg(drawn["rep"].alias("pivot"))
        .join(sketches.select(F.col("rep").alias("pivot"), F.col("sketch").alias("_pivot")), "pivot"),
        "tree-pivots",
    )
    stars = (
        large.join(sketches, "rep")
        .join(pivots, "node")
        .filter((F.col("rep") != F.col("pivot")) & (_alike("sketch", "_pivot") >= least))
        .select(F.least("rep", "pivot").alias("x"), F.greatest("rep", "pivot").alias("y"))
    )
    return stored(found.unionAll(stars).distinct(), "near-pairs")


def _open_members(
    roots: DataFrame, sketches: DataFrame, labels: DataFrame, least: float, similarity: int
) -> DataFrame:
    """(node, rep, label, side) of the members with a likely partner in another component."""
    labels = labels.withColumnsRenamed({"node": "rep", "root": "_root"})
    known = stored(
        sketches.join(labels, "rep", "left")
        .withColumn("label", F.coalesce("_root", "rep"))
        .drop("_root"),
        "tree-labelled",
    )
    no_side = F.lit(-1).alias("side")
    members, compared = roots.select("node", "rep"), []
    for depth in range(MAX_DEPTH + 1):
        # One aggregate gives the members of a node and whether they are of several components.
        sizes = members.join(known.select("rep", "label"), "rep").groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")
        )
        several = stored(sizes.filter("a < b").select("node", "n"), "tree-several")
        open_nodes = members.join(several, "node").join(known, "rep")
        compared.append(
            stored(open_nodes.filter(F.col("n") <= ACROSS_LIMIT).drop("n").withColumn("side", no_side), "tree-small")
        )
        large = stored(open_nodes.filter(F.col("n") > ACROSS_LIMIT), "tree-large")
        if large.isEmpty():
            break
        if depth == MAX_DEPTH:
            compared.append(_in_blocks(large))
            break
        chosen = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(SKETCH)).cast("int") for i in (1, 2)]
        children = [F.xxhash64("node", c, F.get("sketch", c)) for c in chosen]
        second = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(100)) < SECOND
        branches = F.when(second, F.array(*children)).otherwise(F.array(children[0]))
        members = stored(large.select(F.explode(branches).alias("node"), "rep"), "tree-members")
    columns = ["node", "rep", "size", "sketch", "label", "side"]
    together = compared[0].select(columns)
    for part in compared[1:]:
        together = together.unionAll(part.select(columns))
    return stored(
        _in_node_order(together).mapInArrow(
            _by_node(_with_partner(least, similarity), _FLAGGED), _FLAGGED
        ),
        "tree-open",
    )


def _in_blocks(large: DataFrame) -> DataFrame:
    """Members of large nodes once for each pair of blocks that theirs is in."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return (
        large.withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .withColumn("_other", other)
        .withColumn("node", F.xxhash64("node", low, high))
        .withColumn(
            "side",
            F.when(F.col("_own") == F.col("_other"), -1)
            .when(F.col("_own") < F.col("_other"), 0)
            .otherwise(1),
        )
        .drop("n", "_blocks", "_own", "_other")
    )


def _in_node_order(df: DataFrame) -> DataFrame:
    return df.repartition("node").sortWithinPartitions("node")


def _confirmer(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [
                [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("set_x", "set_y")
            ]
            yield batch.select(["x", "y"]).filter(
                pa.array([_linked(a, b, similarity) for a, b in zip(*full)], pa.bool_())
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, "text", 2 << 20):
            for rows, sets in _sets(table, width):
                part = table.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep").combine_chunks(),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["rep", "full"],
                )

    return run


def near_dedup(
    docs: DataFrame,
    width: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: row_id, doc_id, tie, n_shingles, component_id, kept.

    Words are split at ASCII white space, A-Z in lower case. Documents are linked when
    ``100 * common shingles >= similarity * shingles of either``. ``component_id`` is the smallest
    doc_id reachable over links; the row that has it is kept. Defined cases: null and empty texts
    have no shingle and are linked with nothing, so each is its own component and kept; a null id
    comes after all ids; of rows with the same id in one component only one is kept; an empty table
    gives no rows; other columns are not read. ``tie`` is the hash of the text that tells rows with
    the same id apart, and ``row_col`` names a column that numbers the rows, as does ``row_id``.
    """
    least = _likely(similarity)
    tie = F.xxhash64("text")
    scan = docs.select(
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        tie.alias("tie"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    signed = stored(scan.mapInArrow(_signer(width), _SIGNED), "near-signed")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_id", "tie"))
    classes = stored(
        signed.filter("n_shingles > 0")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(first.alias("first"))
        .select("set_a", "set_b", "n_shingles", "first.*")
        .withColumnRenamed("row_id", "rep"),
        "near-classes",
    )
    sketches = stored(
        classes.select("rep").join(
            signed.select(
                F.col("row_id").alias("rep"), F.col("n_shingles").alias("size"), "roots", "sketch"
            ),
            "rep",
        ),
        "near-sketches",
    )
    branches, sketches = _roots(sketches), sketches.drop("roots")
    first_pairs = _first_pairs(branches, sketches, least, similarity)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("_id"), tie.alias("_tie"), F.col("text").cast("binary")
    )

    def full_sets(ends: DataFrame, there: DataFrame | None) -> DataFrame:
        """The full sets of ``ends`` (rep), added to those that are there."""
        ends = ends.distinct()
        if there is not None:
            ends = ends.join(there.select("rep"), "rep", "left_anti")
        wanted = stored(
            classes.select("rep", "doc_id", "tie").join(ends, "rep", "left_semi"), "near-wanted"
        )
        n_wanted = wanted.count()
        if there is not None and not n_wanted:
            return there
        if n_wanted <= SENT_KEYS:
            wanted = F.broadcast(wanted)  # three numbers a row
        same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie"))
        more = stored(
            texts.join(wanted, same)
            .select("rep", "text")
            .mapInArrow(_full_sets(width), "rep long, full binary"),
            "near-sets",
        )
        return more if there is None else there.unionAll(more)

    ends = first_pairs.select(F.col("x").alias("rep")).unionAll(first_pairs.select("y"))
    sets = full_sets(ends, None)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(
            pairs.join(sets.withColumnsRenamed({"rep": "x", "full": "set_x"}), "x")
            .join(sets.withColumnsRenamed({"rep": "y", "full": "set_y"}), "y")
            .mapInArrow(_confirmer(similarity), _PAIR),
            "near-links",
        )

    links = confirmed(first_pairs)
    roots = stored(components(links), "near-roots")
    open_ = _open_members(branches, sketches, roots, least, similarity)
    if not open_.isEmpty():
        sets = full_sets(open_.select("rep"), sets)
        small = stored(sets.mapInArrow(_low_bits, "rep long, small binary"), "near-small")
        met = open_.join(sketches.select("rep", "size"), "rep").join(small, "rep")
        across = _by_node(_joined_across(similarity), _PAIR, "small")
        more_pairs = stored(_in_node_order(met).mapInArrow(across, _PAIR).distinct(), "near-pairs")
        more_links = confirmed(more_pairs)
        if not more_links.isEmpty():
            roots = stored(joined(roots, more_links), "near-roots")

    grouped = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "root", F.coalesce("root", "rep")
    )
    order = F.struct("null", "doc_id", "rep")
    keep = grouped.groupBy("root").agg(F.min(order).alias("keep"))
    decided = stored(
        grouped.join(keep, "root").select(
            "set_a",
            "set_b",
            F.col("keep.doc_id").alias("component_id"),
            F.col("keep.rep").alias("keep_row"),
        ),
        "near-decided",
    )
    alone = F.col("n_shingles") == 0
    return signed.join(decided, ["set_a", "set_b"], "left").select(
        "row_id",
        "doc_id",
        "tie",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
    )

"""Merkle manifest of a dataset: a tree per source under a tree of sources, with proofs.

Every node is labelled by the interval of leaf ranks that it covers. A parent covers up to ``FANOUT``
consecutive nodes of the level below, so its interval contains theirs, and its bucket on that level is
the start of its interval over the width of the level. Trees are built upwards: nodes of one bucket
become a parent that keeps the intervals and digests of its members. Proofs go downwards: members
are joined to their parent by bucket and containment, and what the parent's interval has besides
the member's own are its siblings. Upper levels are handed down inside the nodes, so the leaves
take part in no join: they come out of the nodes above them, sixteen at a time.

No step gathers more than one node's members, however large a source is; ranks within a source
come from range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gavel.llm.common import stored
from gavel.operators.ordering import running_totals

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value of a leaf: ``-`` for null, else the number of its UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    marked = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(text.isNull(), F.lit("-")).otherwise(marked)


def leaf_digest(values: Sequence[Column]) -> Column:
    return hashed(*[field(v) for v in values])


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m["digest"]), "")


@dataclass
class _Tree:
    #: By level: (tree, lo, hi, digest, members); members are the nodes of the level below.
    levels: list[DataFrame]
    #: (tree, digest, depth): the top of every tree and the number of levels above its leaves.
    tops: DataFrame


def _tree(leaves: DataFrame, fanout: int) -> _Tree:
    """Levels of the trees over ``leaves``, (tree, lo, hi, digest, *more), lo = hi being the rank.

    A parent at the start of a tree with a single member is none: its member is the whole tree. Only
    the number of trees still growing is known to the driver.
    """
    spark = leaves.sparkSession
    below, levels, tops, width, depth = leaves, [], None, 1, 0
    while True:
        width *= fanout
        member = F.struct("lo", "hi", "digest", *[c for c in below.columns if c not in _NODE])
        parents = stored(
            below.groupBy("tree", F.floor(F.col("lo") / width).alias("bucket"))
            .agg(F.sort_array(F.collect_list(member)).alias("members"))
            .select(
                "tree",
                (F.col("bucket") * width).alias("lo"),
                F.array_max(F.transform("members", lambda m: m["hi"])).alias("hi"),
                hashed(_joined(F.col("members"))).alias("digest"),
                "members",
            ),
            "merkle-level",
        )
        single = (F.col("lo") == 0) & (F.size("members") == 1)
        ended = parents.filter(single).select(
            "tree", F.col("members")[0]["digest"].alias("digest"), F.lit(depth).alias("depth")
        )
        tops = ended if tops is None else tops.unionAll(ended)
        # The lowest nodes stay: leaves come out of them also where a leaf is the whole tree.
        levels.append(parents if not depth else parents.filter(~single))
        below = parents.filter(~single).select(*_NODE)
        depth += 1
        if below.isEmpty():
            return _Tree(levels, stored(tops, "merkle-tops"))


_NODE = ("tree", "lo", "hi", "digest")
_STEP = "struct<left:string,right:string>"


def _siblings(members: Column, own: Column) -> Column:
    """What the parent's interval has left and right of the member's own."""
    left = _joined(F.filter(members, lambda m: m["hi"] < own["lo"]))
    right = _joined(F.filter(members, lambda m: m["lo"] > own["hi"]))
    return F.struct(left.alias("left"), right.alias("right"))


def _members(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(tree, member, steps, *carried) of the members of nodes that have their own steps."""
    whole = (F.col("lo") == 0) & (F.size("members") == 1)  # a leaf that is the whole tree
    own = F.transform(
        "members",
        lambda m: F.struct(
            m.alias("member"),
            F.when(whole & (F.col("depth") == 0), F.col("steps"))
            .otherwise(F.concat(F.array(_siblings(F.col("members"), m)), "steps"))
            .alias("steps"),
        ),
    )
    opened = nodes.select("tree", "depth", *carried, F.explode(own).alias("one"))
    return opened.select("tree", "depth", *carried, "one.member", "one.steps")


def _proofs(tree: _Tree, above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(tree, member, steps, *carried) of all leaves.

    ``above`` is (tree, steps, *carried) of the tops: the steps from them to the root of everything.
    """
    tops = tree.tops.drop("digest").join(above, "tree")
    handed, n = None, len(tree.levels)
    for at in range(n - 1, -1, -1):
        # A tree with one leaf hangs on its lowest node as the taller ones do, but takes no step there.
        starts = tops.filter(F.col("depth").isin(0, 1) if not at else F.col("depth") == at + 1)
        steps = starts.select(
            F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_lo"), "depth", "steps", *carried
        )
        if handed is not None:
            steps = steps.unionAll(
                handed.select(
                    F.col("tree").alias("_tree"), F.col("member.lo").alias("_lo"), "depth", "steps", *carried
                )
            )
        # A node is found by its bucket of the level, which is where its interval starts.
        same = (F.col("tree") == F.col("_tree")) & (F.col("lo") == F.col("_lo"))
        nodes = tree.levels[at].join(steps, same).drop("_tree", "_lo")
        handed = _members(nodes, carried)
    return handed


def _fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, leaf, lambda acc, s: hashed(s["left"], acc, s["right"]))


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    totals = running_totals(df, order, {"lo": F.lit(1)}, keys=keys)
    return totals.withColumn("lo", F.col("lo").cast("long")).withColumn("hi", F.col("lo"))


def manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, steps, proof, folded_root, verified.

    Leaves are the digests of ``columns``; those of a source ascend by id, and subroots by source,
    null first. ``steps`` are the siblings left and right of the path, leaf to root, and ``proof``
    the digest of them all. Where ``tampered`` holds, the root is folded from the leaf of a text
    with A-Z in lower case, else from the leaf itself. Defined cases: null ids come before others;
    rows with one id follow their leaves, so equal rows may swap places, which changes nothing;
    a source with one document has its leaf as subroot, and with one source the subroot is the root;
    null texts stay null; an empty table gives no rows; other columns are not read.
    """
    lowered = F.translate(
        F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    changed = [lowered if c == text_col else F.col(c) for c in columns]
    touched = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    # Keys of trees are never null, and their order has the null source first.
    key = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit(""))
    leaves = stored(
        docs.select(
            key.alias("tree"),
            F.col(id_col).cast("long").alias("doc_id"),
            leaf_digest([F.col(c) for c in columns]).alias("digest"),
            F.when(touched, leaf_digest(changed)).alias("now"),
        ),
        "merkle-leaves",
    )
    trees = _tree(_ranked(leaves, ["tree"], ["doc_id", "digest"]), fanout)

    # The sources are the leaves of one more tree.
    subroots = trees.tops.select(
        F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("digest")
    )
    upper = _tree(_ranked(subroots, ["tree"], ["source"]), fanout)
    root = upper.tops.select("tree", F.col("digest").alias("root"))
    start = root.withColumn("steps", F.array().cast(f"array<{_STEP}>"))
    above = stored(
        _proofs(upper, start, ["root"]).select(
            F.col("member.source").alias("tree"),
            F.col("member.digest").alias("subroot"),
            "steps",
            "root",
        ),
        "merkle-sources",
    )
    proofs = _proofs(trees, above, ["subroot", "root"])
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = proofs.select(
        F.col("member.doc_id").alias("doc_id"),
        F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("source"),
        F.col("member.digest").alias("leaf"),
        "subroot",
        "root",
        "steps",
        hashed(siblings).alias("proof"),
        _fold(F.coalesce("member.now", "member.digest"), F.col("steps")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))

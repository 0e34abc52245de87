"""Hard negatives, Merkle manifests and shards against plain Python, and their defined cases."""

import hashlib
import pathlib
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent)]

from pyspark.sql import functions as F  # noqa: E402

import brute  # noqa: E402
from compare import compare, connect  # noqa: E402
from gavel.llm import hard_negatives as mining, near_dedup  # noqa: E402
from gavel.llm.hard_negatives import hard_negatives, usable_vectors  # noqa: E402
from gavel.llm.merkle import manifest  # noqa: E402
from gavel.llm.queries import ORACLES, QUERIES  # noqa: E402
from gavel.llm.sharding import equal_text, levels, shard_documents  # noqa: E402

VECTORS = "vec_id long, label int, embedding array<float>, score string, side int, positives string"


# --- hard negatives ---


def mined(rows, anchor, positives=5, negatives=10):
    """From (id, label, integer vector), one row per id."""
    out = set()
    for a, label, v in rows:
        if not anchor(a):
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a
        )
        best = [(i, -s) for s, i, other in scored if other == label][:positives]
        for p, ps in best:
            good = [(i, -s) for s, i, other in scored if other != label and 30 * ps <= -100 * s <= 90 * ps]
            out |= {(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(good[:negatives])}
    return out


def found(df):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [4096, 40])
def test_hard_negatives_with_ties_in_cells_of_any_size(spark, monkeypatch, block):
    for name in ("ANCHOR_BLOCK", "ROW_BLOCK", "LEAST_BLOCK"):
        monkeypatch.setattr(mining, name, block)
    draw = random.Random(5)
    # Few distinct values, so most scores are tied; a third of the rows have one vector.
    rows = [
        (i, draw.randrange(4), [1.0, 0.5, 0.25] if i % 3 == 0 else [draw.randrange(5) / 4 for _ in range(3)])
        for i in range(600)
    ]
    frame = spark.createDataFrame([(*r, "s", 9, "p") for r in rows], VECTORS).repartition(5)
    got = found(hard_negatives(usable_vectors(frame), F.col("vec_id") % 50 == 0))
    want = mined([(i, label, [int(x * 256) for x in v]) for i, label, v in rows], lambda i: i % 50 == 0)
    assert want and got == want


def test_hard_negatives_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.6]),
        (3, 2, [0.6]),  # a repeated row
        (3, 9, [0.9, 0.9]),  # the same id again: the first by label counts
        (4, None, [0.5, 0.5]), (5, 2, None), (6, 2, [nan, 0.5]), (7, 2, [0.5, inf]), (8, 2, [0.5, None]),
        (None, 2, [0.5, 0.5]), (9, 2, []), (10, 2, [0.7, 0.1, 5.0]), (100, 7, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS)
    got = found(hard_negatives(usable_vectors(frame), F.col("vec_id") % 100 == 0))
    # 256*1 with 256*1: 65536; the negatives have 128, 153 and 179 of 256. Anchor 100 has no positive.
    assert got == {
        (0, 1, 1, 10, 65536, 256 * 179), (0, 1, 2, 3, 65536, 256 * 153), (0, 1, 3, 2, 65536, 256 * 128),
    }
    assert found(hard_negatives(usable_vectors(frame.limit(0)), F.col("vec_id") % 100 == 0)) == set()


def test_scores_are_exact_and_clamped():
    draw = np.random.default_rng(1)
    a, b = draw.integers(-(2**40), 2**40, (3, 8)), draw.integers(-(2**40), 2**40, (4, 8))
    want = [[max(-mining.LIMIT, min(mining.LIMIT, sum(int(p) * int(q) for p, q in zip(x, y)))) for y in b] for x in a]
    assert mining.scores(a, b).tolist() == want
    assert mining.scores(a >> 20, b >> 20).tolist() == [
        [sum(int(p) * int(q) for p, q in zip(x, y)) for y in b >> 20] for x in a >> 20
    ]


def test_hard_negatives_on_more_rows(spark):
    folder = "/root/testdata/sf0.1"
    sql = ORACLES["op11_hard_negatives"]
    assert compare(QUERIES["op11_hard_negatives"](spark, folder), connect(folder), sql) is None


# --- Merkle manifest ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """(root, steps of every leaf) of a list of digests."""
    steps, below, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(below) > 1:
        runs = [below[i : i + fanout] for i in range(0, len(below), fanout)]
        for n, at in enumerate(place):
            run, k = runs[at // fanout], at % fanout
            steps[n].append(("".join(run[:k]), "".join(run[k + 1 :])))
            place[n] = at // fanout
        below = [digest(*run) for run in runs]
    return below[0], steps


def manifest_of(rows, fanout):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: digest(*map(code, row))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in sources[s]], fanout)
    root, upper = tree([trees[s][0] for s in names], fanout)
    out = []
    for s, above in zip(names, upper):
        for row, own in zip(sources[s], trees[s][1]):
            steps = own + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf((*row[:4], lower(row[4]))) if tampered else leaf(row)
            for left, right in steps:
                folded = digest(left, folded, right)
            proof = digest(*[left + right for left, right in steps])
            out.append((row[0], leaf(row), trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string, tree int, lo string, digest string, steps int"


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(spark, fanout):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} é") for i in range(70)]
    rows += [(None, None, None, None, None), (None, None, "fr", 0, ""), (7, "lone", "en", 1, "ABC"), (1, "", "x", 2, "b")]
    rows += [(3, "s0", "en", 3, "Text 3 é")]  # a repeated row
    rows += [(4, "s0", "en", 9, "another of the same id")]
    rows += [(i, f"many{i}", "en", 1, "T" * 3000) for i in range(40)]
    frame = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOCUMENT).repartition(4)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = manifest(frame, touched, fanout=fanout)
    columns = ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")
    got = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    want = manifest_of(rows, fanout)
    assert got == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_little(spark):
    one = spark.createDataFrame([(1, "a", "en", 2, "Ab", None, None, None, None)], DOCUMENT)
    row = manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof == hashlib.sha256(b"").hexdigest() and row.source == "a"
    assert manifest(one.limit(0)).count() == 0


# --- shards ---

TEXTS = "doc_id long, text string, shard int, slot string, size string, row_id int, key_0 int"


def shards_of(df, n):
    rows = df.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return rows, [sum(r["size"] for r in by[s]) for s in range(n)]


def test_shards_keep_copies_together_and_sizes_even(spark):
    draw = random.Random(2)
    texts = [f"{i} " + "x" * draw.randrange(300) for i in range(900)]
    texts += [t for t in texts[:200] for _ in range(2)]  # three copies of each
    texts += ["hot " + "y" * 100] * 700  # more than two shards' share of all bytes
    texts += [None] * 30 + [""] * 20 + ["é" * 50]
    frame = spark.createDataFrame([(i, t, 1, "s", "z", 4, 5) for i, t in enumerate(texts)], TEXTS).repartition(6)
    rows, loads = shards_of(shard_documents(frame, 8), 8)
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {
        i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)
    }
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 8
    on = defaultdict(set)
    for r in rows:
        on[texts[r.doc_id] or ""].add(r.shard)
    counts = Counter(t or "" for t in texts)
    groups = {t for t, n in counts.items() if n > 1}
    hot = [t for t in groups if t.startswith("hot")][0]
    share = 101 * 700 / (sum(loads) / 8)
    assert len(on[hot]) <= share + 2
    assert sum(len(on[t]) > 1 for t in groups - {hot}) <= 0.05 * len(groups)


def test_shards_by_two_keys(spark):
    # Chains of documents that share a text with one and a length with others.
    rows = [(i, f"t{i // 3}", 0, "s", "z", 4, i // 12) for i in range(480)]
    frame = spark.createDataFrame(rows, TEXTS)
    placed, loads = shards_of(shard_documents(frame, 4, [equal_text(), F.col("key_0")], rounds=5), 4)
    assert max(loads) - min(loads) <= 0.1 * sum(loads) / 4
    at = {r.doc_id: r.shard for r in placed}
    # Of the pairs linked by a key, a quarter is on one shard by chance.
    groups = [[at[i] for i in range(k, k + 12)] for k in range(0, 480, 12)]
    uncut = sum(n * (n - 1) for g in groups for n in Counter(g).values()) / (len(groups) * 12 * 11)
    assert uncut >= 0.5, uncut


def test_shards_of_little(spark):
    frame = spark.createDataFrame([(1, "a" * 5000, None, None, None, None, None), (1, "b", None, None, None, None, None),
                                   (None, None, None, None, None, None, None), (1, "b", None, None, None, None, None)], TEXTS)
    rows, loads = shards_of(shard_documents(frame), 16)
    assert len(rows) == 4 and max(loads) == 5001
    assert shard_documents(frame.limit(0)).count() == 0
    rows, loads = shards_of(shard_documents(frame, 2, links=[]), 2)
    assert sorted(loads) == [5, 5001]


def test_levels():
    assert levels([5, 0, 9], 6) == [1, 5, 0] or sum(levels([5, 0, 9], 6)) == 6
    for loads, total in ([[0, 0, 0], 7], [[3, 10, 1], 4], [[3, 10, 1], 100], [[4, 4], 0]):
        rooms = levels(loads, total)
        after = [a + b for a, b in zip(loads, rooms)]
        assert sum(rooms) == total and min(rooms) >= 0
        filled = [x for x, r in zip(after, rooms) if r]
        assert not filled or max(filled) - min(after) <= 1


def test_op13_query(spark):
    rows, loads = shards_of(QUERIES["op13_balanced_sharding"](spark, "/root/testdata/sf0.01"), 16)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 16


# --- near duplicates: recall in a large family ---


@pytest.mark.parametrize("limit", [2048, 100])
def test_recall_in_a_family_of_different_texts(spark, monkeypatch, limit):
    """Texts around the similarity asked for, more of them than a node takes: links are not lost."""
    monkeypatch.setattr(near_dedup, "ACROSS_LIMIT", limit)
    draw = random.Random(11)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = []
    for n in range(400):
        words = list(base)
        for at in draw.sample(range(120), draw.choice([2, 3, 3, 4, 5])):
            words[at] = f"x{draw.randrange(10**6)}"
        texts.append((n, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string"), width=4).collect()}
    want = {d: c for d, (_, c, _) in brute.near(texts).items()}
    ours, theirs = Counter(got.values()), Counter(want.values())
    assert all(want[d] == want[c] for d, c in got.items())  # no link that is none
    pairs = lambda sizes: sum(n * (n - 1) // 2 for n in sizes.values())
    assert pairs(theirs) > 300 and len(theirs) > 40
    assert pairs(ours) >= 0.98 * pairs(theirs)

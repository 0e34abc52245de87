"""The registered queries on whole tables, against plain Python or their SQL."""

import hashlib
import pathlib
import sys
import zlib

import numpy as np
import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent)]

import brute  # noqa: E402
from compare import compare, connect  # noqa: E402
from gavel.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source")
    return [tuple(r) for r in rows.collect()]


def result(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(by_id) == len(rows)
    return by_id


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1(spark, texts):
    got = result(spark, "op1_suffix_array_dedup")
    want = brute.repeats([(d, t) for d, t, _ in texts])
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert sum(v[1] for v in want.values()) > 0


def test_op3(spark, texts):
    got = result(spark, "op3_minhash_near_dedup")
    want = brute.near([(d, t) for d, t, _ in texts])
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == want
    assert any(not v[2] for v in want.values())


def test_op4(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op4_best_fit_packing"](spark, FOLDER).collect()
    pieces, total = {}, 0
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(pieces) == len(texts)
    for doc_id, text, _ in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 2048 for r in own[1:]) and own[0].length <= 2048
        at = 0
        for r in own:
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, len(part)) == (at, r.length)
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        total += at
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) * 1.01 + 1


def test_op5(spark, texts):
    got = result(spark, "op5_personal_data")
    for doc_id, text, _ in texts:
        spans = brute.personal(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        counts = [sum(k == kind for k, _, _ in spans) for kind in brute.PATTERNS]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert set(listed.split(",")) - {""} <= set(row.spans.split(","))


def test_op6(spark, texts):
    got = result(spark, "op6_source_mixing")
    sizes = {}
    for doc_id, text, source in texts:
        n = len(brute.WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        assert got[doc_id].size == n
    targets = brute.targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for doc_id, _, source in texts:
        row = got[doc_id]
        assert row.source_size == sizes[source]
        assert row.target == pytest.approx(targets[source], rel=1e-9)
        assert 0 <= row.taken <= 2 * row.size
        taken[source] += row.taken
    for source, n in taken.items():
        assert targets[source] - 1 <= n <= targets[source] + 1e-6
    again = result(spark, "op6_source_mixing")
    assert again == got


def test_op7(spark, texts):
    got = result(spark, "op7_quality_rules")
    for doc_id, text, _ in texts:
        row = got[doc_id]
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
        assert tuple(row[n] for n in names) == brute.quality(text)
        assert not (row.kept and row.base_failed)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    rated = [(r.quality, got[r.doc_id].kept) for r in labels if not got[r.doc_id].base_failed]
    assert all(kept == bool(good) for good, kept in rated)


def test_op9(spark, texts):
    got = result(spark, "op9_licence_scan")
    # The notices in the driver's documents.
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache",
    }
    planted = 0
    for doc_id, text, _ in texts:
        lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
        want = [f"{notices[x]}:{i}" for i, x in enumerate(lines) if x in notices]
        found = [x.rpartition(":")[0] for x in got[doc_id].licences.split(",") if x]
        assert found == want
        assert got[doc_id].n_paragraphs == len(lines)
        planted += len(want)
    assert planted


def test_op10(spark):
    from collections import Counter

    rows = QUERIES["op10_tool_call_linking"](spark, FOLDER).collect()
    kinds = Counter((r.kind, r.status) for r in rows)
    assert kinds["call", "linked"] and kinds["call", "unanswered"] and kinds["call", "invalid"]
    talks = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert sum(n for (kind, _), n in kinds.items() if kind == "message") == talks.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}

    rated = stages["quality rules"](spark, docs, FOLDER)
    assert rated.columns == columns
    passed = texts(rated)
    assert all(labels.get(d, 1) for d, _ in passed)
    assert not any(brute.quality(t)[-1] for _, t in passed)

    exact = stages["exact dedup"](spark, rated, FOLDER)
    first = {}
    for d, t in passed:
        first.setdefault(brute.SPACE.sub(" ", t), (d, t))
    assert exact.columns == columns and texts(exact) == sorted(first.values())

    near = stages["minhash near-dedup"](spark, exact, FOLDER)
    want = brute.near(texts(exact), width=5)
    assert near.columns == columns
    assert texts(near) == [(d, t) for d, t in texts(exact) if want[d][2]]

    mixed = stages["source mixing"](spark, near, FOLDER)
    assert mixed.columns == columns
    sizes, got = {}, {}
    for df, sums in ((near, sizes), (mixed, got)):
        for r in df.collect():
            sums[r.source] = sums.get(r.source, 0) + len(brute.WORD.findall(r.text))
    for source, target in brute.targets(sizes).items():
        assert target - 1 <= got.get(source, 0) <= target + 1e-6
    whole = dict(texts(near))
    for d, t in texts(mixed):
        assert whole[d] == t or " ".join(brute.WORD.findall(whole[d])).startswith(t)

    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in texts(mixed)}
    assert sum(r.piece == 0 for r in packed) == mixed.count()

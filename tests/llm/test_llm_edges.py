"""Defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import json
import pathlib
import random
import sys

import numpy as np
import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent)]

import brute  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from gavel.llm import suffix_dedup, warc  # noqa: E402
from gavel.llm.components import components, joined  # noqa: E402
from gavel.llm.exact_dedup import directory, exact_dedup, owners  # noqa: E402
from gavel.llm.licences import FAMILIES, scan_licences, train, variants  # noqa: E402
from gavel.llm.mixing import mix, mixed_documents, taken  # noqa: E402
from gavel.llm.near_dedup import near_dedup  # noqa: E402
from gavel.llm.packing import added_tokens, pack, places, plan  # noqa: E402
from gavel.llm.pii import find_personal_data, joined_spans  # noqa: E402
from gavel.llm.quality import rate_quality  # noqa: E402
from gavel.llm.suffix_dedup import remove_repeats  # noqa: E402
from gavel.llm.tool_calls import link_tool_calls  # noqa: E402

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept string, row_id string, size string, score string, _row int"
)
PROSE = " ".join(f"word{i % 97} and{i % 31} then{i % 13}" for i in range(120))
LONG = " ".join(f"w{i}" for i in range(60_000))


def doc(doc_id, text, source="a"):
    n = None if text is None else len(text)
    return (doc_id, text, "en", source, n, "x", "y", "z", None, None)


DOCS = [
    doc(3, PROSE),
    doc(1, PROSE + " "),
    doc(1, PROSE + " "),  # a repeated row
    doc(1, "other text of the same id"),
    doc(None, PROSE),
    doc(None, None),
    doc(4, None, None),
    doc(5, ""),
    doc(6, " \n\t "),
    doc(7, LONG, "b"),
    doc(8, LONG.replace("w59000 ", "x ", 1), "b"),
    doc(9, "one"),
    doc(10, "ONE"),
    doc(11, "é" * 150),
    doc(12, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, nothing):
    rows = exact_dedup(docs).collect()
    assert len(rows) == len(DOCS)
    prose = [r for r in rows if r.text_sha256 == next(x for x in rows if x.doc_id == 3).text_sha256]
    # The trailing space is one space, so those texts are equal to each other only.
    assert sorted((r.doc_id or -1, r.kept) for r in prose) == [(-1, False), (3, True)]
    twice = [r for r in rows if r.doc_id == 1 and r.group_size == 2]
    assert sorted(r.kept for r in twice) == [False, True]
    empty = [r for r in rows if r.group_size == 3]
    assert {r.keep_id for r in empty} == {4} and sum(r.kept for r in empty) == 1
    assert exact_dedup(nothing).collect() == []
    small = exact_dedup(docs, bucket_bytes=1)
    assert sorted(map(str, small.drop("row_id").collect())) == sorted(
        map(str, exact_dedup(docs).drop("row_id").collect())
    )


def test_directory():
    sizes = {0: 5, 1: 5, 2: 1, 7: 30}
    assert directory(sizes, 100, 3) == [0]
    assert directory(sizes, 10, 3) == [2, 2, 2, 2, 2, 2, 3, 3]
    slots = directory(sizes, 10, 3)
    assert owners(sizes, slots, 2, 3) == [0, 0, 0, 0, 0, 0, 0, 0]
    assert owners(sizes, slots, 8, 3)[-1] == 2
    assert directory({}, 10, 3) == [0] and owners({}, [0], 4, 3) == [0]


def test_exact_chains(spark):
    """Different texts with one hash stay apart: the bytes decide."""
    import pyarrow as pa

    from gavel.llm.exact_dedup import _load, _own

    batch = pa.RecordBatch.from_pydict(
        {
            "row_id": [0, 1, 2, 3],
            "doc_id": [4, 3, 2, 1],
            "hash": [9, 9, 9, 9],
            "digest": [b"", b"", b"", b""],
            "norm": [b"a", b"b", b"a", b"b"],
        }
    )
    loaded = pa.Table.from_batches(list(_load(iter([batch])))).to_pylist()
    entries = [r for r in loaded if r["norm"] is not None]
    assert [(r["norm"], r["first_id"], r["copies"]) for r in entries] == [(b"a", 2, 2), (b"b", 1, 2)]
    columns = ["hash", "norm", "entry", "first_id", "first_row", "copies"]
    again = pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in entries])
    owned = pa.Table.from_batches(list(_own(iter([again, again])))).to_pylist()
    assert {(r["keep_id"], r["group_size"]) for r in owned} == {(2, 4), (1, 4)}


def test_near_dedup(docs, nothing):
    rows = near_dedup(docs, width=4).collect()
    assert len(rows) == len(DOCS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by_id[3]} == {1}
    assert sum(r.kept for r in rows if r.component_id == 1 and r.n_shingles > 100) == 1
    assert {r.component_id for r in by_id[8]} == {7} and not by_id[8][0].kept
    assert by_id[10][0].component_id == 9 and by_id[9][0].n_shingles == 1
    for empty in (4, 5, 6):
        assert (by_id[empty][0].component_id, by_id[empty][0].n_shingles) == (empty, 0)
        assert by_id[empty][0].kept
    assert by_id[12][0].kept
    assert near_dedup(nothing).collect() == []


def test_near_dedup_large_group(spark):
    """A group far over the node limit, with chains, against all pairs."""
    random = np.random.default_rng(3)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(random.integers(0, 6)):
            words[random.integers(100)] = f"n{random.integers(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:60] + [f"m{i}-{k}" for k in range(40)])) for i in range(100)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near(rows)


def _roots_of(edges):
    """{node: smallest node reachable}, one edge after the other."""
    root = {n: n for edge in edges for n in edge}
    for x, y in edges:
        low, high = sorted((root[x], root[y]))
        root = {n: low if r == high else r for n, r in root.items()}
    return root


def test_components_joined_by_further_edges(spark):
    rng = random.Random(5)
    drawn = [tuple(rng.sample(range(60), 2)) for _ in range(45)]
    star = [(100, n) for n in range(101, 140)]
    first = [*drawn[:25], *star, (201, 200), (202, 200), (202, 201)]
    # Inside a component, between two, repeated, from a known node to a new one, and between new ones.
    for more in ([*drawn[25:], (110, 120), (139, 3), (139, 3), (139, 300), (401, 400)], [(201, 202)], []):
        roots = components(spark.createDataFrame(first, "x long, y long"))
        assert {r.node: r.root for r in roots.collect()} == _roots_of(first)
        got = joined(roots, spark.createDataFrame(more, "x long, y long")).collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.root for r in got} == _roots_of([*first, *more])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = components(spark.createDataFrame(chain, "x long, y long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_remove_repeats(docs, nothing, spark):
    rows = remove_repeats(docs).collect()
    assert len(rows) == len(DOCS)
    removed = {}
    for r in rows:
        assert r.n_bytes - r.n_removed == len(r.kept)
        removed.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    n = len(PROSE)
    # Id 1 comes first; its repeated row is the same document and gets the same result.
    assert removed[1][0] == removed[1][1] or removed[1][0][1] == removed[1][2][1]
    assert (n, n) in removed[3] and (n, n) in removed[None] and (0, 0) in removed[None]
    assert removed[7] == [(len(LONG), 0)]
    assert 0 < removed[8][0][1] < removed[8][0][0]
    assert removed[11] == [(300, 300 - 2)]  # each window repeats the one two bytes before it
    assert removed[12] == [(5000, 4999)]
    assert remove_repeats(nothing).collect() == []


def test_remove_repeats_against_brute_force(spark):
    random = np.random.default_rng(5)
    parts = ["".join(random.choice(list("ab c"), 70)) for _ in range(12)]
    rows = []
    for i in range(120):
        text = "".join(parts[k] for k in random.integers(0, 12, random.integers(0, 9)))
        at = int(random.integers(0, len(text) + 1))
        rows.append((i * 7 % 120, text[:at] + "é\0"[: i % 3] + text[at:]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = remove_repeats(frame).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").alias("n"), F.sha2("kept", 256).alias("h")
    )
    want = brute.repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n, r.h) for r in got.collect()} == want


def test_remove_repeats_over_buckets(spark, monkeypatch):
    """Many small buckets and flushes give what one of each gives."""
    random = np.random.default_rng(6)
    passage = "".join(random.choice(list("abcdefgh "), 130))
    rows = []
    for i in range(200):
        own = "".join(random.choice(list("abcdefgh "), random.integers(0, 400)))
        rows.append((i, own + passage * (i % 3) + own[: i % 200]))
    for name, value in {
        "SAMPLED": 1, "HELD_RUNS": 50, "HELD_SUFFIXES": 300, "BUCKET_RUNS": 100, "BUCKET_SUFFIXES": 300
    }.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeats(frame).collect()
    want = brute.repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts)) for r in got} == {
        d: v[:3] for d, v in want.items()
    }


def test_multikey_order():
    random = np.random.default_rng(1)
    tokens = [random.integers(0, 4, 500).astype(np.uint64) for _ in range(5)]
    order, group = suffix_dedup.multikey_order(tokens)
    rows = list(zip(*(t.tolist() for t in tokens)))
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    assert [a == b for a, b in zip(got, got[1:])] == (np.diff(group) == 0).tolist()


def _pack(frame, **options):
    return pack(
        frame,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        **options,
    )


def test_packing(docs, nothing):
    rows = _pack(docs, with_ids=True).collect()
    assert sum(r.piece == 0 for r in rows) == len(DOCS)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    for empty in (4, 5):
        assert [(r.length, r.start) for r in rows if r.doc_id == empty] == [(1, 0)]
    fills = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 2048
    assert _pack(nothing).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    random = np.random.default_rng(seed)
    capacity = 256
    n = int(random.integers(1, 3000))
    lengths = np.clip(random.lognormal(3 + seed / 3, 1, n), 1, capacity).astype(int)
    counts = np.bincount(lengths, minlength=capacity + 1)
    planned = plan(counts, capacity)
    got = np.zeros(capacity + 1, int)
    for times, own in planned:
        assert sum(own) <= capacity
        for length in own:
            got[length] += times
    assert (got == counts).all()
    used = sum(times for times, _ in planned)
    free, best_fit = [0] * (capacity + 1), 0
    for length in sorted(lengths, reverse=True):
        room = next((f for f in range(length, capacity + 1) if free[f]), None)
        if room is None:
            best_fit, room = best_fit + 1, capacity
        else:
            free[room] -= 1
        free[room - length] += 1
    assert used <= best_fit * 1.02 + 1
    seen = set()
    for length, first, until, each, sequence, offset in places(planned):
        for k in range(until - first):
            place = (sequence + k // each, offset + k % each * length)
            assert place not in seen
            seen.add(place)
    assert len(seen) == n


def test_personal_data(spark, docs, nothing):
    tricky = [
        "a@b@c.d, x.y+z@m.example.com._q@n.org a@b.c.d.e", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255",
        "4539 1488 0343 6467 and 4539148803436468, 4539-1488-0343-6467-", "+1 (555) 010-9999 +12 +1-2",
        "é 日本 +44 20 7946 0958 x@y.zz", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", None, "", "9" * 3000, "a" * 3000,
        "x@" + "y." * 5000 + "z", "call +1.2.3.4.5.6.7.8.9.0 or 10.0.0.1 " * 700,
    ]
    frame = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    rows = find_personal_data(frame).select(
        "doc_id", joined_spans(F.filter("spans", lambda s: s["base"])).alias("found")
    )
    got = {r.doc_id: r.found for r in rows.collect()}
    for i, text in enumerate(tricky):
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in brute.personal(text)), text
    assert find_personal_data(docs).count() == len(DOCS)
    assert find_personal_data(nothing).collect() == []


def test_added_personal_data(spark):
    frame = spark.createDataFrame(
        [
            (1, "Transfer to IBAN GB82 WEST 1234 5698 7654 32 please"),
            (2, "Reference GB83WEST12345698765432 fails"),
            (3, "social security number 078-05-1120"),
            (4, "part 078-05-1120"),
        ],
        "doc_id long, text string",
    )
    got = {
        r.doc_id: [(s.kind, s.text, round(s.score, 2)) for s in r.spans]
        for r in find_personal_data(frame).collect()
    }
    assert got == {
        1: [("iban", "GB82 WEST 1234 5698 7654 32", 1.0)], 2: [], 3: [("ssn", "078-05-1120", 0.6)], 4: [],
    }


def test_mixing(docs, nothing):
    queue, served = mix(docs)
    rows = taken(queue, served).collect()
    assert len(rows) == len(DOCS)
    sizes, got = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        got[r.source] = got.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    for source, target in brute.targets(sizes).items():
        assert target - 1 <= got[source] <= target + 1e-6
    order = [(r.finish, r.before) for r in served.orderBy("before").collect()]
    assert order == sorted(order)
    assert taken(*mix(nothing)).collect() == []
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(brute.WORD.findall(r.text)) for r in mixed.collect()) == sum(got.values())


def test_quality(docs, nothing):
    rated = rate_quality(docs, docs.filter("doc_id = 7").select("doc_id")).collect()
    assert len(rated) == len(DOCS)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    by_text = {}
    for r in rated:
        by_text.setdefault(r.text, r)
    for d in DOCS:
        assert tuple(by_text[d[1]][n] for n in names) == brute.quality(d[1])
    assert rate_quality(nothing, nothing.select("doc_id")).collect() == []
    untrusted = rate_quality(docs, nothing.select("doc_id")).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in untrusted)


PAGES = [
    (1, "http://a/ b", "<p>x</p>\r\n\r\nWARC/1.0\r\n"), (2, None, "<p>x</p>\r\n\r\nWARC/1.0\r\n"), (3, "http://c", None),
    (4, "http://c", ""), (None, "http://d", "é"), (5, "http://e", "é"), (5, "http://e", "é"), (6, "http://f", "z" * 300_000),
]


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.archive_pages(pages, version).collect()
    assert len(rows) == len(PAGES)
    got = sorted((r.source_id or 0, r.warc_type, r.refers_to_id, r.payload_bytes) for r in rows)
    assert got == [
        (0, "revisit", 5, 2), (1, "revisit", 2, 22), (2, "response", None, 22), (3, "revisit", 4, 0),
        (4, "response", None, 0), (5, "response", None, 2), (5, "revisit", 5, 2), (6, "response", None, 300_000),
    ]
    assert len({r.record_id for r in rows}) == len(rows)
    large = warc.archive_pages(pages, version, min_bytes=3).collect()
    assert sum(r.warc_type == "revisit" for r in large) == 1
    assert warc.archive_pages(pages.filter("page_id > 100")).collect() == []


def test_arc_files(spark, tmp_path):
    for version in (1, 2):
        data = warc.arc_header(version, "t.arc", "1999") + b"\n"
        blocks = [b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\n\n", b"plain\ntext", b""]
        for i, block in enumerate(blocks):
            data += warc.arc_record(version, f"http://h/{i}", "19990203040506", "text/plain", block)
        (tmp_path / f"v{version}.arc").write_bytes(data)
        rows = sorted(warc.read_arc(spark, str(tmp_path / f"v{version}.arc")).collect(), key=lambda r: r.seq)
        assert [r.warc_type for r in rows] == ["warcinfo", "response", "resource", "resource"]
        assert [bytes(r.block) for r in rows[1:]] == blocks
        assert [r.date for r in rows[:2]] == ["1999-01-01T00:00:00Z", "1999-02-03T04:05:06Z"]
        assert rows[1].payload_bytes == 6
        assert rows[1].payload_digest == warc.digest(b"body\n\n")
    reader = warc.ArcReader()
    whole = [r for i in range(0, len(data)) for r in reader.feed(data[i : i + 1])]
    assert [r.block for r in whole[1:]] == blocks
    assert list(warc.ArcReader().feed(b"http://x 0 19990101 broken\n"))[0].error


def test_licences(spark, docs, nothing):
    model = train(["some other text about nothing in particular"] * 30)
    from gavel.llm.licences import _features, _logits, _of_texts

    texts, classes = variants(99, 30)
    found = _of_texts(texts)
    buckets, owner = _features(found.hashes, found.first, found.count)
    guess = _logits(model, buckets, owner, len(texts)).argmax(axis=1)
    assert (guess == np.array(classes)).mean() > 0.97
    lines = "Some prose here.\nReleased under the MIT License.\n\nThe license of drivers is under version 2.0 of the law."
    frame = spark.createDataFrame([(1, lines)], "doc_id long, text string")
    row = scan_licences(frame).first()
    assert row.n_paragraphs == 3
    assert [(x.paragraph, x.start, x.family) for x in row.found] == [(1, 17, "mit")]
    assert all(r.found == [] for r in scan_licences(docs).collect())
    assert scan_licences(nothing).collect() == []
    assert FAMILIES == sorted(FAMILIES)


TOOLS = {"find": {"q": ("string", True), "n": ("integer", False)}, "open": {"of": ("object", True)}}
MESSAGES = (
    "conv_id long, turn long, role string, text string, "
    "calls array<struct<id:string,name:string,arguments:string>>, call_id string, level string"
)


def test_tool_calls(spark):
    def said(turn, role, calls=None, call_id=None, conv=1, text="t"):
        return (conv, turn, role, text, calls, call_id, "x")

    frame = spark.createDataFrame(
        [
            said(0, "user", text='say "é"\n'),
            said(1, "assistant", [("b", "open", '{"of": {"$ref": "a"}}'), ("a", "find", '{"n": 2, "q": "x"}')]),
            said(2, "tool", call_id="a"),
            said(3, "tool", call_id="b"),
            said(4, "tool", call_id="a"),
            said(5, "assistant", [("a", "find", '{"q": "again"}'), ("c", "find", '{"q": 1, "z": 0}'), ("d", "no", "{}")]),
            said(6, "assistant", [("e", "open", '{"of": {"$ref": "f"}}'), ("f", "open", '{"of": {"$ref": "e"}}')]),
            said(7, "assistant", [("g", "open", '{"of": {"$ref": "zz"}}'), ("h", "find", "not json"), (None, "find", '{"q": ""}')]),
            said(8, "tool", call_id="unknown"),
            said(None, "tool", None, None, None, None),
            said(0, "assistant", [], None, None),
        ],
        MESSAGES,
    )
    rows = link_tool_calls(frame, TOOLS).collect()
    calls = [(json.loads(r.json)["id"], r.status) for r in rows if r.kind == "call"]
    assert sorted(calls, key=str) == sorted(
        [
            ("a", "linked"), ("b", "linked"), ("a", "duplicate"), ("c", "invalid"), ("d", "invalid"), ("e", "unresolved"),
            ("f", "unresolved"), ("g", "unresolved"), ("h", "invalid"), (None, "unanswered"),
        ],
        key=str,
    )
    results = {(r.turn, r.status) for r in rows if r.kind == "result"}
    assert results == {(2, "linked"), (3, "linked"), (4, "duplicate"), (8, "orphan"), (None, "orphan")}
    order = {json.loads(r.json).get("id") or json.loads(r.json).get("tool_call_id"): r.position
             for r in rows if r.conv_id == 1 and r.status == "linked" and r.kind == "call"}
    returned = {json.loads(r.json)["tool_call_id"]: r.position for r in rows if r.kind == "result" and r.status == "linked"}
    assert order["a"] < returned["a"] < order["b"] < returned["b"]
    assert sorted(r.position for r in rows if r.conv_id == 1) == list(range(1, 1 + sum(r.conv_id == 1 for r in rows)))
    errors = {json.loads(r.json)["id"]: r.errors for r in rows if r.status == "invalid"}
    assert errors["c"] == ["q is not of type string", "z is not a parameter"]
    assert errors["d"] == ["unknown tool"] and errors["h"] == ["arguments are not a JSON object"]
    for r in rows:
        text = json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.json == text
    assert link_tool_calls(frame.filter("conv_id > 9"), TOOLS).collect() == []


def test_stages(spark, docs, nothing, tmp_path):
    labels = spark.createDataFrame([(7, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, nothing):
        given = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            if name != "best-fit packing":
                assert out.columns == docs.columns
            path = f"{tmp_path}/{name}-{frame is docs}"
            out.write.parquet(path)
            given = spark.read.parquet(path)
    assert given.count() == 0


CLASHING = "tokens _size _made _words _text _shapes _bits _places _lines _sorted _row _rows _tokens score kept n_words row_id KEEP_ID".split()


def test_stages_leave_columns_of_any_name_as_they_are(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = []
    for i in range(40):
        text = " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(80))
        rows.append((i, text if i % 10 else rows[i - 1][1] if i else text, "en", f"s{i % 3}", len(text)))
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = plain.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert out.columns == given.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
        found = given.collect()
        assert found
        for r in found:
            assert [r[c] for c in CLASHING] == [f"{c} {r.doc_id}" for c in CLASHING], name
    assert len({r.doc_id for r in found}) < 40


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [
        "a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|>\n\n<|endoftext|>x <|endoftext|", "plain words", "<|ENDOFTEXT|>",
        "many " * 3000 + "<|endoftext|>" + " more" * 100,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = pack(
        frame, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True,
        added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )
    got = {}
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert 50256 in got[0]


def test_remove_repeats_of_wide_strings(spark):
    """Runs of more windows than a byte counts."""
    passage = "".join(chr(97 + (i * i * 7 + i // 26) % 26) for i in range(1500))
    rows = [(1, "start " + passage), (2, passage[100:] + " end"), (3, passage[:350])]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=400).collect()}
    want = {d: v[:2] for d, v in brute.repeats(rows, 400).items()}
    assert got == want and want[2][1] == 1400 and want[3][1] == 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=70_000)

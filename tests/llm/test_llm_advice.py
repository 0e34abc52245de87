"""Cases of the second review: each was wrong or left out before."""

import json
import pathlib
import re
import sys

import numpy as np

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent)]

import brute  # noqa: E402

from gavel.llm import warc  # noqa: E402
from gavel.llm.licences import scan_licences  # noqa: E402
from gavel.llm.suffix_dedup import remove_repeats  # noqa: E402
from gavel.llm.tool_calls import link_tool_calls  # noqa: E402


def test_repeats_with_single_changes(spark):
    """Windows that differ in the lowest bit of one character are different."""
    random = np.random.default_rng(5)
    letters = np.array(list("acegikmoqsuwy 02468"))
    rows = []
    for n in range(40):
        passage = "".join(random.choice(letters, 260))
        at = int(random.integers(90, 170))
        for k, new in enumerate("23bcrs"):
            rows.append((10 * n + k, passage[:at] + new + passage[at + 1 :]))
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = brute.repeats(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, len(r.starts)) == wanted[r.doc_id][:3], r.doc_id


def linked_by_hand(talk):
    """{(kind, turn, index): (level, position, status, json)} of one conversation of unique turns."""
    made, answers = {}, {}
    for turn, role, calls, call_id in talk:
        for index, (id_, _, arguments) in enumerate(calls or []):
            made.setdefault(id_, (turn, index, arguments))
        if role == "tool":
            answers.setdefault(call_id, turn)
    needs = {i: set(re.findall(r'"\$ref": "([^"]+)"', c[2])) for i, c in made.items()}
    place, found = {}, True
    while found:
        found = [i for i in made if i not in place and all(n in place for n in needs[i])]
        for i in found:
            before = [(place[n][0] + 1, max(place[n][1], answers.get(n, 0))) for n in needs[i]]
            place[i] = (
                max([x[0] for x in before], default=0), max([made[i][0], *(x[1] for x in before)])
            )
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    events = []
    for turn, role, calls, call_id in talk:
        if role == "tool":
            level, at = place.get(call_id, (0, turn))
            status = "orphan" if call_id not in made else "linked" if answers[call_id] == turn else "duplicate"
            text = dump({"role": role, "content": "t", "tool_call_id": call_id})
            events.append((max(at, turn), level, 2, turn, 0, "result", status, text))
            continue
        text = dump({"role": role, "content": "t", "tool_calls": [c[0] for c in calls or []]})
        events.append((turn, 0, 0, turn, 0, "message", None, text))
        for index, (id_, name, arguments) in enumerate(calls or []):
            level, at = place.get(id_, (0, made[id_][0]) if made[id_][:2] == (turn, index) else (0, turn))
            status = (
                "duplicate" if made[id_][:2] != (turn, index)
                else "unresolved" if id_ not in place
                else "linked" if id_ in answers else "unanswered"
            )
            text = dump({"type": "tool_call", "id": id_, "name": name, "arguments": json.loads(arguments)})
            events.append((at, level, 1, turn, index, "call", status, text))
    return {
        (kind, turn, index): (level, position, status, text)
        for position, (_, level, _, turn, index, kind, status, text) in enumerate(sorted(events, key=lambda e: e[:5]), 1)
    }


def talks_with_needs():
    """Chains back, ahead and meeting, circles, missing needs, by conversation."""
    random = np.random.default_rng(3)
    for conv in range(24):
        n = 70 if conv < 4 else int(random.integers(2, 14))
        talk = []
        for i in range(n):
            needs = set()
            if conv % 4 == 0 and i:
                needs = {i - 1}  # the query's own chains, deep
            elif conv % 4 == 1 and (i < n - 1 or conv > 12):
                needs = {(i + 1) % n}  # ahead, and then around
            elif conv % 4 == 2 and i:
                needs = {i - 1, int(random.integers(0, i))}
            elif conv % 4 == 3:
                needs = set(random.integers(0, n + 1 if random.random() < 0.2 else n, random.integers(0, 2 + (i % 5 == 0))).tolist())
            refs = {f"k{k}": {"$ref": f"c{k}"} for k in sorted(needs)}
            talk.append((3 * i, "assistant", [(f"c{i}", "go", json.dumps({"of": refs}))], None))
            if random.random() < 0.8:
                talk.append((3 * i + 1, "tool", None, f"c{i}"))
        yield conv, talk


def test_levels_of_all_calls(spark):
    talks = dict(talks_with_needs())
    rows = [(conv, turn, role, "t", calls, call_id) for conv, talk in talks.items() for turn, role, calls, call_id in talk]
    schema = (
        "conv_id long, turn long, role string, text string, "
        "calls array<struct<id:string,name:string,arguments:string>>, call_id string"
    )
    events = link_tool_calls(spark.createDataFrame(rows, schema).coalesce(1), {"go": {"of": ("object", True)}})
    got: dict = {}
    for r in events.collect():
        got.setdefault(r.conv_id, {})[(r.kind, r.turn, r["index"])] = (r.level, r.position, r.status, r.json)
    for conv, talk in talks.items():
        assert got[conv] == linked_by_hand(talk), conv
    assert max(v[0] for v in got[0].values()) == 69
    assert all(v[2] == "unresolved" for v in got[13].values() if v[2] not in (None, "linked"))
    assert any(v[2] == "unresolved" for v in got[13].values())


def test_split_and_cut_arc_files(spark, tmp_path):
    """Files of many splits give all records, and the record cut at a file's end is an error."""
    blocks = [f"record {i}\n".encode() * (i % 400) for i in range(600)]
    data = warc.arc_header(1, "t.arc") + b"\n"
    for i, block in enumerate(blocks):
        data += warc.arc_record(1, f"http://h/{i}", "1999", "text/plain", block)
    (tmp_path / "a.arc").write_bytes(data)
    (tmp_path / "b.arc").write_bytes(data[: -len(blocks[-1]) // 2])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        whole = warc.read_arc(spark, str(tmp_path / "a.arc")).collect()
        both = warc.read_arc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [bytes(r.block) for r in sorted(whole, key=lambda r: r.seq)[1:]] == blocks
    assert not any(r.error for r in whole) and len({r.seq for r in both}) == len(both)
    cut = [r.error for r in both if r.error]
    assert len(cut) == 1 and cut[0].startswith("record cut short: http://h/599 ")
    assert len(both) == 2 * len(whole)


WRAPPED = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
        'of this software and associated documentation files (the "Software"), to deal\n'
        "in the Software without restriction, including without limitation the rights\n",
        {(1, "mit")},
    ),
    (
        "This program is free software: you can redistribute it and/or modify\n"
        "it under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n",
        {(1, "gpl")},
    ),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.\n", {(1, "mit"), (1, "apache")}),
    ("SPDX-License-Identifier: Zlib\n", set()),
]


def test_wrapped_and_dual_licences(spark):
    rows = [(i, f"drobal\n\n{notice}\nsome lines\n") for i, (notice, _) in enumerate(WRAPPED)]
    for row in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert {(x.paragraph, x.family) for x in row.found} == WRAPPED[row.doc_id][1], row
        if row.doc_id == 3:
            assert [x.paragraph for x in row.unknown] == [1]

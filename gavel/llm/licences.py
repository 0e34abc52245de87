"""Licence scan: a trained classifier of paragraphs, confirmed against templates.

Every line of every document is scored by multinomial logistic regression over hashed
word 1- to 3-grams, with one class per licence family and one for all other text. The model is
trained here: on variants of public licence notices, and on corpus paragraphs that share little with
any of them. A temperature fitted on held-out variants calibrates the probabilities; a paragraph
whose best family stays under ``MIN_PROBABILITY`` is unknown. What is left is confirmed by the share
of the template's word pairs that the paragraph holds.

Notices may be wrapped over lines, and a line may hold several. So all places that hold the share of a
template's word pairs are scored as well, each by itself, over the joined lines between blank ones.
A line that looks like a notice and has a word of licences but no confirmed family is listed as unknown.

Training sees a bounded sample of paragraphs (``NEGATIVES``); scoring covers all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavel.llm.common import regrouped
from gavel.llm.textkit import CHUNK_BYTES, binary_parts, mix, words

#: Hash buckets of n-grams.
FEATURES = 1 << 14
#: Corpus paragraphs that the class of other text is trained on, by hash of their text.
NEGATIVES = 4000
#: Longer lines, in characters, are scanned but not trained on.
MAX_LINE = 2000
#: Variants of each template used for training, and as many for calibration.
VARIANTS = 150
MIN_PROBABILITY = 0.6
#: Share of a template's word pairs that a paragraph must hold.
MIN_SHARED = 0.5
#: Words of a place that may hold a notice, as a multiple of the template's.
SPREAD = 1.5

# Short public notices by which works name their licence.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
FAMILIES = sorted(TEMPLATES)
# Words by which a notice says that it is one, with or without punctuation behind.
_TERMS = "license licence licensed licenced licenses licensing sublicense spdx-license-identifier copyright".split()
#: Words put into variants in the place of others.
_FILLER = "this the software work file code package module and its under with a of to text".split()


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # features x classes; class 0 is other text
    bias: np.ndarray
    temperature: float


@dataclass
class Paragraphs:
    """Lines with a word, of several texts."""

    text: np.ndarray
    start: np.ndarray  # byte of the text
    first: np.ndarray  # word
    count: np.ndarray
    hashes: np.ndarray  # of all words
    number: np.ndarray  # within the text
    block: np.ndarray | None = None  # lines without a blank one between have the same


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> Paragraphs:
    found = words(data, offsets)
    text = np.repeat(np.arange(len(found.counts)), found.counts)
    breaks = np.cumsum(data == 10)  # a word holds none, so its first byte has its line
    line = breaks[found.starts] if len(found.starts) else np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(text)))
    owner = text[first]
    begins = np.ones(len(owner), bool)
    begins[1:] = owner[1:] != owner[:-1]
    number = np.arange(len(owner)) - np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(owner) else owner
    at = line[first]
    apart = np.ones(len(owner), bool)
    apart[1:] = begins[1:] | (at[1:] > at[:-1] + 1)
    start = found.starts[first] - offsets[owner]
    return Paragraphs(owner, start, first, count, found.hashes, number, np.cumsum(apart) - 1)


def _grams(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, n: int):
    """(hashes of n-grams, paragraph of each); none cross a paragraph."""
    sizes = np.maximum(count - n + 1, 0)
    owner = np.repeat(np.arange(len(first)), sizes)
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    value = np.full(len(at), np.uint64(n))
    for i in range(n):
        value = value * np.uint64(0x9FB21C651E98DF25) + hashes[at + i]
    return mix(value), owner


def _features(hashes: np.ndarray, first: np.ndarray, count: np.ndarray):
    """(buckets, paragraph of each) of all 1- to 3-grams."""
    parts = [_grams(hashes, first, count, n) for n in (1, 2, 3)]
    buckets = np.concatenate([p[0] for p in parts]) % np.uint64(FEATURES)
    return buckets.astype(np.int64), np.concatenate([p[1] for p in parts])


def _logits(model: Model, buckets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    out = np.empty((n, model.weights.shape[1]))
    for c in range(out.shape[1]):
        out[:, c] = np.bincount(owner, model.weights[buckets, c], n)
    return out / np.sqrt(size)[:, None] + model.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _of_texts(texts: list[str]) -> Paragraphs:
    """Each text, its lines joined, as one paragraph."""
    data, offsets = binary_parts(
        pa.array([" ".join(t.split("\n")).encode() or b"" for t in texts], pa.binary())
    )
    found = words(data, offsets)
    first = np.cumsum(found.counts) - found.counts
    n = np.arange(len(texts))
    return Paragraphs(n, offsets[:-1], first, found.counts, found.hashes, n)


def variants(seed: int, count: int = VARIANTS) -> tuple[list[str], list[int]]:
    """Notices with words left out, replaced or added around them, and their classes.

    Words that only one family's notices have always stay: they are what names it.
    """
    random = np.random.default_rng(seed)
    texts, classes = [], []
    used = {f: {w for t in TEMPLATES[f] for w in t.split()} for f in FAMILIES}
    for number, family in enumerate(FAMILIES, 1):
        own = used[family].difference(*(used[f] for f in FAMILIES if f != family))
        for template in TEMPLATES[family]:
            for i in range(count):
                kept = template.split()
                if i % 4:
                    kept = [w for w in kept if w in own or random.random() > 0.08]
                    kept = [
                        _FILLER[random.integers(len(_FILLER))]
                        if w not in own and random.random() < 0.05
                        else w
                        for w in kept
                    ]
                if i % 3 == 0:
                    before = random.choice(_FILLER, random.integers(0, 8)).tolist()
                    kept = before + kept + random.choice(_FILLER, random.integers(0, 8)).tolist()
                text = " ".join(kept)
                texts.append(text.upper() if i % 7 == 3 else text)
                classes.append(number)
    return texts, classes


def _pairs(found: Paragraphs) -> list[np.ndarray]:
    hashes, owner = _grams(found.hashes, found.first, found.count, 2)
    cuts = np.searchsorted(owner, np.arange(len(found.first) + 1))
    return [np.unique(hashes[i:j]) for i, j in zip(cuts, cuts[1:])]


def _template_pairs() -> list[tuple[int, np.ndarray]]:
    flat = [(n, t) for n, f in enumerate(FAMILIES, 1) for t in TEMPLATES[f]]
    return [(n, p) for (n, _), p in zip(flat, _pairs(_of_texts([t for _, t in flat])))]


def shared_with_template(pairs: np.ndarray, family: int, templates) -> float:
    """Largest share of a family template's word pairs that are among ``pairs``."""
    return max(
        (float(np.isin(own, pairs).mean()) if len(own) else 0.0)
        for number, own in templates
        if number == family
    )


def _with_terms(lines: Paragraphs) -> np.ndarray:
    """Whether a line has a word that tells of licences."""
    terms = np.unique(_of_texts([" ".join(t + end for t in _TERMS for end in ("", *".,;:"))]).hashes)
    owner = np.repeat(np.arange(len(lines.first)), lines.count)
    return np.bincount(owner[np.isin(lines.hashes, terms)], minlength=len(lines.first)) > 0


def _places(lines: Paragraphs, templates) -> list[tuple[int, int, int, float]]:
    """(family, first word, words, share) of the places that hold enough of a template.

    Places begin and end with a word pair of the template, or have as many words as it; they stay
    within a block. Of places of one template that overlap, the one with the largest share is given.
    """
    if not len(lines.first):
        return []
    n = len(lines.hashes)
    blocks = np.flatnonzero(np.diff(lines.block, prepend=-1))
    first = lines.first[blocks]
    ends = np.append(first[1:], n)
    pairs, owner = _grams(lines.hashes, first, ends - first, 2)
    words_at = np.arange(len(pairs)) + owner  # a block has one pair less than words
    known = np.unique(np.concatenate([own for _, own in templates]))
    slot = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    hits = np.flatnonzero(known[slot] == pairs)
    pairs, owner, words_at = pairs[hits], owner[hits], words_at[hits]
    found = []
    for family, own in templates:
        mine = np.flatnonzero(np.isin(pairs, own))
        need, size = int(np.ceil(MIN_SHARED * len(own))), len(own) + 1
        if not len(own) or len(mine) < need:
            continue
        at, value, block = words_at[mine], pairs[mine], owner[mine]
        until = np.searchsorted(at, at + int(np.ceil(SPREAD * size)) - 1)
        until = np.minimum(until, np.searchsorted(block, block, "right"))
        able = []
        for i in np.flatnonzero(until - np.arange(len(at)) >= need).tolist():
            share = len(np.unique(value[i : until[i]])) / len(own)
            if share >= MIN_SHARED:
                end = max(at[until[i] - 1] + 2, min(at[i] + size, ends[block[i]]))
                able.append((-share, int(at[i]), int(end)))
        # Places that overlap follow each other by their first words.
        able.sort(key=lambda x: x[1])
        best: list[tuple] = []
        for place in able:
            if best and place[1] < best[-1][2]:
                best[-1] = min(best[-1], place)
            else:
                best.append(place)
        found += [(family, begin, end - begin, -share) for share, begin, end in best]
    return found


def train(others: list[str], seed: int = 7, rounds: int = 120) -> Model:
    """Softmax regression with L2 by gradient steps with momentum; the temperature on held-out
    variants. ``others`` are corpus paragraphs; those that hold half a template are left out."""
    templates = _template_pairs()
    mine, classes = variants(seed)
    held, held_classes = variants(seed + 1, VARIANTS // 3)
    clean = []
    for text, pairs in zip(others, _pairs(_of_texts(others)) if others else []):
        if all(np.isin(own, pairs).mean() < 0.3 for _, own in templates if len(own)):
            clean.append(text)
    # Prose without any notice's words, so that a small corpus has its class as well.
    random = np.random.default_rng(seed)
    clean += [" ".join(random.choice(_FILLER, 12)) for _ in range(200)]
    split = len(clean) * 3 // 4
    mine, classes = mine + clean[:split], classes + [0] * split
    held, held_classes = held + clean[split:], held_classes + [0] * (len(clean) - split)

    found = _of_texts(mine)
    buckets, owner = _features(found.hashes, found.first, found.count)
    n, k = len(mine), len(FAMILIES) + 1
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    target = np.eye(k)[classes]
    balance = (n / k / np.maximum(target.sum(axis=0), 1))[classes]
    weights, bias = np.zeros((FEATURES, k)), np.zeros(k)
    speed_w, speed_b = np.zeros_like(weights), np.zeros(k)
    for _ in range(rounds):
        p = _softmax(_logits(Model(weights, bias, 1.0), buckets, owner, n))
        error = (p - target) * balance[:, None] / n
        slope = np.empty_like(weights)
        per_gram = (error * scale[:, None])[owner]
        for c in range(k):
            slope[:, c] = np.bincount(buckets, per_gram[:, c], FEATURES)
        speed_w = 0.9 * speed_w - 2.0 * (slope + 1e-5 * weights)
        speed_b = 0.9 * speed_b - 2.0 * error.sum(axis=0)
        weights, bias = weights + speed_w, bias + speed_b

    found = _of_texts(held)
    buckets, owner = _features(found.hashes, found.first, found.count)
    z = _logits(Model(weights, bias, 1.0), buckets, owner, len(held))
    rows = np.arange(len(held))
    losses = {
        t: -np.log(_softmax(z / t)[rows, held_classes] + 1e-12).mean()
        for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
    }
    return Model(weights, bias, min(losses, key=losses.get))


_FOUND = (
    "doc_id long, n_paragraphs long, "
    "found array<struct<paragraph:long,start:long,family:string,probability:double,shared:double>>, "
    "unknown array<struct<paragraph:long,start:long,probability:double>>"
)


def _sampled_lines(docs: DataFrame, n: int) -> list[str]:
    """The ``n`` distinct lines of a sixteenth of the documents that come first by hash.

    A first pass estimates how many there are and so the hash under which about twice as many as asked for
    lie; only those are sent to the driver, whatever the input is. Lines over ``MAX_LINE`` characters
    are no training data.
    """
    lines = (
        docs.filter(F.pmod(F.xxhash64("text"), F.lit(16)) == 0)
        .select(F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line"))
        .filter(F.length("line") <= MAX_LINE)
        .filter(r"line rlike '[^\x20\x09-\x0D]'")
        .select(F.xxhash64("line").alias("h"), "line")
    )
    there = lines.agg(F.approx_count_distinct("h")).first()[0]
    share = 2 * n / max(there, 1)
    if share < 1:
        lines = lines.filter(F.col("h") < int(share * 2**64) - 2**63)
    chosen = lines.distinct().limit(4 * n).collect()
    return [row.line for row in sorted(chosen, key=lambda row: (row.h, row.line))[:n]]


def scan_licences(docs: DataFrame, negatives: int = NEGATIVES, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_paragraphs (lines with a word), and found: the licence
    paragraphs with number, start (byte), family, probability and share of the template. A notice over
    several lines is found at its first one, and a line may hold several families. ``unknown``: the
    lines with a word of licences that are likely some notice, but of no family that could be
    confirmed there.

    Defined cases: null and empty texts have no paragraphs; null ids and repeated rows are scanned
    like others; equal probabilities go to the first family by name; an empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    model = train(_sampled_lines(docs, negatives), seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, templates = shared.value, _template_pairs()
        for table in regrouped(batches, "text", 4 << 20):
            data, offsets = binary_parts(table.column("text"))
            ids = table.column("doc_id").to_pylist()
            at = 0
            while at < len(ids):
                until = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES)) - 1
                until = min(max(at + 1, until), len(ids))
                part = data[offsets[at] : offsets[until]]
                lines = _paragraphs(part, offsets[at : until + 1] - offsets[at])
                totals = np.bincount(lines.text, minlength=until - at)
                found: list[list[dict]] = [[] for _ in range(until - at)]
                unknown: list[list[dict]] = [[] for _ in range(until - at)]
                buckets, owner = _features(lines.hashes, lines.first, lines.count)
                z = _logits(model, buckets, owner, len(lines.first)) / model.temperature
                p = _softmax(z) if len(z) else z
                best = p[:, 1:].argmax(axis=1) + 1 if len(z) else np.zeros(0, int)
                likely = np.flatnonzero(p[np.arange(len(best)), best] >= MIN_PROBABILITY)
                confirmed: dict[tuple[int, int], tuple[float, float]] = {}
                covered = np.zeros(len(lines.first), bool)
                for i in likely.tolist():
                    own, _ = _grams(lines.hashes, lines.first[i : i + 1], lines.count[i : i + 1], 2)
                    share = shared_with_template(np.unique(own), int(best[i]), templates)
                    if share >= MIN_SHARED:
                        confirmed[i, int(best[i])] = float(p[i, best[i]]), share
                        covered[i] = True
                whole = set(confirmed)
                places = _places(lines, templates)
                if places:
                    family, begin, size, share = (np.array(c) for c in zip(*places))
                    buckets, owner = _features(lines.hashes, begin, size)
                    q = _softmax(_logits(model, buckets, owner, len(begin)) / model.temperature)
                    q = q[np.arange(len(begin)), family]
                    head = np.searchsorted(lines.first, begin, "right") - 1
                    tail = np.searchsorted(lines.first, begin + size, "left")
                    good = np.flatnonzero(q >= MIN_PROBABILITY)
                    for k in good[np.argsort(-q[good], kind="stable")].tolist():
                        kind = int(family[k])
                        # The notice that a line was confirmed by is not found in it again.
                        if not any((i, kind) in whole for i in range(head[k], tail[k])):
                            confirmed.setdefault((int(head[k]), kind), (float(q[k]), float(share[k])))
                        covered[head[k] : tail[k]] = True
                for (i, kind), (chance, share) in sorted(confirmed.items()):
                    found[lines.text[i]].append(
                        {
                            "paragraph": int(lines.number[i]),
                            "start": int(lines.start[i]),
                            "family": FAMILIES[kind - 1],
                            "probability": round(chance, 6),
                            "shared": round(share, 6),
                        }
                    )
                some = 1 - p[:, 0] if len(z) else np.zeros(0)
                for i in np.flatnonzero((some >= MIN_PROBABILITY) & _with_terms(lines) & ~covered).tolist():
                    unknown[lines.text[i]].append(
                        {
                            "paragraph": int(lines.number[i]),
                            "start": int(lines.start[i]),
                            "probability": round(float(some[i]), 6),
                        }
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at:until], pa.int64()),
                        pa.array(totals.astype(np.int64)),
                        pa.array(found, _FOUND_TYPE),
                        pa.array(unknown, _UNKNOWN_TYPE),
                    ],
                    names=["doc_id", "n_paragraphs", "found", "unknown"],
                )
                at = until

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    ).mapInArrow(run, _FOUND)


_FOUND_TYPE = pa.list_(
    pa.struct(
        [
            ("paragraph", pa.int64()),
            ("start", pa.int64()),
            ("family", pa.string()),
            ("probability", pa.float64()),
            ("shared", pa.float64()),
        ]
    )
)

_UNKNOWN_TYPE = pa.list_(
    pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("probability", pa.float64())])
)

"""The results of the registered queries in plain Python, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _order(doc_id):
    return (doc_id is None, doc_id or 0)


def repeats(rows, width=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for unique ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: _order(r[0])):
        raw = (text or "").encode()
        removed = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            window = raw[p : p + width]
            if window in seen:
                removed[p : p + width] = b"\x01" * width
            seen.add(window)
        kept = bytes(b for b, r in zip(raw, removed) if not r)
        spans = len(re.findall(rb"\x01+", bytes(removed)))
        out[doc_id] = (len(raw), sum(removed), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(rows, width=4, similarity=80):
    """{doc_id: (n_shingles, component_id, kept)} over all pairs that share a shingle."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            u, v = sorted((find(a), find(b)))
            root[v] = u
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """Base spans (kind, start, end) in order."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = defaultdict(int)
    for w in windows:
        count[w] += 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, again = len(words), len(covered)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        again,
        n < 50 or 100 * again > 50 * n,
    )


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """{source: target} by resharing; sizes maps source (None is last) to size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    total = budget * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: most * sizes[s] for s in over})

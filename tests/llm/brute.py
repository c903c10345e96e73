"""Plain-Python versions of what the operators must give."""

from __future__ import annotations

import hashlib
import re

SPACE = rb"[\x20\x09-\x0D]+"
WORD = rb"[^\x20\x09-\x0D]+"


def raw(text):
    return (text or "").encode()


def repeated_bytes(docs, window=50):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    first = {}
    for d, t in docs:
        b = raw(t)
        for i in range(len(b) - window + 1):
            w = b[i:i + window]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in docs:
        b = raw(t)
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < d:
                gone[i:i + window] = b"\x01" * window
        out[d] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def repeated_words(docs, window=20):
    """doc_id -> (words, removed, digest of the rest)."""
    words = {d: re.findall(WORD, raw(t)) for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i:i + window]), (d, i))
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i:i + window])] != (d, i):
                gone[i:i + window] = [True] * window
        out[d] = (len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest())
    return out


def shingles(text, n=5):
    ws = re.findall(WORD, bytes(c + 32 if 65 <= c <= 90 else c for c in raw(text)))
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def components(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    where = components(ids, links)
    return {d: (len(sets[d]), where[d]) for d in ids}

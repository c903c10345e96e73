"""Substring deduplication by super-k-mer partitioning.

Windows of consecutive words travel to their minimiser's bucket in super-k-mers (see superkmers). In a bucket the windows
are sorted by a 128-bit digest of their words; the first of equal windows, in order of document and place, stays, the
words that later ones cover go. Windows are judged on the input.

Null text has no words. Repeated rows with one doc_id and text get the same result each; rows that share a doc_id but
not a text are judged as one document. Rows without doc_id are kept whole. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, mixed, read, rolled, window_starts, word_bounds, word_hashes
from .superkmers import _OTHER, repeated_runs, with_runs


def runs_of(which: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, end) of maximal runs of consecutive windows; input sorted by string and window."""
    if not len(which):
        return which, window, window
    head = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)])
    last = np.r_[head[1:], len(which)] - 1
    return which[head], window[head], window[last] + 1


def later_windows(first_by: int) -> callable:
    """Judge of a bucket for windows of `first_by` words."""

    def flagged(text, off, docs, starts, marks):
        hi, lo, which, place = [], [], [], []
        for i, j in blocks(off, 1 << 20):
            a, b, first = word_bounds(text[off[i]:off[j]], off[i:j + 1] - off[i])
            h = word_hashes(text[off[i]:off[j]], a, b)
            at = window_starts(first, first_by)
            string = np.searchsorted(first, at, "right") - 1
            hi.append(rolled(h, first_by)[at])
            lo.append(rolled(mixed(h ^ _OTHER), first_by)[at])
            which.append(string + i)
            place.append(at - first[string])
        hi, lo, which, place = (np.concatenate(x) for x in (hi, lo, which, place))
        # Windows whose first half of the digest is unique have no copy.
        order = np.argsort(hi, kind="stable")
        near = np.zeros(len(hi), bool)
        same = hi[order][1:] == hi[order][:-1]
        near[1:] |= same
        near[:-1] |= same
        order = order[near]
        hi, lo, which, place = hi[order], lo[order], which[order], place[order]
        order = np.lexsort((starts[which] + place, docs[which], lo, hi))
        hi, lo, which, place = hi[order], lo[order], which[order], place[order]
        head = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])][: len(hi)]
        group = np.cumsum(head) - 1
        lead = np.flatnonzero(head)[group] if len(hi) else group
        later = (docs[which] != docs[which[lead]]) | (starts[which] + place != starts[which[lead]] + place[lead])
        which, place = which[later], place[later]
        order = np.lexsort((place, which))
        return runs_of(which[order], place[order])

    return flagged


def kept_words(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, bytes]:
    """(number of words, number removed, kept words joined by one space)."""
    words = text.split()  # bytes: splits at space and 9-13
    if not len(lo):
        return len(words), 0, b" ".join(words)
    keep, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        keep += words[at:a]
        at = max(at, b)
    keep += words[at:]
    return len(words), len(words) - len(keep), b" ".join(keep)


def repeated_passages(docs: DataFrame, window: int = 20, k: int = 4) -> DataFrame:
    """doc_id, lo, hi: runs of word numbers (half-open) that windows found earlier cover; runs may overlap."""
    return repeated_runs(docs, True, window, k, later_windows(window), by_document=False)


def without_passages(docs: DataFrame, window: int = 20, k: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space, UTF-8) for every row of docs(doc_id, text, ...)."""
    return with_runs(docs, repeated_passages(docs, window, k), kept_words, "doc_id long, n_words long, n_removed long, kept binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, str]:
        n, removed, kept = kept_words(text, lo, hi)
        return n, removed, hashlib.sha256(kept).hexdigest()

    docs = read(spark, sf_dir, "documents")
    return with_runs(docs, repeated_passages(docs), digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")

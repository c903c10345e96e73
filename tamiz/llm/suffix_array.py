"""Suffix-array deduplication: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

The windows that may repeat are brought together by minimiser (see superkmers): a bucket holds every occurrence of its
windows, but for those so common that every task knows where they start first. Equal strings of a bucket are indexed
once. Pieces of a bucket are indexed one after another; a piece's strings are dealt to shards. A shard's strings are taken as circles, their suffixes sorted up to
the window's length, and the symbols before them are its transform. Shards then merge without their texts: an
interleave (which shard comes next) is refined by reading the next symbol of each shard in interleave order and dealing
the labels out by symbol, which sorts by one more symbol each round. Ranks at which a new block starts in a round have
the common prefix of the rounds before; blocks left after the last round are the repeated intervals.

A symbol is a run of bytes, numbered by its rank among those of the bucket, so that few rounds reach the window's length.

Null text is empty; texts shorter than the window lose nothing. Repeated rows with one doc_id never count as copies of
one another; rows that share a doc_id but not a text are judged as one document. Rows without doc_id are kept whole.
Extra columns are ignored; texts of any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import mixed, read
from .superkmers import byte_kmers, packed, repeated_runs, with_runs
from .substring_dedup import runs_of

WINDOW = 50
KMER = 16


class Circles:
    """Strings as circles, and the ranks of the symbols of `wide` and of `rest` bytes at every place."""

    def __init__(self, text: np.ndarray, off: np.ndarray):
        self.text, self.off = text, off
        n = np.diff(off)
        self.base = np.repeat(off[:-1], n).astype(np.int32)
        self.length = np.repeat(n, n).astype(np.int32)
        self.place = np.arange(len(text), dtype=np.int32) - self.base

    def ahead(self, by: int) -> np.ndarray:
        return self.base + (self.place + by) % self.length

    def symbols(self, window: int) -> list[tuple[int, np.ndarray]]:
        """Widths (in the order of the rounds, together `window`) and symbol ranks; the widest with at most 65,536 different ones."""
        by_width, pair = {}, self.text.astype(np.uint32)
        pair = (pair << np.uint32(8)) | pair[self.ahead(1)]
        by_width[2] = pair.astype(np.uint16)
        four, rank = np.unique((pair << np.uint32(16)) | pair[self.ahead(2)], return_inverse=True)
        if len(four) <= 1 << 16:
            by_width[4] = rank.astype(np.uint16)
        wide = max(by_width)
        rest = window % wide
        widths = ([rest] if rest else []) + [wide] * (window // wide)
        if rest == 1 or rest == 3:
            raise ValueError("window must be even")
        return [(w, by_width[w]) for w in widths]


def shard_order(before: list[tuple[np.ndarray, np.ndarray]], members: np.ndarray) -> np.ndarray:
    """Places of a shard sorted by their next `window` bytes. before: for each round (place one symbol earlier, symbol there)."""
    order = members
    for earlier, symbol in before:
        order = earlier[order]
        order = order[np.argsort(symbol[order], kind="stable")]
    return order


def merge(transforms: list[list[np.ndarray]], rounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(shard of every rank, common prefix of every rank with the one before) of the merged order.

    transforms: for each round the shards' transforms, in shard order: the symbol of that round's width before each rank.
    The first interleave is shard after shard; every round deals the labels out by the symbols they bring.
    """
    sizes = [len(x) for x in transforms[0]]
    labels = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) > 256 else np.uint8), sizes)
    block = np.zeros(len(labels), np.int32)
    common = np.full(len(labels), sum(rounds), np.int32)
    new = np.zeros(len(labels), bool)
    depth = 0
    for width, shards in zip(rounds, transforms, strict=True):
        brought = np.empty(len(labels), np.uint16)
        brought[np.argsort(labels, kind="stable")] = np.concatenate(shards)
        deal = np.argsort(brought, kind="stable")
        labels, brought, source = labels[deal], brought[deal], block[deal]
        start = np.ones(len(labels), bool)
        start[1:] = (brought[1:] != brought[:-1]) | (source[1:] != source[:-1])
        common[start & ~new] = depth
        new = start
        block = np.cumsum(start, dtype=np.int32) - 1
        depth += width
    return labels, common


def repeated_intervals(text: np.ndarray, off: np.ndarray, shard: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in merged order, common prefix with the place before, up to the window) of all suffixes of all strings.

    shard: number of each string's shard, ascending.
    """
    circles = Circles(text, off)
    symbols = circles.symbols(window)
    backs = {w: circles.base + (circles.place - w) % circles.length for w in {w for w, _ in symbols}}
    before = [(backs[w], s) for w, s in symbols]
    of = np.repeat(shard, np.diff(off))
    edges = np.searchsorted(of, np.arange(int(shard[-1]) + 2))
    orders = [shard_order(before, np.arange(a, b, dtype=np.int32)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    early = {w: s[backs[w]] for w, s in symbols}
    labels, common = merge([[early[w][o] for o in orders] for w, _ in symbols], [w for w, _ in symbols])
    places = np.empty(len(labels), np.int32)
    places[np.argsort(labels, kind="stable")] = np.concatenate(orders)
    return places, common


def judge(window: int, k: int, most: int = 1 << 20) -> callable:
    """Judge of a bucket: windows that also start in a document with a smaller id."""

    def flagged(text, off, docs, starts, marks):
        none = np.zeros(0, np.int64)
        size = np.diff(off)
        # A window has copies only in strings with its minimiser: strings whose minimiser is one document's alone are out.
        value = kmer_at(text, off[:-1] + marks, k)
        order = np.argsort(value, kind="stable")
        head = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
        d = docs[order]
        several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
        live = np.sort(order[several[group]])
        if not len(live):
            return none, none, none
        # Equal strings are indexed once, for the smallest document that has them.
        digest = string_digests(text, off, live)
        rank = np.lexsort((live, docs[live], digest))
        same = np.r_[False, digest[rank][1:] == digest[rank][:-1]]
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(rank))))
        copy = docs[live][rank] != docs[live][rank[lead]]
        copies = live[rank[same & copy]]
        own = live[rank[~same]]
        # A string with no other of its minimiser has no windows in common with any.
        alike, at = np.unique(value[own], return_inverse=True)
        own = own[(np.bincount(at, minlength=len(alike)) > 1)[at]]
        # A shared window has the minimiser and, on one side at least, half of the window's other bytes: strings that share
        # neither such half with another one are out.
        side = (window - k + 1) // 2
        reach = np.zeros(len(own), bool)
        for shift, fits in ((-side, marks[own] >= side), (0, marks[own] + k + side <= size[own])):
            some = np.flatnonzero(fits)
            _, at, n = np.unique(kmer_at(text, off[own[some]] + marks[own[some]] + shift, k + side), return_inverse=True, return_counts=True)
            reach[some[n[at] > 1]] = True
        own = own[reach]
        extra = live[rank[same & ~copy]]  # the string again in its first document
        found = [(copies, np.zeros(len(copies), np.int64), size[copies] - window + 1)]
        if not len(own):
            return found[0]
        # Strings of a minimiser stay together: pieces of the bucket of bounded size are indexed one after another.
        own = own[np.argsort(value[own], kind="stable")]
        ends = np.cumsum(size[own])
        group = np.flatnonzero(np.r_[True, value[own][1:] != value[own][:-1]])
        piece = (ends[group] // most)
        cuts = group[np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])]
        first = {}
        for i, j in zip(cuts, np.r_[cuts[1:], len(own)], strict=True):
            which, a, b = later(text, off, docs, np.sort(own[i:j]), window)
            found.append((which, a, b))
            if len(extra):
                for w, x, y in zip(which.tolist(), a.tolist(), b.tolist(), strict=True):
                    first.setdefault(w, []).append((x, y))
        if len(extra):
            leader = live[rank[lead[same & ~copy]]]
            again = [(e, x, y) for e, w in zip(extra.tolist(), leader.tolist(), strict=True) for x, y in first.get(w, ())]
            if again:
                found.append(tuple(np.array(x, np.int64) for x in zip(*again, strict=True)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return flagged


def later(text: np.ndarray, off: np.ndarray, docs: np.ndarray, strings: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, end window) of windows that occur in a string of a smaller document, through the merged transforms."""
    size = np.diff(off)[strings]
    own = np.frombuffer(packed(text, off[strings], off[strings] + size), np.uint8)
    at = np.r_[0, np.cumsum(size)]
    shards = max(2, min(64, len(own) >> 18))
    shard = np.arange(len(strings)) * shards // len(strings)
    places, common = repeated_intervals(own, at, shard, window)
    of = np.searchsorted(at, places, "right") - 1
    place = places - at[of]
    begin = np.flatnonzero(common < window)  # a repeated interval: ranks from one such to the next
    # Only whole windows count, not suffixes that run on into the circle's beginning.
    doc = np.where(place <= size[of] - window, docs[strings[of]], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.r_[begin, len(doc)]))
    hit = (doc > least) & (place <= size[of] - window)
    of, place = of[hit], place[hit]
    order = np.lexsort((place, of))
    which, a, b = runs_of(of[order], place[order].astype(np.int64))
    return strings[which], a, b


def kmer_at(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at the given places."""
    acc = np.zeros(len(at), np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + text[at + i]
        acc ^= acc >> np.uint64(31)
    return mixed(acc)


def string_digests(text: np.ndarray, off: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """16 bytes of digest of each string."""
    raw = memoryview(np.ascontiguousarray(text))
    return np.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off[strings].tolist(), off[strings + 1].tolist(), strict=True)], "S16")


def kept_bytes(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, maximal runs removed, bytes left)."""
    keep, at, removed = [], 0, 0
    for a, b in zip(lo.tolist(), np.minimum(hi, len(text)).tolist(), strict=True):
        if b > a:
            keep.append(text[at:a])
            removed, at = removed + b - a, b
    keep.append(text[at:])
    return len(text), removed, len(lo), b"".join(keep)


def repeated_bytes(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """doc_id, lo, hi: byte ranges that windows also found in smaller documents cover; ranges may overlap."""
    return repeated_runs(docs, False, window, k, judge(window, k), by_document=True, bucket_bytes=24 << 20)


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row of docs(doc_id, text, ...)."""
    return with_runs(docs, repeated_bytes(docs, window, k), kept_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, str]:
        *counts, kept = kept_bytes(text, lo, hi)
        return *counts, hashlib.sha256(kept).hexdigest()

    docs = read(spark, sf_dir, "documents")
    return with_runs(docs, repeated_bytes(docs), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

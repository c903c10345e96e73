"""Super-k-mers: runs of consecutive windows that share a minimiser at one place, sent as one packed string to its bucket.

Equal windows have equal minimisers, so that all copies of a window meet in one bucket. Windows are of words or of
bytes; either way a packed string is the slice of the text that the run's windows cover.

The super-k-mers of a minimiser that holds more than a stated share of all are cut further, where a second minimiser of
longer k-mers changes, and dealt to buckets by both. Single windows that hold more than that share do not travel: they
are few, so that the place where each starts first, found by grouped minima that are summed before the shuffle, is
known to every task (by a 128-bit digest of the window), and each task flags its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Frequent, blocks, forget, mixed, rolled, shuffle_parts, stored, texts_of, word_bounds, word_hashes

_PLACE = 28  # low bits of a k-mer's rank: its place, so that the leftmost of equal k-mers is the minimiser
_LOW = np.uint64((1 << _PLACE) - 1)
_OTHER = np.uint64(0xA0761D6478BD642F)
RUN = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


class Units:
    """The items of some documents: words with their byte slices, or single bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, words: bool, k: int):
        self.data = data
        if words:
            self.starts, self.ends, self.first = word_bounds(data, off)
            self.hash = word_hashes(data, self.starts, self.ends)
            self.kmers = rolled(self.hash, k)
        else:
            self.starts, self.first = None, off
            self.hash = None
            self.kmers = byte_kmers(data, k)

    def slices(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the items a .. b - 1."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def second(self, at: np.ndarray, window: int) -> np.ndarray:
        """For the windows at the given items, the minimiser of longer k-mers (10 words, 24 bytes) by another hash."""
        k = min(window, 10 if self.hash is not None else 24)
        kmers = rolled(self.hash, k) if self.hash is not None else byte_kmers(self.data, k)
        return lowest(mixed(kmers ^ _OTHER), window - k + 1)[at] >> np.uint64(_PLACE)

    def digests(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows that start at the given items."""
        if self.hash is not None:
            h = self.hash
            return rolled(h, window)[at], rolled(mixed(h ^ _OTHER), window)[at]
        whole, a, b = byte_kmers(self.data, 10), np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for i in [*range(0, window - 10, 10), window - 10]:
            part = whole[at + i]
            a, b = a * np.uint64(0xD6E8FEB86659FD93) + part, b * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(part ^ _OTHER)
        return mixed(a), mixed(b)


def byte_kmers(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive bytes (k from 8 to 24)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    acc = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i, odd in zip(sorted({*range(8, k - 8, 8), k - 8} - {0}), (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93), strict=False):
        acc ^= acc >> np.uint64(29)
        acc += x[i:i + n] * np.uint64(odd)
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0x94D049BB133111EB)
    acc ^= acc >> np.uint64(29)
    return acc


def lowest(kmers: np.ndarray, need: int) -> np.ndarray:
    """The least rank (of k-mer, then place) among every `need` consecutive k-mers."""
    low, span = kmers & ~_LOW, 1
    low |= np.arange(len(low), dtype=np.uint64) & _LOW
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if need > span:
        low = np.minimum(low[: len(low) - (need - span)], low[need - span:])
    return low


def super_kmers(units: Units, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser, document, place of the minimiser) of every super-k-mer."""
    first = np.asarray(units.first)
    last = first[1:] - window + 1  # first[d] .. last[d] - 1 are the windows of document d
    some = np.flatnonzero(last > first[:-1])
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, none
    low = lowest(units.kmers, window - k + 1)
    value = low >> np.uint64(_PLACE)
    # Windows run from document to document; what lies between the last window of one and the first of the next is cut out.
    change = np.zeros(len(value) + 1, bool)
    change[1:-1] = low[1:] != low[:-1]
    change[first[:-1][some]] = True
    change[last[some]] = True
    begin = np.flatnonzero(change[:-1])
    doc = some[np.searchsorted(last[some], begin, "right").clip(max=len(some) - 1)]
    inside = (begin >= first[:-1][doc]) & (begin < last[doc])
    end = np.r_[begin[1:], len(value)]
    begin, end, doc = begin[inside], end[inside], doc[inside]
    place = (begin & ~int(_LOW)) | (low[begin] & _LOW).astype(np.int64)
    place += (place < begin) * (1 << _PLACE)
    return begin, np.minimum(end, last[doc]) - begin, value[begin], doc, place


def packed(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """The byte ranges lo .. hi - 1, one after another."""
    raw = data.tobytes()
    return b"".join([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])


#: Bytes of text worked on at a time: the arrays of a block stay in a core's cache.
BLOCK = 1 << 18


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second, ...: high bytes, mostly zero, lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def windows_of(docs: DataFrame, words: bool, window: int, k: int, find: Callable, out: str, close: Callable = lambda kept: None) -> DataFrame:
    """find(units, ids, super-k-mers, kept) for each block of whole documents, then close(kept): RecordBatches or None. kept: a list for the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for batch in batches:
            data, off = texts_of(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in blocks(off, BLOCK):
                units = Units(data[off[i]:off[j]], off[i:j + 1] - off[i], words, k)
                if (found := find(units, ids[i:j], super_kmers(units, window, k), kept)) is not None:
                    yield found
        if (found := close(kept)) is not None:
            yield found

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, out)


def heavy_minimisers(docs: DataFrame, words: bool, window: int, k: int, bucket_bytes: int, least_share: float = 1e-6) -> tuple[np.ndarray, int, float]:
    """(sorted minimisers that hold a large share of all super-k-mers, number of buckets, super-k-mers that are such a share).

    A minimiser with a share s of all has at least s/2 of all within tasks where its own share is s/2 or more; each task
    so names at most 2/s minimisers, and at most 2/s are left. s is an eighth of a bucket's mean, least_share at least.
    A task's counters are bounded; those of rare minimisers may be too low.
    """
    totals = docs.where("doc_id is not null").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = max(8, math.ceil(4 * totals / bucket_bytes))
    share = max(1 / (8 * n_buckets), least_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Frequent(1 << 18), 0
        for batch in batches:
            data, off = texts_of(batch)
            for i, j in blocks(off, BLOCK):
                value = super_kmers(Units(data[off[i]:off[j]], off[i:j + 1] - off[i], words, k), window, k)[2]
                total += len(value)
                seen.add(value)
        if total:
            seen.settle()
            big = seen.counts >= max(2, total * share / 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[seen.values[big].astype(np.int64), -1]), pa.array(np.r_[seen.counts[big].astype(np.int64), total])], ["value", "n"])

    counted = docs.where("doc_id is not null").select("text").mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    total = (counted.where("value = -1").first() or [0, 0])[1]
    least = max(64, total * share / 2)
    heavy = np.array(sorted(r[0] for r in counted.where(F.col("value") >= 0).where(F.col("n") >= least).collect()), np.uint64)
    forget(counted)
    return heavy, n_buckets, least


def _is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def repeated_runs(docs: DataFrame, words: bool, window: int, k: int, flagged: Callable, by_document: bool, bucket_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, lo, hi: items covered by windows that also start earlier, as runs that may overlap or touch.

    flagged(text, offsets, docs, starts, marks) -> (string number, first window, end window) judges the super-k-mers of
    one bucket: strings text[offsets[i]:offsets[i + 1]], their documents, first items, and the minimiser's item in each.
    by_document: earlier means a smaller doc_id; else also an earlier start in the same document.
    """
    heavy, n_buckets, least = heavy_minimisers(docs, words, window, k, bucket_bytes)
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(heavy)  # at most 2 / share entries

    def heavy_windows(units: Units, found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the super-k-mer, window, its digest in two parts) of the windows of heavy minimisers."""
        some = np.flatnonzero(_is_in(hot.value, found[2]))
        n = found[1][some]
        of = np.repeat(some, n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(found[0][some], n)
        return of, at, *(units.digests(at, window) if len(at) else (np.zeros(0, np.uint64),) * 2)

    common = common_windows(docs, words, window, k, heavy_windows, least, by_document) if len(heavy) else None
    known = spark.sparkContext.broadcast(common)  # as bounded as the list of minimisers: each holds that share

    def flush(kept: list) -> pa.RecordBatch | None:
        by_bucket: dict[int, list] = {}
        for bucket, edges, ids, start, mark, size, ends, text in kept:
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                by_bucket.setdefault(int(bucket[i]), []).append((ids[i:j], start[i:j], size[i:j], mark[i:j], text[ends[i] - size[i]:ends[j - 1]]))
        kept.clear()
        z = zstandard.ZstdCompressor(6)
        rows = []
        for parts in by_bucket.values():
            ids, start, size, mark = (np.concatenate([x[c] for x in parts]) for c in range(4))
            heads = [planes(np.diff(ids, prepend=0)), planes(start), planes(size), planes(mark)]
            rows.append(z.compress(b"".join([np.array([len(ids)], np.int64).tobytes(), *heads, *(x[4] for x in parts)])))
        return pa.RecordBatch.from_arrays([pa.array(list(by_bucket), pa.int32()), pa.array(rows, pa.binary())], ["bucket", "packed"]) if rows else None

    def send(units: Units, ids: np.ndarray, found: tuple, kept: list) -> pa.RecordBatch | None:
        cold = ~_is_in(hot.value, found[2])
        key = found[2]
        at, n, value, doc, place = (x[cold] for x in found)
        if not cold.all():
            of, w, a, b = heavy_windows(units, found)
            rare = place_of(known.value, a, b) < 0
            of, w = of[rare], w[rare]
            second = units.second(w, window)
            head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (w[1:] != w[:-1] + 1) | (second[1:] != second[:-1])][: len(w)])
            of, count = of[head], np.diff(np.r_[head, len(w)])
            at, n = np.r_[at, w[head]], np.r_[n, count]
            doc, place = np.r_[doc, found[3][of]], np.r_[place, found[4][of]]
            value = np.r_[value, mixed(key[of] ^ mixed(second[head]))]
        if not len(at):
            return None
        bucket = (mixed(value) % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        at, n, doc, place, bucket = at[order], n[order], doc[order], place[order], bucket[order]
        lo, hi = units.slices(at, at + n + window - 1)
        size = (hi - lo).astype(np.int32)
        edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        kept.append((bucket, edges, ids[doc].astype(np.int64), (at - units.first[doc]).astype(np.int32), (place - at).astype(np.int32), size, np.cumsum(size, dtype=np.int64), packed(units.data, lo, hi)))
        return flush(kept) if sum(len(x[-1]) for x in kept) > 48 << 20 else None

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        columns: tuple[list, ...] = ([], [], [], [], [])
        z = zstandard.ZstdDecompressor()
        for blob in group["packed"]:
            raw = z.decompress(blob)
            n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
            for column, kind in zip(columns, (np.int64, np.int32, np.int32, np.int32), strict=False):
                column.append(from_planes(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            columns[0][-1] = np.cumsum(columns[0][-1])
            columns[4].append(np.frombuffer(raw, np.uint8, -1, at))
        docs_, starts, sizes, marks = (np.concatenate(x).astype(np.int64) for x in columns[:4])
        which, a, b = flagged(np.concatenate(columns[4]), np.r_[0, np.cumsum(sizes)], docs_, starts, marks)
        return pd.DataFrame({"doc_id": docs_[which], "lo": starts[which] + a, "hi": starts[which] + b + window - 1})

    sent = windows_of(docs, words, window, k, send, "bucket int, packed binary", flush)
    cold = sent.repartition(min(n_buckets, 4 * shuffle_parts(spark)), "bucket").groupBy("bucket").applyInPandas(judge, "doc_id long, lo long, hi long")
    if common is None or not len(common[0]):
        return cold

    def flag(units: Units, ids: np.ndarray, found: tuple, kept: list) -> pa.RecordBatch | None:
        of, w, a, b = heavy_windows(units, found)
        at = place_of(known.value, a, b)
        doc = found[3][of]
        own, start = ids[doc].astype(np.int64), w - np.asarray(units.first)[doc]
        _, _, first_doc, first_start = known.value
        later = (at >= 0) & ((own > first_doc[at]) | (False if by_document else (own == first_doc[at]) & (start > first_start[at])))
        if not later.any():
            return None
        own, start, doc = own[later], start[later], doc[later]
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.r_[head[1:], len(doc)] - 1
        return pa.RecordBatch.from_arrays([pa.array(own[head]), pa.array(start[head]), pa.array(start[last] + window)], schema=RUN)

    return cold.unionByName(windows_of(docs, words, window, k, flag, "doc_id long, lo long, hi long"))


def common_windows(docs: DataFrame, words: bool, window: int, k: int, heavy_windows: Callable, least: float, by_document: bool) -> tuple:
    """Digest parts a (sorted), b, and the first document and start of the windows of heavy minimisers that start `least` times or more."""

    def count(units: Units, ids: np.ndarray, found: tuple, kept: list) -> pa.RecordBatch | None:
        of, w, a, b = heavy_windows(units, found)
        if not len(w):
            return None
        doc = found[3][of]
        own, start = ids[doc].astype(np.int64), w - np.asarray(units.first)[doc]
        order = np.lexsort((start, own, b, a))
        a, b, own, start = a[order], b[order], own[order], start[order]
        head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[head].view(np.int64), b[head].view(np.int64), own[head], start[head], np.diff(np.r_[head, len(a)]))], ["a", "b", "doc_id", "start", "n"])

    each = windows_of(docs, words, window, k, count, "a long, b long, doc_id long, start long, n long")
    found = each.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where(F.col("n") >= least).select("a", "b", "first.doc_id", "first.start").toArrow()
    a, b, doc, start = (found.column(c).to_numpy() for c in ("a", "b", "doc_id", "start"))
    order = np.lexsort((b.view(np.uint64), a.view(np.uint64)))
    return a.view(np.uint64)[order], b.view(np.uint64)[order], doc[order], start[order]


def place_of(common: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of each digest among the common windows, -1 for others. Of two with equal first parts one is found; the other goes to buckets."""
    if not len(common[0]):
        return np.full(len(a), -1)
    at = np.minimum(np.searchsorted(common[0], a), len(common[0]) - 1)
    return np.where((common[0][at] == a) & (common[1][at] == b), at, -1)


def joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open runs, touching ones joined."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return lo[head], hi[np.r_[head[1:] - 1, len(hi) - 1]]


def with_runs(docs: DataFrame, runs: DataFrame, use: Callable, out: str) -> DataFrame:
    """Join each document with its runs: use(text bytes, lo, hi) -> tuple of column values after doc_id.

    Texts cross the shuffle compressed, next to the packed runs of each document.
    """
    per = runs.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))  # at most as many as the document has windows

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for batch in batches:
            data, off = texts_of(batch)
            raw = memoryview(data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([z.compress(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], ["id", "text"])

    names = [c.split()[0] for c in out.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        schema = None
        for batch in batches:
            rows = []
            lists = batch.column("runs")
            for d, text, own in zip(batch.column("id").to_pylist(), batch.column("text"), lists, strict=True):
                own = own.values if own.is_valid else None
                lo, hi = (np.zeros(0, np.int64),) * 2 if own is None else joined(own.field("lo").to_numpy(), own.field("hi").to_numpy())
                rows.append((d, *use(z.decompress(text.as_py()), lo, hi)))
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            schema = schema or pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, out.split(", "), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)

    sent = docs.select("doc_id", "text").mapInArrow(press, "id long, text binary")
    return sent.join(per, F.col("id") == F.col("doc_id"), "left").select("id", "text", "runs").mapInArrow(finish, out)

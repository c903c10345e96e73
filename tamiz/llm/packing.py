"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

A document's ids (with its end id) are cut into pieces of the sequence length and one remainder. Only the histogram of
piece lengths goes to the driver: at most one count for each length up to the sequence length, whatever the input.
There lengths are placed longest first, each into the shortest pack if it has room, and a pack pattern
carries a count instead of being repeated. The patterns' slots join back to the pieces by their rank within a length.

Null text is empty: it has the end id alone. Repeated rows are packed each. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, read, stored, texts_of, word_bounds, word_hashes

LENGTH = 2048
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has its own core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids by word. This tokenizer never joins what white space parts, so that a document's ids are its words' ids in order."""

    def __init__(self, path: str, most_words: int = 1_000_000):
        self.tok, self.most = tokenizer(path), most_words
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the words known
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, h: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        words = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]
        count = np.array([len(x) for x in got], np.int64)
        ids = np.fromiter((i for x in got for i in x), np.uint32, int(count.sum()))
        keys, start = np.r_[self.keys, h], np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.count, self.ids = keys[order], start[order], np.r_[self.count, count][order], np.r_[self.ids, ids]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, and the number of each document's ids."""
        starts, ends, first = word_bounds(data, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        h = word_hashes(data, starts, ends)
        own, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        place = np.searchsorted(self.keys, own)
        new = np.ones(len(own), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != own[inside]
        if new.any():
            self.learn(own[new], data.tobytes(), starts[at[new]], ends[at[new]])
            place = np.searchsorted(self.keys, own)
        start, count = self.start[place][back], self.count[place][back]
        total = np.cumsum(count)
        pos = np.arange(int(total[-1])) - np.repeat(total - count, count) + np.repeat(start, count)
        upto = np.r_[0, total]
        return self.ids[pos], upto[first[1:]] - upto[first[:-1]]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table of known words for all tasks of a Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of docs(doc_id, text, ...)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            data, off = texts_of(batch)
            key = batch.column("doc_id")
            for i, j in blocks(off):
                part = data[off[i]:off[j]]
                ids, n = words.encode(part, off[i:j + 1] - off[i])
                rows, at = ([], [], [], [], []), 0
                for d, c in enumerate(n.tolist()):
                    own = np.append(ids[at:at + c], np.uint32(end_id)).astype("<u4")
                    at += c
                    for s in range(0, c + 1, length):
                        cutting = own[s:s + length]
                        for col, x in zip(rows, (i + d, s, len(cutting), zlib.crc32(cutting.tobytes()), c + 1), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([key.take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs). Longest lengths first; each goes into the shortest pack, if it has room there, else into a new one."""
    open_: dict[int, list] = {}  # total -> [(lengths, count)]
    totals: list[int] = []  # a heap of the totals in open_

    def put(total: int, pattern: tuple, count: int) -> None:
        if total not in open_:
            open_[total] = []
            heapq.heappush(totals, total)
        open_[total].append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not totals or totals[0] + size > length:
                put(size, (size,), left)
                break
            total = totals[0]
            pattern, count = open_[total].pop()
            if not open_[total]:
                del open_[total]
                heapq.heappop(totals)
            used = min(count, left)
            if used < count:
                put(total, pattern, count - used)
            put(total + size, (*pattern, size), used)
            left -= used
    return [x for total in sorted(open_, reverse=True) for x in open_[total]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the ranges of ranks: (first rank, first sequence, offset), sorted by first rank."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rank = used.get(size, 0)
            out.setdefault(size, []).append((rank, sequence, offset))
            used[size] = rank + count
            offset += size
        sequence += count
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, length, end_id))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    table = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, length)))  # bounded by the number of lengths, not by the input

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("length").to_numpy()
            head = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
            rank = np.arange(len(size)) - np.repeat(head, np.diff(np.r_[head, len(size)]))
            if size[0] == now:
                rank[size == now] += seen
            now, seen = int(size[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int64)), pa.array(rank)], [*batch.schema.names, "part", "rank"])

    # Ranks within a length: sorted ranges, so that a length with many pieces spans as many tasks as it needs.
    ranged = stored(cut.repartitionByRange("length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
                    .mapInArrow(ranks, f"{PIECE}, part long, rank long"))
    offsets: dict[tuple[int, int], int] = {}
    upto: dict[int, int] = {}
    for r in ranged.groupBy("part", "length").count().orderBy("part").collect():  # a task's range holds few lengths: tasks + lengths rows at most
        offsets[r["part"], r["length"]] = upto.get(r["length"], 0)
        upto[r["length"]] = upto.get(r["length"], 0) + r["count"]
    before = spark.sparkContext.broadcast(offsets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, part, rank = (batch.column(c).to_numpy() for c in ("length", "part", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            code = part * (length + 1) + size
            order = np.argsort(code, kind="stable")
            heads = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else np.zeros(0, int)
            for a, b in zip(heads, np.r_[heads[1:], len(code)].astype(int), strict=True):
                rows = order[a:b]
                n = int(size[rows[0]])
                at = rank[rows] + before.value[int(part[rows[0]]), n]
                first, seq, off = table.value[n]
                k = np.searchsorted(first, at, "right") - 1
                sequence[rows], offset[rows] = seq[k] + at - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranged.mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

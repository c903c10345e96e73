"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut into halves again and again, at places where the pattern surely ends a match: before a white space that
follows something else, as no match has a white space behind another character, and the pattern never looks back. There the
ids of two halves join as they are. A match that is longer than a leaf is cut in halves of its bytes, and their ids join
by encoding a window of ids around the cut anew. The window doubles until the ids outside it are proven to be those
of the whole: a run of ids is what the merges give for its bytes if every two neighbours are what the merges give for
theirs. (Take the first merge over a border between neighbours: before it all merges stayed within ids, so the two neighbours
alone would have come to the same merge.) Within the halves, and within the window, neighbours have this property already;
only the two at the window's edges are tried. Decoding concatenates the ids' bytes up the same kind of tree.

One task encodes a text, in memory that grows with the text's own length only: matches are listed for one leaf at a time,
and the table of known matches is cleared at a fixed size. The work on a text is n log n at most, whatever it holds.

Null text is empty: no ids. Bytes that are no UTF-8 are read as U+FFFD, as Spark's own text functions do. Repeated rows are
encoded each. Rows without doc_id keep their null. Ids that the table of ranks hasn't make decoding fail. Extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, read, texts_of

#: Characters of a leaf of a text, bytes of a leaf of one match, and matches that a worker remembers.
TEXT_LEAF, MATCH_LEAF, KNOWN = 1 << 16, 32, 800_000
NEVER = 1 << 62


def _points(kind: str) -> list[int]:
    """Code points of a class, as the tokenizer library's own pattern engine has it: engines differ by their Unicode versions."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    e = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return [ord(c) for c in e.decode(e.encode_ordinary(every))]


def _ranges(points: list[int]) -> str:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=4)
def spelled(pattern: str) -> tuple[str, str, str]:
    r"""(white space, pattern with \p{L}, \p{N}, \s and \S spelled out, characters that the regex package classifies otherwise)."""
    import regex

    kinds = {k: _points(k) for k in (r"\p{L}", r"\p{N}", r"\s")}
    other = sorted(set().union(*(set(points) ^ {ord(c) for c in regex.findall(k, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))} for k, points in kinds.items())))
    letters, numbers, space = (_ranges(p) for p in kinds.values())
    in_class = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": space}

    def spell(part: re.Match) -> str:
        if part[0][0] == "[":
            return re.sub(r"\\p\{[LN]\}|\\s", lambda m: in_class[m[0]], part[0])
        return f"[^{space}]" if part[0] == r"\S" else f"[{in_class[part[0]]}]"

    return space, re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spell, pattern), _ranges(other)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Merges:
    """What the merges in order of rank give for bytes, and the joining of two results."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.packed = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.alone = lru_cache(1 << 16)(self._stay_apart)

    def direct(self, data: bytes) -> list[bytes]:
        """The lowest rank first, of equal ones the leftmost."""
        return self.few(data) if len(data) <= MATCH_LEAF else self.many(data)

    def few(self, data: bytes) -> list[bytes]:
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [rank(a + b, NEVER) for a, b in pairwise(parts)]
        while ranks and (low := min(ranks)) < NEVER:
            i = ranks.index(low)
            parts[i:i + 2] = [one := parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(one + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + one, NEVER)
        return parts

    def many(self, data: bytes) -> list[bytes]:
        """As few, by a heap of the pairs: n log n."""
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here: its end, and where the one before it starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != e:
                continue  # one of the two has grown since
            end[i], end[j] = e, -1
            if e < n:
                before[e] = i
                if (r := rank(data[i:end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if i and (r := rank(data[before[i]:e])) is not None:
                heapq.heappush(heap, (r, before[i], e))
        out, i = [], 0
        while i < n:
            out.append(data[i:end[i]])
            i = end[i]
        return out

    def _stay_apart(self, a: bytes, b: bytes) -> bool:
        return self.direct(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Results of two neighbours to that of both."""
        width = 2
        while left and right:
            i, j = max(0, len(left) - width), min(width, len(right))
            window = self.direct(b"".join(left[i:] + right[:j]))
            if (i == 0 or self.alone(left[i - 1], window[0])) and (j == len(right) or self.alone(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2
        return left or right

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= MATCH_LEAF:
            return self.direct(data)
        half = 1 << (len(data) - 1).bit_length() - 1  # a power of two: runs of one byte then join without shifts
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def ids(self, data: bytes) -> bytes:
        """Ids of one match as little-endian 32-bit integers. A match that is itself in the table is one id."""
        return self.packed.get(data) or b"".join(map(self.packed.__getitem__, self.tree(data)))


class Encoder(dict):
    """match -> its ids; a text's ids by halves."""

    def __init__(self, path: str, pattern: str, space: str, exact: str, other: str):
        import regex

        self.merges = Merges(ranks_of(path))
        self.fast, self.exact, self.other = regex.compile(pattern).findall, re.compile(exact).findall, re.compile(f"[{other}]")
        self.lead = chr(int(other[2:10], 16)).encode()[0]  # no text without such bytes has one of the other characters
        self.edge = re.compile(f"[^{space}](?=[{space}])")

    def __missing__(self, match: str) -> bytes:
        data = match.encode()
        ids = self.merges.ids(data)
        if len(data) <= 64:
            self[match] = ids
        return ids

    def encode(self, raw: np.ndarray) -> bytes:
        """Ids of a text's UTF-8 bytes."""
        text = raw.tobytes().decode("utf-8", "replace")
        rare = len(raw) and raw.max() >= self.lead and self.other.search(text)
        return self.halves(text, self.exact if rare else self.fast)

    def halves(self, text: str, matches: Callable[[str], list[str]]) -> bytes:
        middle = len(text) // 2
        edge = (self.edge.search(text, middle) or self.edge.search(text, 0, middle)) if len(text) > TEXT_LEAF else None
        if edge is None:  # short, or no white space behind another character: then the few matches' own trees take it
            if len(self) > KNOWN:
                self.clear()
            return b"".join(map(self.__getitem__, matches(text)))
        return self.halves(text[:edge.end()], matches) + self.halves(text[edge.end():], matches)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, space: str, exact: str, other: str) -> Encoder:
    """One table of known matches for all tasks of a Python worker."""
    return Encoder(path, pattern, space, exact, other)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary: little-endian 32-bit integers) of every row of docs(doc_id, text, ...). ranks_path: a table that every machine has there."""
    spelling = spelled(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(ranks_path, pattern, *spelling)
        for batch in batches:
            data, off = texts_of(batch)
            for i, j in blocks(off):
                ids = [one.encode(data[a:b]) for a, b in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


@lru_cache(maxsize=2)
def bytes_of(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks_of(path).items()}


def decoded(ids: list[int], table: dict[int, bytes], leaf: int = 1 << 12) -> bytes:
    if len(ids) <= leaf:
        return b"".join(map(table.__getitem__, ids))
    half = len(ids) // 2
    return decoded(ids[:half], table, leaf) + decoded(ids[half:], table, leaf)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded(doc_id, ids) with bytes, what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_of(ranks_path)
        for batch in batches:
            data, off = texts_of(batch, "ids")
            for i, j in blocks(off):
                out = [decoded(np.frombuffer(data[a:b].tobytes(), "<u4").tolist(), table) for a, b in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "ids")), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    both = decode(encode(read(spark, sf_dir, "documents"), path, P.PATTERN), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))

"""Shared helpers: shared scratch tables, Arrow text views, vectorised word and shingle hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.sources.model import spread

#: White space of every word rule here: space and bytes 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SPACE_REGEX = r"[\x20\x09-\x0D]+"

#: Spark's setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RNG = np.random.default_rng(20240607)
_BYTE_TABLE = _RNG.integers(1, 2**64, (64, 256), np.uint64) | np.uint64(1)
_LONG_WORD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir. Only in local mode, a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tamiz-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tamiz-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared scratch folder and read again: lineage ends there, and a lost executor repeats nothing before it.

    What the write shuffled goes with it. Else those files stay until the driver happens to collect its garbage, and a
    long operator holds all that it ever moved.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying per row; null reads as empty."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1 + arr.offset)[arr.offset:]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]] if len(off) else data, off - off[0]


def blocks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `most` bytes (one row at least), so that working arrays stay small."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift-multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~separator[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    v = _BYTE_TABLE[pos & 63, data[at]]
    if lens.max() > 64:
        far = np.flatnonzero(pos > 63)
        v[far] *= (pos[far] >> 6).astype(np.uint64) * np.uint64(2) * _LONG_WORD + np.uint64(1)
    return mixed(np.add.reduceat(v, first) + lens.astype(np.uint64))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * _STEP + h[i:i + n]
    return mixed(acc)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Of all items, those from which k items follow within the same document. first: as from word_bounds."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    last = first[1:] - k + 1
    some = last > first[:-1]
    np.add.at(ok, first[:-1][some], 1)
    np.add.at(ok, last[some], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


class Frequent:
    """Counts of the most frequent values seen, in bounded memory: when there are too many, all lose as much as the first left out has."""

    def __init__(self, most: int, kind: type = np.uint64, wait: int = 1):
        self.most, self.wait, self.waiting, self.held = most, wait * most, [], 0
        self.values, self.counts = np.zeros(0, kind), np.zeros(0, np.int32)

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.held += len(values)
        if self.held >= self.wait:
            self.settle()

    def settle(self) -> None:
        value, count = np.unique(np.concatenate([self.values[:0], *self.waiting]), return_counts=True)
        self.waiting, self.held = [], 0
        at = np.searchsorted(self.values, value)
        known = self.values[np.minimum(at, max(0, len(self.values) - 1))] == value if len(self.values) else np.zeros(len(value), bool)
        self.counts[at[known]] += count[known].astype(np.int32)
        self.values = np.insert(self.values, at[~known], value[~known])
        self.counts = np.insert(self.counts, at[~known], count[~known])
        if len(self.values) > self.most:
            self.counts -= np.partition(self.counts, -self.most - 1)[-self.most - 1]
            self.values, self.counts = self.values[self.counts > 0], self.counts[self.counts > 0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars; each round is joins and grouped minima only.

    edges: undirected pairs of longs. Returns node, component (smallest node of its component), for nodes that
    have an edge to another node. Rounds go on until one changes nothing: about the square of the logarithm of the
    longest path. Empty input gives an empty result; loops, repeats and nulls are ignored.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u <> v and u is not null and v is not null").distinct())
    e = stored(e)
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        before, e = e, stored(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))

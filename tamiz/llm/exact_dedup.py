"""Exact deduplication by counting quotient filters.

Every task builds a counting quotient filter over the 64-bit fingerprints of its rows: the high bits (quotient) say
which home slot a fingerprint belongs to, the low bits (remainder) are stored sorted within the run of that home slot.
Filters are cut into ranges of quotients; the pieces of one range merge by their sorted remainders without loss. Only
fingerprints whose merged count is above one go on to the comparison of bytes.

Null text counts as empty; empty texts equal each other. Repeated rows (same doc_id) count each, and the group stays
with the smallest doc_id; if rows share doc_id and text, all of them point to that id and all are marked kept.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_REGEX, read, shuffle_parts, stored

FILTER_SCHEMA = "block int, first long, r int, occupied binary, runends binary, counts binary, slots binary"


def encode(fingerprints: np.ndarray, counts: np.ndarray, first: int, n_quotients: int, r: int) -> dict:
    """One filter piece over the quotients first .. first + n_quotients - 1.

    fingerprints: sorted, distinct. A slot holds a remainder; one with its bit in `counts` set holds the count of the
    remainder before it, and is there only if that count is above one.
    """
    quotient = (fingerprints >> np.uint64(r)).astype(np.int64) - first
    remainder = fingerprints & np.uint64((1 << r) - 1)
    extra = counts > 1
    width = 1 + extra.astype(np.int64)
    at = np.cumsum(width) - width
    slots = np.zeros(int(width.sum()), np.uint64)
    slots[at] = remainder
    slots[at[extra] + 1] = counts[extra].astype(np.uint64)
    is_count = np.zeros(len(slots), bool)
    is_count[at[extra] + 1] = True
    occupied = np.zeros(n_quotients, bool)
    occupied[quotient] = True
    runends = np.zeros(len(slots), bool)
    last = np.ones(len(quotient), bool)
    last[:-1] = quotient[1:] != quotient[:-1]
    runends[(at + width - 1)[last]] = True
    pack = lambda x: np.packbits(x).tobytes()
    return {"first": first, "r": r, "occupied": pack(occupied), "runends": pack(runends), "counts": pack(is_count), "slots": slots.tobytes()}


def decode(first: int, r: int, occupied: bytes, runends: bytes, counts: bytes, slots: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (sorted) and counts of a filter piece: the n-th run belongs to the n-th occupied quotient."""
    values = np.frombuffer(slots, np.uint64)
    bits = lambda x, n=None: np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
    is_count, ends = bits(counts, len(values)), bits(runends, len(values))
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(bits(occupied))[run].astype(np.uint64) + np.uint64(first)
    here = np.flatnonzero(~is_count)
    n = np.ones(len(values), np.int64)
    held = np.flatnonzero(is_count)
    n[held - 1] = values[held].astype(np.int64)
    return (quotient[here] << np.uint64(r)) | values[here], n[here]


def merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge decoded pieces of one range: equal remainders of equal quotients add their counts."""
    fp, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(fp, kind="stable")
    fp, n = fp[order], n[order]
    head = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
    return fp[head], np.add.reduceat(n, head)


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """prints: fp long. The fingerprints that occur more than once, as (fp, n), through per-task filters."""
    bits = math.ceil(math.log2(max(shuffle_parts(prints.sparkSession), rows / (1 << 20), 2)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True) for b in batches if b.num_rows]
        if not seen:
            return
        fp, n = merged(seen)
        q = max(bits, math.ceil(math.log2(len(fp) / 0.75 + 1)))  # as many home slots as this task's rows need
        r, each = 64 - q, 1 << (q - bits)
        block = (fp >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        rows_ = [{"block": int(block[i])} | encode(fp[i:j], n[i:j], int(block[i]) * each, each, r) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_pylist(rows_, pa.schema([("block", pa.int32()), ("first", pa.int64()), ("r", pa.int32()), *((c, pa.binary()) for c in ("occupied", "runends", "counts", "slots"))]))

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        fp, n = merged([decode(*row) for row in pieces[["first", "r", "occupied", "runends", "counts", "slots"]].itertuples(index=False)])
        return pd.DataFrame({"fp": fp[n > 1].view(np.int64), "n": n[n > 1]})

    return prints.select("fp").mapInArrow(build, FILTER_SCHEMA).groupBy("block").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text, ...)."""
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_REGEX, " ")
    hashed = docs.select("doc_id", F.sha2(normal, 256).alias("text_sha256"))
    fp = F.xxhash64("text_sha256").alias("fp")
    ids = stored(hashed.withColumn("fp", fp))
    repeated = stored(repeated_fingerprints(ids, ids.count()))
    # The bytes decide: rows of a repeated fingerprint group by their whole text. What is grouped is summed on each side of the shuffle.
    same = (docs.select("doc_id", normal.alias("norm")).withColumn("sha", F.sha2("norm", 256))
            .withColumn("fp", F.xxhash64("sha")).join(repeated.select("fp"), "fp", "left_semi")
            .groupBy("sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .select("sha", "keep_id", "group_size"))
    return (ids.join(same, ids.text_sha256 == same.sha, "left")
            .select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(True)).alias("kept"), "text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


#: The same rows in SQL.
OP7_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""

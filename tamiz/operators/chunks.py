"""Chunks of texts for retrieval: greedy packing of sentences, with an overlap of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import as_column, trimmed


def chunk_list(text: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """array<string>: sentences packed while a chunk and the next one stay within `size`; a chunk starts with the last `overlap` characters of the one before.

    A text within `size` is one chunk; null and blank texts have none. Chunks can be longer than `size`, as the overlap
    comes on top; a sentence is cut, at `size`, only where it meets an empty chunk.
    """
    spaced = F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")
    clean = trimmed(F.regexp_replace(spaced, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]", ""))
    state = lambda full, open_: F.struct(full.alias("full"), open_.alias("open"))

    def add(s: Column, sentence: Column) -> Column:
        full, open_ = s["full"], s["open"]
        tail = F.right(open_, F.lit(overlap)) if overlap > 0 else F.lit("")
        return (F.when(F.length(open_) + F.length(sentence) <= size, state(full, F.concat(open_, F.lit(" "), sentence)))
                .when(open_ == "", state(F.array_append(full, F.left(sentence, F.lit(size))), F.substring(sentence, F.lit(size + 1), F.length(sentence))))
                .otherwise(state(F.array_append(full, trimmed(open_)), F.concat(tail, sentence))))

    last = lambda s: F.filter(F.array_append(s["full"], trimmed(s["open"])), lambda c: c != "")
    none = F.array().cast("array<string>")
    packed = F.aggregate(F.split(clean, r"(?U)(?<=[.!?])\s+"), state(none, F.lit("")), add, last)
    return F.when(F.length(clean) > size, packed).when(clean != "", F.array(clean)).otherwise(none)


def chunked(df: DataFrame, key: str, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """key, chunk_index, total_chunks, chunk_id and content of every chunk; ids come from key and index, so that none is used twice."""
    # The outer form, as for the inner one Spark puts a filter below that would chunk every text twice.
    out = df.select(F.col(key), chunk_list(text, size, overlap).alias("_c")).select(F.col(key), F.size("_c").alias("total_chunks"), F.posexplode_outer("_c").alias("chunk_index", "content")).where("content is not null")
    return out.select(key, "chunk_index", "total_chunks", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_index").cast("string"))).alias("chunk_id"), "content")

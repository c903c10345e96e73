"""Streams of content: cleaning, exclusion and keyword labels as they arrive; exact duplicates and counts within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import clean_post, comparable
from tamiz.operators.classify import classify


def classified(stream: DataFrame, text: str = "text") -> DataFrame:
    """A stateless transformation: text cleaned, junk tagged, keyword labels."""
    return classify(stream.withColumn(text, clean_post(text)), text=text)


def without_copies(stream: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Texts that are equal after normalisation pass once within the watermark."""
    return stream.withWatermark(time, delay).withColumn("_norm", F.xxhash64(comparable(text))).dropDuplicatesWithinWatermark(["_norm"]).drop("_norm")


def counts(stream: DataFrame, time: str, window: str = "1 day", delay: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts for each window and value; windows close when the watermark passes them."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")

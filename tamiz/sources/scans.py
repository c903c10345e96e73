"""Scans: seed lists, documents of knowledge, few-shot examples, ground truth, taxonomy and glossaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.text import plain_markdown, readable, trimmed
from tamiz.functions.urls import url_class


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """url and source of every line that is neither blank nor a remark."""
    lines = spark.read.text(path).select(trimmed("value").alias("url")).where("url <> '' and not startswith(url, '#')")
    return lines.select("url", url_class("url").alias("source"))


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """source and content of all .md and .txt files below a folder; Markdown without its marks."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}")
    name = F.col("_metadata.file_path")
    return files.select(name.alias("source"), F.when(name.endswith(".md"), plain_markdown("value")).otherwise(readable("value")).alias("content"))


def few_shots(spark: SparkSession, path: str) -> DataFrame:
    """The examples of JSON files, as operators.fewshots.examples gives them; ValueError if there are none."""
    from tamiz.operators.fewshots import examples

    out = examples(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    if not out.limit(1).count():
        raise ValueError(f"{path} declares no examples")
    return out


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """content_id, exclusion_label and one row for each labelled (orden, dimension); items without labels have nulls there."""
    items = spark.read.schema("items array<struct<content_id:string,ground_truth:array<array<string>>,exclusion_label:string,source:string>>").option("multiLine", True).json(path)
    item = items.select(F.explode("items").alias("i")).select("i.*")
    return item.select("content_id", "exclusion_label", F.explode_outer("ground_truth").alias("g")).select("content_id", "exclusion_label", F.col("g")[0].cast("int").alias("orden"), F.col("g")[1].alias("dimension"))


def sections(text: str) -> dict[str, str]:
    """Sections of a Markdown text by their second-level headings, each up to the next one. For configuration files."""
    found = re.split(r"(?m)^## +(.+?)\s*$", text)
    return {title: body.strip() for title, body in zip(found[1::2], found[2::2], strict=True)}


def fenced_tokens(text: str) -> list[str]:
    """Lines of the first fenced block, without blanks and remarks. For glossaries."""
    block = re.search(r"(?s)```[^\n]*\n(.*?)```", text)
    return [t for t in (line.strip() for line in (block[1] if block else "").splitlines()) if t and not t.startswith("#")]

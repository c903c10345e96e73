"""Batch analysis: content without an analysis is cleaned, classified and written back, with errors and counts beside it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.labels import primary_label
from tamiz.functions.text import clean_comment, clean_post
from tamiz.functions.vocabulary import NONE
from tamiz.sources.tables import Partitioned, bucket_of, measured

from .classify import classify
from .replies import EMPTY, INVALID, LABEL, NO_OBJECT, NO_REPLY

KEY = ["content_type", "content_id"]
ANALYSIS = """content_type string, content_id string, post_id string, comment_id string, tiene_violencia string, categoria string, dimension string, severidad string, confianza string, justificacion string,
evidencia string, regla_disparada string, marcadores_detectados string, es_falso_positivo_probable string, score_ajuste string, exclusion_label string, exclusion_codigo string, exclusion_justificacion string, bucket int"""
LABELS = """content_type string, content_id string, orden int, categoria string, dimension string, severidad string, justificacion string, evidencia string, regla_disparada string, marcadores_detectados string,
confianza string, score_ajuste string, es_falso_positivo_probable string, bucket int"""
#: In which bucket of errors a code counts.
ERROR_BUCKETS = {NO_REPLY: "errors_model", EMPTY: "errors_parse", INVALID: "errors_parse", NO_OBJECT: "errors_validation"}


def content_of(posts: DataFrame | None, comments: DataFrame | None) -> DataFrame:
    """content_type, content_id, post_id, comment_id and cleaned text of posts(id, text, author) and comments(id, text, author, post_id)."""
    parts = []
    if posts is not None:
        parts.append(posts.select(F.lit("post").alias("content_type"), F.col("id").alias("content_id"), F.col("id").alias("post_id"), F.lit(None).cast("string").alias("comment_id"), clean_post("text").alias("text")))
    if comments is not None:
        parts.append(comments.select(F.lit("comment").alias("content_type"), F.col("id").alias("content_id"), "post_id", F.col("id").alias("comment_id"), clean_comment("text", F.nullif("author", F.lit("")))["body"].alias("text")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def open_content(content: DataFrame, analyses: DataFrame) -> DataFrame:
    """Content without an analysis."""
    done = analyses.select(*[F.col(k).alias(f"_{k}") for k in KEY])
    return content.join(done, [F.col(k) == F.col(f"_{k}") for k in KEY], "left_anti")


def analysed(content: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, reply: str | None = None) -> DataFrame:
    """content(content_type, content_id, post_id, comment_id, text) with the fields of an analysis, its labels, and error. The primary label gives the flat fields."""
    rows = classify(content, model, reply=reply)
    rows = rows.withColumn("_top", primary_label("labels"))
    top = lambda f: F.col("_top")[f]
    return rows.select(
        "content_type", "content_id", "post_id", "comment_id", "tiene_violencia", F.coalesce(top("categoria"), F.lit(NONE)).alias("categoria"), top("dimension").alias("dimension"),
        F.coalesce(top("severidad"), F.lit(NONE)).alias("severidad"), top("confianza").cast("string").alias("confianza"), F.coalesce(top("justificacion"), F.lit("")).alias("justificacion"),
        F.coalesce(top("evidencia"), F.lit("")).alias("evidencia"), top("regla_disparada").alias("regla_disparada"), F.to_json(top("marcadores")).alias("marcadores_detectados"),
        F.when(top("falso_positivo"), "true").otherwise("false").alias("es_falso_positivo_probable"), top("score_ajuste").cast("string").alias("score_ajuste"),
        "exclusion_label", "exclusion_codigo", "exclusion_justificacion", "labels", "error")


def label_rows(rows: DataFrame) -> DataFrame:
    """One row for each label of analysed rows, numbered from 0."""
    ls = rows.select(*KEY, F.posexplode("labels").alias("orden", "l"))
    return ls.select(*KEY, "orden", "l.categoria", "l.dimension", "l.severidad", "l.justificacion", "l.evidencia", "l.regla_disparada", F.to_json("l.marcadores").alias("marcadores_detectados"),
                     F.col("l.confianza").cast("string").alias("confianza"), F.col("l.score_ajuste").cast("string").alias("score_ajuste"), F.when(F.col("l.falso_positivo"), "true").otherwise("false").alias("es_falso_positivo_probable"))


def error_rows(rows: DataFrame) -> DataFrame:
    """content_type, content_id, bucket of errors and code of the rows that failed."""
    def failed(code: Column) -> Column:
        kind = F.lit("errors_db")
        for known, name in ERROR_BUCKETS.items():
            kind = F.when(code == known, name).otherwise(kind)
        return F.struct(kind.alias("error_bucket"), code.alias("error"))

    # A filter on the error would run all that leads to it once more.
    return rows.select(*KEY, F.explode(F.transform(F.array_compact(F.array("error")), failed)).alias("e")).select(*KEY, "e.*")


MEASURED = ["posts_analyzed", "comments_analyzed", "violence_detected_posts", "violence_detected_comments", "errors", *sorted(set(ERROR_BUCKETS.values()))]


def measures() -> list:
    """Counts of a run, as they are observed while it writes; named as in MEASURED."""
    post, violent = F.col("content_type") == "post", F.col("tiene_violencia") == "true"
    of_bucket = [F.col("error").isin(*[c for c, b in ERROR_BUCKETS.items() if b == name]) for name in MEASURED[5:]]
    return [F.count(F.when(c, 1)).alias(name) for name, c in zip(MEASURED, [post, ~post, post & violent, ~post & violent, F.col("error").isNotNull(), *of_bucket], strict=True)]


class Analyses:
    """Stored analyses and their labels below one folder, both in the same number of parts by content."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.rows = Partitioned(spark, f"{self.path}/analyses", ANALYSIS, "bucket")
        self.labels = Partitioned(spark, f"{self.path}/labels", LABELS, "bucket")

    def run(self, content: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, reply: str | None = None, again: bool = False, name: str = "run") -> dict[str, int]:
        """Analyse what has no analysis yet (again: everything) and write it back. Returns the counts observed.

        Everything is classified and written once, to the folder of the run, results and errors apart; the tables are
        brought up to date from there. A run that is lost before that is repeated as a whole; a second run finds nothing.
        Rows without content_id have no key and are left out.
        """
        todo = content.where("content_id is not null").dropDuplicates(KEY)
        todo = todo if again else open_content(todo, self.rows.read())
        seen = Observation(f"{name}-{self.path}")
        out = analysed(todo, model, reply).withColumn("bucket", bucket_of(self.parts, *KEY)).withColumn("failed", F.col("error").isNotNull())
        folder = f"{self.path}/runs/{name}"
        out.observe(seen, *measures()).write.mode("overwrite").partitionBy("failed").parquet(folder)
        found = measured(seen)
        counts = {k: int(found.get(k) or 0) for k in MEASURED}
        if counts["posts_analyzed"] + counts["comments_analyzed"]:
            rows = self.spark.read.schema(out.schema).parquet(folder)
            # Labels before analyses: only a content that has its row counts as done, and its labels are there by then.
            self.labels.replace_of(rows, label_rows(rows).withColumn("bucket", bucket_of(self.parts, *KEY)), KEY)
            self.rows.upsert(rows, KEY)
        return counts

    def errors(self, name: str = "run") -> DataFrame:
        """What failed in a run."""
        return error_rows(self.spark.read.schema(run_schema()).parquet(f"{self.path}/runs/{name}").where("failed"))


def run_schema() -> str:
    return f"{ANALYSIS}, labels array<{LABEL}>, error string, failed boolean"

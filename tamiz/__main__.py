"""Jobs for spark-submit: python -m tamiz VERB --store FOLDER ...

load      pages of raw HTML (Parquet: page_id, url, html) or nested pages into the store
analyze   what has no analysis yet, by keywords, or by replies (Parquet: content_id, reply)
status    how much the store holds
report    analyses by category and state
dedup     duplicate comments: what would go, or --apply
all       load, then analyze
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.operators import dedup, loads, relational, stats
from tamiz.operators.analyse import Analyses, content_of
from tamiz.sources import elements


def nested_of(pages: DataFrame) -> DataFrame:
    """Raw pages as nested ones, by their elements; pages by their address' digest."""
    h = elements.hierarchy(pages)
    comment = lambda c: F.struct(F.lit(None).cast("string").alias("id"), c["text"].alias("text"), c["author"].alias("author"), c["date"].alias("date"), c["likes"].cast("string").alias("likes"), F.lit(None).cast("string").alias("created_at"), c["url"].alias("url"))
    post = lambda p: F.struct(F.substring(F.md5(p["url"]), 1, 16).alias("id"), p["text"].alias("text"), p["author"].alias("author"), p["date"].alias("date"), p["likes"].cast("string").alias("likes"), p["shares"].cast("string").alias("shares"), p["url"].alias("url"), F.transform(p["comments"], comment).alias("comments"))
    null = F.lit(None).cast("string")
    return h.select(F.substring(F.md5("url"), 1, 16).alias("page_id"), "url", "title", F.lit(0).alias("html_size"), null.alias("raw_metadata"), null.alias("scrape_status"), null.alias("error_message"), F.transform("posts", post).cast(f"array<{loads.POST}>").alias("posts"))


def load(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.nested is None and a.html is None:
        raise SystemExit("load needs --html or --nested")
    rows = spark.read.schema(loads.NESTED).parquet(a.nested) if a.nested else nested_of(spark.read.parquet(a.html))
    loads.PageStore(spark, a.store).load(rows)
    return status(spark, a)


def analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    s = loads.PageStore(spark, a.store)
    content = content_of(s.posts.read(), None if a.posts_only else s.comments.read())
    if a.replies:
        r = spark.read.parquet(a.replies).groupBy(F.col("content_id").alias("_r")).agg(F.max("reply").alias("reply"))
        content = content.join(r, F.col("content_id") == F.col("_r"), "left").drop("_r")
    return Analyses(spark, f"{a.store}/analysis").run(content, reply="reply" if a.replies else None, again=a.reanalyze)


def status(spark: SparkSession, a: argparse.Namespace) -> dict:
    s, n = loads.PageStore(spark, a.store), Analyses(spark, f"{a.store}/analysis")
    return relational.counts(pages=s.pages.read(), posts=s.posts.read(), comments=s.comments.read(), analyses=n.rows.read(), labels=n.labels.read()).first().asDict()


def report(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = Analyses(spark, f"{a.store}/analysis").rows.read()
    by = lambda df, key: {r[0]: r["n"] for r in df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).collect()}  # noqa: E731  as many rows as the taxonomy has
    return {"categorias": by(rows, "categoria"), "estados": by(rows.withColumn("estado", stats.state()), "estado")}


def duplicates(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Authors are not stored, so that all comments of a post count as one author's."""
    s, n = loads.PageStore(spark, a.store), Analyses(spark, f"{a.store}/analysis")
    c = s.comments.read()
    groups = dedup.clusters(c.select("id", "text", "author", "post_id", "likes", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("id").alias("pos")), a.threshold)
    gone = dedup.duplicate_map(groups).select(F.col("old").alias("id"), "new")
    held = n.rows.read().join(gone.select(F.col("id").alias("_d")), (F.col("content_type") == "comment") & (F.col("content_id") == F.col("_d")), "left_semi").count()
    out = {"duplicates": gone.count(), "analyses_of_duplicates": held, "applied": bool(a.apply)}
    if a.apply and out["duplicates"]:
        hit = c.join(gone.select(F.col("id").alias("_d")), F.col("id") == F.col("_d"), "left_semi").select("page_id", "bucket").distinct()
        left = c.join(gone.select(F.col("id").alias("_d")), F.col("id") == F.col("_d"), "left_anti").join(hit.select(F.col("page_id").alias("_p")), F.col("page_id") == F.col("_p"), "left_semi")
        s.comments.replace_of(hit, left, ["page_id"])
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="tamiz", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("verb", choices=["load", "analyze", "status", "report", "dedup", "all"])
    p.add_argument("--store", required=True, help="folder of the stored tables")
    p.add_argument("--html", help="Parquet of raw pages")
    p.add_argument("--nested", help="Parquet of nested pages")
    p.add_argument("--replies", help="Parquet of models' replies")
    p.add_argument("--reanalyze", action="store_true")
    p.add_argument("--posts-only", action="store_true")
    p.add_argument("--threshold", type=float, default=0.95)
    p.add_argument("--apply", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tamiz {a.verb}").getOrCreate()
    steps = {"load": [load], "analyze": [analyze], "status": [status], "report": [report], "dedup": [duplicates], "all": [load, analyze]}[a.verb]
    out: dict = {}
    for step in steps:
        out.update(step(spark, a))
    print(json.dumps(out, ensure_ascii=False))
    return out


if __name__ == "__main__":
    main()

"""Sinks: what exports hold, and how they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import as_markers
from tamiz.operators.relational import nested


def export_analysis(analysis: DataFrame, texts: DataFrame, longest: int = 500) -> DataFrame:
    """Rows of the analysis section: texts(id, text) cut to `longest` characters."""
    t = texts.select(F.col("id").alias("_k"), F.substring("text", 1, longest).alias("texto"))
    return analysis.join(t, F.col("id") == F.col("_k")).select("id", "categoria", F.coalesce("dimension", F.lit("")).alias("dimension"), "texto")


def export_sections(posts: DataFrame, comments: DataFrame, analyses: DataFrame, labels: DataFrame, longest: int = 500) -> dict[str, DataFrame]:
    """The four sections of an export, by name: posts, comments of these posts, analyses with the number of their labels, labels. Texts are cut to `longest` characters; null is empty."""
    text = lambda c, name=None: F.coalesce(F.substring(c, 1, longest), F.lit("")).alias(name or c)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    held = comments.join(posts.select(F.col("id").alias("_p")).distinct(), F.col("post_id") == F.col("_p"), "left_semi")
    n = labels.groupBy(F.col("analysis_result_id").alias("_a")).agg(F.count("*").alias("_n"))
    counted = analyses.join(n, F.col("id") == F.col("_a"), "left")
    marks = F.array_join(as_markers(F.col("marcadores_detectados")), "|") if labels.schema["marcadores_detectados"].dataType.typeName() == "string" else F.array_join("marcadores_detectados", "|")
    return {
        "posts": posts.select("id", text("text"), said("author"), said("date"), number("likes"), number("comments_count"), number("shares"), said("url"), said("page_id")),
        "comments": held.select("id", text("text"), said("author"), said("date"), number("likes"), "post_id", said("parent_id")),
        "analyses": counted.select("id", "content_type", "content_id", said("tiene_violencia"), said("categoria"), said("dimension"), said("codigo"), said("severidad"), said("confianza"), text("justificacion"), F.coalesce("_n", F.lit(0)).alias("n_etiquetas")),
        "labels": labels.select("analysis_result_id", "orden", said("categoria"), said("dimension"), said("severidad"), said("confianza"), said("score_ajuste"), F.coalesce("es_falso_positivo_probable", F.lit("false")).alias("es_falso_positivo_probable"), said("regla_disparada"),
                                F.coalesce(marks, F.lit("")).alias("marcadores_detectados"), text("justificacion"), text("evidencia")),
    }


def violence_rows(analysis: DataFrame) -> DataFrame:
    """Every violent row twice: under its category and under its severity (seccion, valor), for a report in folders by these two. No group is held together."""
    v = analysis.where(F.col("tiene_violencia") == "true")
    both = F.array(*[F.struct(F.lit(c).alias("seccion"), F.coalesce(F.col(c), F.lit("unknown")).alias("valor")) for c in ("categoria", "severidad")])
    return v.withColumn("_s", F.explode(both)).select("_s.seccion", "_s.valor", *analysis.columns)


def write_violence_report(analysis: DataFrame, path: str) -> None:
    violence_rows(analysis).write.mode("overwrite").partitionBy("seccion", "valor").json(path)


def violence_sections(analysis: DataFrame) -> DataFrame:
    """Violent rows counted by category and by severity."""
    v = analysis.where(F.col("tiene_violencia") == "true")
    part = lambda c: v.groupBy(F.lit(c).alias("seccion"), F.col(c).alias("valor")).agg(F.count("*").alias("n"))
    return part("categoria").unionByName(part("severidad"))


def inspector_rows(analysis: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that aren't excluded with their labels as cat|dim|sev, joined by ||."""
    n = nested(analysis.where("exclusion_label is null").select("id", "content_type"), labels, "id", "analysis_result_id", ["orden"], ["orden", "categoria", "dimension", "severidad"], "_l")
    flat = F.transform("_l", lambda x: F.concat_ws("|", x["categoria"], F.coalesce(x["dimension"], F.lit("")), x["severidad"]))
    return n.select("id", "content_type", F.array_join(flat, "||").alias("etiquetas"))


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """CSV with a header; lists joined by |. Every task writes its own part."""
    flat = [F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", delimiter).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sections(path: str, **sections: DataFrame) -> None:
    """One folder of CSV for each section."""
    for name, df in sections.items():
        write_csv(df, f"{path}/{name}")


def stats_sections(**sections: DataFrame) -> DataFrame:
    """Results of several rules as rows (section, row as JSON), for one file."""
    out = None
    for name, df in sections.items():
        one = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out

"""Few-shot examples as rows, what a person suggested against what a model said, the inspector's rows, titles to show, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.labels import severity
from tamiz.functions.text import as_column, trimmed
from tamiz.functions.vocabulary import NONE

from .replies import _kind, _text, _truth
from .review import adjusted

LABEL = "struct<categoria:string,dimension:string,severidad:string,justificacion:string,evidencia:string,regla_disparada:string,marcadores:array<string>>"


def examples(documents: DataFrame, column: str = "content") -> DataFrame:
    """text, tiene_violencia, severidad, exclusion_label and labels of every example in JSON documents, with the documents' other columns and the example's place.

    A document is an object with a list `examples`; each has a text and a result, with a list of labels or with one
    label's fields. Severities are made canonical, texts trimmed, markers kept as a list; labels are not judged.
    """
    rows = documents.withColumn("_v", F.try_parse_json(column))
    rest = [c for c in documents.columns if c != column]
    rows = rows.select(*rest, F.posexplode_outer(F.try_variant_get("_v", "$.examples", "array<variant>")).alias("pos", "e")).where(_kind(F.col("e"), "$") == "OBJECT")
    rows = rows.withColumn("r", F.try_variant_get("e", "$.result", "variant"))
    r, said = F.col("r"), lambda v, k: trimmed(F.coalesce(_text(v, k), F.lit("")))

    def label(v: Column) -> Column:
        marks = F.filter(F.coalesce(F.try_variant_get(v, "$.marcadores_detectados", "array<string>"), F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != ""))
        return F.struct(said(v, "categoria").alias("categoria"), _text(v, "dimension").alias("dimension"), severity(_text(v, "severidad")).alias("severidad"), said(v, "justificacion").alias("justificacion"),
                        said(v, "evidencia").alias("evidencia"), _text(v, "regla_disparada").alias("regla_disparada"), marks.alias("marcadores"))

    given = F.filter(F.coalesce(F.try_variant_get(r, "$.clasificaciones", "array<variant>"), F.array().cast("array<variant>")), lambda x: _kind(x, "$") == "OBJECT")
    single = F.coalesce(_text(r, "categoria"), F.lit(""))
    none = F.array().cast(f"array<{LABEL}>")
    labels = F.when(F.size(given) > 0, F.transform(given, label)).when(~single.isin("", NONE), F.array(label(r))).otherwise(none)
    rows = rows.withColumn("labels", labels)
    whole = F.coalesce(F.nullif(_text(r, "severidad_global"), F.lit("")), _text(r, "severidad"))
    violent = F.when(_kind(r, "$.tiene_violencia").isNull(), F.size("labels") > 0).otherwise(_truth(r, "tiene_violencia"))
    return rows.select(*rest, "pos", said(F.col("e"), "text").alias("text"), violent.alias("tiene_violencia"), severity(whole).alias("severidad"), F.nullif(_text(r, "exclusion_label"), F.lit("")).alias("exclusion_label"), "labels")


def suggestion(suggested: Column | str, labels: Column | str) -> Column:
    """struct(ia, sugeridas, coinciden, faltan, sobran, resultado): a person's list of sub-dimensions or categories, parted by commas, against predicted labels.

    A suggestion matches a label category/sub-dimension that contains it. resultado: todas, algunas, ninguna, or vacio
    where there is nothing to compare.
    """
    wanted = F.filter(F.transform(F.split(F.coalesce(as_column(suggested), F.lit("")), ","), lambda s: trimmed(s)), lambda s: s != "")
    named = F.filter(as_column(labels), lambda x: ~F.coalesce(x["categoria"], F.lit("")).isin("", NONE))
    said = F.coalesce(F.transform(named, lambda x: F.concat(x["categoria"], F.lit("/"), F.coalesce(x["dimension"], F.lit("")))), F.array().cast("array<string>"))
    matched = F.filter(wanted, lambda d: F.exists(said, lambda a: F.contains(a, d)))
    missed, extra = F.filter(wanted, lambda d: ~F.exists(said, lambda a: F.contains(a, d))), F.filter(said, lambda a: ~F.array_contains(matched, a))
    result = F.when((F.size(matched) > 0) & (F.size(missed) == 0), "todas").when(F.size(matched) > 0, "algunas").when(F.size(extra) > 0, "ninguna").otherwise("vacio")
    return F.struct(said.alias("ia"), wanted.alias("sugeridas"), matched.alias("coinciden"), missed.alias("faltan"), extra.alias("sobran"), result.alias("resultado"))


def inspector(analysis: DataFrame, feedback: DataFrame, posts: DataFrame) -> DataFrame:
    """The adjusted view with the text of posts(id, text); null for what is no post."""
    p = posts.select(F.col("id").alias("_p"), F.col("text").alias("texto"))
    return adjusted(analysis, feedback).join(p, (F.col("content_type") == "post") & (F.col("content_id") == F.col("_p")), "left").drop("_p")


def seeded_titles(current: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(titles of categories, and those that somebody changed): current(code, title, source), or the taxonomy's own where there are none yet."""
    own = dims.select(F.col("categoria").alias("code"), F.coalesce(F.nullif("label", F.lit("")), "categoria").alias("title"), F.lit("taxonomy").alias("source")).distinct()
    some = current.groupBy().agg((F.count("*") > 0).alias("_some"))  # one row
    rows = current.select("code", "title", "source").unionByName(own.crossJoin(some).where("not _some").drop("_some"))
    return rows, rows.where("source <> 'taxonomy'")


def first_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """Any n rows, as a store gives them."""
    return df.limit(n)


def random_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by chance, the same for one seed and one order of partitions; each task keeps its own n at most."""
    return df.orderBy(F.rand(seed)).limit(n)

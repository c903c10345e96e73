"""A reviewer's form: which labels it may hold, and the review that it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.labels import dimension, primary_label, severity
from tamiz.functions.text import as_column, as_markers, as_truth, bound, trimmed
from tamiz.functions.vocabulary import CODES, DIMENSIONS, MAX_LABELS, NONE

LABEL = "struct<categoria:string,dimension:string,severidad:string,justificacion:string>"


def _given(value: Column | str) -> Column:
    """Without white space at both ends; null if nothing is left."""
    return F.nullif(trimmed(as_column(value)), F.lit(""))


def valid_pair(code: Column | str, dim: Column | str) -> Column:
    """Whether a sub-dimension may stand with a category: none with no category or NONE, else none or one of its own."""
    c, d = F.coalesce(as_column(code), F.lit("")), F.coalesce(as_column(dim), F.lit(""))
    own = F.lit(False)
    for k, dims in DIMENSIONS.items():
        own = F.when(c == k, d.isin(dims)).otherwise(own)
    return (d == "") | (~c.isin("", NONE) & own)


def _key(x: Column) -> Column:
    return F.concat_ws("\x01", x["categoria"], F.coalesce(x["dimension"], F.lit("\x02")))


def form_labels(labels: Column | str, most: int = MAX_LABELS) -> Column:
    """Labels of a form made canonical: unknown categories go, of equal (category, sub-dimension) the first stays, in the order given, `most` at most. Null gives an empty list."""
    def clean(x: Column) -> Column:
        return bound(F.struct(_given(x["categoria"]).alias("c"), _given(x["dimension"]).alias("d")), lambda y: F.struct(
            y["c"].alias("categoria"), F.when(y["d"].isNotNull(), dimension(y["c"], y["d"])).alias("dimension"), severity(x["severidad"]).alias("severidad"),
            F.coalesce(x["justificacion"], F.lit("")).alias("justificacion")))

    def firsts(known: Column) -> Column:
        keys = F.transform(known, _key)
        return F.slice(F.filter(known, lambda x, i: F.array_position(keys, _key(x)) == i + 1), 1, most)

    every = F.transform(F.coalesce(as_column(labels), F.array().cast(f"array<{LABEL}>")), clean)
    return bound(F.filter(every, lambda x: F.coalesce(x["categoria"].isin(*CODES, NONE), F.lit(False))), firsts)


FULL_LABEL = "struct<categoria:string,dimension:string,severidad:string,justificacion:string,evidencia:string,regla_disparada:string,marcadores_detectados:string,confianza:double,score_ajuste:double,es_falso_positivo_probable:string>"


def full_form_labels(labels: Column | str, most: int = MAX_LABELS) -> Column:
    """As form_labels, with all fields of FULL_LABEL: evidence, the rule, the markers (a list, or text as JSON or parted by commas) as a list, the flag of a likely false positive as boolean.

    labels: structs with these fields, marcadores_detectados and es_falso_positivo_probable as text.
    """
    more = lambda x: (F.coalesce(x["evidencia"], F.lit("")).alias("evidencia"), _given(x["regla_disparada"]).alias("regla_disparada"), F.transform(as_markers(x["marcadores_detectados"]), lambda m: trimmed(m)).alias("marcadores_detectados"),
                      x["confianza"].alias("confianza"), x["score_ajuste"].alias("score_ajuste"), as_truth(x["es_falso_positivo_probable"]).alias("es_falso_positivo_probable"))

    def clean(x: Column) -> Column:
        return bound(F.struct(_given(x["categoria"]).alias("c"), _given(x["dimension"]).alias("d")), lambda y: F.struct(
            y["c"].alias("categoria"), F.when(y["d"].isNotNull(), dimension(y["c"], y["d"])).alias("dimension"), severity(x["severidad"]).alias("severidad"), F.coalesce(x["justificacion"], F.lit("")).alias("justificacion"), *more(x)))

    def firsts(known: Column) -> Column:
        keys = F.transform(known, _key)
        return F.slice(F.filter(known, lambda x, i: F.array_position(keys, _key(x)) == i + 1), 1, most)

    every = F.transform(F.coalesce(as_column(labels), F.array().cast(f"array<{FULL_LABEL}>")), clean)
    return bound(F.filter(every, lambda x: F.coalesce(x["categoria"].isin(*CODES, NONE), F.lit(False))), firsts)


def payload(reviews: DataFrame) -> DataFrame:
    """The reviews to store: analysis_result_id, agrees ('true' or 'false'), reason, reviewer, corrected_categoria, corrected_dimension, corrected_justificacion, corrected_labels.

    reviews: the same columns, agrees as boolean, corrected_labels a list of LABEL. A review that agrees corrects nothing.
    One without a list has its flat fields as its one label; of several labels the most severe, the first of equal ones,
    gives the flat fields.
    """
    none = F.array().cast(f"array<{LABEL}>")
    flat = F.array(F.struct(F.col("corrected_categoria").alias("categoria"), F.col("corrected_dimension").alias("dimension"), F.lit(None).cast("string").alias("severidad"),
                            F.coalesce("corrected_justificacion", F.lit("")).alias("justificacion")))
    own = F.when(F.coalesce("corrected_categoria", F.lit("")) != "", flat).otherwise(none)
    kept = form_labels(F.when(F.coalesce("agrees", F.lit(False)), none).otherwise(F.coalesce(F.col("corrected_labels").cast(f"array<{LABEL}>"), own)))
    made = reviews.withColumn("corrected_labels", kept).withColumn("_top", primary_label("corrected_labels"))
    return made.select("analysis_result_id", F.when(F.coalesce("agrees", F.lit(False)), "true").otherwise("false").alias("agrees"), _given("reason").alias("reason"), _given("reviewer").alias("reviewer"),
                       F.col("_top.categoria").alias("corrected_categoria"), F.col("_top.dimension").alias("corrected_dimension"), F.col("_top.justificacion").alias("corrected_justificacion"), "corrected_labels")


def precision_shown(value: Column | str) -> Column:
    """A precision given as text, a share or per cent, in per cent with one decimal; 0 if it is no number."""
    v = trimmed(F.regexp_replace(as_column(value).cast("string"), "%+$", "")).try_cast("double")
    return F.coalesce(F.round(F.when((v > 0) & (v <= 1), v * 100).otherwise(v), 1), F.lit(0.0))

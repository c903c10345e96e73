"""Stored replies of models: JSON repaired step by step, and classifications read from it.

JSON is read as VARIANT in the JVM, so that a reply of any shape has a value; only a reply that no JSON reader takes goes
to Python, as a last step. Every reply has a row in the result, and one that can't be read has a code and its own text in
a rescue column.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.labels import highest_severity, severity, valid_labels
from tamiz.functions.text import as_column, as_markers, as_number, as_truth, reply_body, trimmed
from tamiz.functions.vocabulary import COMMON, MAX_LABELS, NONE

#: Steps of the ladder in order, and what stands for a text that no step can read.
STEPS = ("strict", "quotes", "escapes", "literal")
UNREAD = "unread"
#: Codes of replies that give no classification.
NO_REPLY, EMPTY, INVALID, NO_OBJECT = "no_reply", "empty_response_after_strip", "invalid_json", "not_an_object"
REASON = "Violencia común / sin sesgo de género."
MORE = ("justificacion", "evidencia", "regla_disparada", "confianza", "score_ajuste", "falso_positivo")
LABEL = "struct<categoria:string,dimension:string,severidad:string,marcadores:array<string>,justificacion:string,evidencia:string,regla_disparada:string,confianza:double,score_ajuste:double,falso_positivo:boolean>"


def literal_json(text: str | None) -> str | None:
    """JSON of a Python literal; null if it is none."""
    if text is None:
        return None
    try:
        return json.dumps(ast.literal_eval(text.strip()), ensure_ascii=False, default=list)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def literals(text: Column) -> Column:
    """JSON of texts that are Python literals, in batches; nulls cost nothing."""
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(literal_json, na_action="ignore").astype(object)

    return F.pandas_udf(read, "string")(text)


def repaired(df: DataFrame, column: str) -> DataFrame:
    """df with json (VARIANT), json_step and json_rescue of a text column that may hold JSON.

    Strict JSON first; then with single quotes as double ones; then also without the backslashes of escapes that JSON
    hasn't; then as a Python literal (True, None, tuples, commas at the end). A step sees the rows only that failed all
    before it, and Python those that failed three. Blank and null texts have no step and no rescue. An object with a
    key twice is no JSON here.
    """
    raw = F.col(column)
    blank = trimmed(F.coalesce(raw, F.lit(""))) == ""
    rows = df.withColumn("_a", F.when(~blank, F.try_parse_json(raw)))
    left = ~blank & F.col("_a").isNull()
    rows = rows.withColumn("_quoted", F.when(left, F.replace(raw, F.lit("'"), F.lit('"')))).withColumn("_b", F.try_parse_json("_quoted"))
    rows = rows.withColumn("_fixed", F.when(F.col("_b").isNull(), F.regexp_replace("_quoted", r'\\([^"\\/bfnrtu])', "$1"))).withColumn("_c", F.try_parse_json("_fixed"))
    rows = rows.withColumn("_d", F.try_parse_json(literals(F.when(F.col("_c").isNull(), F.col("_fixed")))))
    steps = ["_a", "_b", "_c", "_d"]
    step = F.when(blank, None)
    for name, c in zip(STEPS, steps, strict=True):
        step = step.when(F.col(c).isNotNull(), name)
    out = rows.withColumn("json", F.coalesce(*steps)).withColumn("json_step", step.otherwise(UNREAD))
    return out.withColumn("json_rescue", F.when(F.col("json_step") == UNREAD, raw)).drop(*steps, "_quoted", "_fixed")


def _kind(v: Column, path: str) -> Column:
    """'OBJECT', 'ARRAY', 'STRING', 'VOID' ... of what stands at a path; null where nothing does."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _truth(v: Column, key: str) -> Column:
    """Texts by what they say, numbers but 0 and lists but empty ones are true; null and missing aren't."""
    kind, said = _kind(v, f"$.{key}"), _text(v, key)
    return F.coalesce(F.when(kind == "STRING", as_truth(said)).when(kind.isin("ARRAY", "OBJECT"), ~said.isin("[]", "{}")).otherwise(F.try_variant_get(v, f"$.{key}", "boolean")), F.lit(False))


def _label(v: Column, trim: bool) -> Column:
    """A label as it is given, each field of any type made the one it has to be."""
    said = lambda k: trimmed(F.coalesce(_text(v, k), F.lit(""))) if trim else F.coalesce(_text(v, k), F.lit(""))
    number = lambda k: F.when(_kind(v, f"$.{k}") != "BOOLEAN", as_number(_text(v, k)))
    return F.struct(_text(v, "categoria").alias("categoria"), _text(v, "dimension").alias("dimension"), _text(v, "severidad").alias("severidad"), as_markers(_text(v, "marcadores_detectados")).alias("marcadores"),
                    said("justificacion").alias("justificacion"), said("evidencia").alias("evidencia"), trimmed(_text(v, "regla_disparada")).alias("regla_disparada"),
                    number("confianza").alias("confianza"), number("score_ajuste").alias("score_ajuste"), _truth(v, "es_falso_positivo_probable").alias("falso_positivo"))


def classifications(df: DataFrame, reply: str, most: int = MAX_LABELS, repair: bool = False) -> DataFrame:
    """df with the classification that a reply holds: error, rescue, tiene_violencia, severidad_global, labels, exclusion_label, exclusion_codigo, exclusion_justificacion.

    A reply is an object with a list of labels, or with one label's fields. Labels are made canonical and ranked
    (valid_labels); common violence is an exclusion and leaves no labels. A reply with an error (one of the codes above,
    with the reply in rescue) has no labels and no exclusion. repair: replies that are no strict JSON go up the ladder.
    """
    none = F.array().cast(f"array<{LABEL}>")
    rows = df.withColumn("_body", reply_body(reply))
    rows = repaired(rows, "_body").drop("json_step", "json_rescue").withColumnRenamed("json", "_v") if repair else rows.withColumn("_v", F.try_parse_json("_body"))
    v = F.col("_v")
    rows = rows.withColumn("_error", F.when(F.col(reply).isNull(), NO_REPLY).when(F.col("_body") == "", EMPTY).when(v.isNull(), INVALID).when(_kind(v, "$") != "OBJECT", NO_OBJECT))
    listed = F.filter(F.try_variant_get(v, "$.clasificaciones", "array<variant>"), lambda x: _kind(x, "$") == "OBJECT")
    given = F.when(_kind(v, "$.clasificaciones") == "ARRAY", F.transform(listed, lambda x: _label(x, True))).otherwise(F.array(_label(v, False)))
    whole = F.upper(trimmed(F.coalesce(_text(v, "categoria"), F.lit("")))) == COMMON
    rows = rows.withColumn("_labels", F.when(F.col("_error").isNull() & ~whole, valid_labels(given, most, MORE)).otherwise(none))
    rows = rows.withColumn("_common", F.try_element_at(F.filter("_labels", lambda x: x["categoria"] == COMMON), F.lit(1)))

    def read(r: DataFrame) -> DataFrame:
        fine, one = F.col("_error").isNull(), F.col("_common")
        excluded = whole | one.isNotNull()
        labels = F.when(excluded, none).otherwise(F.col("_labels"))
        stated = F.when(_kind(v, "$.tiene_violencia").isNull(), F.lit(True)).otherwise(_truth(v, "tiene_violencia"))
        top = F.when(_text(v, "severidad_global").isNotNull(), severity(_text(v, "severidad_global"))).otherwise(highest_severity(F.transform("_labels", lambda x: x["severidad"])))
        filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))

        def exclusion(field: str, of_reply: Column, of_label: Column) -> Column:
            return F.when(fine, F.when(whole, of_reply).when(one.isNotNull(), of_label).otherwise(_text(v, field))).alias(field)

        new = {"error": F.col("_error"), "rescue": F.when(~fine, as_column(reply)), "tiene_violencia": F.coalesce(fine & ~excluded & (F.size("_labels") > 0) & stated, F.lit(False)),
               "severidad_global": F.when(fine & ~excluded, top).otherwise(NONE), "labels": labels,
               "exclusion_label": exclusion("exclusion_label", F.lit(COMMON), F.lit(COMMON)),
               "exclusion_codigo": exclusion("exclusion_codigo", filled(_text(v, "codigo"), COMMON + "_LLM"), filled(one["regla_disparada"], COMMON + "_LLM")),
               "exclusion_justificacion": exclusion("exclusion_justificacion", filled(_text(v, "justificacion"), REASON), filled(one["justificacion"], REASON))}
        return r.withColumns(new).drop("_body", "_v", "_error", "_labels", "_common")

    return read(rows)

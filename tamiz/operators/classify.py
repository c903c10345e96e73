"""Rule classification by keyword buckets, and a hook for an outside model."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.exclusion import PATTERNS, exclusion_code
from tamiz.functions.labels import highest_severity, severity_rank
from tamiz.functions.text import as_column, bound, trimmed, without_accents
from tamiz.functions.vocabulary import BUCKETS, JUNK, MAX_LABELS

from .replies import LABEL, NO_OBJECT, NO_REPLY, classifications


def plain(words: list[str]) -> list[str]:
    import unicodedata

    return ["".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c)) for w in words]


HITS = "array<struct<i:int,categoria:string,dimension:string,severidad:string,score:int,bucket:string,marcadores:array<string>>>"


def numbered(buckets: list[tuple]) -> dict[str, int]:
    """All words and contexts of buckets, plain, and their numbers."""
    return {w: i for i, w in enumerate(sorted({p for *_, words, context in buckets for p in plain([*words, *(context or [])])}))}


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, word in enumerate(words):
        a.add_word(word, i)
    a.make_automaton()
    return a


def words_found(norm: Column, words: tuple[str, ...]) -> Column:
    """array<int>: places of those of the words that occur anywhere in a normalised text, all in one pass over it; null for null.

    It leaves the JVM, as Spark has no search for many words at once (a scan for each is many times slower), and counts as
    not deterministic, so that no filter repeats it.
    """

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _automaton(words).iter
        for batch in batches:
            yield batch.map(lambda t: sorted({i for _, i in find(t)}), na_action="ignore")

    return F.pandas_udf(scan, "array<int>").asNondeterministic()(norm)


def keyword_labels(text: Column | str, most: int = MAX_LABELS, buckets: list[tuple] = BUCKETS) -> Column:
    """array<struct(categoria, dimension, severidad, score, buckets, marcadores)> of the buckets that the text hits. buckets: as rules.buckets_of gives them.

    Words match anywhere, without case and accents. Buckets of one (category, sub-dimension) join: the first one's
    severity unless a later one is higher, all their markers, the highest score. Most severe first, then bucket order.
    """
    numbers = numbered(buckets)

    def hits(found: Column) -> Column:
        has = lambda word: F.array_contains(found, numbers[word])
        out = []
        for i, (name, cat, dim, sev, score, words, context) in enumerate(buckets):
            markers = F.array_compact(F.array(*[F.when(has(p), F.lit(w)) for w, p in zip(words, plain(words), strict=True)]))
            near = F.arrays_overlap(found, F.array(*[F.lit(numbers[p]) for p in plain(context)])) if context else F.lit(True)
            head = [F.lit(v).alias(k) for k, v in (("i", i), ("categoria", cat), ("dimension", dim), ("severidad", sev), ("score", score), ("bucket", name))]
            out.append(F.struct(*head, F.when(near, markers).otherwise(F.array().cast("array<string>")).alias("marcadores")))
        # Most texts have none of the words.
        return F.filter(F.when(F.size(found) > 0, F.array(*out)), lambda x: F.size(x["marcadores"]) > 0)

    def ranked(hit: Column) -> Column:
        firsts = F.filter(hit, lambda x: ~F.exists(hit, lambda y: (y["i"] < x["i"]) & (y["dimension"] == x["dimension"])))

        def joined(x: Column) -> Column:
            def of(own: Column) -> Column:
                return bound(F.array_max(F.transform(own, lambda y: severity_rank(y["severidad"]))), lambda top: F.struct(
                    (-top).alias("o"), x["i"].alias("i"), x["categoria"].alias("categoria"), x["dimension"].alias("dimension"), F.element_at(F.filter(own, lambda y: severity_rank(y["severidad"]) == top), 1)["severidad"].alias("severidad"),
                    F.array_max(F.transform(own, lambda y: y["score"])).alias("score"), F.transform(own, lambda y: y["bucket"]).alias("buckets"), F.array_distinct(F.flatten(F.transform(own, lambda y: y["marcadores"]))).alias("marcadores")))

            return bound(F.filter(hit, lambda y: y["dimension"] == x["dimension"]), of)  # a sub-dimension belongs to one category

        best = F.slice(F.array_sort(F.transform(firsts, joined)), 1, most)
        return F.transform(best, lambda x: F.struct(*[x[f].alias(f) for f in ("categoria", "dimension", "severidad", "score", "buckets", "marcadores")]))

    found = words_found(without_accents(F.lower(as_column(text))), tuple(numbers))
    return bound(bound(found, lambda x: F.coalesce(hits(x), F.array().cast(HITS))), ranked)


def ask(model: Callable[[pd.Series], pd.Series], text: Column) -> Column:
    """struct(reply, seconds) of the model for every text, batch by batch; null for a null text, which the model never sees, and a null reply for a whole batch at which the model fails. seconds: the batch's time over its texts."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = batch.notna()
            out = pd.DataFrame({"reply": pd.Series([None] * len(batch), dtype=object), "seconds": pd.Series([None] * len(batch), dtype="Float64")})
            if given.any():
                began = time.monotonic()
                try:
                    out.loc[given, "reply"] = list(model(batch[given].reset_index(drop=True)))
                except Exception:  # whatever an outside model raises: its rows have no reply, and keyword labels stand in
                    logging.getLogger(__name__).exception("the model failed on %d texts", int(given.sum()))
                out.loc[given, "seconds"] = (time.monotonic() - began) / int(given.sum())
            yield out

    return F.pandas_udf(run, "reply string, seconds double").asNondeterministic()(text)


def as_labels(found: Column, text: Column) -> Column:
    """Keyword labels in the form of those read from replies."""
    share = lambda x: F.least(F.lit(1.0), x["score"] / 3.0)
    return F.transform(found, lambda x: F.struct(
        x["categoria"].alias("categoria"), x["dimension"].alias("dimension"), x["severidad"].alias("severidad"), x["marcadores"].alias("marcadores"),
        F.concat(F.lit("Fallback rule-based: buckets="), F.array_join(x["buckets"], ", "), F.lit("; marcadores="), F.array_join(x["marcadores"], ", ")).alias("justificacion"), F.substring(text, 1, 200).alias("evidencia"),
        F.concat(F.lit("rule-based:"), F.array_join(x["buckets"], ",")).alias("regla_disparada"), share(x).alias("confianza"), share(x).alias("score_ajuste"), F.lit(False).alias("falso_positivo")).cast(LABEL))


def classify(content: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, text: str = "text", reply: str | None = None, patterns: list[tuple[str, str]] = PATTERNS, buckets: list[tuple] = BUCKETS) -> DataFrame:
    """content with tiene_violencia, severidad_global, labels, exclusion_label, exclusion_codigo, exclusion_justificacion, error and seconds, the time a model took.

    A blank text has no label and no exclusion. What the cascade excludes reaches no model. The rest goes to the model
    (texts of a batch to its replies, null where it has none), or has its reply in a column; replies are read as in
    replies.classifications. A text without a reply, or with one that is no object, has keyword labels, and so has every text
    without a model; the error says which. A reply that can't be read gives no labels, and the error says so.
    patterns and buckets: rules that were scanned, in place of the fixed ones.
    """
    t = F.col(text)
    rows = content.withColumn("_code", F.when(trimmed(F.coalesce(t, F.lit(""))) != "", exclusion_code(t, patterns)))
    # One evaluation of the cascade: what is open is a column of its own, and all that follows hangs on it.
    rows = rows.withColumn("_open", F.when((trimmed(F.coalesce(t, F.lit(""))) != "") & F.col("_code").isNull(), t))
    if model is None and reply is None:
        rows = rows.withColumns({"error": F.lit(None).cast("string"), "labels": as_labels(keyword_labels("_open", buckets=buckets), t)})
    else:
        if model is None:
            rows = rows.withColumn("_reply", F.when(F.col("_open").isNotNull(), F.col(reply)))
        else:
            rows = rows.withColumn("_asked", ask(model, F.col("_open"))).withColumns({"_reply": F.col("_asked.reply"), "_seconds": F.col("_asked.seconds")})
        rows = classifications(rows, "_reply").drop("rescue")
        for c in ("tiene_violencia", "severidad_global", "labels", "exclusion_label", "exclusion_codigo", "exclusion_justificacion", "error"):
            rows = rows.withColumnRenamed(c, f"_r_{c}")
        rows = rows.withColumn("error", F.when(F.col("_open").isNotNull(), F.col("_r_error")))
        by_rule = F.col("error").isin(NO_REPLY, NO_OBJECT)
        rows = rows.withColumn("_rules", as_labels(keyword_labels(F.when(by_rule, F.col("_open")), buckets=buckets), t))
        rows = rows.withColumn("labels", F.when(by_rule, F.col("_rules")).when(F.col("_open").isNotNull(), F.col("_r_labels")).otherwise(F.array().cast(f"array<{LABEL}>")))
    read = [c for c in rows.columns if c.startswith("_r_")]
    own = F.coalesce(F.col("error").isin(NO_REPLY, NO_OBJECT), F.lit(False)) if read else F.lit(True)
    of_reply = lambda c: F.when(F.col("_open").isNotNull() & ~own, F.col(f"_r_{c}")) if read else F.lit(None)
    severities = F.transform("labels", lambda x: x["severidad"])
    return rows.select(
        *content.columns, F.when(F.coalesce(of_reply("tiene_violencia").cast("boolean"), F.size("labels") > 0), "true").otherwise("false").alias("tiene_violencia"),
        F.coalesce(of_reply("severidad_global").cast("string"), highest_severity(severities)).alias("severidad_global"), "labels",
        F.coalesce(F.when(F.col("_code").isNotNull(), JUNK), of_reply("exclusion_label").cast("string")).alias("exclusion_label"),
        F.coalesce("_code", of_reply("exclusion_codigo").cast("string")).alias("exclusion_codigo"), of_reply("exclusion_justificacion").cast("string").alias("exclusion_justificacion"), "error",
        (F.col("_seconds") if "_seconds" in rows.columns else F.lit(None).cast("double")).alias("seconds"))

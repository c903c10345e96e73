"""Multi-label evaluation of predictions against a ground truth.

Both sides are rows (content_id, categoria, dimension); ids that have no label are in items(content_id) alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(df: DataFrame) -> Column:
    return F.concat(F.col("categoria"), F.lit("::"), F.coalesce("dimension", F.lit("None")))


def per_item(items: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """For each item the sizes of both label sets, their Jaccard similarity (1 if both are empty), kind of match and item errors.

    items: content_id, gt_exclusion, pred_exclusion. The match is exact only if the exclusions are equal too.
    """
    sides = truth.select("content_id", _pair(truth).alias("pair"), F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predicted.select("content_id", _pair(predicted).alias("pair"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    pairs = sides.groupBy("content_id", "pair").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    n = pairs.groupBy(F.col("content_id").alias("_k")).agg(F.sum("t").alias("n_gt"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("both"), F.count("*").alias("either"))
    j = items.join(n, F.col("content_id") == F.col("_k"), "left").na.fill(0, ["n_gt", "n_pred", "both", "either"])
    exact = (F.col("both") == F.col("either")) & F.col("gt_exclusion").eqNullSafe(F.col("pred_exclusion"))
    return j.select("content_id", "n_gt", "n_pred", F.when(F.col("either") == 0, 1.0).otherwise(F.try_divide(F.col("both").cast("double"), F.col("either"))).alias("jaccard"),
                    F.when(exact, "exact").when(F.col("both") > 0, "partial").otherwise("none").alias("match"),
                    ((F.col("n_gt") == 0) & (F.col("n_pred") > 0)).alias("item_fp"), ((F.col("n_gt") > 0) & (F.col("n_pred") == 0)).alias("item_fn"))


def _rates(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.select("*", F.round(ratio(tp, tp + fp), 3).alias("precision"), F.round(ratio(tp, tp + fn), 3).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 3).alias("f1"))


def _hits(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    t = truth.select(F.col("content_id").alias("tk"), _pair(truth).alias("tp_")).distinct()
    p = predicted.select(F.col("content_id").alias("pk"), _pair(predicted).alias("pp_")).distinct()
    return t.join(p, (F.col("tk") == F.col("pk")) & (F.col("tp_") == F.col("pp_")), "full_outer")


def per_class(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of every category::sub-dimension."""
    n = _hits(truth, predicted).groupBy(F.coalesce("tp_", "pp_").alias("clase")).agg(
        F.count_if(F.col("tk").isNotNull() & F.col("pk").isNotNull()).alias("tp"), F.count_if(F.col("tk").isNull()).alias("fp"), F.count_if(F.col("pk").isNull()).alias("fn"))
    return _rates(n)


def micro(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same over all classes together, one row."""
    return _rates(_hits(truth, predicted).agg(
        F.count_if(F.col("tk").isNotNull() & F.col("pk").isNotNull()).alias("tp"), F.count_if(F.col("tk").isNull()).alias("fp"), F.count_if(F.col("pk").isNull()).alias("fn")))


def summary(items: DataFrame) -> DataFrame:
    """One row over per_item: matches, item errors, averages."""
    n = lambda v: F.count_if(F.col("match") == v)
    return items.agg(F.count("*").alias("n_items"), n("exact").alias("exact"), n("partial").alias("partial"), n("none").alias("none"), F.count_if("item_fp").alias("item_fp"),
                     F.count_if("item_fn").alias("item_fn"), F.round(F.avg("jaccard"), 3).alias("avg_jaccard"), F.round(F.avg("n_gt"), 2).alias("avg_n_gt"), F.round(F.avg("n_pred"), 2).alias("avg_n_pred"))


def label_histogram(items: DataFrame) -> DataFrame:
    """How many items have how many labels, on each side."""
    side = lambda c, s: items.groupBy(F.col(c).alias("n_labels")).agg(F.count("*").alias("items")).withColumn("side", F.lit(s))
    return side("n_gt", "ground_truth").unionByName(side("n_pred", "predicted"))


# Evaluation of a classifier that runs in this job


def category_of(orden: Column, codes: list[str]) -> Column:
    """A category's code by its ordinal, from 1; a made code for others, so that they match nothing."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, codes)), F.when(orden > 0, orden)), F.concat(F.lit("UNKNOWN_"), orden.cast("string")))


def live(items: DataFrame, classified: Callable[[DataFrame], DataFrame], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items to evaluate, predicted labels) of a classifier over items(content_id, text, gt_exclusion).

    classified: content to the same with labels, exclusion_label, error and seconds, as classify.classify gives it. Items
    without a text are left out of both, as what nobody could classify. What failed stays among the items, with nothing
    predicted and its error. folder: where what the classifier gives is written once, for both results to read; without one,
    each use of either runs the classifier.
    """
    rows = classified(items.where(F.coalesce("text", F.lit("")) != ""))
    kept = rows.select("content_id", "gt_exclusion", F.col("exclusion_label").alias("pred_exclusion"), "error", "seconds", F.transform("labels", lambda x: F.struct(x["categoria"].alias("categoria"), x["dimension"].alias("dimension"))).alias("labels"))
    if folder is not None:
        kept.write.parquet(folder)
        kept = items.sparkSession.read.schema(kept.schema).parquet(folder)
    return kept, kept.select("content_id", F.explode("labels").alias("l")).select("content_id", "l.categoria", "l.dimension").distinct()


def focused(items: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """content_id, match, jaccard, gt and pred (sorted lists), seconds and error of every item that was classified.

    The match is by labels alone: exact, partial, fn, fp, or none where both sides have labels that share none. Each item has one.
    """
    lists = lambda df, name: df.groupBy(F.col("content_id").alias("_k" + name)).agg(F.sort_array(F.collect_set(_pair(df))).alias(name))
    empty = F.array().cast("array<string>")
    j = items.join(lists(truth, "gt"), F.col("content_id") == F.col("_kgt"), "left").join(lists(predicted, "pred"), F.col("content_id") == F.col("_kpred"), "left")
    j = j.withColumns({"gt": F.coalesce("gt", empty), "pred": F.coalesce("pred", empty)})
    both, either = F.size(F.array_intersect("gt", "pred")), F.size(F.array_union("gt", "pred"))
    match = F.when(both == either, "exact").when(both > 0, "partial").when(F.size("pred") == 0, "fn").when(F.size("gt") == 0, "fp").otherwise("none")
    return j.select("content_id", match.alias("match"), F.round(F.when(either == 0, 1.0).otherwise(F.try_divide(both.cast("double"), either)), 3).alias("jaccard"), "gt", "pred", "seconds", "error")


def focused_summary(per_item_: DataFrame) -> DataFrame:
    """One row: items, matches of each kind, average similarity, errors, seconds."""
    n = lambda v: F.count_if(F.col("match") == v).alias(v)
    return per_item_.agg(F.count("*").alias("n_items"), n("exact"), n("partial"), n("fp"), n("fn"), n("none"), F.round(F.avg("jaccard"), 3).alias("avg_jaccard"), F.count("error").alias("errors"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 1).alias("seconds"))

"""Labels: categories, sub-dimensions and severities made canonical; lists of labels checked and ranked.

All are column expressions. A label is a struct with categoria, dimension, severidad and marcadores at least.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, bound, trimmed, without_accents
from .vocabulary import CODES, COMMON, DIMENSIONS, LABELS, MATCH_ORDER, MAX_LABELS, NONE, SAFEGUARD


def _slug(text: Column) -> Column:
    low = F.lower(without_accents(text))
    return F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def category(value: Column | str) -> Column:
    """The canonical code of a free-form category; null, blank and unknown ones give NONE.

    A fragment takes the first code, in matching order, that contains it.
    """
    def match(x: Column) -> Column:
        out = F.when(x["raw"] == "", NONE).when(x["raw"].isin(MATCH_ORDER), x["raw"])
        for code in MATCH_ORDER:
            out = out.when(F.contains(F.lit(code.lower()), x["slug"]), code)
        return out.when(F.upper(x["raw"]) == COMMON, COMMON).otherwise(NONE)

    raw = trimmed(F.coalesce(as_column(value).cast("string"), F.lit("")))
    return bound(bound(raw, lambda r: F.struct(r.alias("raw"), _slug(r).alias("slug"))), match)


def dimension(code: Column | str, value: Column | str) -> Column:
    """The sub-dimension if its category has it, leading zeros repaired; the safeguard category has a default for a missing one."""
    def match(x: Column) -> Column:
        c, r = x["c"], x["raw"]
        missing = (r == "") | F.lower(r).isin("null", "none", NONE)
        bare, valid = F.regexp_replace(r, "^0+", ""), F.lit(None).cast("string")
        for k, dims in DIMENSIONS.items():
            valid = F.when(c == k, F.when(r.isin(dims), r).when(bare.isin(dims), bare)).otherwise(valid)
        return F.when(missing, F.when(c == SAFEGUARD, "6.3")).otherwise(valid)

    return bound(F.struct(as_column(code).alias("c"), trimmed(F.coalesce(as_column(value).cast("string"), F.lit(""))).alias("raw")), match)


def severity(value: Column | str) -> Column:
    """baja, media, alta or ninguna; of a range the lower end, the extreme counts as alta."""
    first = F.split(F.lower(trimmed(F.coalesce(as_column(value).cast("string"), F.lit("")))), "-")[0]
    return F.when(first.isin("baja", "media", "alta"), first).when(first == "extrema", "alta").otherwise(NONE)


def severity_rank(value: Column | str) -> Column:
    v = F.lower(F.coalesce(as_column(value), F.lit(NONE)))
    return F.when(v == "alta", 3).when(v == "media", 2).when(v == "baja", 1).otherwise(0)


def highest_severity(values: Column | str) -> Column:
    """Of a list of severities; an empty one gives NONE."""
    has = lambda name: F.exists(as_column(values), lambda x: F.lower(x) == name)
    return F.when(has("alta"), "alta").when(has("media"), "media").when(has("baja"), "baja").otherwise(NONE)


def primary_label(labels: Column | str) -> Column:
    """The label of highest severity, the first of several; null for an empty list."""
    ls = as_column(labels)
    ranks = F.transform(ls, lambda x: severity_rank(x["severidad"]))
    at = F.array_position(ranks, F.array_max(ranks)).cast("int")
    return F.when(F.size(ls) > 0, F.element_at(ls, F.greatest(at, F.lit(1))))


def valid_labels(labels: Column | str, most: int = MAX_LABELS, carry: tuple[str, ...] = ()) -> Column:
    """Canonical labels without NONE; of equal ones (category, sub-dimension, markers) the most severe; most severe first, then as given.

    carry: fields of a label that stay with it, as they are.
    """
    kept = ("categoria", "dimension", "severidad", "marcadores", *carry)

    def normal(x: Column) -> Column:
        return bound(category(x["categoria"]), lambda c: bound(F.struct(c.alias("c"), dimension(c, x["dimension"]).alias("d"), severity(x["severidad"]).alias("s")), lambda y: F.struct(
            y["c"].alias("categoria"), y["d"].alias("dimension"), y["s"].alias("severidad"), x["marcadores"].alias("marcadores"), *[x[f].alias(f) for f in carry], severity_rank(y["s"]).alias("rank"),
            F.concat_ws("\x01", y["c"], F.coalesce(y["d"], F.lit("\x02")), F.array_join(F.array_sort(x["marcadores"]), "\x03")).alias("key"))))

    def ranked(known: Column) -> Column:
        def best(x: Column, i: Column) -> Column:
            def chosen(same: Column) -> Column:
                return bound(F.array_max(F.transform(same, lambda y: y["rank"])), lambda top: F.struct(
                    (-top).alias("o"), i.alias("i"), F.element_at(F.filter(same, lambda y: y["rank"] == top), 1).alias("label"), (F.array_position(F.transform(known, lambda y: y["key"]), x["key"]) == i + 1).alias("first")))

            return bound(F.filter(known, lambda y: y["key"] == x["key"]), chosen)

        ordered = F.array_sort(F.filter(F.transform(known, best), lambda x: x["first"]))
        return F.transform(F.slice(ordered, 1, most), lambda x: F.struct(*[x["label"][f].alias(f) for f in kept]))

    return bound(F.filter(F.transform(F.coalesce(as_column(labels), F.array()), normal), lambda x: x["categoria"] != NONE), ranked)


def category_title(code: Column | str, override: Column | None = None) -> Column:
    """A category's title: an override first, then the taxonomy's, then the code in words."""
    c = as_column(code)
    title = F.lit(None).cast("string")
    for k in CODES:
        title = F.when(c == k, LABELS[k]).otherwise(title)
    words = F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.coalesce(*([override] if override is not None else []), title, words)


def is_violent_label(code: Column, dim: Column, false_positive: Column) -> Column:
    """Whether a corrected label carries violence: all do but NONE, and the safeguard flagged as a false positive."""
    c = F.upper(F.coalesce(code, F.lit("")))
    return ~((c == "") | (c == NONE.upper()) | ((c == SAFEGUARD) & (F.coalesce(dim, F.lit("")) == "6.3") & F.coalesce(false_positive, F.lit(False))))

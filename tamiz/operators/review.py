"""Human reviews over automatic analyses: the adjusted view, its breakdowns, the review listing, label differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.labels import is_violent_label, severity_rank
from tamiz.functions.vocabulary import COMMON, NONE, SAFEGUARD

from .relational import first_of
from .stats import is_excluded, percent


def latest(feedback: DataFrame, last_given: bool = False) -> DataFrame:
    """One review for each analysis: the latest, the first given of several; or the one given last. pos is the order given."""
    order = [F.desc("pos")] if last_given else [F.coalesce("updated_at", F.lit("")).desc(), F.asc("pos")]
    return first_of(feedback.where(F.col("analysis_result_id").isNotNull()), ["analysis_result_id"], order)


def adjusted(analysis: DataFrame, feedback: DataFrame, feedback_labels: DataFrame | None = None) -> DataFrame:
    """Analyses with corrections applied, and has_feedback and adjusted_by_human.

    Excluded rows never change. A review's list of labels beats its flat fields; a disagreement that names no category
    leaves the category and still counts as violence. feedback_labels: analysis_result_id, orden, categoria, dimension,
    severidad, justificacion, falso_positivo.
    """
    f = latest(feedback).select(F.col("analysis_result_id").alias("_k"), "agrees", "corrected_categoria", "corrected_dimension")
    out = analysis.join(f, F.col("id") == F.col("_k"), "left")
    if feedback_labels is not None:
        top = first_of(feedback_labels, ["analysis_result_id"], [severity_rank("severidad").desc(), F.asc("orden")])
        out = out.join(top.select(F.col("analysis_result_id").alias("_l"), F.col("categoria").alias("_lc"), F.col("dimension").alias("_ld"), F.col("falso_positivo").alias("_lf")), F.col("id") == F.col("_l"), "left")
    else:
        out = out.withColumns({"_l": F.lit(None).cast("long"), "_lc": F.lit(None).cast("string"), "_ld": F.lit(None).cast("string"), "_lf": F.lit(None).cast("boolean")})
    differs = (F.lower("agrees") == "false") & F.col("exclusion_label").isNull() & F.col("_k").isNotNull()
    listed = differs & F.col("_l").isNotNull()
    flat = differs & F.col("_l").isNull()
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    violent = F.when(listed, is_violent_label(F.col("_lc"), F.col("_ld"), F.col("_lf"))).otherwise(F.upper(F.coalesce("corrected_categoria", F.lit(""))) != NONE.upper())
    changed = F.coalesce(listed | (flat & (given("corrected_categoria") | given("corrected_dimension"))), F.lit(False))
    kept = [c for c in analysis.columns if c not in ("categoria", "dimension", "tiene_violencia")]
    return out.select(
        *kept, F.when(listed, F.coalesce("_lc", "categoria")).when(flat & given("corrected_categoria"), F.col("corrected_categoria")).otherwise(F.col("categoria")).alias("categoria"),
        F.when(listed, F.coalesce("_ld", "dimension")).when(flat & given("corrected_dimension"), F.col("corrected_dimension")).otherwise(F.col("dimension")).alias("dimension"),
        F.when(differs, F.when(violent, "true").otherwise("false")).otherwise(F.col("tiene_violencia")).alias("tiene_violencia"),
        F.col("_k").isNotNull().alias("has_feedback"), changed.alias("adjusted_by_human"))


def adjustment_share(rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count("*").alias("total"), F.count_if("adjusted_by_human").alias("adjusted_count"))
    pct = F.round(percent(F.col("adjusted_count"), F.col("total")), 1)
    return n.select("total", "adjusted_count", pct.alias("adjusted_pct"), F.when(F.col("total") > 0, F.round(100.0 - pct, 1)).otherwise(0.0).alias("autonomous_pct"))


def validation_share(rows: DataFrame) -> DataFrame:
    """Agreed, disagreed and pending over rows that aren't excluded."""
    net = ~is_excluded()
    n = rows.agg(F.count("*").alias("total"), F.count_if(net).alias("net_total"), F.count_if(net & F.col("has_feedback") & ~F.col("adjusted_by_human")).alias("agreed_count"),
                 F.count_if(net & F.col("adjusted_by_human")).alias("disagreed_count"))
    done = F.col("agreed_count") + F.col("disagreed_count")
    pct = F.round(percent(done, F.col("net_total")), 1)
    return n.select("*", done.alias("validated_count"), (F.col("net_total") - done).alias("pending_count"), pct.alias("validated_pct"), F.round(100.0 - pct, 1).alias("pending_pct"))


def listing(analysis: DataFrame, feedback: DataFrame, content_type: str | None = None, review_state: str = "all", only_violent: bool = False) -> DataFrame:
    """Rows to review with their status: agreed, disagreed or pending by the review given last. Excluded rows aren't listed."""
    f = latest(feedback, last_given=True).select(F.col("analysis_result_id").alias("_k"), F.lower(F.coalesce("agrees", F.lit(""))).alias("_a"))
    rows = analysis.where(~is_excluded())
    if content_type:
        rows = rows.where(F.col("content_type") == content_type)
    if only_violent:
        rows = rows.where(F.col("tiene_violencia") == "true")
    status = F.when(F.col("_k").isNull(), "pending").when(F.col("_a") == "true", "agreed").otherwise("disagreed")
    out = rows.join(f, F.col("id") == F.col("_k"), "left").withColumn("feedback_status", status).drop("_k", "_a")
    return out if review_state == "all" else out.where(F.col("feedback_status") == review_state)


def sort_keys(by: str = "severidad", descending: bool = True) -> list:
    """Order expressions of the review listing, by type, category, severity or status; ties by id."""
    status = F.when(F.col("feedback_status") == "pending", 0).when(F.col("feedback_status") == "disagreed", 1).otherwise(2)
    key = {"tipo": F.col("content_type"), "categoria": F.col("categoria"), "severidad": severity_rank("severidad"), "estado": status}[by]
    return [key.desc() if descending else key.asc(), F.asc("id")]


def label_differences(automatic: DataFrame, corrected: DataFrame) -> DataFrame:
    """analysis_result_id, op, cat, dim, ai_dim: what a review kept, added, removed or changed, by category.

    Both: analysis_result_id, orden, categoria, dimension; the first label of a category counts.
    """
    def firsts(df: DataFrame, tag: str) -> DataFrame:
        named = df.where(F.coalesce("categoria", F.lit("")) != "")
        one = first_of(named, ["analysis_result_id", "categoria"], [F.asc("orden")])
        return one.select(F.col("analysis_result_id").alias(f"{tag}_id"), F.col("categoria").alias(f"{tag}_cat"), F.coalesce("dimension", F.lit("")).alias(f"{tag}_dim"))

    a, c = firsts(automatic, "a"), firsts(corrected, "c")
    j = a.join(c, (F.col("a_id") == F.col("c_id")) & (F.col("a_cat") == F.col("c_cat")), "full_outer")
    ad, cd = F.coalesce("a_dim", F.lit("")), F.coalesce("c_dim", F.lit(""))
    op = F.when((ad != "") & (ad == cd), "kept").when((ad != "") & (cd == ""), "removed").when((cd != "") & (ad == ""), "added").otherwise("changed")
    return j.select(F.coalesce("a_id", "c_id").alias("analysis_result_id"), op.alias("op"), F.coalesce("a_cat", "c_cat").alias("cat"),
                    F.when(op.isin("kept", "removed"), ad).otherwise(cd).alias("dim"), F.when(op == "changed", ad).alias("ai_dim"))


def bulk_agree(selected: DataFrame, feedback: DataFrame) -> DataFrame:
    """Reviews that agree, for selected analyses without one."""
    done = feedback.select(F.col("analysis_result_id").alias("_k"))
    return selected.join(done, F.col("id") == F.col("_k"), "left_anti").select(F.col("id").alias("analysis_result_id"), F.lit("true").alias("agrees"))


def pending_count(analysis: DataFrame, feedback: DataFrame) -> DataFrame:
    """pending: analyses decided as violent or not, neither excluded nor reviewed yet."""
    open_ = analysis.where(F.col("tiene_violencia").isin("true", "false") & ~is_excluded())
    reviewed = feedback.select(F.col("analysis_result_id").alias("id"))
    return open_.join(reviewed, "id", "left_anti").agg(F.count("*").alias("pending"))


def promoted(analysis: DataFrame, labels: DataFrame, feedback: DataFrame, feedback_labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(analysis with applied_feedback, labels, feedback left) after corrections have become the analyses themselves.

    analysis: id, categoria, dimension, severidad, tiene_violencia, exclusion_label, exclusion_codigo and more, which stays. labels and feedback_labels:
    orden, categoria, dimension, severidad by analysis_result_id, and by pos. feedback: pos, analysis_result_id, agrees,
    corrected_categoria, corrected_dimension. Of several disagreements with one analysis the first given is applied. Its list
    of labels counts, or else its flat correction as one label; the most severe gives the flat fields. Any category of
    violence but the safeguard makes a row violent; common violence is an exclusion, and no other exclusion stays.
    Promoted reviews go, with those that came after them for the same analysis.
    """
    first = first_of(feedback.where((F.coalesce("agrees", F.lit("")) != "true") & F.col("analysis_result_id").isNotNull()), ["analysis_result_id"], [F.asc("pos")])
    chosen = first.join(analysis.select(F.col("id").alias("_id")), F.col("analysis_result_id") == F.col("_id"), "left_semi").select(F.col("pos").alias("_pos"), F.col("analysis_result_id").alias("_a"), F.col("corrected_categoria").alias("_fc"), F.col("corrected_dimension").alias("_fd"))
    listed = feedback_labels.join(chosen.select("_pos", "_a"), F.col("pos") == F.col("_pos")).select(F.col("_a").alias("analysis_result_id"), "orden", "categoria", "dimension", "severidad")
    flat = chosen.join(listed.select(F.col("analysis_result_id").alias("_has")).distinct(), F.col("_a") == F.col("_has"), "left_anti").where("_fc is not null and _fc <> ''")
    new = listed.unionByName(flat.select(F.col("_a").alias("analysis_result_id"), F.lit(0).alias("orden"), F.col("_fc").alias("categoria"), F.col("_fd").alias("dimension"), F.lit(NONE).alias("severidad")))
    top = first_of(new, ["analysis_result_id"], [severity_rank("severidad").desc(), F.asc("orden")]).select(F.col("analysis_result_id").alias("_t"), F.col("categoria").alias("_c"), F.col("dimension").alias("_d"), F.col("severidad").alias("_s"))
    j = analysis.join(chosen, F.col("id") == F.col("_a"), "left").join(top, F.col("id") == F.col("_t"), "left")
    hit, some = F.col("_a").isNotNull(), F.col("_t").isNotNull()
    common = some & (F.col("_c") == COMMON)
    violent = F.coalesce(F.col("_c").startswith("VDG_") & (F.col("_c") != SAFEGUARD), F.lit(False))
    own = {"categoria": F.when(some, F.col("_c")).otherwise(NONE), "dimension": F.when(some, F.col("_d")).otherwise(F.col("_fd")), "severidad": F.when(some, F.col("_s")).otherwise(NONE),
           "tiene_violencia": F.when(violent, "true").otherwise("false"), "exclusion_label": F.when(common, COMMON), "exclusion_codigo": F.when(common, "FEEDBACK_PROMOTION")}
    rows = j.select(*[F.when(hit, own[c]).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in analysis.columns], F.col("_pos").alias("applied_feedback"))
    kept = labels.join(chosen.select(F.col("_a").alias("_k")), F.col("analysis_result_id") == F.col("_k"), "left_anti").select("analysis_result_id", "orden", "categoria", "dimension", "severidad")
    left = feedback.join(chosen.select(F.col("_a").alias("_k"), "_pos"), (F.col("analysis_result_id") == F.col("_k")) & (F.col("pos") >= F.col("_pos")) & (F.coalesce("agrees", F.lit("")) != "true"), "left_anti")
    return rows, kept.unionByName(new), left

"""Queries of the statistics rules (A), the review view (V) and evaluation (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions.text import month_of
from tamiz.functions.vocabulary import ALL_DIMENSIONS, CODES
from tamiz.operators import evaluate as G
from tamiz.operators import review as V
from tamiz.operators import stats as A
from tamiz.operators.relational import where_equal
from tamiz.sources.model import view

from .registry import query

VOTES = """votes as (select a.*, case when l.analysis_result_id is null then a.categoria else l.categoria end as vcat, case when l.analysis_result_id is null then a.dimension else l.dimension end as vdim
from m_analysis a left join m_labels l on l.analysis_result_id = a.id where a.tiene_violencia = 'true' and (a.exclusion_label is null or a.exclusion_label not in ('CODIGO_99', 'VIOLENCIA_COMUN')))"""
VALID = "(exclusion_label is null or exclusion_label not in ('CODIGO_99', 'VIOLENCIA_COMUN'))"
LATEST = "latest as (select * from (select *, row_number() over (partition by analysis_result_id order by updated_at desc, pos) as k from m_feedback) as x where k = 1)"
ADJUSTED = LATEST + """, adjusted as (select a.id, a.content_type, a.exclusion_label, a.severidad,
case when d and corrected_categoria is not null then corrected_categoria else categoria end as categoria, case when d and corrected_dimension is not null then corrected_dimension else dimension end as dimension,
case when d then case when corrected_categoria = 'ninguna' then 'false' else 'true' end else tiene_violencia end as tiene_violencia, agrees is not null as has_feedback,
d and (corrected_categoria is not null or corrected_dimension is not null) as adjusted_by_human
from (select a.*, l.agrees, l.corrected_categoria, l.corrected_dimension, coalesce(l.agrees = 'false' and a.exclusion_label is null, false) as d from m_analysis a left join latest l on l.analysis_result_id = a.id) as a)"""


def votes(spark, d, keep_none: bool = False):
    return A.votes(view(spark, d, "m_analysis"), view(spark, d, "m_labels"), keep_none)


def adjusted(spark, d):
    return V.adjusted(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"))


@query("a1_missing_values", """
with n as (select count(*) as total, count(*) filter (exclusion_label = 'CODIGO_99') as n_basura, count(*) filter (exclusion_label = 'VIOLENCIA_COMUN') as n_comun from m_analysis),
p as (select *, round(100.0 * n_basura / total, 2) as pct_basura, round(100.0 * n_comun / total, 2) as pct_comun from n)
select *, case when pct_basura > 10 then 'critica' when pct_basura > 5 then 'preventiva' else 'ok' end as nivel from p""")
def missing(spark, d):
    return A.missing_values(view(spark, d, "m_analysis"))


@query("a1_missing_codes", "select coalesce(exclusion_codigo, 'SIN_CODIGO') as codigo, count(*) as n from m_analysis where exclusion_label = 'CODIGO_99' group by 1")
def missing_codes(spark, d):
    return A.missing_codes(view(spark, d, "m_analysis"))


@query("a2_votes", f"with {VOTES} select id, vcat as categoria, vdim as dimension from votes where coalesce(vcat, 'ninguna') <> 'ninguna'")
def vote_rows(spark, d):
    return votes(spark, d).select("id", "categoria", "dimension")


def _frequency(column: str, universe: str, pos: str) -> str:
    return f"""with {VOTES}, c as (select u.value, u.pos, count(v.id) as n from (select {universe} as value, {pos} as pos from {'m_categories' if column == 'vcat' else 'm_taxonomy'}) as u
left join votes v on v.{column} = u.value and coalesce(v.vcat, 'ninguna') <> 'ninguna' group by u.value, u.pos), p as (select *, 100.0 * n / nullif(sum(n) over (), 0) as x from c)
select value, n, round(coalesce(x, 0), 2) as pct, round(coalesce(sum(x) over (order by n desc, pos rows unbounded preceding), 0), 2) as pct_acumulado, cast(row_number() over (order by n desc, pos) as integer) as rango from p"""


@query("a3_frequency_category", _frequency("vcat", "categoria", "pos"))
def frequency_category(spark, d):
    v = votes(spark, d)
    return A.frequency(v, A.universe_of(v, CODES), "categoria")


@query("a3_frequency_dimension", _frequency("vdim", "dimension", "pos"))
def frequency_dimension(spark, d):
    v = votes(spark, d)
    return A.frequency(v, A.universe_of(v, ALL_DIMENSIONS), "dimension")


@query("a4_mode_category", f"with {VOTES}, n as (select vcat as moda, count(*) as n from votes where vcat <> 'ninguna' group by 1), t as (select * from n where n = (select max(n) from n)) select moda, n, (select count(*) from t) > 1 as multimodal from t")
def mode_category(spark, d):
    return A.modes(votes(spark, d), "categoria")


@query("a4_mode_dimension", f"with {VOTES}, n as (select vdim as moda, count(*) as n from votes where vcat <> 'ninguna' and vdim is not null group by 1), t as (select * from n where n = (select max(n) from n)) select moda, n, (select count(*) from t) > 1 as multimodal from t")
def mode_dimension(spark, d):
    return A.modes(votes(spark, d), "dimension")


_GRID = f"""with {VOTES}, g as (select c.categoria, t.dimension, c.pos as row_pos, t.pos as col_pos, (select count(*) from votes v where v.vcat = c.categoria and v.vdim = t.dimension) as n from m_categories c cross join m_taxonomy t)
select categoria, dimension, row_pos, col_pos, n, coalesce(100.0 * n / nullif(sum(n) over (partition by dimension), 0), 0) as pct from g"""


@query("a5_crosstab_dimension", _GRID)
def crosstab_dimension(spark, d):
    return A.grid(votes(spark, d))


@query("a5_crosstab_pivot", f"with {VOTES} select vcat as categoria, " + ", ".join(f"count(*) filter (vdim = '{x}') as d{x.replace('.', '_')}" for x in ALL_DIMENSIONS) + " from votes where vcat <> 'ninguna' and vdim is not null group by vcat")
def crosstab_pivot(spark, d):
    return A.grid_pivot(votes(spark, d))


@query("a6_crosstab_page", f"""with {VOTES}, j as (select v.vcat as categoria, coalesce(g.title, p.page_id, 'Sin página') as pagina, count(*) as n from votes v left join m_posts p on p.id = v.post_id left join m_pages g on g.id = p.page_id where v.vcat <> 'ninguna' group by 1, 2)
select *, 100.0 * n / sum(n) over (partition by pagina) as pct from j""")
def crosstab_page(spark, d):
    return A.by_page(votes(spark, d), view(spark, d, "m_posts"), view(spark, d, "m_pages"))


@query("a7_crosstab_month", f"""with {VOTES}, j as (select v.vcat as categoria, coalesce(substr(p.date, 1, 7), 'Sin fecha') as mes, count(*) as n from votes v left join m_posts p on p.id = v.post_id where v.vcat <> 'ninguna' group by 1, 2)
select *, 100.0 * n / sum(n) over (partition by mes) as pct from j""")
def crosstab_month(spark, d):
    return A.by_month(votes(spark, d), view(spark, d, "m_posts"), month_of("date"))


@query("a9_pattern_alert", _GRID.replace(" select categoria, dimension", ", x as (select categoria, dimension", 1).replace("\nselect categoria, dimension", ", x as (select categoria, dimension", 1) + ") select * from x where pct > 0 order by pct desc, row_pos, col_pos limit 1")
def pattern_alert(spark, d):
    return A.pattern_alert(A.grid(votes(spark, d)), ["row_pos", "col_pos"])


_MATRIX = f"""j as (select case when {VALID} and tiene_violencia = 'true' then 1 else 0 end as p, agrees, corrected_categoria from m_feedback f join m_analysis a on a.id = f.analysis_result_id),
t as (select p, case when agrees = 'true' then p when coalesce(corrected_categoria, 'ninguna') <> 'ninguna' then 1 else 0 end as y from j),
m as (select count(*) filter (p = 1 and y = 1) as vp, count(*) filter (p = 0 and y = 0) as vn, count(*) filter (p = 1 and y = 0) as fp, count(*) filter (p = 0 and y = 1) as fn from t)"""


@query("a10_confusion", f"with {_MATRIX} select * from m")
def confusion(spark, d):
    return A.confusion(view(spark, d, "m_feedback"), view(spark, d, "m_analysis"))


@query("a11_reliability", f"""with {_MATRIX} select *, coalesce(vp * 1.0 / nullif(vp + fp, 0), 0) as precision, coalesce(vp * 1.0 / nullif(vp + fn, 0), 0) as recall, coalesce(2.0 * vp / nullif(2 * vp + fp + fn, 0), 0) as f1, vp + vn + fp + fn as soporte from m""")
def reliability(spark, d):
    return A.reliability(A.confusion(view(spark, d, "m_feedback"), view(spark, d, "m_analysis")))


@query("a13_violent_counts", f"select count(*) filter (tiene_violencia = 'true') as con_violencia, count(*) filter (tiene_violencia = 'false') as sin_violencia from m_analysis where {VALID}")
def violent_counts(spark, d):
    return A.violent_counts(view(spark, d, "m_analysis"))


@query("a14_state_counts", "select case when exclusion_label = 'CODIGO_99' then 'basura' when exclusion_label = 'VIOLENCIA_COMUN' then 'comun' when tiene_violencia = 'true' then 'con_violencia' else 'sin_violencia' end as estado, count(*) as n from m_analysis group by 1")
def state_counts(spark, d):
    return A.state_counts(view(spark, d, "m_analysis"))


@query("a15_category_bars", f"with {VOTES}, c as (select u.categoria as codigo, count(v.id) as cantidad from m_categories u left join votes v on v.vcat = u.categoria group by 1) select codigo, cantidad, round(coalesce(100.0 * cantidad / nullif(sum(cantidad) over (), 0), 0), 1) as porcentaje from c")
def category_bars(spark, d):
    return A.bars(votes(spark, d))


@query("a16_label_pairs", f"with {VOTES}, c as (select coalesce(vcat, 'ninguna') as categoria, coalesce(vdim, '—') as dimension, count(*) as n from votes group by 1, 2) select *, round(100.0 * n / sum(n) over (), 1) as pct from c")
def label_pairs(spark, d):
    return A.label_pairs(votes(spark, d, keep_none=True))


@query("a17_headline", f"""with {VOTES}, b as (select count(*) as total, count(*) filter (tiene_violencia = 'true') as violent from m_analysis where {VALID}),
t as (select coalesce(vcat, 'ninguna') as top from votes group by 1 order by count(*) desc, 1 limit 1) select total, violent, top, round(100.0 * violent / total, 1) as violent_pct from b cross join t""")
def headline(spark, d):
    return A.headline(view(spark, d, "m_analysis"), votes(spark, d, keep_none=True))


@query("a18_comments_only", "select id, categoria from m_analysis where content_type = 'comment'")
def comments_only(spark, d):
    return where_equal(view(spark, d, "m_analysis"), content_type="comment").select("id", "categoria")


@query("a20_drill_down", f"with {VOTES} select t.categoria, t.dimension, count(v.id) as n from m_taxonomy t left join votes v on v.vcat = t.categoria and v.vdim = t.dimension group by 1, 2")
def drill_down(spark, d):
    return A.drill_down(votes(spark, d))


@query("a21_page_lookup", "select p.id as post_id, coalesce(g.title, p.page_id) as title from m_posts p left join m_pages g on g.id = p.page_id")
def page_lookup(spark, d):
    g = view(spark, d, "m_pages").select(F.col("id").alias("k"), "title")
    return view(spark, d, "m_posts").join(g, F.col("page_id") == F.col("k"), "left").select(F.col("id").alias("post_id"), F.coalesce("title", "page_id").alias("title"))


@query("a22_report_counts", "select categoria, count(*) as n from m_analysis group by categoria")
def report_counts(spark, d):
    return view(spark, d, "m_analysis").groupBy("categoria").agg(F.count("*").alias("n"))


@query("a24_inspector_totals", f"select count(*) filter ({VALID}) as net, count(*) filter (exclusion_label = 'CODIGO_99') as basura, count(*) filter (exclusion_label = 'VIOLENCIA_COMUN') as comun, count(*) filter ({VALID} and tiene_violencia = 'true') as violent from m_analysis")
def inspector_totals(spark, d):
    net = ~A.is_excluded()
    return view(spark, d, "m_analysis").agg(F.count_if(net).alias("net"), F.count_if(F.col("exclusion_label") == "CODIGO_99").alias("basura"), F.count_if(F.col("exclusion_label") == "VIOLENCIA_COMUN").alias("comun"),
                                            F.count_if(net & (F.col("tiene_violencia") == "true")).alias("violent"))


@query("v0_latest_feedback", f"with {LATEST} select analysis_result_id, pos, agrees from latest")
def latest_feedback(spark, d):
    return V.latest(view(spark, d, "m_feedback")).select("analysis_result_id", "pos", "agrees")


@query("v1_adjusted", f"with {ADJUSTED} select * from adjusted")
def adjusted_rows(spark, d):
    return adjusted(spark, d).select("id", "content_type", "exclusion_label", "severidad", "categoria", "dimension", "tiene_violencia", "has_feedback", "adjusted_by_human")


@query("v1_adjusted_by_labels", f"""
with {LATEST}, top as (select *, row_number() over (partition by analysis_result_id order by case severidad when 'alta' then 3 when 'media' then 2 when 'baja' then 1 else 0 end desc, orden) as place from m_labels),
x as (select a.*, l.agrees, l.corrected_categoria as cc, l.corrected_dimension as cd, t.analysis_result_id as tid, t.categoria as tc, t.dimension as td, coalesce(l.agrees = 'false' and a.exclusion_label is null, false) as d
from m_analysis a left join latest l on l.analysis_result_id = a.id left join top t on t.analysis_result_id = a.id and t.place = 1)
select id, case when d and tid is not null then coalesce(tc, categoria) when d and cc is not null then cc else categoria end as categoria, case when d and tid is not null then coalesce(td, dimension) when d and tid is null and cd is not null then cd else dimension end as dimension,
case when d then case when (case when tid is not null then not (tc = 'ninguna' or (tc = '{CODES[5]}' and coalesce(td, '') = '6.3' and id % 2 = 0)) else coalesce(cc, '') <> 'ninguna' end) then 'true' else 'false' end else tiene_violencia end as tiene_violencia,
agrees is not null as has_feedback, d and (tid is not null or cc is not null or cd is not null) as adjusted_by_human from x""")
def adjusted_by_labels(spark, d):
    """Reviews with lists of labels: these beat the flat corrections."""
    labels = view(spark, d, "m_labels").withColumn("falso_positivo", F.col("analysis_result_id") % 2 == 0)
    return V.adjusted(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"), labels).select("id", "categoria", "dimension", "tiene_violencia", "has_feedback", "adjusted_by_human")


@query("v3_adjustment_share", f"""with {ADJUSTED}, n as (select count(*) as total, count(*) filter (adjusted_by_human) as adjusted_count from adjusted)
select *, round(100.0 * adjusted_count / total, 1) as adjusted_pct, round(100.0 - round(100.0 * adjusted_count / total, 1), 1) as autonomous_pct from n""")
def adjustment_share(spark, d):
    return V.adjustment_share(adjusted(spark, d))


@query("v4_validation_share", f"""with {ADJUSTED}, n as (select count(*) as total, count(*) filter ({VALID}) as net_total, count(*) filter ({VALID} and has_feedback and not adjusted_by_human) as agreed_count, count(*) filter ({VALID} and adjusted_by_human) as disagreed_count from adjusted)
select *, agreed_count + disagreed_count as validated_count, net_total - agreed_count - disagreed_count as pending_count, round(100.0 * (agreed_count + disagreed_count) / net_total, 1) as validated_pct, round(100.0 - round(100.0 * (agreed_count + disagreed_count) / net_total, 1), 1) as pending_pct from n""")
def validation_share(spark, d):
    return V.validation_share(adjusted(spark, d))


_LISTING = f"""l as (select * from (select *, row_number() over (partition by analysis_result_id order by pos desc) as k from m_feedback) as x where k = 1),
listed as (select a.id, a.content_type, a.categoria, a.severidad, case when l.agrees is null then 'pending' when l.agrees = 'true' then 'agreed' else 'disagreed' end as feedback_status, a.tiene_violencia from m_analysis a left join l on l.analysis_result_id = a.id where {VALID})"""


@query("v5_review_listing", f"with {_LISTING} select id, categoria, feedback_status from listed where content_type = 'post' and tiene_violencia = 'true'")
def review_listing(spark, d):
    return V.listing(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"), "post", "all", True).select("id", "categoria", "feedback_status")


@query("v6_sorted_page", f"with {_LISTING} select id, severidad, feedback_status from listed order by case severidad when 'alta' then 3 when 'media' then 2 when 'baja' then 1 else 0 end desc, id limit 20 offset 20")
def sorted_page(spark, d):
    rows = V.listing(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"))
    return rows.orderBy(*V.sort_keys()).offset(20).limit(20).select("id", "severidad", "feedback_status")


@query("v8_review_progress", f"with {_LISTING} select count(*) filter (feedback_status <> 'pending') as reviewed, count(*) as total from listed")
def review_progress(spark, d):
    rows = V.listing(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"))
    return rows.agg(F.count_if(F.col("feedback_status") != "pending").alias("reviewed"), F.count("*").alias("total"))


@query("l14_label_differences", f"""with {LATEST}, a as (select * from (select *, row_number() over (partition by analysis_result_id, categoria order by orden) as k2 from m_labels where categoria <> '') as x where k2 = 1),
c as (select analysis_result_id, corrected_categoria as categoria, corrected_dimension as dimension from latest where corrected_categoria is not null),
j as (select coalesce(a.analysis_result_id, c.analysis_result_id) as analysis_result_id, coalesce(a.categoria, c.categoria) as cat, coalesce(a.dimension, '') as ad, coalesce(c.dimension, '') as cd from a full outer join c on a.analysis_result_id = c.analysis_result_id and a.categoria = c.categoria),
o as (select *, case when ad <> '' and ad = cd then 'kept' when ad <> '' and cd = '' then 'removed' when cd <> '' and ad = '' then 'added' else 'changed' end as op from j)
select analysis_result_id, op, cat, case when op in ('kept', 'removed') then ad else cd end as dim, case when op = 'changed' then ad end as ai_dim from o""")
def label_differences(spark, d):
    corrected = V.latest(view(spark, d, "m_feedback")).where("corrected_categoria is not null").select("analysis_result_id", F.lit(0).alias("orden"), F.col("corrected_categoria").alias("categoria"), F.col("corrected_dimension").alias("dimension"))
    return V.label_differences(view(spark, d, "m_labels"), corrected)


@query("l15_bulk_agree", "select id as analysis_result_id, 'true' as agrees from m_analysis where categoria = 'ninguna' and id not in (select analysis_result_id from m_feedback)")
def bulk_agree(spark, d):
    return V.bulk_agree(view(spark, d, "m_analysis").where("categoria = 'ninguna'"), view(spark, d, "m_feedback"))


_EVAL = f"""{LATEST}, items as (select a.id as content_id, case when a.id % 9 = 0 then 'CODIGO_99' end as gt_exclusion, a.exclusion_label as pred_exclusion from latest f join m_analysis a on a.id = f.analysis_result_id),
tr as (select distinct f.analysis_result_id as content_id, concat(corrected_categoria, '::', coalesce(corrected_dimension, 'None')) as pair from latest f join m_analysis a on a.id = f.analysis_result_id where corrected_categoria is not null and corrected_categoria <> 'ninguna'),
pr as (select distinct l.analysis_result_id as content_id, concat(l.categoria, '::', coalesce(l.dimension, 'None')) as pair from m_labels l join items i on i.content_id = l.analysis_result_id where l.categoria <> 'ninguna'),
h as (select t.pair as tp_, p.pair as pp_, t.content_id as tk, p.content_id as pk from tr t full outer join pr p on t.content_id = p.content_id and t.pair = p.pair),
s as (select i.content_id, gt_exclusion, pred_exclusion, (select count(*) from tr where tr.content_id = i.content_id) as n_gt, (select count(*) from pr where pr.content_id = i.content_id) as n_pred, (select count(*) from tr join pr on tr.content_id = pr.content_id and tr.pair = pr.pair where tr.content_id = i.content_id) as b from items i),
it as (select content_id, n_gt, n_pred, case when n_gt + n_pred = 0 then 1.0 else b * 1.0 / (n_gt + n_pred - b) end as jaccard, case when n_gt = n_pred and n_gt = b and gt_exclusion is not distinct from pred_exclusion then 'exact' when b > 0 then 'partial' else 'none' end as match,
n_gt = 0 and n_pred > 0 as item_fp, n_gt > 0 and n_pred = 0 as item_fn from s)"""


def _evaluation(spark, d):
    a = view(spark, d, "m_analysis").select("id", "exclusion_label")
    f = V.latest(view(spark, d, "m_feedback")).join(a, F.col("analysis_result_id") == F.col("id"))
    items = f.select(F.col("id").alias("content_id"), F.when(F.col("id") % 9 == 0, "CODIGO_99").alias("gt_exclusion"), F.col("exclusion_label").alias("pred_exclusion"))
    truth = f.where("corrected_categoria <> 'ninguna'").select(F.col("id").alias("content_id"), F.col("corrected_categoria").alias("categoria"), F.col("corrected_dimension").alias("dimension"))
    predicted = view(spark, d, "m_labels").where("categoria <> 'ninguna'").join(items.select("content_id"), F.col("analysis_result_id") == F.col("content_id")).select("content_id", "categoria", "dimension")
    return items, truth, predicted


@query("g3_item_matches", f"with {_EVAL} select * from it")
def item_matches(spark, d):
    return G.per_item(*_evaluation(spark, d))


_RATES = "round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 3) as precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 3) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) as f1"
_HITS = "count(*) filter (tk is not null and pk is not null) as tp, count(*) filter (tk is null) as fp, count(*) filter (pk is null) as fn"


@query("g5_class_metrics", f"with {_EVAL}, n as (select coalesce(tp_, pp_) as clase, {_HITS} from h group by 1) select *, {_RATES} from n")
def class_metrics(spark, d):
    return G.per_class(*_evaluation(spark, d)[1:])


@query("g6_micro_metrics", f"with {_EVAL}, n as (select {_HITS} from h) select *, {_RATES} from n")
def micro_metrics(spark, d):
    return G.micro(*_evaluation(spark, d)[1:])


@query("g6_summary", f"""with {_EVAL} select count(*) as n_items, count(*) filter (match = 'exact') as exact, count(*) filter (match = 'partial') as partial, count(*) filter (match = 'none') as none, count(*) filter (item_fp) as item_fp, count(*) filter (item_fn) as item_fn,
round(avg(jaccard), 3) as avg_jaccard, round(avg(n_gt), 2) as avg_n_gt, round(avg(n_pred), 2) as avg_n_pred from it""")
def evaluation_summary(spark, d):
    return G.summary(G.per_item(*_evaluation(spark, d)))


@query("g6_label_histogram", f"with {_EVAL} select n_gt as n_labels, count(*) as items, 'ground_truth' as side from it group by 1 union all select n_pred, count(*), 'predicted' from it group by 1")
def label_histogram(spark, d):
    return G.label_histogram(G.per_item(*_evaluation(spark, d)))


@query("v9_pending_reviews", """select count(*) as pending from m_analysis a where tiene_violencia in ('true', 'false') and coalesce(exclusion_label not in ('CODIGO_99', 'VIOLENCIA_COMUN'), true)
    and not exists (select 1 from m_feedback f where f.analysis_result_id = a.id)""")
def pending_reviews(spark, d):
    return V.pending_count(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"))

"""Queries of evaluation in one job with its classifier (G1, G7, G8), of seeds by rounds (K13, M16), and of all rules at once (S19, S21, A20, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions.text import month_of
from tamiz.functions.vocabulary import CODES
from tamiz.operators import classify, discovery, evaluate, stats
from tamiz.sources.model import spread, table, view
from tamiz.sources.tables import shared_folder

from .analyse import result_sql
from .registry import query
from .statistics import VOTES, votes

# Evaluation

_ALL = "open_ as (select doc_id as id, 'post' as content_type, text as t from documents where text <> '')"
_LIVE = result_sql(_ALL) + """, pred as (select distinct id, string_split(l, '/')[1] as cat, nullif(string_split(l, '/')[2], '-') as dim from (select id, unnest(string_split(etiquetas, '|')) as l from final where etiquetas <> '') as x),
truth as (select distinct analysis_result_id as id, categoria as cat, dimension as dim from m_labels where categoria <> 'ninguna'),
pairs as (select coalesce(t.id, p.id) as id, t.id is not null as t, p.id is not null as p, coalesce(t.cat, p.cat) as cat, coalesce(t.dim, p.dim) as dim from truth t full outer join pred p on p.id = t.id and p.cat = t.cat and p.dim is not distinct from t.dim),
sizes as (select id, count(*) filter (t) as n_gt, count(*) filter (p) as n_pred, count(*) filter (t and p) as both_, count(*) as either from pairs group by id),
judged as (select f.id, f.error, f.exclusion_label as pred_exclusion, a.exclusion_label as gt_exclusion, coalesce(n_gt, 0) as n_gt, coalesce(n_pred, 0) as n_pred, coalesce(both_, 0) as both_, coalesce(either, 0) as either from final f join m_analysis a on a.id = f.id left join sizes on sizes.id = f.id)"""


def live(spark, d):
    texts = spread(table(spark, d, "documents").select("doc_id", "text")).join(view(spark, d, "m_replies").select("id", "reply"), F.col("doc_id") == F.col("id"))
    a = view(spark, d, "m_analysis").select(F.col("id").alias("_a"), F.col("exclusion_label").alias("gt_exclusion"))
    items = texts.join(a, F.col("doc_id") == F.col("_a")).select(F.col("doc_id").alias("content_id"), "text", "gt_exclusion", "reply")
    truth = view(spark, d, "m_labels").where("categoria <> 'ninguna'").select(F.col("analysis_result_id").alias("content_id"), "categoria", "dimension")
    return *evaluate.live(items, lambda content: classify.classify(content, reply="reply"), shared_folder(spark)), truth


@query("g7_live_items", f"""with {_LIVE} select id as content_id, n_gt, n_pred, case when either = 0 then 1.0 else both_ * 1.0 / either end as jaccard, case when both_ = either and gt_exclusion is not distinct from pred_exclusion then 'exact' when both_ > 0 then 'partial' else 'none' end as match,
n_gt = 0 and n_pred > 0 as item_fp, n_gt > 0 and n_pred = 0 as item_fn from judged""")
def live_items(spark, d):
    items, predicted, truth = live(spark, d)
    return evaluate.per_item(items, truth, predicted)


@query("g7_live_classes", f"""with {_LIVE}, classes as (select concat(cat, '::', coalesce(dim, 'None')) as clase, count(*) filter (t and p) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn from pairs where id in (select id from final) group by 1)
select *, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 3) as precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 3) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) as f1 from classes""")
def live_classes(spark, d):
    items, predicted, truth = live(spark, d)
    return evaluate.per_class(truth.join(items.select("content_id"), "content_id", "left_semi"), predicted)


_FOCUSED = _LIVE + """, fo as (select id, error, case when both_ = either then 'exact' when both_ > 0 then 'partial' when n_pred = 0 then 'fn' when n_gt = 0 then 'fp' else 'none' end as match, case when either = 0 then 1.0 else both_ * 1.0 / either end as jac from judged)"""


@query("g8_focused_items", f"""with {_FOCUSED} select id as content_id, match, round(jac, 3) as jaccard, error, (select coalesce(string_agg(concat(cat, '::', coalesce(dim, 'None')), '|' order by concat(cat, '::', coalesce(dim, 'None'))), '') from truth t where t.id = fo.id) as gt,
(select coalesce(string_agg(concat(cat, '::', coalesce(dim, 'None')), '|' order by concat(cat, '::', coalesce(dim, 'None'))), '') from pred p where p.id = fo.id) as pred from fo""")
def focused_items(spark, d):
    items, predicted, truth = live(spark, d)
    return evaluate.focused(items, truth, predicted).select("content_id", "match", "jaccard", "error", F.array_join("gt", "|").alias("gt"), F.array_join("pred", "|").alias("pred"))


@query("g8_focused_summary", f"""with {_FOCUSED} select count(*) as n_items, count(*) filter (match = 'exact') as exact, count(*) filter (match = 'partial') as partial, count(*) filter (match = 'fp') as fp, count(*) filter (match = 'fn') as fn, count(*) filter (match = 'none') as none, round(avg(round(jac, 3)), 3) as avg_jaccard, count(error) as errors, cast(0 as double) as seconds from fo""")
def focused_summary(spark, d):
    items, predicted, truth = live(spark, d)
    return evaluate.focused_summary(evaluate.focused(items, truth, predicted))


@query("g1_truth_codes", f"select e.event_id, case when user_id % 8 between 1 and 6 then ([{', '.join(repr(c) for c in CODES)}])[user_id % 8] else concat('UNKNOWN_', user_id % 8) end as categoria from events e")
def truth_codes(spark, d):
    return table(spark, d, "events").select("event_id", evaluate.category_of((F.col("user_id") % 8).cast("int"), CODES).alias("categoria"))


# Seeds

_SCORE = "case substr(o_orderpriority, 1, 1) when '1' then 0.9 when '2' then 0.7 else 0.3 end"


@query("k13_seeds_by_rounds", f"""
with recursive e as (select concat('c', o_custkey) as u, concat('c', o_orderkey % 1500) as v, cast({_SCORE} as double) as s from orders where {_SCORE} >= 0.7),
z as (select concat('c', c_custkey) as k from customer where c_nationkey = 0 and c_acctbal > 9000), r(k, n) as (select k, 0 from z union select e.v, r.n + 1 from r join e on e.u = r.k where r.n < 40),
m as (select k, min(n) as n from r group by k), b as (select m.k, m.n, e.u, e.s, row_number() over (partition by m.k order by e.s desc, e.u) as place from m join e on e.v = m.k join m f on f.k = e.u and f.n = m.n - 1)
select k as url, cast(null as varchar) as discovered_from, cast(null as double) as score, 0 as round from m where n = 0 union all select k, u, s, cast(n as integer) from b where place = 1""")
def seeds_by_rounds(spark, d):
    """Customers reached from a few by their urgent orders, with the round and where from."""
    orders = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("discovered_from"), F.concat(F.lit("c"), F.col("o_orderkey") % 1500).alias("url"), F.expr(_SCORE).cast("double").alias("score"))

    def discover(seeds):
        return orders.join(seeds.select(F.col("url").alias("_s")), F.col("discovered_from") == F.col("_s"), "left_semi")

    seeds = table(spark, d, "customer").where("c_nationkey = 0 and c_acctbal > 9000").select(F.concat(F.lit("c"), "c_custkey").alias("url"))
    return discovery.reached(seeds, discover, shared_folder(spark)).select("url", "discovered_from", "score", "round")


# All rules at once

_PLACED = f"""{VOTES}, v as (select vcat as categoria, vdim as dimension, coalesce(g.title, p.page_id, 'Sin página') as pagina, coalesce(substr(p.date, 1, 7), 'Sin fecha') as mes from votes v left join m_posts p on p.id = v.post_id left join m_pages g on g.id = p.page_id where v.vcat <> 'ninguna'),
a3 as (select 'frecuencia_categoria' as seccion, c.categoria as fila, cast(null as varchar) as columna, c.pos, (select count(*) from v where v.categoria = c.categoria) as n from m_categories c union all select 'frecuencia_subdimension', t.dimension, null, t.pos, (select count(*) from v where v.dimension = t.dimension) from m_taxonomy t),
p3 as (select *, 100.0 * n / nullif(sum(n) over (partition by seccion), 0) as x from a3),
f3 as (select seccion, fila, columna, n, round(coalesce(x, 0), 2) as pct, round(coalesce(sum(x) over (partition by seccion order by n desc, pos rows unbounded preceding), 0), 2) as pct_acumulado, cast(row_number() over (partition by seccion order by n desc, pos) as integer) as rango from p3),
a5 as (select 'cruce_subdimension' as seccion, c.categoria as fila, t.dimension as columna, (select count(*) from v where v.categoria = c.categoria and v.dimension = t.dimension) as n from m_categories c cross join m_taxonomy t
union all select 'cruce_pagina', categoria, pagina, count(*) from v group by categoria, pagina union all select 'cruce_mes', categoria, mes, count(*) from v group by categoria, mes),
all_rules as (select * from f3 union all select seccion, fila, columna, n, round(coalesce(100.0 * n / nullif(sum(n) over (partition by seccion, columna), 0), 0), 2), null, null from a5)"""


def placed_votes(spark, d):
    return stats.placed(votes(spark, d), view(spark, d, "m_posts"), view(spark, d, "m_pages"), month_of("date"))


@query("s21_all_rules", f"with {_PLACED} select * from all_rules")
def all_rules(spark, d):
    return stats.all_rules(placed_votes(spark, d))


@query("s19_statistics_file", f"""with {_PLACED} select seccion, count(*) as filas, cast(sum(n) as bigint) as votos from all_rules group by seccion
union all select concat('moda_', replace(seccion, 'frecuencia_', '')), count(*), cast(sum(n) as bigint) from f3 where n = (select max(n) from f3 g where g.seccion = f3.seccion) and n > 0 group by seccion
union all select 'valores_perdidos', 1, count(*) filter (exclusion_label = 'CODIGO_99') from m_analysis union all select 'codigos_exclusion', count(distinct coalesce(exclusion_codigo, 'SIN_CODIGO')), count(*) from m_analysis where exclusion_label = 'CODIGO_99'
union all select 'confiabilidad', 1, count(*) from m_feedback f join m_analysis a on a.id = f.analysis_result_id""")
def statistics_file(spark, d):
    """The rows of the statistics file by section, with the counts that stand in their JSON."""
    s = stats.snapshot(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"), placed_votes(spark, d))
    said = F.from_json("fila", "n long, n_basura long, soporte long")
    return s.groupBy("seccion").agg(F.count("*").alias("filas"), F.sum(F.coalesce(said["n"], said["n_basura"], said["soporte"])).alias("votos"))


@query("m8_votes_of_category", f"with {VOTES} select count(*) filter (vcat = '{CODES[3]}') as n from votes where vcat <> 'ninguna'")
def votes_of_category(spark, d):
    return stats.votes_of_category(votes(spark, d), CODES[3])

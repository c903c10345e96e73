"""Queries of the reviewer's form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.operators import feedback as O
from tamiz.operators import review as V
from tamiz.sources.model import table, view

from .registry import query
from .statistics import LATEST


@query("l12_feedback_payload", f"""
with {LATEST}, firsts as (select *, row_number() over (partition by analysis_result_id, categoria, dimension order by orden) as k1 from m_labels),
ranked as (select *, count(*) over (partition by analysis_result_id) as n, row_number() over (partition by analysis_result_id order by case severidad when 'alta' then 3 when 'media' then 2 when 'baja' then 1 else 0 end desc, orden) as k2 from firsts where k1 = 1)
select f.analysis_result_id, f.agrees, case when f.agrees = 'false' then case when r.n is null then f.corrected_categoria else r.categoria end end as corrected_categoria,
case when f.agrees = 'false' then case when r.n is not null then r.dimension when f.corrected_categoria is not null then f.corrected_dimension end end as corrected_dimension,
cast(case when f.agrees <> 'false' then 0 when r.n is not null then r.n when f.corrected_categoria is not null then 1 else 0 end as integer) as n_labels
from latest f left join ranked r on r.analysis_result_id = f.analysis_result_id and r.k2 = 1""")
def feedback_payload(spark, d):
    item = F.struct("orden", "categoria", "dimension", "severidad", F.lit("").alias("justificacion"))
    lists = view(spark, d, "m_labels").groupBy(F.col("analysis_result_id").alias("k")).agg(F.sort_array(F.collect_list(item)).alias("ls"))  # two labels a row at most
    labels = F.transform("ls", lambda x: F.struct(*[x[c].alias(c) for c in ("categoria", "dimension", "severidad", "justificacion")]))
    f = V.latest(view(spark, d, "m_feedback")).join(lists, F.col("analysis_result_id") == F.col("k"), "left")
    nothing = F.lit(None).cast("string")
    reviews = f.select("analysis_result_id", (F.col("agrees") == "true").alias("agrees"), nothing.alias("reason"), nothing.alias("reviewer"), "corrected_categoria", "corrected_dimension",
                       nothing.alias("corrected_justificacion"), labels.alias("corrected_labels"))
    return O.payload(reviews).select("analysis_result_id", "agrees", "corrected_categoria", "corrected_dimension", F.size("corrected_labels").alias("n_labels"))


@query("l13_valid_pairs", """
select a.id, f.pos, case when coalesce(f.corrected_categoria, '') in ('', 'ninguna') then coalesce(a.dimension, '') = '' when coalesce(a.dimension, '') = '' then true
else exists (select 1 from m_taxonomy t where t.categoria = f.corrected_categoria and t.dimension = a.dimension) end as valid from m_feedback f join m_analysis a on a.id = f.analysis_result_id""")
def valid_pairs(spark, d):
    j = view(spark, d, "m_feedback").join(view(spark, d, "m_analysis").select("id", "dimension"), F.col("analysis_result_id") == F.col("id"))
    return j.select("id", "pos", O.valid_pair("corrected_categoria", "dimension").alias("valid"))


@query("a23_precision_shown", """
select doc_id, cast(case doc_id % 3 when 0 then n_chars % 97 + 1 + 0.5 when 1 then (n_chars % 9 + 1) * 10.0 else 0.0 end as double) as pct from documents""")
def precision_shown(spark, d):
    n = F.col("n_chars")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat((n % 97 + 1).cast("string"), F.lit(".5%"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" 0."), (n % 9 + 1).cast("string"))).otherwise("sin dato")
    return table(spark, d, "documents").select("doc_id", O.precision_shown(text).alias("pct"))

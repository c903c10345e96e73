"""Queries of few-shot examples (M7, S12), suggestions against predictions (L19), the inspector's rows (M10), a form's full labels (L11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions.text import reply_body
from tamiz.operators import feedback, fewshots
from tamiz.sources.model import spread, table, view

from .registry import query
from .replies import BODY
from .statistics import ADJUSTED


@query("m7_few_shots", f"""with {BODY}, e as (select id, body, case when coalesce(json_type(body, '$.clasificaciones') = 'ARRAY', false) then from_json(json_extract(body, '$.clasificaciones'), '["json"]') when coalesce(json_extract_string(body, '$.categoria'), 'ninguna') <> 'ninguna' then [cast(body as json)] else [] end as ls from body where json_valid(body) and json_type(body) = 'OBJECT'),
l as (select id, unnest(ls) as x, generate_subscripts(ls, 1) as i from e), k as (select id, i, trim(json_extract_string(x, '$.categoria')) as cat, json_extract_string(x, '$.dimension') as dim, split_part(lower(coalesce(json_extract_string(x, '$.severidad'), '')), '-', 1) as sev,
case json_type(x, '$.marcadores_detectados') when 'ARRAY' then array_to_string(list_filter(from_json(json_extract(x, '$.marcadores_detectados'), '["varchar"]'), lambda m: m <> ''), '+') else '' end as marks from l where json_type(x) = 'OBJECT'),
g as (select id, string_agg(concat(cat, '/', coalesce(dim, '-'), '/', case when sev in ('baja', 'media', 'alta') then sev else 'ninguna' end, '/', marks), '|' order by i) as labels from k group by id)
select e.id, concat('texto ', e.id) as text, case when json_extract_string(body, '$.tiene_violencia') is null then g.labels is not null else lower(json_extract_string(body, '$.tiene_violencia')) in ('true', 'si') end as tiene_violencia,
case when split_part(lower(coalesce(json_extract_string(body, '$.severidad_global'), json_extract_string(body, '$.severidad'), '')), '-', 1) in ('baja', 'media', 'alta') then split_part(lower(coalesce(json_extract_string(body, '$.severidad_global'), json_extract_string(body, '$.severidad'))), '-', 1) else 'ninguna' end as severidad,
json_extract_string(body, '$.exclusion_label') as exclusion_label, coalesce(g.labels, '') as labels from e left join g on g.id = e.id""")
def few_shots(spark, d):
    """Every stored reply that is an object, as the result of an example."""
    r = spread(view(spark, d, "m_replies")).select("id", reply_body("reply").alias("body")).where(F.startswith("body", F.lit("{")) & F.try_parse_json("body").isNotNull())
    docs = r.select("id", F.concat(F.lit('{"examples": [{"_id": 1, "text": " texto '), F.col("id").cast("string"), F.lit(' ", "result": '), "body", F.lit("}]}")).alias("content"))
    flat = F.array_join(F.transform("labels", lambda x: F.concat_ws("/", x["categoria"], F.coalesce(x["dimension"], F.lit("-")), x["severidad"], F.array_join(x["marcadores"], "+"))), "|")
    return fewshots.examples(docs).select("id", "text", "tiene_violencia", "severidad", "exclusion_label", flat.alias("labels"))


@query("l19_suggestions", """
with s as (select f.pos, f.analysis_result_id, list_filter([coalesce(f.corrected_dimension, ''), coalesce(f.corrected_categoria, ''), '9.9'], lambda x: x <> '') as wanted from m_feedback f),
a as (select analysis_result_id, list(concat(categoria, '/', coalesce(dimension, '')) order by orden) as said from m_labels where categoria <> 'ninguna' group by analysis_result_id),
j as (select pos, wanted, coalesce(said, []) as said from s left join a using (analysis_result_id)), m as (select *, list_filter(wanted, lambda w: len(list_filter(said, lambda x: contains(x, w))) > 0) as hit from j)
select pos, array_to_string(hit, '|') as coinciden, array_to_string(list_filter(wanted, lambda w: not list_contains(hit, w)), '|') as faltan, array_to_string(list_filter(said, lambda x: not list_contains(hit, x)), '|') as sobran,
case when len(hit) > 0 then 'algunas' when len(said) > 0 then 'ninguna' else 'vacio' end as resultado from m""")
def suggestions(spark, d):
    labels = view(spark, d, "m_labels").groupBy(F.col("analysis_result_id").alias("k")).agg(F.sort_array(F.collect_list(F.struct("orden", "categoria", "dimension"))).alias("ls"))
    said = F.concat(F.coalesce("corrected_dimension", F.lit("")), F.lit(" , "), F.coalesce("corrected_categoria", F.lit("")), F.lit(",,9.9"))
    j = view(spark, d, "m_feedback").join(labels, F.col("analysis_result_id") == F.col("k"), "left").select("pos", fewshots.suggestion(said, "ls").alias("s"))
    return j.select("pos", *[F.array_join(f"s.{c}", "|").alias(c) for c in ("coinciden", "faltan", "sobran")], "s.resultado")


@query("m10_inspector_rows", f"with {ADJUSTED} select a.id, a.categoria, a.tiene_violencia, a.has_feedback, case when a.content_type = 'post' then md5(d.text) end as digest from adjusted a join documents d on d.doc_id = a.id")
def inspector_rows(spark, d):
    posts = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return fewshots.inspector(view(spark, d, "m_analysis"), view(spark, d, "m_feedback"), posts).select("id", "categoria", "tiene_violencia", "has_feedback", F.md5("texto").alias("digest"))


@query("l11_full_form_labels", """
with r as (select *, row_number() over (partition by analysis_result_id, categoria, dimension order by orden) as k from m_labels), n as (select *, row_number() over (partition by analysis_result_id order by orden) as place from r where k = 1)
select analysis_result_id, string_agg(concat(categoria, '/', coalesce(dimension, '-'), '/', severidad, '/e', orden, '/', case when orden = 0 then 'R' else '-' end, '/a+b/', case when orden = 1 then 'true' else 'false' end), '|' order by place) as labels from n where place <= 5 group by analysis_result_id""")
def full_form_labels(spark, d):
    o = F.col("orden").cast("string")
    item = F.struct("orden", "categoria", "dimension", "severidad", F.lit("j").alias("justificacion"), F.concat(F.lit("e"), o).alias("evidencia"), F.when(F.col("orden") == 0, " R ").otherwise(" ").alias("regla_disparada"),
                    F.when(F.col("orden") == 0, '["a", " b ", ""]').otherwise("a, b,").alias("marcadores_detectados"), F.lit(0.5).alias("confianza"), F.lit(None).cast("double").alias("score_ajuste"), F.when(F.col("orden") == 1, "Sí").otherwise("no").alias("es_falso_positivo_probable"))
    ls = view(spark, d, "m_labels").groupBy("analysis_result_id").agg(F.sort_array(F.collect_list(item)).alias("ls"))
    fields = [f.split(":")[0] for f in feedback.FULL_LABEL[7:-1].split(",")]
    full = feedback.full_form_labels(F.transform("ls", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    flat = F.array_join(F.transform("l", lambda x: F.concat_ws("/", x["categoria"], F.coalesce(x["dimension"], F.lit("-")), x["severidad"], x["evidencia"], F.coalesce(x["regla_disparada"], F.lit("-")), F.array_join(x["marcadores_detectados"], "+"), x["es_falso_positivo_probable"].cast("string"))), "|")
    return ls.select("analysis_result_id", full.alias("l")).select("analysis_result_id", flat.alias("labels"))

"""Queries of stored replies: JSON repaired by steps (X24), classifications read from replies (L6, X25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions.text import reply_body
from tamiz.functions.vocabulary import CODES, COMMON, SAFEGUARD
from tamiz.operators import replies as P
from tamiz.sources.model import spread, view

from .registry import query

#: SQL: a stripped reply, from its first brace to its last.
BODY = r"""s1 as (select id, reply, regexp_replace(coalesce(reply, ''), '^\s+|\s+$', '', 'g') as t from m_replies),
s2 as (select id, reply, regexp_replace(regexp_replace(regexp_replace(t, '^```json', ''), '^```', ''), '```$', '') as t from s1),
s3 as (select id, reply, regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g'), '</?[^>]+>', '', 'g') as t from s2),
body as (select id, reply, regexp_replace(case when regexp_matches(t, '(?s)\{.*\}') then regexp_extract(t, '(?s)\{.*\}') else t end, '^\s+|\s+$', '', 'g') as body from s3)"""


@query("x25_reply_bodies", f"with {BODY} select id, body from body")
def reply_bodies(spark, d):
    return replies(spark, d).select("id", reply_body("reply").alias("body"))


def replies(spark, d):
    return spread(view(spark, d, "m_replies"))


@query("x24_repaired_json", rf"""
with {BODY}, q as (select *, replace(body, '''', '"') as quoted from body),
e as (select *, regexp_replace(quoted, '\\([^"\\/bfnrtu])', '\1', 'g') as fixed from q)
select id, case when body = '' then null when json_valid(body) then 'strict' when json_valid(quoted) then 'quotes' when json_valid(fixed) then 'escapes' when id % 14 = 10 then 'literal' else 'unread' end as step,
case when body = '' then null when json_valid(body) then json_type(body) when json_valid(quoted) then json_type(quoted) when json_valid(fixed) then json_type(fixed) when id % 14 = 10 then 'OBJECT' end as kind,
case when body <> '' and not json_valid(body) and not json_valid(quoted) and not json_valid(fixed) and id % 14 <> 10 then body end as rescue from e""")
def repaired_json(spark, d):
    r = P.repaired(replies(spark, d).select("id", reply_body("reply").alias("body")), "body")
    return r.select("id", F.col("json_step").alias("step"), F.regexp_extract(F.schema_of_variant("json"), "^[A-Z]+", 0).alias("kind"), F.col("json_rescue").alias("rescue"))


_RANK = "case sev when 'alta' then 3 when 'media' then 2 when 'baja' then 1 else 0 end"

#: SQL: every reply's error, and its labels in order.
PARSED = rf"""{BODY},
v as (select id, reply, case when reply is null then 'no_reply' when body = '' then 'empty_response_after_strip' when not json_valid(body) then 'invalid_json' when json_type(body) <> 'OBJECT' then 'not_an_object' end as error, body from body),
o as (select id, body, coalesce(json_type(body, '$.clasificaciones') = 'ARRAY', false) as listed, upper(trim(coalesce(json_extract_string(body, '$.categoria'), ''))) = '{COMMON}' as whole from v where error is null),
i as (select id, listed, unnest(case when listed then from_json(json_extract(body, '$.clasificaciones'), '["json"]') else [cast(body as json)] end) as x, generate_subscripts(case when listed then from_json(json_extract(body, '$.clasificaciones'), '["json"]') else [cast(body as json)] end, 1) as i from o where not whole),
f as (select id, i, json_extract_string(x, '$.categoria') as cat, nullif(json_extract_string(x, '$.dimension'), '') as dim, split_part(lower(coalesce(json_extract_string(x, '$.severidad'), '')), '-', 1) as sev, coalesce(json_extract_string(x, '$.justificacion'), '') as why,
json_extract_string(x, '$.regla_disparada') as rule, try_cast(json_extract_string(x, '$.confianza') as double) as conf, coalesce(lower(json_extract_string(x, '$.es_falso_positivo_probable')) in ('sí', 'true'), false) as fp,
list_filter(list_transform(case json_type(x, '$.marcadores_detectados') when 'ARRAY' then from_json(json_extract(x, '$.marcadores_detectados'), '["varchar"]') when 'VARCHAR' then string_split(json_extract_string(x, '$.marcadores_detectados'), ',') else [] end, lambda m: trim(m)), lambda m: m <> '') as marks
from i where json_type(x) = 'OBJECT'),
n as (select id, i, cat, case when dim is null then case when cat = '{SAFEGUARD}' then '6.3' end when exists (select 1 from m_taxonomy t where t.categoria = cat and t.dimension = dim) then dim end as dim, case when sev in ('baja', 'media', 'alta') then sev else 'ninguna' end as sev, why, rule, conf, fp, marks
from f where cat in ({', '.join(f"'{c}'" for c in (*CODES, COMMON))})),
k as (select *, {_RANK} as rank, row_number() over (partition by id, cat, dim, list_sort(marks) order by {_RANK} desc, i) as copy, min(i) over (partition by id, cat, dim, list_sort(marks)) as first from n),
l as (select *, row_number() over (partition by id order by rank desc, first) as place from k where copy = 1),
lab as (select id, count(*) as n, max(rank) as top, max(case when cat = '{COMMON}' then 1 else 0 end) as common, arg_min(rule, place) filter (cat = '{COMMON}') as common_rule, arg_min(why, place) filter (cat = '{COMMON}') as common_why,
string_agg(concat(cat, '/', coalesce(dim, '-'), '/', sev, '/', why, '/', coalesce(cast(round(conf, 3) as varchar), '-'), '/', cast(fp as varchar), '/', array_to_string(marks, '+')), '|' order by place) as etiquetas from l where place <= 5 group by id),
parsed as (select v.id, v.error, case when v.error is not null then v.reply end as rescue, coalesce(o.whole, false) or coalesce(lab.common, 0) = 1 as common,
v.error is null and not coalesce(o.whole, false) and coalesce(lab.common, 0) = 0 and lab.n is not null and coalesce(lower(json_extract_string(o.body, '$.tiene_violencia')) in ('true', 'si'), true) as tiene_violencia,
case when v.error is not null or o.whole or coalesce(lab.common, 0) = 1 then 'ninguna' when json_extract_string(o.body, '$.severidad_global') is not null then json_extract_string(o.body, '$.severidad_global') else case coalesce(lab.top, 0) when 3 then 'alta' when 2 then 'media' when 1 then 'baja' else 'ninguna' end end as severidad_global,
case when v.error is null and not o.whole and coalesce(lab.common, 0) = 0 then coalesce(lab.etiquetas, '') else '' end as etiquetas,
case when o.whole or lab.common = 1 then '{COMMON}' else json_extract_string(o.body, '$.exclusion_label') end as exclusion_label,
case when o.whole then coalesce(json_extract_string(o.body, '$.codigo'), '{COMMON}_LLM') when lab.common = 1 then coalesce(lab.common_rule, '{COMMON}_LLM') else json_extract_string(o.body, '$.exclusion_codigo') end as exclusion_codigo,
case when o.whole then coalesce(json_extract_string(o.body, '$.justificacion'), '{P.REASON}') when lab.common = 1 then coalesce(nullif(lab.common_why, ''), '{P.REASON}') else json_extract_string(o.body, '$.exclusion_justificacion') end as exclusion_justificacion
from v left join o on o.id = v.id left join lab on lab.id = v.id)"""


def flat(labels: str):
    """A list of labels as one text."""
    one = lambda x: F.concat_ws("/", x["categoria"], F.coalesce(x["dimension"], F.lit("-")), x["severidad"], x["justificacion"], F.coalesce(F.round(x["confianza"], 3).cast("string"), F.lit("-")),
                                x["falso_positivo"].cast("string"), F.array_join(x["marcadores"], "+"))
    return F.array_join(F.transform(labels, one), "|")


@query("l6_parsed_replies", f"""
with {PARSED} select id, error, rescue, tiene_violencia, severidad_global, etiquetas, exclusion_label, exclusion_codigo, exclusion_justificacion from parsed""")
def parsed_replies(spark, d):
    r = P.classifications(replies(spark, d).select("id", "reply"), "reply")
    return r.select("id", "error", "rescue", "tiene_violencia", "severidad_global", flat("labels").alias("etiquetas"), "exclusion_label", "exclusion_codigo", "exclusion_justificacion")

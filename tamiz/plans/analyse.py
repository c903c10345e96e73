"""Queries of batch analysis (L10, O2): content without an analysis, by its stored replies, and what a write-back then holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions.text import ACCENTED, PLAIN
from tamiz.functions.vocabulary import JUNK
from tamiz.operators import analyse as A
from tamiz.sources.model import spread, table, view

from .registry import query
from .replies import PARSED
from .rules_sql import cascade, keyword_hits

#: SQL: documents that have no label yet stand for content without an analysis.
_OPEN = "open_ as (select doc_id as id, case when doc_id % 3 = 0 then 'comment' else 'post' end as content_type, text as t from documents where doc_id not in (select doc_id from labels))"
#: SQL: the analysis of each row of open_: the cascade first, then the reply, and keywords where there is no reply or one that is no object.
def result_sql(rows: str) -> str:
    return f"""{PARSED}, {rows}, {cascade('open_', 'id')},
low as (select id, translate(lower(t), '{ACCENTED}', '{PLAIN}') as t from open_), hits as ({keyword_hits('low', 'id')}),
merged as (select id, categoria, dimension, max(rank) as rank, max(score) as score, min(i) as i from hits group by id, categoria, dimension),
placed as (select *, row_number() over (partition by id order by rank desc, i) as place from merged),
rules as (select id, count(*) as n, string_agg(concat(categoria, '/', dimension, '/', case rank when 3 then 'alta' when 2 then 'media' else 'baja' end), '|' order by place) as etiquetas, max(rank) as top from placed where place <= 5 group by id),
result as (select o.id, o.content_type, case when c.codigo is null then p.error end as error, c.codigo as junk, p.error in ('no_reply', 'not_an_object') as by_rule, p.*  exclude (id, error), r.n as rule_n, r.etiquetas as rule_labels, r.top as rule_top
from open_ o join casc c on c.id = o.id join parsed p on p.id = o.id left join rules r on r.id = o.id),
final as (select id, content_type, error, case when junk is not null then '' when by_rule then coalesce(rule_labels, '') else array_to_string(list_transform(case when etiquetas = '' then [] else string_split(etiquetas, '|') end, lambda x: array_to_string(string_split(x, '/')[1:3], '/')), '|') end as etiquetas,
case when junk is not null then 'false' when by_rule then case when rule_n > 0 then 'true' else 'false' end when tiene_violencia then 'true' else 'false' end as tiene_violencia,
case when junk is not null then '{JUNK}' when by_rule is not true then exclusion_label end as exclusion_label, case when junk is not null then junk when by_rule is not true then exclusion_codigo end as exclusion_codigo from result)"""


_RESULT = result_sql(_OPEN)


def open_documents(spark, d):
    """Documents as content, with their stored replies, of which those with a label are analysed already."""
    kind = F.when(F.col("doc_id") % 3 == 0, "comment").otherwise("post")
    docs = spread(table(spark, d, "documents")).select(kind.alias("content_type"), F.concat(F.lit("d"), "doc_id").alias("content_id"), F.lit(None).cast("string").alias("post_id"), F.lit(None).cast("string").alias("comment_id"), "text")
    done = table(spark, d, "labels").select(F.when(F.col("doc_id") % 3 == 0, "comment").otherwise("post").alias("content_type"), F.concat(F.lit("d"), "doc_id").alias("content_id"))
    replies = view(spark, d, "m_replies").select(F.col("content_id").alias("_id"), "reply")
    return A.open_content(docs, done).join(replies, F.col("content_id") == F.col("_id"), "left").drop("_id")


@query("l10_batch_analysis", f"with {_RESULT} select concat('d', id) as content_id, content_type, error, tiene_violencia, etiquetas, exclusion_label, exclusion_codigo from final")
def batch_analysis(spark, d):
    rows = A.analysed(open_documents(spark, d), reply="reply")
    pair = F.array_join(F.transform("labels", lambda x: F.concat_ws("/", x["categoria"], F.coalesce(x["dimension"], F.lit("-")), x["severidad"])), "|")
    return rows.select("content_id", "content_type", "error", "tiene_violencia", pair.alias("etiquetas"), "exclusion_label", "exclusion_codigo")


@query("o2_batch_counts", f"""with {_RESULT} select count(*) filter (content_type = 'post') as posts_analyzed, count(*) filter (content_type = 'comment') as comments_analyzed,
count(*) filter (content_type = 'post' and tiene_violencia = 'true') as violence_detected_posts, count(*) filter (content_type = 'comment' and tiene_violencia = 'true') as violence_detected_comments, count(error) as errors,
count(*) filter (error = 'no_reply') as errors_model, count(*) filter (error in ('empty_response_after_strip', 'invalid_json')) as errors_parse, count(*) filter (error = 'not_an_object') as errors_validation from final""")
def batch_counts(spark, d):
    return A.analysed(open_documents(spark, d), reply="reply").agg(*A.measures())


@query("l10_error_rows", f"with {_RESULT} select content_type, concat('d', id) as content_id, case error when 'no_reply' then 'errors_model' when 'not_an_object' then 'errors_validation' else 'errors_parse' end as error_bucket, error from final where error is not null")
def batch_errors(spark, d):
    return A.error_rows(A.analysed(open_documents(spark, d), reply="reply"))

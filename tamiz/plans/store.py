"""Queries of embeddings, collections and corrections (U1, K4, K5, K10, M5, S22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.operators import store as S
from tamiz.sources.model import spread, table, view
from tamiz.sources.tables import written

from .registry import query

LETTERS = "aeinorst"


def letters(texts: list[str]) -> list[list[float]]:
    """A provider that needs no model: how often each of some letters stands in a text."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


def _vector(text: str) -> str:
    return "[" + ", ".join(f"cast(length({text}) - length(replace({text}, '{c}', '')) as double)" for c in LETTERS) + "]"


@query("u1_embedded_documents", f"select doc_id, array_to_string(list_transform({_vector('text')}, lambda x: cast(cast(x as bigint) as varchar)), ',') as embedding from documents")
def embedded_documents(spark, d):
    e = S.embedded(spread(table(spark, d, "documents").select("doc_id", "text")), letters)
    return e.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


@query("k10_vectors_to_ask", "select count(distinct text) as asked from documents where text not in (select text from benchmark)")
def vectors_to_ask(spark, d):
    """Vectors of all texts but those that are known already."""
    known = S.vectors_of(table(spark, d, "benchmark"), letters)
    return S.vectors_of(spread(table(spark, d, "documents").select("text")), letters, known=known).agg(F.count("*").alias("asked"))


#: SQL: pending corrections, with the text of their document and its category.
_PENDING = """f as (select pos as id, analysis_result_id, corrected_categoria, corrected_dimension from m_feedback where agrees = 'false' and indexed <> 'true' and (corrected_categoria is not null or corrected_dimension is not null)),
p as (select f.id, a.content_type, a.content_id, d.text, coalesce(f.corrected_categoria, a.categoria, 'ninguna') as cat, f.corrected_dimension as dim, a.categoria as own from f join m_analysis a on a.id = f.analysis_result_id join documents d on d.doc_id = f.analysis_result_id),
e as (select *, concat('TEXTO: "', text, '"', chr(10), 'RESULTADO: {"tiene_violencia": ', case when cat = 'ninguna' then 'false' else 'true' end, ', "severidad_global": "ninguna", "clasificaciones": [', case when cat = 'ninguna' then '' else
concat('{"categoria": "', cat, '", "dimension": ', case when dim is null then 'null' else concat('"', dim, '"') end, ', "severidad": "ninguna", "confianza": 1.0, "regla_disparada": null, "marcadores_detectados": [], "es_falso_positivo_probable": false, "score_ajuste": 1.0, "justificacion": "Revisado por humano", "evidencia": ""}') end, ']}') as example from p)"""


def pending(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    a = view(spark, d, "m_analysis").select("id", "content_type", "content_id", "categoria")
    texts = docs.join(a, F.col("doc_id") == F.col("id")).select("content_type", "content_id", "text")
    null = F.lit(None).cast("string")
    f = view(spark, d, "m_feedback").join(a.select(F.col("id").alias("k"), "content_type", "content_id"), F.col("analysis_result_id") == F.col("k"))
    feedback = f.select(F.col("pos").alias("id"), "content_type", "content_id", "agrees", "indexed", null.alias("text_snapshot"), "corrected_categoria", "corrected_dimension", null.alias("corrected_justificacion"), null.alias("reviewer_user_id"), null.alias("chromadb_id"), null.alias("added_at"))
    return S.corrections(feedback, a, texts)


@query("m5_pending_corrections", f"with {_PENDING} select concat('feedback_', id) as id, content_type, content_id, cat as corrected_categoria, coalesce(dim, '') as corrected_dimension, own as original_categoria, md5(example) as digest from e")
def pending_corrections(spark, d):
    m = F.col("metadata")
    return pending(spark, d).select("id", *[m[k].alias(k) for k in ("content_type", "content_id", "corrected_categoria", "corrected_dimension", "original_categoria")], F.md5("text").alias("digest"))


@query("k4_correction_search", f"""
with {_PENDING}, v as (select concat('feedback_', id) as id, {_vector('example')} as v from e where cat = 'VDG_MANOSFERA_ANTIFEMINISMO'), q as (select doc_id as query_id, {_vector('text')} as q from documents where doc_id % 100 = 0),
s as (select query_id, id, list_sum(list_transform(list_zip(v, q), lambda p: power(p[1] - p[2], 2))) as distance from v cross join q), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from s)
select query_id, id, distance, cast(rank as integer) as rank from r where rank <= 3""")
def correction_search(spark, d):
    """Every hundredth document's nearest corrections to one category."""
    rows = S.embedded(written(pending(spark, d).drop("feedback_id")), letters)
    asked = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return S.find(rows, asked, letters, 3, {"corrected_categoria": "VDG_MANOSFERA_ANTIFEMINISMO"}, most_queries=1_000_000).select("query_id", "id", "distance", "rank")

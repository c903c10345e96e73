"""The content model over the driver's tables: posts, comments, pages, analyses, their labels and reviews.

Each view is SQL that Spark and a plain SQL engine read alike, so that an operator and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.functions.vocabulary import ALL_DIMENSIONS, CATEGORIES, CODES

from .replies import reply_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_category = "case n_chars % 8 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(CODES)) + " else 'ninguna' end"
_second = "case n_chars % 5 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(CODES[:4])) + " else 'ninguna' end"
_dims = "case {c} " + " ".join(f"when '{code}' then case n_chars % {len(d) + 1} " + " ".join(f"when {i} then '{x}'" for i, (x, _) in enumerate(d)) + " end" for code, _, _, d in CATEGORIES) + " end"
_sev = "case {x} % 4 when 0 then 'ninguna' when 1 then 'baja' when 2 then 'media' else 'alta' end"

VIEWS = {
    "m_taxonomy": " union all ".join(f"select '{d}' as dimension, '{c}' as categoria, {ALL_DIMENSIONS.index(d)} as pos, {CODES.index(c)} as cat_pos" for c, _, _, ds in CATEGORIES for d, _ in ds),
    "m_categories": " union all ".join(f"select '{c}' as categoria, '{t}' as label, {i} as pos" for i, (c, t, _, _) in enumerate(CATEGORIES)),
    "m_pages": "select source as id, case when source <> 'src3' then concat('Página ', source) end as title, concat('https://www.facebook.com/', source) as url, count(*) as docs from documents group by source",
    "m_posts": """select concat('p', conv_id) as id, text, role as author, concat('src', conv_id % 23) as page_id, conv_id % 50 as likes, conv_id % 7 as comments_count, conv_id % 3 as shares,
        case when conv_id % 11 = 0 then null else concat('2026-', lpad(cast(conv_id % 12 + 1 as string), 2, '0'), '-15T10:00:00') end as date
        from conversations where turn = 0 and conv_id % 13 <> 5""",
    "m_comments": "select concat('c', conv_id, '_', turn) as id, text, role as author, case when conv_id % 17 = 3 then null else concat('p', conv_id) end as post_id, turn % 5 as likes, turn, conv_id from conversations where turn > 0",
    "m_analysis": f"""select doc_id as id, case when doc_id % 3 = 0 then 'comment' else 'post' end as content_type, concat('d', doc_id) as content_id,
        concat('p', doc_id % 400) as post_id, {_category} as categoria, {_dims.format(c='(' + _category + ')')} as dimension, {_sev.format(x='n_chars')} as severidad,
        case when toxic = 1 or n_chars % 4 <> 1 then 'true' when toxic is null then 'unknown' else 'false' end as tiene_violencia,
        case when n_chars % 19 = 0 then 'CODIGO_99' when n_chars % 23 = 0 then 'VIOLENCIA_COMUN' end as exclusion_label,
        case when n_chars % 19 = 0 then case n_chars % 2 when 0 then 'COND_1_VACIO' else null end when n_chars % 23 = 0 then 'VIOLENCIA_COMUN_HEURISTICA' end as exclusion_codigo,
        concat('j', n_chars) as justificacion
        from documents left join (select doc_id as ldoc, max(toxic) as toxic from labels group by doc_id) as lab on doc_id = ldoc""",
    "m_labels": f"""select doc_id as analysis_result_id, 0 as orden, {_category} as categoria, {_dims.format(c='(' + _category + ')')} as dimension, {_sev.format(x='n_chars')} as severidad from documents where n_chars % 3 <> 0
        union all select doc_id, 1, {_second}, {_dims.format(c='(' + _second + ')')}, {_sev.format(x='(n_chars + 1)')} from documents where n_chars % 3 = 2""",
    "m_replies": reply_sql(_category, _second, _dims, _sev),
    "m_feedback": """select doc_id as analysis_result_id, case when quality = 1 then 'true' else 'false' end as agrees, concat('2026-01-', lpad(cast(doc_id % 28 + 1 as string), 2, '0')) as updated_at,
        case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'ninguna' else 'VDG_HOSTILIDAD_FEMINICIDIO' end as corrected_categoria, case when doc_id % 5 > 2 then '3.2' end as corrected_dimension,
        case when doc_id % 2 = 0 then 'true' else 'false' end as indexed, doc_id * 2 as pos from labels
        union all select doc_id, 'false', concat('2026-02-', lpad(cast(doc_id % 28 + 1 as string), 2, '0')), 'VDG_MANOSFERA_ANTIFEMINISMO', '4.1', 'false', doc_id * 2 + 1 from labels where doc_id % 4 = 0""",
}
#: Which views a view reads.
_READS = {"m_pages": ["documents"], "m_posts": ["conversations"], "m_comments": ["conversations"], "m_analysis": ["documents", "labels"], "m_labels": ["documents"], "m_replies": ["documents"], "m_feedback": ["labels"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where the files have fewer parts than that (a small table of long texts); large tables stay as they are."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the content model over the tables in sf_dir."""
    for t in _READS.get(name, []):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """Plain SQL with the views it names in front."""
    used = [n for n in VIEWS if n in sql]
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in used)
    if not used:
        return sql
    body = sql.strip()
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"

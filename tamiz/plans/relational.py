"""Queries of relational access (R) and of the sections that sinks write (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions.text import hashed_id
from tamiz.operators import relational as R
from tamiz.sources.model import table, view

from .registry import query


@query("s2_scan_first_posts", "select id, page_id, likes from m_posts order by id limit 100")
def scan_first(spark, d):
    return view(spark, d, "m_posts").select("id", "page_id", "likes").orderBy("id").limit(100)  # the report's length is the feature


@query("r1_posts_of_author", "select id, likes from m_posts where author = 'user' and likes = 8")
def equal_filter(spark, d):
    return R.where_equal(view(spark, d, "m_posts"), author="user", likes=8, page_id=None).select("id", "likes")


@query("r2_feedback_pending", "select analysis_result_id, pos from m_feedback where agrees = 'false' and indexed = 'false' and corrected_categoria is not null")
def pending(spark, d):
    return R.where_equal(view(spark, d, "m_feedback"), agrees="false", indexed="false").where("corrected_categoria is not null").select("analysis_result_id", "pos")


@query("r3_labels_nested", """
select a.id, coalesce(count(l.orden), 0) as n_labels, coalesce(string_agg(case when l.orden is not null then concat(l.orden, ':', l.categoria, ':', coalesce(l.dimension, '-')) end, '|' order by l.orden), '') as labels
from m_analysis a left join m_labels l on a.id = l.analysis_result_id group by a.id""")
def nest_labels(spark, d):
    n = R.nested(view(spark, d, "m_analysis").select("id"), view(spark, d, "m_labels"), "id", "analysis_result_id", ["orden"], ["orden", "categoria", "dimension"], "labels")
    one = F.transform("labels", lambda x: F.concat(x["orden"].cast("string"), F.lit(":"), x["categoria"], F.lit(":"), F.coalesce(x["dimension"], F.lit("-"))))
    return n.select("id", F.size("labels").cast("long").alias("n_labels"), F.array_join(one, "|").alias("labels"))


@query("r4_orphan_comments", "select id, post_id from m_comments where post_id is not null and post_id not in (select id from m_posts)")
def orphan_comments(spark, d):
    return R.orphans(view(spark, d, "m_comments"), view(spark, d, "m_posts"), "post_id", "id").select("id", "post_id")


@query("r5_not_analysed", """
select concat('d', item_id) as id from benchmark b where not exists (select 1 from m_analysis a where a.content_type = 'comment' and a.content_id = concat('d', b.item_id))""")
def unanalysed(spark, d):
    content = table(spark, d, "benchmark").select(F.concat(F.lit("d"), "item_id").alias("id"))
    return R.not_analysed(content, view(spark, d, "m_analysis"), "comment")


@query("r6_feedback_with_analysis", """
select f.analysis_result_id as id, a.content_type, a.categoria as original_categoria, f.corrected_categoria, f.agrees, f.updated_at, f.pos
from m_feedback f join m_analysis a on a.id = f.analysis_result_id""")
def feedback_joined(spark, d):
    a = view(spark, d, "m_analysis").select(F.col("id").alias("k"), "content_type", F.col("categoria").alias("original_categoria"))
    return (view(spark, d, "m_feedback").join(a, F.col("analysis_result_id") == F.col("k")).orderBy(F.desc("updated_at"), "pos")
            .select(F.col("k").alias("id"), "content_type", "original_categoria", "corrected_categoria", "agrees", "updated_at", "pos"))


@query("r7_comparison_rows", """
select a.id, substr(d.text, 1, 200) as text_snapshot, f.agrees, f.pos from m_feedback f join m_analysis a on a.id = f.analysis_result_id join documents d on d.doc_id = a.id""")
def comparison(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("text_snapshot"))
    a = view(spark, d, "m_analysis").select("id")
    return view(spark, d, "m_feedback").join(a, F.col("analysis_result_id") == F.col("id")).join(texts, F.col("id") == F.col("doc_id")).select("id", "text_snapshot", "agrees", "pos")


@query("r8_content_texts", """
select a.id, case when a.content_type = 'post' then p.text else c.text end as text from m_analysis a left join m_posts p on p.id = a.post_id left join m_comments c on c.id = concat('c', a.id, '_1')""")
def content_texts(spark, d):
    p = view(spark, d, "m_posts").select(F.col("id").alias("pk"), F.col("text").alias("pt"))
    c = view(spark, d, "m_comments").select(F.col("id").alias("ck"), F.col("text").alias("ct"))
    a = view(spark, d, "m_analysis").select("id", "content_type", "post_id", F.concat(F.lit("c"), "id", F.lit("_1")).alias("cid"))
    return a.join(p, F.col("post_id") == F.col("pk"), "left").join(c, F.col("cid") == F.col("ck"), "left").select("id", F.when(F.col("content_type") == "post", F.col("pt")).otherwise(F.col("ct")).alias("text"))


@query("r9_backfill_candidates", "select a.id, d.lang from m_analysis a join documents d on d.doc_id = a.id where a.exclusion_label is null and a.content_type = 'post'")
def candidates(spark, d):
    a = view(spark, d, "m_analysis").where("exclusion_label is null and content_type = 'post'").select("id")
    return a.join(table(spark, d, "documents").select("doc_id", "lang"), F.col("id") == F.col("doc_id")).select("id", "lang")


@query("r10_corpus_posts_first", """
select id, text, 'post' as kind from m_posts union all select case when turn = 1 then concat('p', conv_id) else id end as id, text, 'comment' from m_comments where case when turn = 1 then concat('p', conv_id) else id end not in (select id from m_posts)""")
def corpus_posts_first(spark, d):
    posts = view(spark, d, "m_posts").select("id", "text", F.lit("post").alias("kind"))
    comments = view(spark, d, "m_comments").select(F.when(F.col("turn") == 1, F.concat(F.lit("p"), "conv_id")).otherwise(F.col("id")).alias("id"), "text", F.lit("comment").alias("kind"))
    return R.union_first(posts, comments)


@query("r11_corpus_comments_first", """
select case when turn = 1 then concat('p', conv_id) else id end as id, text, 'comment' as kind from m_comments union all select id, text, 'post' from m_posts where id not in (select concat('p', conv_id) from m_comments where turn = 1)""")
def corpus_comments_first(spark, d):
    posts = view(spark, d, "m_posts").select("id", "text", F.lit("post").alias("kind"))
    comments = view(spark, d, "m_comments").select(F.when(F.col("turn") == 1, F.concat(F.lit("p"), "conv_id")).otherwise(F.col("id")).alias("id"), "text", F.lit("comment").alias("kind"))
    return R.union_first(comments, posts)


@query("r12_page_hierarchy", """
with c as (select post_id, count(*) as n, string_agg(id, ',' order by id) as ids from m_comments where post_id is not null group by post_id),
p as (select page_id, count(*) as n_posts, cast(sum(coalesce(c.n, 0)) as bigint) as n_comments, string_agg(concat(p.id, '[', coalesce(c.ids, ''), ']'), ';' order by p.id) as posts from m_posts p left join c on c.post_id = p.id group by page_id)
select g.id, coalesce(p.n_posts, 0) as n_posts, coalesce(p.n_comments, 0) as n_comments, coalesce(p.posts, '') as posts from m_pages g left join p on p.page_id = g.id""")
def page_hierarchy(spark, d):
    h = R.hierarchy(view(spark, d, "m_pages").select("id"), view(spark, d, "m_posts"), view(spark, d, "m_comments"))
    listed = F.transform("posts", lambda p: F.concat(p["id"], F.lit("["), F.array_join(F.transform(p["comments"], lambda c: c["id"]), ","), F.lit("]")))
    return h.select("id", F.size("posts").cast("long").alias("n_posts"), F.aggregate("posts", F.lit(0).cast("long"), lambda s, p: s + F.size(p["comments"])).alias("n_comments"), F.array_join(listed, ";").alias("posts"))


@query("r13_one_page", "select g.id, count(p.id) as n_posts from m_pages g left join m_posts p on p.page_id = g.id where g.id = 'src4' group by g.id")
def one_page(spark, d):
    h = R.nested(R.where_equal(view(spark, d, "m_pages"), id="src4").select("id"), view(spark, d, "m_posts"), "id", "page_id", ["id"], ["id"], "posts")
    return h.select("id", F.size("posts").cast("long").alias("n_posts"))


@query("r14_point_lookup", "select id, categoria from m_analysis where content_type = 'post' and content_id = 'd7'")
def point(spark, d):
    return R.where_equal(view(spark, d, "m_analysis"), content_type="post", content_id="d7").select("id", "categoria")


@query("r15_label_map", "select analysis_result_id, count(*) as n, min(orden) as first, string_agg(concat(categoria, '/', coalesce(dimension, '-'), '/', severidad), '|' order by orden) as labels from m_labels group by analysis_result_id")
def label_map(spark, d):
    m = R.lists_of(view(spark, d, "m_labels"), "analysis_result_id", ["orden"], ["orden", "categoria", "dimension", "severidad"], "l")
    flat = F.array_join(F.transform("l", lambda x: F.concat_ws("/", x["categoria"], F.coalesce(x["dimension"], F.lit("-")), x["severidad"])), "|")
    return m.select("analysis_result_id", F.size("l").cast("long").alias("n"), F.element_at("l", 1)["orden"].alias("first"), flat.alias("labels"))


@query("r16_table_counts", """
select (select count(*) from m_pages) as pages, (select count(*) from m_posts) as posts, (select count(*) from m_comments) as comments, (select count(*) from m_analysis) as analyses,
(select count(*) from m_feedback where agrees = 'false' and indexed = 'false') as pending""")
def table_counts(spark, d):
    v = lambda n: view(spark, d, n)
    return R.counts(pages=v("m_pages"), posts=v("m_posts"), comments=v("m_comments"), analyses=v("m_analysis"), pending=v("m_feedback").where("agrees = 'false' and indexed = 'false'"))


@query("r17_upsert_customers", """
with b as (select c_custkey, case when c_custkey % 2 = 0 then c_acctbal + 1 end as c_acctbal, cast(null as string) as c_mktsegment from customer where c_custkey % 3 = 0
union all select c_custkey + 1000000, 5.0, 'NEW' from customer where c_custkey % 100 = 0)
select coalesce(b.c_custkey, c.c_custkey) as c_custkey, coalesce(b.c_acctbal, c.c_acctbal) as c_acctbal, coalesce(b.c_mktsegment, c.c_mktsegment) as c_mktsegment from customer c full outer join b on b.c_custkey = c.c_custkey""")
def upsert_customers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    new = c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(5.0).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    # Every change comes twice, first with another balance: the last one counts.
    earlier = changes.withColumn("c_acctbal", F.lit(-1.0))
    batch = earlier.withColumn("pos", F.lit(1)).unionByName(changes.unionByName(new).withColumn("pos", F.lit(2)))
    return R.upsert(c, batch, ["c_custkey"], "pos")


@query("r18_replace_labels", """
select analysis_result_id, orden, categoria from m_labels where analysis_result_id not in (select analysis_result_id from m_feedback where agrees = 'false')
union all select analysis_result_id, 0, 'VDG_MANOSFERA_ANTIFEMINISMO' from (select distinct analysis_result_id from m_feedback where agrees = 'false') as f""")
def replace_labels(spark, d):
    new = view(spark, d, "m_feedback").where("agrees = 'false'").select("analysis_result_id").distinct().select("analysis_result_id", F.lit(0).alias("orden"), F.lit("VDG_MANOSFERA_ANTIFEMINISMO").alias("categoria"))
    return R.replace_children(view(spark, d, "m_labels").select("analysis_result_id", "orden", "categoria"), new, "analysis_result_id")


@query("r19_feedback_upsert", """
with n as (select analysis_result_id, agrees, updated_at, pos, row_number() over (partition by analysis_result_id order by pos desc) as k from m_feedback)
select n.analysis_result_id, n.agrees, n.updated_at, 'false' as indexed, a.exclusion_codigo as regla from n left join m_analysis a on a.id = n.analysis_result_id where k = 1""")
def feedback_upsert(spark, d):
    last = R.first_of(view(spark, d, "m_feedback"), ["analysis_result_id"], [F.desc("pos")])
    a = view(spark, d, "m_analysis").select("id", F.col("exclusion_codigo").alias("regla"))
    return last.join(a, F.col("analysis_result_id") == F.col("id"), "left").select("analysis_result_id", "agrees", "updated_at", F.lit("false").alias("indexed"), "regla")


@query("r22_index_flags", "select pos, case when agrees = 'false' then 'true' else indexed end as indexed from m_feedback")
def index_flags(spark, d):
    return view(spark, d, "m_feedback").select("pos", F.when(F.col("agrees") == "false", "true").otherwise(F.col("indexed")).alias("indexed"))


@query("r23_repoint_duplicates", """
with k as (select c_name, c_mktsegment, c_nationkey, min(c_custkey) over (partition by c_nationkey, c_mktsegment) as canon, c_custkey from customer)
select o_orderkey, k.canon as o_custkey from orders join k on k.c_custkey = o_custkey""")
def repoint_duplicates(spark, d):
    c = table(spark, d, "customer")
    canon = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("new"))
    mapping = c.join(canon, ["c_nationkey", "c_mktsegment"]).where("c_custkey <> new").select(F.col("c_custkey").alias("old"), "new")
    return R.repoint(table(spark, d, "orders").select("o_orderkey", "o_custkey"), mapping, "o_custkey")


@query("r24_fill_missing", "select id, coalesce(exclusion_label, case when n_chars < 40 then 'CODIGO_99' end) as exclusion_label from m_analysis join documents on doc_id = id")
def fill_missing(spark, d):
    new = table(spark, d, "documents").where("n_chars < 40").select(F.col("doc_id").alias("id"), F.lit("CODIGO_99").alias("value"))
    return R.fill_missing(view(spark, d, "m_analysis").select("id", "exclusion_label"), new, "id", "exclusion_label")


@query("r25_promote_feedback", """
with f as (select *, row_number() over (partition by analysis_result_id order by updated_at desc, pos) as k from m_feedback where agrees = 'false' and corrected_categoria is not null)
select a.id, coalesce(f.corrected_categoria, a.categoria) as categoria, coalesce(f.corrected_dimension, a.dimension) as dimension,
case when f.k is null then a.tiene_violencia when f.corrected_categoria like 'VDG_%' and f.corrected_categoria <> 'VDG_SALVAGUARDA_FALSO_POSITIVO' then 'true' else 'false' end as tiene_violencia
from m_analysis a left join f on f.analysis_result_id = a.id and f.k = 1""")
def promote(spark, d):
    f = R.first_of(view(spark, d, "m_feedback").where("agrees = 'false' and corrected_categoria is not null"), ["analysis_result_id"], [F.desc("updated_at"), F.asc("pos")])
    j = view(spark, d, "m_analysis").join(f.select(F.col("analysis_result_id").alias("k"), "corrected_categoria", "corrected_dimension"), F.col("id") == F.col("k"), "left")
    violent = F.col("corrected_categoria").startswith("VDG_") & (F.col("corrected_categoria") != "VDG_SALVAGUARDA_FALSO_POSITIVO")
    return j.select("id", F.coalesce("corrected_categoria", "categoria").alias("categoria"), F.coalesce("corrected_dimension", "dimension").alias("dimension"),
                    F.when(F.col("k").isNull(), F.col("tiene_violencia")).when(violent, "true").otherwise("false").alias("tiene_violencia"))


#: SQL: the first disagreement with every analysis, the labels it brings, and the most severe of them.
_PROMOTED = """fb as (select * from (select *, row_number() over (partition by analysis_result_id order by pos) as k from m_feedback where agrees <> 'true') as x where k = 1 and analysis_result_id in (select id from m_analysis)),
nl as (select l.analysis_result_id, l.orden, l.categoria, l.dimension, l.severidad from m_labels l join fb on fb.analysis_result_id = l.analysis_result_id where l.analysis_result_id % 2 = 0
union all select analysis_result_id, 0, corrected_categoria, corrected_dimension, 'ninguna' from fb where corrected_categoria is not null and not (analysis_result_id % 2 = 0 and analysis_result_id in (select analysis_result_id from m_labels))),
tp as (select *, row_number() over (partition by analysis_result_id order by case severidad when 'alta' then 3 when 'media' then 2 when 'baja' then 1 else 0 end desc, orden) as place from nl)"""


def promotion(spark, d):
    from tamiz.operators.review import promoted

    feedback, labels = view(spark, d, "m_feedback"), view(spark, d, "m_labels")
    # Every second analysis' reviews bring a list of labels.
    brought = labels.where("analysis_result_id % 2 = 0").join(feedback.select(F.col("analysis_result_id").alias("_k"), "pos"), F.col("analysis_result_id") == F.col("_k")).select("pos", "orden", "categoria", "dimension", "severidad")
    return promoted(view(spark, d, "m_analysis"), labels, feedback, brought)


@query("r25_promoted_analyses", f"""with {_PROMOTED} select a.id, case when fb.pos is null then a.categoria else coalesce(tp.categoria, 'ninguna') end as categoria, case when fb.pos is null then a.dimension when tp.place is null then fb.corrected_dimension else tp.dimension end as dimension,
case when fb.pos is null then a.severidad else coalesce(tp.severidad, 'ninguna') end as severidad, case when fb.pos is null then a.tiene_violencia when tp.categoria like 'VDG_%' and tp.categoria <> 'VDG_SALVAGUARDA_FALSO_POSITIVO' then 'true' else 'false' end as tiene_violencia,
case when fb.pos is null then a.exclusion_label end as exclusion_label, fb.pos as applied_feedback from m_analysis a left join fb on fb.analysis_result_id = a.id left join tp on tp.analysis_result_id = a.id and tp.place = 1""")
def promoted_analyses(spark, d):
    return promotion(spark, d)[0].select("id", "categoria", "dimension", "severidad", "tiene_violencia", "exclusion_label", "applied_feedback")


@query("r25_promoted_labels", f"with {_PROMOTED} select analysis_result_id, orden, categoria, dimension, severidad from m_labels where analysis_result_id not in (select analysis_result_id from fb) union all select * from nl")
def promoted_labels(spark, d):
    return promotion(spark, d)[1]


@query("r25_feedback_left", f"with {_PROMOTED} select f.pos from m_feedback f left join fb on fb.analysis_result_id = f.analysis_result_id where fb.pos is null or f.pos < fb.pos or f.agrees = 'true'")
def feedback_left(spark, d):
    return promotion(spark, d)[2].select("pos")


@query("r26_category_titles", """
select c.categoria, case when c.categoria = 'VDG_MANOSFERA_ANTIFEMINISMO' then 'Manosfera' else c.label end as title from m_categories c union all select 'ninguna', 'Ninguna'""")
def category_titles(spark, d):
    from tamiz.functions.labels import category_title

    codes = view(spark, d, "m_categories").select("categoria").unionByName(spark.createDataFrame([("ninguna",)], "categoria string"))
    override = F.when(F.col("categoria") == "VDG_MANOSFERA_ANTIFEMINISMO", "Manosfera")
    return codes.select("categoria", category_title("categoria", override).alias("title"))


@query("r27_content_ids", "select doc_id, substr(md5(concat(source, '_', lang, '_', doc_id)), 1, 16) as id from documents")
def content_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", hashed_id("source", "lang", "doc_id").alias("id"))


@query("s15_export_rows", "select id, categoria, coalesce(dimension, '') as dimension, substr(text, 1, 500) as texto from m_analysis join documents on doc_id = id")
def export_rows(spark, d):
    from tamiz.sources.sinks import export_analysis

    return export_analysis(view(spark, d, "m_analysis"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("s17_violence_report", """
select 'categoria' as seccion, categoria as valor, count(*) as n from m_analysis where tiene_violencia = 'true' group by categoria
union all select 'severidad', severidad, count(*) from m_analysis where tiene_violencia = 'true' group by severidad""")
def violence_report(spark, d):
    from tamiz.sources.sinks import violence_sections

    return violence_sections(view(spark, d, "m_analysis"))


def export(spark, d, section):
    from tamiz.sources.sinks import export_sections

    null = F.lit(None).cast("string")
    posts = view(spark, d, "m_posts").withColumn("url", null)
    comments = view(spark, d, "m_comments").withColumns({"date": null, "parent_id": null})
    analyses = view(spark, d, "m_analysis").withColumns({"codigo": null, "confianza": F.lit("0.5")})
    made = {"confianza": null, "score_ajuste": F.lit("1.0"), "es_falso_positivo_probable": null, "regla_disparada": null, "marcadores_detectados": F.when(F.col("orden") == 0, '["a", "b"]'), "justificacion": F.lit("x" * 600), "evidencia": null}
    return export_sections(posts, comments, analyses, view(spark, d, "m_labels").withColumns(made))[section]


@query("s15_export_posts", "select id, coalesce(substr(text, 1, 500), '') as text, author, coalesce(date, '') as date, likes, comments_count, shares, '' as url, page_id from m_posts")
def export_posts(spark, d):
    return export(spark, d, "posts")


@query("s15_export_comments", "select id, coalesce(substr(text, 1, 500), '') as text, author, '' as date, likes, post_id, '' as parent_id from m_comments where post_id in (select id from m_posts)")
def export_comments(spark, d):
    return export(spark, d, "comments")


@query("s15_export_analyses", "select id, content_type, content_id, tiene_violencia, categoria, coalesce(dimension, '') as dimension, '' as codigo, severidad, '0.5' as confianza, justificacion, (select count(*) from m_labels l where l.analysis_result_id = m_analysis.id) as n_etiquetas from m_analysis")
def export_analyses(spark, d):
    return export(spark, d, "analyses")


@query("s15_export_labels", "select analysis_result_id, orden, categoria, coalesce(dimension, '') as dimension, severidad, '' as confianza, '1.0' as score_ajuste, 'false' as es_falso_positivo_probable, '' as regla_disparada, case when orden = 0 then 'a|b' else '' end as marcadores_detectados, repeat('x', 500) as justificacion, '' as evidencia from m_labels")
def export_labels(spark, d):
    return export(spark, d, "labels")


@query("s17_violence_rows", "select 'categoria' as seccion, categoria as valor, id, content_id from m_analysis where tiene_violencia = 'true' union all select 'severidad', severidad, id, content_id from m_analysis where tiene_violencia = 'true'")
def violence_rows(spark, d):
    from tamiz.sources.sinks import violence_rows as rows

    return rows(view(spark, d, "m_analysis")).select("seccion", "valor", "id", "content_id")


@query("s20_inspector_rows", """
select a.id, a.content_type, coalesce(string_agg(case when l.orden is not null then concat(l.categoria, '|', coalesce(l.dimension, ''), '|', l.severidad) end, '||' order by l.orden), '') as etiquetas
from m_analysis a left join m_labels l on l.analysis_result_id = a.id where a.exclusion_label is null group by a.id, a.content_type""")
def inspector_rows(spark, d):
    from tamiz.sources.sinks import inspector_rows as rows

    return rows(view(spark, d, "m_analysis"), view(spark, d, "m_labels"))


@query("s22_chunks_by_source", "select coalesce(source, 'desconocido') as source, count(*) as n from documents group by 1")
def chunks_by_source(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("desconocido")).alias("source")).agg(F.count("*").alias("n"))


@query("s23_replace_source", """
select doc_id, source, n_chars from documents where source <> 'src5' union all select doc_id + 10000000, 'src5', n_chars * 2 from documents where source = 'src5'""")
def replace_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("source = 'src5'").select((F.col("doc_id") + 10000000).alias("doc_id"), "source", (F.col("n_chars") * 2).alias("n_chars"))
    return R.replace_children(docs, new, "source")


@query("v7_page_of_orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def page_of_orders(spark, d):
    return R.page_of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 25)


@query("m11_merged_counters", "select count(*) as items, cast(sum(likes) as bigint) as likes from (select likes from m_posts union all select likes from m_comments) as x")
def merged_counters(spark, d):
    both = view(spark, d, "m_posts").select("likes").unionByName(view(spark, d, "m_comments").select("likes"))
    return both.agg(F.count("*").alias("items"), F.sum("likes").cast("long").alias("likes"))

"""Queries of text functions (X), exclusion (E), labels (L), deduplication (D), chunks and vectors (K), pages (S5, X28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions import exclusion, labels, text, urls
from tamiz.functions.text import ACCENTED, PLAIN
from tamiz.functions.vocabulary import AGGRESSION, CODES, COMMON, GENDER_MARKERS, MATCH_ORDER
from tamiz.operators import chunks, classify, dedup, stats, vectors
from tamiz.sources import html
from tamiz.sources.model import spread, table, view

from .registry import query
from .rules_sql import cascade, contains_any, keyword_hits


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("x1_clean_posts")
def clean_posts(spark, d):
    """Patterns with lookahead and Unicode classes have no counterpart in the oracle's engine; the tests compare cases."""
    return documents(spark, d).select("doc_id", text.clean_post("text").alias("limpio"))


@query("x2_clean_comments")
def clean_comments(spark, d):
    c = text.clean_comment("text")
    return view(spark, d, "m_comments").select("id", c.alias("c")).select("id", "c.body", "c.time_ago", "c.responses")


@query("x3_without_numbers", r"select item_id, regexp_replace(text, '\b\d+\b', '', 'g') as limpio from benchmark")
def without_numbers(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.without_numbers("text").alias("limpio"))


@query("x6_repeated_short_words", """
with w as (select doc_id, unnest(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) as w, generate_subscripts(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' '), 1) as i from documents),
k as (select *, lag(w) over (partition by doc_id order by i) as before from w)
select doc_id, md5(string_agg(w, ' ' order by i)) as digest from k where before is null or w <> before or length(w) > 4 group by doc_id""")
def repeated_short_words(spark, d):
    spaced = F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))
    return documents(spark, d).select("doc_id", F.md5(text.without_repeated_words(spaced)).alias("digest"))


@query("x7_comparable_comments")
def comparable(spark, d):
    return view(spark, d, "m_comments").select("id", text.comparable("text").alias("norm"))


@query("x9_without_accents", "select doc_id, md5(translate(text, 'áéíóúüñçàèìòùâêîôûäëïöÁÉÍÓÚÜÑÇÀÈÌÒÙÂÊÎÔÛÄËÏÖ', 'aeiouuncaeiouaeiouaeioAEIOUUNCAEIOUAEIOUAEIO')) as digest from documents")
def without_accents(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.without_accents("text")).alias("digest"))


@query("x10_letters_only", r"select doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s', ' ', 'g'), '[^\p{L}\p{Nd}\p{No} ]', '', 'g'))) as digest from documents")
def letters_only(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.letters_only("text")).alias("digest"))


@query("x12_dates", """
with s as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%d/%m/%Y') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else 'ayer' end as t, ts from events)
select event_id, t, case when event_id % 4 < 2 then strftime(ts, '%Y-%m-%d 00:00:00') when event_id % 4 = 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as fecha from s""")
def dates(spark, d):
    ts = F.col("ts")
    form = lambda f: F.date_format(ts, f)
    t = F.when(F.col("event_id") % 4 == 0, form("yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, form("dd/MM/yyyy")).when(F.col("event_id") % 4 == 2, form("yyyy-MM-dd'T'HH:mm:ss")).otherwise("ayer")
    return table(spark, d, "events").select("event_id", t.alias("t")).select("event_id", "t", F.date_format(text.parsed_date("t"), "yyyy-MM-dd HH:mm:ss").alias("fecha"))


@query("x14_months", "select coalesce(substr(date, 1, 7), 'Sin fecha') as mes, count(*) as n from m_posts group by 1")
def months(spark, d):
    return view(spark, d, "m_posts").groupBy(text.month_of("date").alias("mes")).agg(F.count("*").alias("n"))


@query("x15_counts", "select event_id, greatest(0, coalesce(try_cast(case event_id % 3 when 0 then cast(event_id - 500 as string) when 1 then 'x' end as integer), 0)) as n from events")
def counts(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") - 500).cast("string")).when(F.col("event_id") % 3 == 1, "x")
    return table(spark, d, "events").select("event_id", text.as_count(raw).alias("n"))


@query("x16_truths", "select event_id, coalesce(lower(trim(case event_id % 5 when 0 then ' True ' when 1 then '1' when 2 then 'SI' when 3 then 'no' end)) in ('true', '1', 'yes', 'si', 'sí'), false) as si from events")
def truths(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, " True ").when(k == 1, "1").when(k == 2, "SI").when(k == 3, "no")
    return table(spark, d, "events").select("event_id", text.as_truth(raw).alias("si"))


@query("x17_numbers", "select event_id, try_cast(case event_id % 3 when 0 then ' 0.5 ' when 1 then cast(event_id as string) else 'alta' end as double) as x from events")
def numbers(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, " 0.5 ").when(k == 1, F.col("event_id").cast("string")).otherwise("alta")
    return table(spark, d, "events").select("event_id", text.as_number(raw).alias("x"))


@query("x18_markers", "select event_id, case event_id % 3 when 0 then 'a|b' when 1 then 'x|y' else '' end as m, case event_id % 3 when 2 then 0 else 2 end as n from events")
def markers(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, '["a", "b", ""]').when(k == 1, " x, ,y ")
    return table(spark, d, "events").select("event_id", text.as_markers(raw).alias("l")).select("event_id", F.array_join("l", "|").alias("m"), F.size("l").alias("n"))


_URL = "concat('https://', case page_id % 3 when 0 then 'www.facebook.com' when 1 then 'facebook.com' else 'example.org' end, case page_id % 7 when 0 then '/groups/x/posts/1' when 1 then '/reel/77' when 2 then '/pag/posts/123' when 3 then '/story.php?story_fbid=9&id=1' when 4 then '/share/ab/' when 5 then '/MiPagina/' else '/a/b' end)"


@query("x19_url_classes", f"""
select page_id, case when page_id % 3 = 2 then 'unknown' when page_id % 7 = 0 then 'group' when page_id % 7 < 5 then 'post' when page_id % 7 = 5 then 'page' else 'unknown' end as clase,
case page_id % 7 when 0 then '1' when 1 then '77' when 2 then '123' when 3 then '9' end as post_id, {_URL} as url from pages""")
def url_classes(spark, d):
    p = table(spark, d, "pages").select("page_id", F.expr(_URL).alias("url"))
    return p.select("page_id", urls.url_class("url").alias("clase"), urls.url_post_id("url").alias("post_id"), "url")


@query("x21_blocked_pages", """
select page_id, (case when contains(h, 'name="email"') then 1 else 0 end + case when contains(h, 'name="pass"') then 1 else 0 end + case when contains(h, 'id="login_form"') then 1 else 0 end) >= 2 as login, contains(h, 'id="captcha"') as captcha
from (select page_id, lower(concat(html, case page_id % 5 when 0 then '<input NAME="email"><input name="pass">' when 1 then '<div id="captcha">' when 2 then 'name="email"' else '' end)) as h from pages) as x""")
def blocked_pages(spark, d):
    more = F.when(F.col("page_id") % 5 == 0, '<input NAME="email"><input name="pass">').when(F.col("page_id") % 5 == 1, '<div id="captcha">').when(F.col("page_id") % 5 == 2, 'name="email"').otherwise("")
    p = table(spark, d, "pages").select("page_id", F.concat("html", more).alias("html"))
    return p.select("page_id", urls.is_login_wall("html").alias("login"), urls.is_captcha("html").alias("captcha"))


@query("x28_page_titles", r"select page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') as title from pages")
def page_titles(spark, d):
    return html.page_metadata(table(spark, d, "pages")).select("page_id", "title")


@query("s5_page_blocks")
def page_blocks(spark, d):
    """Blocks of text of raw pages, parsed in tasks."""
    return html.blocks(table(spark, d, "pages"))


@query("x33_engagement", "select id, likes + comments_count + shares as interaccion, length(text) > 0 as con_texto from m_posts")
def engagement(spark, d):
    return view(spark, d, "m_posts").select("id", text.engagement("likes", "comments_count", "shares").alias("interaccion"), (F.length("text") > 0).alias("con_texto"))


@query("x34_review_gap_average", """
with recursive o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events), r as (
select user_id, k, value as ema from o where k = 1 union all select o.user_id, o.k, 0.5 * o.value + 0.5 * r.ema from r join o on o.user_id = r.user_id and o.k = r.k + 1)
select user_id, round(ema, 6) as ema from (select *, row_number() over (partition by user_id order by k desc) as z from r) as x where z = 1""")
def review_gaps(spark, d):
    """Exponential average (half weight) over each user's events in time order; a user's events are one session's."""
    lists = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    ema = F.aggregate(F.slice("e", F.lit(2), F.size("e")), F.element_at("e", 1)["value"], lambda s, x: 0.5 * x["value"] + 0.5 * s)
    return lists.select("user_id", F.round(ema, 6).alias("ema"))


@query("x35_cleaning_report", "select count(*) as scanned, count(*) filter (limpio <> text) as modified, cast(sum(length(text)) as bigint) as before_chars, cast(sum(length(limpio)) as bigint) as after_chars from (select text, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) as limpio from documents) as x")
def cleaning_report(spark, d):
    x = documents(spark, d).select("text", F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).alias("limpio"))
    return x.agg(F.count("*").alias("scanned"), F.count_if(F.col("limpio") != F.col("text")).alias("modified"), F.sum(F.length("text")).alias("before_chars"), F.sum(F.length("limpio")).alias("after_chars"))


_SPECIAL = "case doc_id % 12 when 0 then '' when 1 then 'https://a.example/x?y=1' when 2 then '@ana @luis,' when 3 then 'zzzzzz' when 4 then '!!! ...' when 5 then ' JaJaJa!! ' when 6 then 'Ok.' when 7 then 'aaa hola' when 8 then null else text end"


@query("e1_exclusion_codes", f"with s as (select doc_id, {_SPECIAL} as t from documents), {cascade('s', 'doc_id')} select doc_id, codigo from casc")
def exclusion_codes(spark, d):
    """All documents, two thirds of them replaced by texts that the cascade knows."""
    return documents(spark, d).select("doc_id", exclusion.exclusion_code(F.expr(_SPECIAL)).alias("codigo"))


@query("e9_exclusion_of_documents", f"with s as (select doc_id, text as t from documents), {cascade('s', 'doc_id')} select doc_id, codigo from casc")
def exclusion_of_documents(spark, d):
    return documents(spark, d).select("doc_id", exclusion.exclusion_code("text").alias("codigo"))


_MIXED = "concat(text, case doc_id % 4 when 0 then ' IDIOTA total' when 1 then ' eres una perra estúpida' when 2 then ' qué imbécil' else '' end)"


@query("e8_common_violence", f"""
select doc_id, case when not {contains_any(GENDER_MARKERS)} and {contains_any(AGGRESSION)} then '{COMMON}' end as etiqueta from (select doc_id, translate(lower({_MIXED}), 'áéíóúüñçàèìòùâêîôûäëïö', 'aeiouuncaeiouaeiouaeio') as t from documents) as x""")
def common_violence(spark, d):
    return documents(spark, d).select("doc_id", exclusion.common_violence(F.expr(_MIXED)).alias("etiqueta"))


_FREE = "case n_chars % 9 when 0 then 'violencia-simbólica' when 1 then ' VDG_HOSTILIDAD_FEMINICIDIO ' when 2 then 'Manosfera' when 3 then 'violencia_comun' when 4 then '' when 5 then 'Slutshaming' when 6 then 'otra cosa' when 7 then '...' else null end"


@query("l1_categories", f"""select doc_id, case n_chars % 9 when 0 then '{CODES[0]}' when 1 then '{CODES[2]}' when 2 then '{CODES[3]}' when 3 then '{COMMON}' when 5 then '{CODES[1]}' when 7 then '{MATCH_ORDER[0]}' else 'ninguna' end as categoria from documents""")
def categories(spark, d):
    return documents(spark, d).select("doc_id", labels.category(F.expr(_FREE)).alias("categoria"))


@query("l2_dimensions", f"""select doc_id, case when x in ('', 'null') then case when c = '{CODES[5]}' then '6.3' end when starts_with(x, '0') and ltrim(x, '0') in (select dimension from m_taxonomy where categoria = c) then ltrim(x, '0') when x in (select dimension from m_taxonomy where categoria = c) then x end as dimension
from (select doc_id, case n_chars % 3 when 0 then '{CODES[0]}' when 1 then '{CODES[3]}' else '{CODES[5]}' end as c, case n_chars % 7 when 0 then '1.2' when 1 then '04.4' when 2 then '6.1' when 3 then '' when 4 then 'null' when 5 then '9.9' else '4.1' end as x from documents) as q""")
def dimensions(spark, d):
    c = F.when(F.col("n_chars") % 3 == 0, CODES[0]).when(F.col("n_chars") % 3 == 1, CODES[3]).otherwise(CODES[5])
    x = F.expr("case n_chars % 7 when 0 then '1.2' when 1 then '04.4' when 2 then '6.1' when 3 then '' when 4 then 'null' when 5 then '9.9' else '4.1' end")
    return documents(spark, d).select("doc_id", labels.dimension(c, x).alias("dimension"))


@query("l3_severities", """select doc_id, case n_chars % 6 when 0 then 'baja' when 1 then 'alta' when 2 then 'media' when 3 then 'alta' else 'ninguna' end as severidad from documents""")
def severities(spark, d):
    raw = F.expr("case n_chars % 6 when 0 then 'Baja-Media' when 1 then 'alta-extrema' when 2 then ' media ' when 3 then 'extrema' when 4 then 'ortogonal' end")
    return documents(spark, d).select("doc_id", labels.severity(raw).alias("severidad"))


@query("l4_primary_labels", """
select analysis_result_id, categoria, severidad from (select *, row_number() over (partition by analysis_result_id order by case severidad when 'alta' then 3 when 'media' then 2 when 'baja' then 1 else 0 end desc, orden) as k from m_labels) as x where k = 1""")
def primary_labels(spark, d):
    ls = view(spark, d, "m_labels").groupBy("analysis_result_id").agg(F.sort_array(F.collect_list(F.struct("orden", "categoria", "severidad"))).alias("l"))
    return ls.select("analysis_result_id", labels.primary_label("l").alias("p")).select("analysis_result_id", "p.categoria", "p.severidad")


@query("l5_valid_labels", """
with r as (select *, case severidad when 'alta' then 3 when 'media' then 2 when 'baja' then 1 else 0 end as rank from m_labels where categoria <> 'ninguna'),
f as (select *, row_number() over (partition by analysis_result_id, categoria, dimension order by rank desc, orden) as k, min(orden) over (partition by analysis_result_id, categoria, dimension) as first from r),
t as (select *, row_number() over (partition by analysis_result_id order by rank desc, first) as place from f where k = 1)
select analysis_result_id, count(*) as n, string_agg(concat(categoria, ':', severidad), '|' order by place) as etiquetas from t where place <= 5 group by 1""")
def valid(spark, d):
    # Taxonomy pairs of the view are valid, except sub-dimensions that are missing in the safeguard category.
    ls = view(spark, d, "m_labels").groupBy("analysis_result_id").agg(F.sort_array(F.collect_list(F.struct("orden", "categoria", "dimension", "severidad"))).alias("l"))
    arr = F.transform("l", lambda x: F.struct(x["categoria"].alias("categoria"), x["dimension"].alias("dimension"), x["severidad"].alias("severidad"), F.array().cast("array<string>").alias("marcadores")))
    out = ls.select("analysis_result_id", labels.valid_labels(arr).alias("v")).where("size(v) > 0")
    return out.select("analysis_result_id", F.size("v").cast("long").alias("n"), F.array_join(F.transform("v", lambda x: F.concat(x["categoria"], F.lit(":"), x["severidad"])), "|").alias("etiquetas"))


_KEYED = "concat(text, case doc_id % 6 when 0 then ' te voy a MATAR, feminazi' when 1 then ' jajaja a la cocina, activista' when 2 then ' a la cocina' when 3 then ' estás loca y pega' else '' end)"


@query("l7_keyword_labels", f"""
with t as (select doc_id, translate(lower({_KEYED}), 'áéíóúüñçàèìòùâêîôûäëïö', 'aeiouuncaeiouaeiouaeio') as t from documents), h as ({keyword_hits('t', 'doc_id')}),
g as (select doc_id, categoria, dimension, max(rank) as rank, max(score) as score, min(i) as i from h group by 1, 2, 3), o as (select *, row_number() over (partition by doc_id order by rank desc, i) as place from g)
select doc_id, string_agg(concat(categoria, '/', dimension, '/', score), '|' order by place) as etiquetas from o where place <= 5 group by doc_id""")
def keyword_labels(spark, d):
    rows = documents(spark, d).select("doc_id", classify.keyword_labels(F.expr(_KEYED)).alias("l")).where("size(l) > 0")
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: F.concat_ws("/", x["categoria"], x["dimension"], x["score"].cast("string"))), "|").alias("etiquetas"))


@query("l9_classified_documents", f"""
with s as (select doc_id, text as t from documents), {cascade('s', 'doc_id')}, t as (select doc_id, translate(lower(t), '{ACCENTED}', '{PLAIN}') as t from s), h as ({keyword_hits('t', 'doc_id')}),
g as (select doc_id, count(*) as n from (select distinct doc_id, categoria, dimension from h) as x group by doc_id)
select casc.doc_id, case when codigo <> 'COND_1_VACIO' then codigo end as exclusion_codigo, case when codigo is null and n > 0 then 'true' else 'false' end as tiene_violencia, cast(case when codigo is null then least(5, coalesce(n, 0)) else 0 end as integer) as n_labels
from casc left join g on g.doc_id = casc.doc_id""")
def classified(spark, d):
    out = classify.classify(documents(spark, d).select("doc_id", "text"))
    return out.select("doc_id", "exclusion_codigo", "tiene_violencia", F.size("labels").alias("n_labels"))


@query("flagship_frequency_of_documents", f"""
with s as (select doc_id, {_KEYED} as t from documents), {cascade('s', 'doc_id')}, t as (select doc_id, translate(lower(t), '{ACCENTED}', '{PLAIN}') as t from s), h as ({keyword_hits('t', 'doc_id')}),
g as (select doc_id, categoria, dimension, max(rank) as rank, min(i) as i from h group by 1, 2, 3), o as (select *, row_number() over (partition by doc_id order by rank desc, i) as place from g),
c as (select m.categoria as value, m.pos, (select count(*) from o join casc on casc.doc_id = o.doc_id where casc.codigo is null and o.place <= 5 and o.categoria = m.categoria) as n from m_categories m), p as (select *, 100.0 * n / nullif(sum(n) over (), 0) as x from c)
select value, n, round(coalesce(x, 0), 2) as pct, round(coalesce(sum(x) over (order by n desc, pos rows unbounded preceding), 0), 2) as pct_acumulado, cast(row_number() over (order by n desc, pos) as integer) as rango from p""")
def flagship(spark, d):
    """Documents with their labels, junk tagged and left out, frequency of the categories that keywords give."""
    rows = classify.classify(documents(spark, d).select("doc_id", F.expr(_KEYED).alias("text")))
    # The outer form: a filter on the lists' size would run the cascade once more.
    vote = rows.select(F.explode_outer("labels").alias("l")).where("l is not null").select("l.categoria")
    return stats.frequency(vote, stats.universe_of(vote, CODES), "categoria")


@query("d1_exact_comment_groups")
def exact_comment_groups(spark, d):
    rows = documents(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", F.col("lang").alias("author"), F.col("source").alias("post_id"))
    return dedup.exact_clusters(rows).select("id", "cluster")


@query("k1_chunks")
def chunk_rows(spark, d):
    return chunks.chunked(documents(spark, d), "doc_id")


@query("k3_nearest_vectors", """
with q as (select vec_id as query_id, embedding as query from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.query), lambda p: power(p[1]::double - p[2]::double, 2))), 6) as distance from embeddings e cross join q),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from s) select query_id, vec_id, distance, cast(rank as integer) as rank from r where rank <= 10""")
def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.search(e, q, 10, most_queries=1_000_000, digits=6).select("query_id", "vec_id", "distance", "rank")


@query("k6_cosine_to_first", """
select e.vec_id, round(greatest(0, least(1, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])))), 6) as cosine from embeddings e cross join (select embedding from embeddings where vec_id = 0) as q""")
def cosine_to_first(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("reference"))  # one row
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine("embedding", "reference", True), 6).alias("cosine"))


@query("k8_word_overlap", """
with q as (select list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) as y from benchmark where item_id = 1),
x as (select item_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) as x from benchmark)
select item_id, round(len(list_intersect(x, y)) * 1.0 / (len(x) + len(y) - len(list_intersect(x, y))), 6) as overlap from x cross join q""")
def word_overlap(spark, d):
    b = table(spark, d, "benchmark")
    q = b.where("item_id = 1").select(F.col("text").alias("other"))  # one row
    return b.crossJoin(F.broadcast(q)).select("item_id", F.round(vectors.word_overlap("text", "other"), 6).alias("overlap"))


@query("k10_texts_to_embed", "select count(*) as n from (select distinct text from documents) as x")
def texts_to_embed(spark, d):
    return vectors.distinct_texts(documents(spark, d)).agg(F.count("*").alias("n"))


@query("k11_pages_above", "select s_suppkey, s_acctbal, cast(rank() over (order by s_acctbal desc) as integer) as rank from supplier where s_acctbal >= 5000")
def above(spark, d):
    return vectors.above(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 5000.0)

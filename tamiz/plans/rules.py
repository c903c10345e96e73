"""Queries of scanned rules (S9, S10, L16): glossaries, patterns and buckets made from the tables, and operators that go by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions import exclusion
from tamiz.functions.text import ACCENTED, PLAIN
from tamiz.functions.vocabulary import ALL_DIMENSIONS, CATEGORIES, CODES
from tamiz.operators import classify
from tamiz.sources import rules
from tamiz.sources.model import spread, table, view

from .registry import query

#: SQL: every benchmark item's two longest words (the first of equal ones), without accents and case.
_LONG = f"""w as (select item_id, unnest(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[a-z]+')) as w, generate_subscripts(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[a-z]+'), 1) as i from benchmark),
d as (select item_id, w, min(i) as i from w group by item_id, w), r as (select *, row_number() over (partition by item_id order by length(w) desc, i) as place from d), long as (select item_id, w, place from r where place <= 2)"""
_PLAIN_DOCS = f"t as (select doc_id, translate(lower(text), '{ACCENTED}', '{PLAIN}') as t from documents)"


def long_words(spark, d):
    from pyspark.sql import Window

    plain = F.translate(F.lower("text"), ACCENTED, PLAIN)
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(plain, F.lit("[a-z]+"), 0)).alias("i", "w")).groupBy("item_id", "w").agg(F.min("i").alias("i"))
    return w.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.length("w").desc(), "i"))).where("place <= 2")


def glossaries(spark, d):
    """A Markdown glossary of every benchmark item: its longest words in a fenced block, with blanks, remarks and repeats."""
    words = long_words(spark, d).groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda x: F.upper(x["w"])), "\n\n  # nota\n `").alias("w"))
    return words.select(F.concat(F.lit("glosario-"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Glosario\ntexto\n```plain\n`"), "w", F.lit("\n# no\n```\n```\notra\n```\n")).alias("content"))


@query("s10_glossary_tokens", f"with {_LONG} select concat('glosario-', item_id, '.md') as path, w as token from long")
def glossary_tokens(spark, d):
    return rules.glossary(glossaries(spark, d))


@query("s10_glossary_patterns", f"with {_LONG} select concat('glosario-', item_id, '.md') as path, concat('^', w, '+$') as regex, case when item_id % 3 = 1 then 'COND_5_REACCION_CORTA' else 'COND_4_SOLO_RISA' end as codigo from long where place = 1")
def glossary_patterns(spark, d):
    tag = F.when(F.col("item_id") % 3 == 0, " # COND_4_SOLO_RISA").when(F.col("item_id") % 3 == 1, " # COND_5_REACCION_CORTA").otherwise("")
    docs = long_words(spark, d).where("place = 1").select(F.concat(F.lit("glosario-"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("```\n# risas\n\n ^"), "w", F.lit("+$"), tag, F.lit("\n```")).alias("content"))
    return rules.patterns(docs).select("path", "regex", "codigo")


@query("e6_scanned_patterns", f"""
with {_LONG}, {_PLAIN_DOCS}, x as (select distinct unnest(regexp_extract_all(t, '[a-z]+')) as w from t)
select x.w, case when bool_or(item_id % 3 <> 1) then 'COND_4_SOLO_RISA' else 'COND_5_REACCION_CORTA' end as codigo from x join long on long.w = x.w where place = 1 group by x.w""")
def scanned_patterns(spark, d):
    """The different words of all documents against patterns that were scanned; a broken one among them is left out."""
    tag = F.when(F.col("item_id") % 3 == 1, " # COND_5_REACCION_CORTA").otherwise(" # COND_4_SOLO_RISA")
    docs = long_words(spark, d).where("place = 1").select(F.concat(F.when(F.col("item_id") % 3 == 1, "b").otherwise("a"), F.col("item_id").cast("string")).alias("path"), F.concat(F.lit("```\n(rota # COND_4_SOLO_RISA\n"), "w", tag, F.lit("\n```")).alias("content"))
    usable = rules.usable_patterns(rules.patterns(docs))
    texts = spread(table(spark, d, "documents").select("text"))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.lower("text"), ACCENTED, PLAIN), F.lit("[a-z]+"), 0))).alias("w")).distinct()
    return words.select("w", exclusion.short_code(F.col("w"), usable).alias("codigo")).where("codigo is not null")


@query("e8_scanned_words", f"""
with {_LONG}, {_PLAIN_DOCS} select doc_id, case when not exists (select 1 from long where place = 2 and contains(t, w)) and exists (select 1 from long where place = 1 and contains(t, w)) then 'VIOLENCIA_COMUN' end as etiqueta from t""")
def scanned_words(spark, d):
    """Common violence by scanned glossaries: the longest words for aggression, the second longest for marks of gender."""
    fenced = lambda df: df.select(F.lit("g").alias("path"), F.concat(F.lit("```\n"), "w", F.lit("\n```")).alias("content"))
    aggression, markers = (rules.words_of(rules.glossary(fenced(long_words(spark, d).where(f"place = {k}")))) for k in (1, 2))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", exclusion.common_violence("text", aggression, markers).alias("etiqueta"))


_BUCKETS = f"""b as (select item_id, w, place, case item_id % 6 {' '.join(f"when {i} then '{c}'" for i, c in enumerate(CODES))} end as categoria, case item_id % 6 {' '.join(f"when {i} then '{c[3][0][0]}'" for i, c in enumerate(CATEGORIES))} end as dimension, item_id % 3 + 1 as rank, item_id % 4 as score from long)"""


@query("l7_scanned_buckets", f"""
with {_LONG}, {_PLAIN_DOCS}, {_BUCKETS}, h as (select distinct doc_id, item_id, categoria, dimension, rank, score from t join b on contains(t.t, b.w)),
f as (select *, row_number() over (partition by doc_id, dimension order by rank desc, item_id) as k from h), g as (select doc_id, categoria, dimension, max(rank) as rank, max(score) as score, min(item_id) as i from h group by 1, 2, 3),
o as (select *, row_number() over (partition by doc_id order by rank desc, i) as place from g)
select doc_id, string_agg(concat(categoria, '/', dimension, '/', score), '|' order by place) as etiquetas from o where place <= 5 group by doc_id""")
def scanned_buckets(spark, d):
    """Keyword labels by buckets that were scanned and checked against a taxonomy, instead of the fixed ones."""
    n = F.col("item_id") % 6
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    rows = long_words(spark, d).groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]).alias("words"))
    made = rows.select(F.col("item_id").alias("pos"), F.concat(F.lit("b"), "item_id").alias("name"), pick(CODES).alias("categoria"), pick([c[3][0][0] for c in CATEGORIES]).alias("dimension"),
                       F.element_at(F.array(*map(F.lit, ("baja", "media", "alta"))), (F.col("item_id") % 3 + 1).cast("int")).alias("severidad"), (F.col("item_id") % 4).cast("int").alias("score"), "words", F.array().cast("array<string>").alias("context"))
    buckets = rules.buckets_of(made, view(spark, d, "m_taxonomy"))
    out = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", classify.keyword_labels("text", buckets=buckets).alias("l")).where("size(l) > 0")
    return out.select("doc_id", F.array_join(F.transform("l", lambda x: F.concat_ws("/", x["categoria"], x["dimension"], x["score"].cast("string"))), "|").alias("etiquetas"))


_CANON = " ".join(f"when {k} then '{ALL_DIMENSIONS[k]}'" for k in range(7))


@query("l16_marker_drift", f"""
with n as (select source as path, n_chars % 7 as k, dimension from m_labels join documents on doc_id = analysis_result_id where dimension is not null and source is not null)
select path, concat('Márca  ', k) as marcador, dimension as narrada, case k {_CANON} end as canonica from n where dimension <> case k {_CANON} end and not (k = 0 and dimension = '2.1')""")
def marker_drift(spark, d):
    """A narrative document of every source gives markers to the sub-dimensions of its labels."""
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") % 7).alias("k")).where("source is not null")
    said = view(spark, d, "m_labels").join(docs, F.col("analysis_result_id") == F.col("doc_id")).where("dimension is not null")
    line = F.concat(F.lit("- `Márca  "), F.col("k").cast("string"), F.lit("` → **"), "dimension", F.lit("** según"))
    narrative = said.groupBy(F.col("source").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    canon = said.select((F.col("k").cast("int")).alias("k")).distinct().select(F.element_at(F.array(*map(F.lit, ALL_DIMENSIONS)), F.col("k") + 1).alias("dimension"), F.concat(F.lit("marca "), F.col("k").cast("string")).alias("marcador"))
    overlap = canon.where("marcador = 'marca 0'").select("dimension", "marcador", F.lit("2.1").alias("secundaria"))
    return rules.drifted(narrative, canon, overlap)

"""Queries of nested loads (R20, R21, M13, M14) and of duplicate comments (D2, D4), over conversations with copies among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.operators import dedup, loads
from tamiz.sources.model import table, view

from .registry import query

#: SQL: posts of the made pages, with their place on the page and the ids they are given: some none, some one id several times.
_POSTS = """p as (select concat('src', conv_id % 23) as page_id, row_number() over (partition by conv_id % 23 order by conv_id) - 1 as post_idx, case when conv_id % 7 = 0 then null when conv_id % 11 = 0 then 'dup' else concat('p', conv_id) end as given, conv_id, text,
case when conv_id % 3 = 0 then null else concat('2026-01-', lpad(cast(conv_id % 28 + 1 as string), 2, '0'), 'T10:00:00Z') end as date from conversations where turn = 0),
q as (select *, case when given is not null and row_number() over (partition by page_id, given order by post_idx) = 1 then given else concat(page_id, '_p', post_idx) end as post_id from p),
c as (select page_id, post_idx, post_id, q.conv_id, row_number() over (partition by page_id, post_idx order by turn) - 1 as comment_idx, turn, case when q.conv_id % 5 = 0 then concat(t.text, ' 17 min') else t.text end as text from q join conversations t on t.conv_id = q.conv_id and t.turn > 0)"""


def nested_pages(spark, d):
    """A page for each 23rd conversation: first turns are posts, later ones comments, every fifth conversation's comments twice, the second time with an interface's remark."""
    t = table(spark, d, "conversations")
    c = t.where("turn > 0").withColumn("copy", F.explode(F.when(F.col("conv_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("copy") == 1, F.concat("text", F.lit(" 17 min"))).otherwise(F.col("text"))
    given = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn"))
    comment = F.struct(given.alias("id"), text.alias("text"), F.concat(F.lit(" "), "role").alias("author"), F.lit("2026-02-03").alias("date"), (F.col("turn") % 5).cast("string").alias("likes"), F.lit(None).cast("string").alias("created_at"), F.lit("u").alias("url"))
    comments = c.groupBy(F.col("conv_id").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "copy", comment.alias("c")))), lambda x: x["c"]).alias("comments"))
    n = F.col("conv_id")
    pid = F.when(n % 7 == 0, None).when(n % 11 == 0, "dup").otherwise(F.concat(F.lit("p"), n))
    date = F.when(n % 3 != 0, F.concat(F.lit("2026-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")))
    post = F.struct(pid.alias("id"), F.col("text"), F.col("role").alias("author"), date.alias("date"), F.when(n % 4 == 0, "x").otherwise((n % 50).cast("string")).alias("likes"), F.lit("3").alias("shares"), F.lit(None).cast("string").alias("url"), F.col("comments"))
    posts = t.where("turn = 0").join(comments, F.col("conv_id") == F.col("k"), "left").select(n.alias("n"), F.concat(F.lit("src"), n % 23).alias("page_id"), post.alias("p"))
    pages = posts.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias("posts"))
    return pages.select("page_id", F.concat(F.lit("https://www.facebook.com/"), "page_id").alias("url"), F.concat(F.lit("Página "), "page_id").alias("title"), F.lit(10).alias("html_size"), F.lit(None).cast("string").alias("raw_metadata"),
                        F.lit(None).cast("string").alias("scrape_status"), F.lit(None).cast("string").alias("error_message"), F.col("posts").cast(f"array<{loads.POST}>").alias("posts"))


@query("r20_page_load", f"""with {_POSTS} select post_id, page_id, '' as author, md5(text) as digest, case when date is null then null else replace(substr(date, 1, 19), 'T', ' ') end as date, cast(case when conv_id % 4 = 0 then 0 else conv_id % 50 end as integer) as likes,
cast((select count(*) from c where c.page_id = q.page_id and c.post_idx = q.post_idx) as integer) as n_comments, 3 as shares from q""")
def page_load(spark, d):
    posts = loads.three_tables(nested_pages(spark, d))[1]
    return posts.select(F.col("id").alias("post_id"), "page_id", "author", F.md5("text").alias("digest"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "likes", F.col("comments_count").alias("n_comments"), "shares")


@query("r20_loaded_comments", f"""with {_POSTS} select case when turn % 2 = 1 then concat('c', conv_id, '_', turn) else concat(post_id, '_c', comment_idx) end as comment_id, post_id, page_id, '' as author, md5(text) as digest, cast(turn % 5 as integer) as likes, '2026-02-03' as date from c""")
def loaded_comments(spark, d):
    c = loads.three_tables(nested_pages(spark, d))[2]
    return c.select(F.col("id").alias("comment_id"), "post_id", "page_id", "author", F.md5("text").alias("digest"), "likes", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("r20_loaded_pages", f"""with {_POSTS} select q.page_id as id, concat('Página ', q.page_id) as title, cast(count(*) as integer) as posts_extracted, cast((select count(*) from c where c.page_id = q.page_id) as integer) as comments_extracted, 'success' as scrape_status, 0 as authors,
cast(count(*) as integer) as posts_listed from q group by q.page_id""")
def loaded_pages(spark, d):
    p = loads.three_tables(nested_pages(spark, d))[0]
    listed = F.size(F.from_json("preprocessed_data", "posts array<struct<text:string>>")["posts"])
    return p.select("id", "title", "posts_extracted", "comments_extracted", "scrape_status", F.contains("preprocessed_data", F.lit('"author"')).cast("int").alias("authors"), listed.alias("posts_listed"))


def comments_twice(spark, d):
    """Comments and, after each, a copy of it by the same author with an interface's remark behind it and one like more."""
    c = view(spark, d, "m_comments").select("id", "text", "author", "post_id", "likes", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    again = F.col("copy") == 1
    return c.select(F.when(again, F.concat("id", F.lit("b"))).otherwise(F.col("id")).alias("id"), F.when(again, F.concat("text", F.lit(" 17 min"))).otherwise(F.col("text")).alias("text"), "author", "post_id", (F.col("likes") + F.col("copy")).cast("int").alias("likes"),
                    (2 * F.col("pos") + F.col("copy")).alias("pos"))


@query("r21_saved_comments", "select id, concat(text, ' 17 min') as text, cast(likes + 11 as integer) as likes, post_id from m_comments union all select concat('old', id), text, cast(likes as integer), post_id from m_comments")
def saved_comments(spark, d):
    """What is stored, and a batch that has every comment twice: the longer one stays, under the id that is stored already."""
    stored = view(spark, d, "m_comments").select("id", "text", F.col("likes").cast("int").alias("likes"), "post_id")
    current = stored.unionByName(stored.withColumn("id", F.concat(F.lit("old"), "id")))
    twice = comments_twice(spark, d)
    batch = twice.withColumn("likes", (F.col("likes") + 10).cast("int")).withColumn("id", F.when(F.endswith("id", F.lit("b")), F.rtrim("id", F.lit("b"))).otherwise(F.concat("id", F.lit("a"))))
    return loads.saved_comments(current, batch)


@query("d2_duplicate_comments", "select id, id as cluster, false as canonical from m_comments union all select concat(id, 'b'), id, true from m_comments")
def duplicate_comments(spark, d):
    """Comments in groups of duplicates, with the one that stays."""
    g = dedup.with_canonical(dedup.clusters(comments_twice(spark, d)))
    return g.select("id", "cluster", "canonical")


@query("d4_merge_plan", "select concat(id, 'b') as canonical_id, md5(trim(concat(text, ' 17 min'))) as digest, id as duplicate_ids, 1 as removed_count from m_comments")
def merge_plan(spark, d):
    p = dedup.merge_plan(dedup.clusters(comments_twice(spark, d)))
    return p.select("canonical_id", F.md5("canonical_text").alias("digest"), F.array_join("duplicate_ids", "|").alias("duplicate_ids"), F.col("removed_count").cast("int").alias("removed_count"))


@query("d5_repointed_likes", "select id as old, concat(id, 'b') as new from m_comments")
def duplicate_map(spark, d):
    return dedup.duplicate_map(dedup.clusters(comments_twice(spark, d)))


@query("m14_comment_lists", """
with c as (select conv_id, role, turn, row_number() over (partition by conv_id order by turn) - 1 as idx from conversations where turn > 0)
select concat('p', conv_id) as post_id, cast(idx as integer) as idx, role as author, cast(case when conv_id % 4 = 3 then 0 else turn % 5 end as integer) as likes, '2026-02-03' as date, 'https://x/' as url from c where conv_id % 4 <> 2 or idx = 0""")
def comment_lists(spark, d):
    """Comments as models list them: an array, an object with a list, one comment alone in Python's notation, and numbers as texts."""
    c = table(spark, d, "conversations").where("turn > 0")
    likes = F.when(F.col("conv_id") % 4 == 3, "many").otherwise((F.col("turn") % 5).cast("string"))
    lists = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.struct("text", F.col("role").alias("author"), F.lit("2026-02-03").alias("date"), likes.alias("likes"), F.lit("https://x/").alias("url")).alias("c")))), lambda x: x["c"]).alias("l"))
    n, first = F.col("conv_id") % 4, F.element_at("l", 1)
    alone = F.concat(F.lit("{'comment': {'text': 'hola a todas', 'author': '"), first["author"], F.lit("', 'date': '2026-02-03', 'likes': "), first["likes"], F.lit(", 'url': 'https://x/', 'parent': None},}"))
    reply = F.when(n == 0, F.to_json("l")).when(n == 2, alone).otherwise(F.to_json(F.struct(F.col("l").alias("comments"))))
    r = loads.comment_lists(lists.select(F.concat(F.lit("p"), "conv_id").alias("post_id"), reply.alias("reply")))
    return r.select("post_id", "idx", "author", "likes", F.date_format("date", "yyyy-MM-dd").alias("date"), "url")

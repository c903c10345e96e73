"""Queries of pages' posts and comments (X27, X30, X31, M13), of embedded JSON (S6, X26) and of X29."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions.text import json_field, json_int
from tamiz.sources import elements as E
from tamiz.sources import html
from tamiz.sources.model import spread, table

from .registry import query

#: SQL: the made pages hold a post for each first turn and a comment for each later one.
_PAGES = """t as (select conv_id % 19 as page_id, conv_id, turn, role, text from conversations), p as (select *, row_number() over (partition by page_id order by conv_id) - 1 as idx from t where turn = 0),
c as (select t.*, p.idx as post_idx, row_number() over (partition by t.page_id order by t.conv_id, t.turn) - 1 as comment_idx from t join p on p.conv_id = t.conv_id where t.turn > 0)"""


def escaped(c):
    for raw, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(by))
    return c


def made_pages(spark, d):
    """Pages in the shape of a network's: articles with an author's link, a time and counts, comments inside them or beside; every third page marks posts by a label instead of a role."""
    t = table(spark, d, "conversations").withColumn("page_id", F.col("conv_id") % 19)
    n = F.col("conv_id").cast("string")
    comment = F.concat(F.lit('<div><ul><li data-testid="UFI2Comment/root"><a href="/u/'), "turn", F.lit('">Autora '), F.col("turn").cast("string"), F.lit('</a><span>'), escaped(F.col("text")), F.lit('</span><time datetime="2026-02-0'), (F.col("turn") % 9 + 1).cast("string"), F.lit('"></time></li></ul></div>'))
    comments = t.where("turn > 0").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", comment.alias("h")))), lambda x: x["h"]), "").alias("cs"))
    posts = t.where("turn = 0").join(comments, "conv_id", "left")
    mark = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div aria-label="Publicación de Página '), n, F.lit('">'))).otherwise('<div role="article">')
    head = F.concat(mark, F.lit('<h3><a href="/p/'), n, F.lit('">Perfil <b>'), n, F.lit("</b></a></h3>"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('<time datetime="2026-01-'), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit('"></time>'))).otherwise("<span>3 h</span>"),
                    F.lit("<p>Nota numero "), n, F.lit(" sobre la vida</p><script>var x = \"Responder\";</script><span>"), (F.col("conv_id") % 40).cast("string"), F.lit(" reacciones "), (F.col("conv_id") % 7).cast("string"), F.lit(" comentarios "), (F.col("conv_id") % 5).cast("string"), F.lit(" veces compartido</span>"))
    # Comments stand inside the post on even pages, and behind it in one block with it on odd ones.
    body = F.when(F.col("page_id") % 2 == 0, F.concat(head, F.coalesce("cs", F.lit("")), F.lit("</div>"))).otherwise(F.concat(F.lit("<section>"), head, F.lit("</div>"), F.coalesce("cs", F.lit("")), F.lit("</section>")))
    pages = posts.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", body.alias("h")))), lambda x: x["h"]), "<hr>").alias("h"))
    return pages.select("page_id", F.concat(F.lit("https://x/"), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit("<html><head><title> Página "), F.col("page_id").cast("string"), F.lit(" </title></head><body><main>"), "h", F.lit("</main></body></html>")).alias("html"))


@query("x27_posts_of_pages", f"""with {_PAGES} select page_id, cast(idx as integer) as post_idx, case when page_id % 3 = 0 then concat('Página ', conv_id) else concat('Perfil', conv_id) end as author, case when conv_id % 2 = 0 then concat('2026-01-', lpad(cast(conv_id % 28 + 1 as varchar), 2, '0'))
when page_id % 2 = 0 and exists (select 1 from c where c.conv_id = p.conv_id) then concat('2026-02-0', (select min(turn) from c where c.conv_id = p.conv_id) % 9 + 1) else '3 h' end as date, cast(conv_id % 40 as integer) as likes, cast(conv_id % 7 as integer) as comments_count, cast(conv_id % 5 as integer) as shares, concat('https://x/', page_id, '#post_', idx) as url from p""")
def posts_of_pages(spark, d):
    return E.dom_posts(made_pages(spark, d)).select("page_id", "post_idx", "author", "date", "likes", "comments_count", "shares", "url")


@query("x30_nearest_posts", rf"""with {_PAGES} select page_id, cast(comment_idx as integer) as comment_idx, cast(post_idx as integer) as post_idx, concat('Autora ', turn) as author, concat('2026-02-0', turn % 9 + 1) as date, concat('https://x/', page_id, '#comment_', comment_idx) as url, md5(concat('Autora ', turn, ' ', regexp_replace(text, '^\s+|\s+$', '', 'g'))) as digest from c""")
def nearest_posts(spark, d):
    found = E.elements(made_pages(spark, d))
    near = E.nearest(E.comments_in(found), E.posts_in(found))
    return near.select("page_id", "comment_idx", "post_idx", "author", "date", "url", F.md5("text").alias("digest"))


@query("m13_page_hierarchies", f"""with {_PAGES}, n as (select page_id, idx, (select string_agg(concat('Autora ', turn), '+' order by comment_idx) from c where c.conv_id = p.conv_id) as cs from p)
select page_id, concat('Página ', page_id) as title, string_agg(concat(idx, ':', coalesce(cs, '')), '|' order by idx) as posts from n group by page_id""")
def page_hierarchies(spark, d):
    h = E.hierarchy(made_pages(spark, d))
    listed = F.array_join(F.transform("posts", lambda p, i: F.concat(i.cast("string"), F.lit(":"), F.array_join(F.transform(p["comments"], lambda c: c["author"]), "+"))), "|")
    return h.select("page_id", "title", listed.alias("posts"))


def script_pages(spark, d):
    """Pages whose posts stand in scripts' JSON only, with braces and quotes in strings, among prose with odd quotes."""
    t = table(spark, d, "conversations").where("turn = 0")
    n = F.col("conv_id")
    node = F.struct(F.struct(F.concat(F.lit("f"), n).alias("id"), (n % 9).alias("total_comment_count")).alias("feedback"), F.struct(F.concat(F.lit('Quien "dice" {'), n, F.lit("} \\ x")).alias("name")).alias("owner"),
                    F.struct(F.concat(F.lit("Nota "), n, F.lit(": "), F.substring("text", 1, 300)).alias("text")).alias("message"), (F.lit(1700000000) + n).alias("creation_time"), F.when(n % 3 == 0, F.concat(F.lit("id"), n)).alias("post_id"))
    json = F.to_json(F.struct(F.struct(F.array(node).alias("nodes"), F.lit("}}{").alias("brace")).alias("data")))
    pages = t.select((n % 19).alias("page_id"), "conv_id", F.concat(F.lit('<p>5" &amp; {</p><script type="application/json" data-x>'), json, F.lit("</script>")).alias("h"))
    return pages.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "h"))), lambda x: x["h"]), "\n").alias("h")).select("page_id", F.concat(F.lit("https://x/"), F.col("page_id").cast("string"), F.lit("#top")).alias("url"), F.concat(F.lit("<html><body>"), "h", F.lit("</body></html>")).alias("html"))


@query("s6_embedded_posts", r"""with p as (select conv_id % 19 as page_id, conv_id as n, regexp_replace(concat('Nota ', conv_id, ': ', substr(text, 1, 300)), '\s+$', '') as text, row_number() over (partition by conv_id % 19 order by conv_id) - 1 as i from conversations where turn = 0)
select page_id, cast(i as integer) as post_idx, md5(text) as digest, concat('Quien "dice" {', n, '} \ x') as author, strftime(make_timestamp((1700000000 + n) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') as date, coalesce(case when n % 3 = 0 then concat('id', n) end, concat('f', n)) as post_id,
concat('https://x/', page_id, '#post_', case when n % 3 = 0 then concat('id', n) else concat('f', n) end) as url,
cast(coalesce(nullif(lead(n % 9) over (partition by page_id order by n), 0), n % 9 * 0) as integer) as comments_count from p""")
def embedded_posts(spark, d):
    return E.embedded_posts(script_pages(spark, d)).select("page_id", "post_idx", F.md5("text").alias("digest"), "author", "date", "post_id", "url", "comments_count")


@query("x26_json_fields", r"""select event_id, try_cast(nullif(regexp_extract(props, '"k"\s*:\s*(\d+)', 1), '') as bigint) as k, json_extract_string(concat('{"a": {"name": "x"}, "b": {"n": ', event_id, ', "name": "é \" ', event_type, '"}}'), '$.b.name') as name, event_id as n from events""")
def json_fields(spark, d):
    made = F.concat(F.lit('{"a": {"name": "x"}, "b": {"n": '), F.col("event_id").cast("string"), F.lit(', "name": "é \\" '), "event_type", F.lit('"}}'))
    return table(spark, d, "events").select("event_id", json_int("props", "k").alias("k"), json_field(made, "name", '"b"').alias("name"), json_int(made, "n").alias("n"))


@query("x29_reduced_pages")
def reduced_pages(spark, d):
    """Lazy patterns across tags differ between engines; the tests compare cases."""
    return spread(table(spark, d, "pages")).select("page_id", html.reduced("html").alias("html"))

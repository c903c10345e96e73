"""Nested loads: pages with their posts and these with their comments, one row a page, into three tables; lists of comments in replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions.text import clean_comment, iso_time, parsed_date, trimmed
from tamiz.sources.tables import Partitioned, bucket_of

from .dedup import clusters, with_canonical
from .replies import repaired

COMMENT = "struct<id:string,text:string,author:string,date:string,likes:string,created_at:string,url:string>"
POST = f"struct<id:string,text:string,author:string,date:string,likes:string,shares:string,url:string,comments:array<{COMMENT}>>"
NESTED = f"page_id string, url string, title string, html_size int, raw_metadata string, scrape_status string, error_message string, posts array<{POST}>"
PAGES = "id string, url string, title string, source string, html_size int, posts_extracted int, comments_extracted int, preprocessed_data string, raw_metadata string, scrape_status string, error_message string, bucket int"
POSTS = "id string, text string, author string, date timestamp_ntz, likes int, comments_count int, shares int, url string, page_id string, source string, bucket int"
COMMENTS = "id string, text string, author string, date timestamp_ntz, likes int, post_id string, url string, page_id string, bucket int"


def whole(value: Column | str) -> Column:
    """A number given as text; 0 where there is none."""
    return F.coalesce(F.col(value).try_cast("int") if isinstance(value, str) else value.try_cast("int"), F.lit(0))


def survivors(comments: DataFrame, threshold: float = 0.95) -> DataFrame:
    """comments(id, text, author, post_id, likes, created_at, pos) without the duplicates within a post and author; the canonical one of a group stays."""
    gone = with_canonical(clusters(comments, threshold)).where("not canonical").select(F.col("id").alias("_gone"))
    return comments.join(gone, F.col("id") == F.col("_gone"), "left_anti")


def posts_of(nested: DataFrame) -> DataFrame:
    """page_id, post_idx, post_id and the fields of every post. A post keeps its id where it is the first of its page that has it; the others are named by page and place."""
    rows = nested.select("page_id", F.posexplode("posts").alias("post_idx", "p")).select("page_id", "post_idx", "p.*")
    first = F.row_number().over(Window.partitionBy("page_id", "id").orderBy("post_idx")) == 1
    own = (F.coalesce("id", F.lit("")) != "") & first
    return rows.withColumn("post_id", F.when(own, F.col("id")).otherwise(F.concat_ws("_p", "page_id", F.col("post_idx").cast("string"))))


def comments_of(posts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """page_id, post_idx, post_id, comment_idx, comment_id and the fields of the comments that stay, numbered anew within their post. Those without an id are named by post and place."""
    c = posts.select("page_id", "post_idx", "post_id", F.posexplode("comments").alias("pos", "c")).select("page_id", "post_idx", "post_id", "pos", "c.*").withColumnRenamed("post_id", "_post").withColumnRenamed("id", "_given")
    key = F.concat_ws("\x01", "page_id", F.lpad(F.col("post_idx").cast("string"), 9, "0"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    c = c.withColumns({"id": key, "post_id": F.concat_ws("\x01", "page_id", F.col("post_idx").cast("string")), "likes": whole("likes")})
    left = survivors(c, threshold)
    at = F.row_number().over(Window.partitionBy("page_id", "post_idx").orderBy("pos")) - 1
    left = left.withColumn("comment_idx", at)
    return left.select("page_id", "post_idx", F.col("_post").alias("post_id"), "comment_idx", F.coalesce(F.nullif("_given", F.lit("")), F.concat_ws("_c", "_post", F.col("comment_idx").cast("string"))).alias("comment_id"),
                       "text", "author", "date", "likes", "created_at", "url")


def hierarchy_json(url: Column, title: Column, posts: Column) -> Column:
    """A page's hierarchy as JSON, without anybody's name."""
    bare = F.transform(posts, lambda p: F.struct(*[p[f].alias(f) for f in ("id", "text", "date", "likes", "shares", "url")], F.transform(p["comments"], lambda c: F.struct(*[c[f].alias(f) for f in ("id", "text", "date", "likes", "created_at", "url")])).alias("comments")))
    return F.to_json(F.struct(F.struct(url.alias("url"), title.alias("title")).alias("page"), bare.alias("posts")))


def three_tables(nested: DataFrame, parts: int = 64, threshold: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of pages, posts and comments. Names of authors serve to find duplicates and are stored nowhere; of comments with one id the last stays."""
    posts = posts_of(nested)
    comments = comments_of(posts, threshold)
    per_post = comments.groupBy(F.col("page_id").alias("_g"), F.col("post_idx").alias("_i")).agg(F.count("*").cast("int").alias("_n"))
    per_page = per_post.groupBy(F.col("_g")).agg(F.sum("_n").cast("int").alias("_total"))
    bucket = bucket_of(parts, "page_id").alias("bucket")
    page_rows = nested.join(per_page, F.col("page_id") == F.col("_g"), "left").select(
        F.col("page_id").alias("id"), "url", "title", F.lit("facebook").alias("source"), F.coalesce("html_size", F.lit(0)).alias("html_size"), F.coalesce(F.size("posts"), F.lit(0)).alias("posts_extracted"),
        F.coalesce("_total", F.lit(0)).alias("comments_extracted"), hierarchy_json(F.col("url"), F.col("title"), F.col("posts")).alias("preprocessed_data"), F.coalesce("raw_metadata", F.lit("")).alias("raw_metadata"),
        F.coalesce("scrape_status", F.lit("success")).alias("scrape_status"), "error_message", bucket)
    said = lambda c: F.coalesce(c, F.lit("")).alias(c)
    post_rows = posts.join(per_post, (F.col("page_id") == F.col("_g")) & (F.col("post_idx") == F.col("_i")), "left").select(
        F.col("post_id").alias("id"), said("text"), F.lit("").alias("author"), iso_time("date").alias("date"), whole("likes").alias("likes"), F.coalesce("_n", F.lit(0)).alias("comments_count"), whole("shares").alias("shares"), said("url"),
        "page_id", F.lit("facebook_page").alias("source"), bucket)
    last = comments.groupBy("page_id", "comment_id").agg(F.max_by(F.struct("text", "date", "likes", "post_id"), F.struct("post_idx", "comment_idx")).alias("l"), F.min_by("url", F.struct("post_idx", "comment_idx")).alias("url"))
    comment_rows = last.select(F.col("comment_id").alias("id"), F.coalesce("l.text", F.lit("")).alias("text"), F.lit("").alias("author"), iso_time("l.date").alias("date"), F.col("l.likes").alias("likes"), F.col("l.post_id").alias("post_id"), said("url"), "page_id", bucket)
    return page_rows, post_rows, comment_rows


class PageStore:
    """Pages, posts and comments below one folder, in the same number of parts by page."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.parts = parts
        self.pages, self.posts, self.comments = (Partitioned(spark, f"{path.rstrip('/')}/{name}", schema, "bucket") for name, schema in (("pages", PAGES), ("posts", POSTS), ("comments", COMMENTS)))

    def load(self, nested: DataFrame) -> None:
        """Pages with all that hangs on them in place of what was stored of them. Loading the same twice gives the same tables.

        nested: as NESTED, one row a page; of several of one page_id any counts, so give one. Posts and comments of a
        page go with it also where the new load has none. A post that two pages hold stays under both.
        """
        one = nested.where("page_id is not null").dropDuplicates(["page_id"])
        pages, posts, comments = three_tables(one, self.parts)
        owners = one.select("page_id", bucket_of(self.parts, "page_id").alias("bucket"))
        # Children first: a page is there when all that hangs on it is, and a lost load is repeated from the start.
        self.comments.replace_of(owners, comments, ["page_id"])
        self.posts.replace_of(owners, posts, ["page_id"])
        self.pages.replace_of(owners.withColumnRenamed("page_id", "id"), pages, ["id"])


def saved_comments(current: DataFrame, batch: DataFrame, threshold: float = 0.95) -> DataFrame:
    """current with a batch of comments in it by id, duplicates within the batch left out first. batch: as current, with pos, the order of input; the last of one id counts, null fields leave what is there."""
    from .relational import upsert

    dated = survivors(batch, threshold)
    for c in ("date", "created_at"):
        if c in dated.columns and dated.schema[c].dataType.typeName() == "string":
            dated = dated.withColumn(c, iso_time(c))
    return upsert(current, dated.select(*[c for c in dated.columns if c in current.columns], "pos"), ["id"], "pos").select(*current.columns)


def comment_lists(replies: DataFrame, reply: str = "reply", most: int = 500, shortest: int = 0) -> DataFrame:
    """post_id, idx and the fields of every comment in replies(post_id, url, ...): id, text, author, date, likes, responses, time_ago, url.

    A reply is a list of comments, or an object with them (or one) under comments or comment, in JSON that may need repair.
    Items that are no objects go and keep their numbers. Texts of fewer than `shortest` characters go; `most` items of a reply count.
    """
    r = repaired(replies.withColumnRenamed("url", "_page") if "url" in replies.columns else replies.withColumn("_page", F.lit(None).cast("string")), reply)
    v = F.col("json")
    kind = lambda x, path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(x, path, "variant")), "^[A-Z]+", 0)
    under = F.when(kind(v, "$.comments").isNotNull(), F.lit("comments")).otherwise(F.lit("comment"))
    pick = lambda typ: F.when(under == "comments", F.try_variant_get(v, "$.comments", typ)).otherwise(F.try_variant_get(v, "$.comment", typ))
    one = F.regexp_extract(F.schema_of_variant(pick("variant")), "^[A-Z]+", 0)
    items = F.when(kind(v, "$") == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(one == "ARRAY", pick("array<variant>")).when(one == "OBJECT", F.array(pick("variant")))
    rows = r.select("post_id", "_page", F.posexplode(F.slice(items, 1, most)).alias("idx", "c")).where(kind(F.col("c"), "$") == "OBJECT")
    get = lambda k: F.try_variant_get("c", f"$.{k}", "string")
    said = lambda k, d="": F.coalesce(get(k), F.lit(d))
    rows = rows.select("post_id", "_page", "idx", F.coalesce(get("text"), get("content"), F.lit("")).alias("raw"), said("author").alias("author"), get("date").alias("date"), F.when(kind(F.col("c"), "$.date").isNull(), "").otherwise(F.coalesce(get("date"), F.lit("None"))).alias("date_said"), whole(get("likes")).alias("likes"), whole(get("responses")).alias("said_responses"), said("url").alias("url"))
    rows = rows.where(F.length(trimmed("raw")) >= shortest).withColumn("clean", clean_comment("raw", F.nullif("author", F.lit(""))))
    digest = F.concat_ws("_", "url", "author", "date_said", F.substring(F.md5("clean.body"), 1, 8), F.col("idx").cast("string"), F.lit("comment"))
    return rows.select("post_id", "idx", F.substring(F.md5(digest), 1, 16).alias("id"), F.col("clean.body").alias("text"), "author", parsed_date("date").alias("date"), "likes",
                       F.when(F.coalesce("clean.responses", F.lit(0)) != 0, F.col("clean.responses")).otherwise(F.col("said_responses")).alias("responses"), F.col("clean.time_ago").alias("time_ago"), "url")

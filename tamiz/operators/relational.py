"""Relational access: filters, nesting joins, anti joins, unions with precedence, upserts.

No operator needs an order of its input; where order decides, the column that holds it is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Rows equal in every given column; a value of None asks for nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[str], fields: list[str], into: str) -> DataFrame:
    """Every parent with the ordered list of its children; an empty list without any.

    The children group before the join, so that only one row a parent meets it.
    """
    lists = lists_of(children, child_key, order, fields, into).withColumnRenamed(child_key, "_k")
    return parents.join(lists, F.col(key) == F.col("_k"), "left").withColumn(into, F.coalesce(into, F.array().cast(_list_type(children, fields)))).drop("_k")


def lists_of(children: DataFrame, key: str, order: list[str], fields: list[str], into: str) -> DataFrame:
    """key and the ordered list of the children of every key that has any."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(into))
    return lists.select(key, F.transform(into, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(into))


def _list_type(df: DataFrame, fields: list[str]) -> str:
    return "array<struct<" + ",".join(f"{f}:{df.schema[f].dataType.simpleString()}" for f in fields) + ">>"


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose foreign key is set and names no parent."""
    return children.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias("_k")), F.col(foreign) == F.col("_k"), "left_anti")


def not_analysed(content: DataFrame, analyses: DataFrame, content_type: str) -> DataFrame:
    """Content without an analysis of its type."""
    done = analyses.where(F.col("content_type") == content_type).select(F.col("content_id").alias("_k"))
    return content.join(done, F.col("id") == F.col("_k"), "left_anti")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def union_first(*frames: DataFrame, key: str = "id") -> DataFrame:
    """All rows of the first frame, and of each later one those whose key no earlier one has."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df.join(out.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti"))
    return out


def last_of(batch: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last by order. Without an order the batch has to have each key once: which row is the last can't be known then."""
    if order is None:
        once = batch.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*batch.columns)).alias("_row"))
        return once.select(F.when(F.col("_n") > 1, F.raise_error(F.lit("a key comes twice; name the column that orders the batch"))).otherwise(F.col("_row")).alias("_row")).select("_row.*")
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("_last")).select("_last.*")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Current rows with those of the batch in place or added; a null in the batch leaves the current value.

    Of rows of the batch with one key the last by order counts.
    """
    batch = last_of(batch, keys, order)
    b = batch.select(*[F.col(c).alias(f"_{c}") for c in batch.columns])
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    both = current.join(b, on, "full_outer")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in both.columns else F.col(c) for c in current.columns])


def replace_children(children: DataFrame, new: DataFrame, foreign: str) -> DataFrame:
    """Children of other parents, and the new ones of theirs."""
    return children.join(new.select(F.col(foreign).alias("_k")).distinct(), F.col(foreign) == F.col("_k"), "left_anti").unionByName(new)


def repoint(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Foreign keys moved from duplicates to what replaces them: mapping(old, new)."""
    return df.join(mapping, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def fill_missing(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """A column filled from updates(key, value) where it is null; of several values of one key the greatest."""
    u = updates.groupBy(key).agg(F.max("value").alias("value")).select(F.col(key).alias("_k"), F.col("value").alias("_v"))
    return df.join(u, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce(column, "_v")).drop("_k", "_v")


def hierarchy(pages: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Pages with their posts, and these with their comments, as nested lists in order of id."""
    with_comments = nested(posts, comments, "id", "post_id", ["id"], ["id", "text", "likes"], "comments")
    return nested(pages, with_comments, "id", "page_id", ["id"], ["id", "text", "likes", "comments"], "posts")


def counts(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of every frame. Each is counted in parts before they meet."""
    parts = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("name")).groupBy("name").count()
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy().agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("count"))), F.lit(0)).alias(n) for n in frames])


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the ordered rows; a page number outside the pages gives the nearest."""
    total = max(1, -(-df.count() // size))
    at = min(max(1, page), total)
    return df.orderBy(*order).offset((at - 1) * size).limit(size)

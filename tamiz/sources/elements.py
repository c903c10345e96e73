"""Posts and comments in pages: elements found by selectors, their fields, comments given to the nearest post, and posts in embedded JSON.

Python reads a page's tags once, in the tasks, and yields a row for each element that a selector takes, with the way to it
from the top of the page; all that is made of these rows is Spark columns, joins and groups.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.text import clean_post, first_number, json_field, json_int, trimmed

from .html import VOID, page_metadata

# What marks posts and comments in a page, the first kind that finds any counts; and where their fields stand.
POST_LABEL = re.compile(r"(publicaci.n de|Acciones en esta)", re.IGNORECASE)
POST_LABEL_ANY = re.compile(r"Publicaci.n", re.IGNORECASE)
COMMENT_ID = re.compile(r"comment", re.IGNORECASE)
REPLY = re.compile(r"Responder")
AUTHOR_LINK = re.compile(r"/[^/]+")
POST_SELECTORS: list[Callable[[str, dict], bool]] = [
    lambda tag, a: tag == "div" and bool(POST_LABEL.search(a.get("aria-label") or "")),
    lambda tag, a: a.get("data-testid") == "post_message",
    lambda tag, a: "userContent" in (a.get("class") or "").split(),
    lambda tag, a: a.get("role") == "article",
    lambda tag, a: "data-pagelet" in a,
    lambda tag, a: tag == "div" and bool(POST_LABEL_ANY.search(a.get("aria-label") or "")),
]
LABEL_AUTHOR = r'(?iU)publicaci[óo]n de ([^"]+?)(?:"|$)'
RELATIVE_DATES = [r"(?iU)(\d+)\s*h\b", r"(?iU)(\d+)\s*min\b", r"(?iU)(\d+)\s*d[ií]as?", r"(?iU)(\d+)\s*sem"]
LIKES = [r"(?iU)(\d+)\s*reacciones?", r"(?iU)(\d+)\s*me gusta", r"(?iU)(\d+)\s*likes?"]
COMMENT_COUNTS = [r"(?iU)(\d+)\s*comentarios?"]
SHARES = [r"(?iU)(\d+)\s*compartidos?", r"(?iU)(\d+)\s*veces compartido"]
COMMENT_LIKES = [r"(?iU)(\d+)\s*(?:Me gusta|Like|likes)"]
LEAST_POST, LEAST_COMMENT, SAME_TEXT = 10, 5, 200
UNKNOWN = "Unknown"

#: Attributes that a selector or a field reads, and rows of elements that leave a task at a time.
READ = frozenset("aria-label data-testid class role data-pagelet href datetime".split())
ROWS = 2000
ELEMENT = {"kind": pa.string(), "selector": pa.int32(), "idx": pa.int32(), "label": pa.string(), "link": pa.string(), "dated": pa.string(), "text": pa.string(), "path": pa.list_(pa.int32())}
ELEMENT_DDL = "kind string, selector int, idx int, label string, link string, dated string, text string, path array<int>"
NOTHING: dict = {}


class _Tree(HTMLParser):
    """A page's elements in the order of their start. Everything below an element is an interval: of elements, and of texts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parents = ["", ], [{}], [-1]
        self.text_from, self.text_to, self.last = [0], [0], [0]
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.open = [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.parents.append(self.open[-1])
        self.tags.append(sys.intern(tag))
        self.attrs.append({k: v for k, v in attrs if k in READ} or NOTHING)
        for column in (self.text_from, self.text_to):
            column.append(len(self.texts))
        self.last.append(len(self.tags) - 1)
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        if any(self.tags[k] == tag for k in self.open):
            while self._leave() != tag:
                pass

    def _leave(self) -> str:
        k = self.open.pop()
        self.text_to[k], self.last[k] = len(self.texts), len(self.tags) - 1
        return self.tags[k]

    def handle_data(self, data: str) -> None:
        if data.strip() and self.tags[self.open[-1]] not in ("script", "style", "template"):
            self.texts.append(data.strip())
            self.owners.append(self.open[-1])

    def close(self) -> None:
        super().close()
        while len(self.open) > 1:
            self._leave()
        self.last[0] = len(self.tags) - 1

    def path(self, k: int) -> list[int]:
        """The element and those around it, up to below the body; up to the top where there is no body around it."""
        out = []
        while k >= 0 and self.tags[k] != "body":
            out.append(k)
            k = self.parents[k]
        return out[::-1]

    def first_inside(self, k: int, sorted_elements: list[int]) -> int | None:
        at = bisect_right(sorted_elements, k)
        return sorted_elements[at] if at < len(sorted_elements) and sorted_elements[at] <= self.last[k] else None


def elements_in(html: str | None) -> Iterator[dict]:
    """A row for each time that a selector takes an element of a page."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    every = range(1, len(t.tags))
    links = [k for k in every if t.tags[k] == "a" and AUTHOR_LINK.search(t.attrs[k].get("href") or "")]
    times = [k for k in every if t.tags[k] == "time"]
    found = [("post", n, [k for k in every if takes(t.tags[k], t.attrs[k])]) for n, takes in enumerate(POST_SELECTORS)]
    found.append(("comment", 0, [k for k in every if COMMENT_ID.search(t.attrs[k].get("data-testid") or "")]))
    found.append(("comment", 1, [owner for owner, said in zip(t.owners, t.texts, strict=True) if REPLY.search(said)]))
    for kind, selector, taken in found:
        for idx, k in enumerate(taken):
            link, time = t.first_inside(k, links), t.first_inside(k, times)
            yield {"kind": kind, "selector": selector, "idx": idx, "label": t.attrs[k].get("aria-label"), "link": None if link is None else "".join(t.texts[t.text_from[link]:t.text_to[link]]),
                   "dated": None if time is None else t.attrs[time].get("datetime"), "text": " ".join(t.texts[t.text_from[k]:t.text_to[k]]), "path": t.path(k)}


def elements(pages: DataFrame) -> DataFrame:
    """page_id, url, kind, selector, idx, label, link, dated, text and path of every element of pages(page_id, url, html) that a selector takes.

    Parsing HTML has no form in Spark; it runs page by page, and a task holds one page's tags and ROWS rows of its elements at
    a time. What follows needs no page.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column("page_id"), batch.column("url")]
            for n in range(batch.num_rows):
                rows = elements_in(batch.column("html")[n].as_py())
                while some := list(islice(rows, ROWS)):
                    own = [pa.repeat(key[n], len(some)) for key in keys]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array([r[c] for r in some], kind) for c, kind in ELEMENT.items()]], names=["page_id", "url", *ELEMENT])

    return pages.select("page_id", "url", "html").mapInArrow(parse, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, {ELEMENT_DDL}")


def _first_kind(rows: DataFrame) -> DataFrame:
    """Of each page's rows those of the first selector that has any."""
    first = rows.groupBy(F.col("page_id").alias("_p")).agg(F.min("selector").alias("_s"))
    return rows.join(first, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("selector") == F.col("_s"))).drop("_p", "_s")


def _author(label: Column | None) -> Column:
    own = F.nullif(trimmed(F.regexp_extract(F.coalesce(label, F.lit("")), LABEL_AUTHOR, 1)), F.lit("")) if label is not None else F.lit(None)
    linked = F.when((F.col("link") != "") & (F.length("link") < 100), F.col("link"))
    return F.coalesce(own.cast("string"), linked, F.lit(UNKNOWN))


def _hit(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def posts_in(found: DataFrame) -> DataFrame:
    """page_id, post_idx, text, author, date, likes, comments_count, shares, url and path of the posts among elements; of those that share their first 200 characters the first."""
    t = F.col("text")
    rows = found.where((F.col("kind") == "post") & (F.length("text") >= LEAST_POST)).withColumn("author", _author(F.col("label")))
    rows = rows.select("page_id", "selector", "idx", "path", "author", F.coalesce("dated", _hit(t, RELATIVE_DATES), F.lit("")).alias("date"), first_number(t, LIKES).alias("likes"), first_number(t, COMMENT_COUNTS).alias("comments_count"),
                       first_number(t, SHARES).alias("shares"), F.concat("url", F.lit("#post_"), F.col("idx").cast("string")).alias("url"), clean_post("text", "author").alias("text"))
    rows = _first_kind(rows.where(F.length("text") >= LEAST_POST)).withColumn("_same", F.substring(trimmed("text"), 1, SAME_TEXT))
    firsts = rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "_same").orderBy("idx"))).where("_n = 1")
    return firsts.withColumn("post_idx", F.row_number().over(Window.partitionBy("page_id").orderBy("idx")) - 1).select("page_id", "post_idx", "text", "author", "date", "likes", "comments_count", "shares", "url", "path")


def comments_in(found: DataFrame) -> DataFrame:
    """page_id, comment_idx, text, author, date, likes, url and path of the comments among elements."""
    rows = _first_kind(found.where((F.col("kind") == "comment") & (F.length("text") >= LEAST_COMMENT)))
    return rows.select("page_id", F.col("idx").alias("comment_idx"), "text", _author(None).alias("author"), F.coalesce("dated", F.lit("")).alias("date"), first_number(F.col("text"), COMMENT_LIKES).alias("likes"),
                       F.concat("url", F.lit("#comment_"), F.col("idx").cast("string")).alias("url"), "path")


def nearest(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """comments with post_idx, the post of their page with the fewest steps through the tree; the first of equally near ones, and of all where none hangs on the same body. Comments of pages without posts go.

    A post is known to every element around it, by its least steps from there; a comment asks those around itself. So the work
    grows with the elements and their depth, not with comments times posts.
    """
    around = lambda df, *own: df.select("page_id", *own, F.size("path").alias("deep"), F.posexplode("path").alias("level", "node"))
    best = around(posts, "post_idx").groupBy(F.col("page_id").alias("_p"), F.col("node").alias("_n")).agg(F.min(F.struct((F.col("deep") - F.col("level") - 1).alias("steps"), "post_idx")).alias("post"))
    asked = around(comments, "comment_idx").join(best, (F.col("page_id") == F.col("_p")) & (F.col("node") == F.col("_n")))
    own = asked.groupBy(F.col("page_id").alias("_c"), F.col("comment_idx").alias("_i")).agg(F.min(F.struct((F.col("deep") - F.col("level") - 1 + F.col("post.steps")).alias("steps"), F.col("post.post_idx").alias("post_idx")))["post_idx"].alias("_near"))
    some = posts.groupBy(F.col("page_id").alias("_q")).agg(F.min("post_idx").alias("_first"))
    return (comments.join(some, F.col("page_id") == F.col("_q")).join(own, (F.col("page_id") == F.col("_c")) & (F.col("comment_idx") == F.col("_i")), "left")
            .withColumn("post_idx", F.coalesce("_near", "_first")).drop("_q", "_first", "_c", "_i", "_near"))


# Posts in embedded JSON. The shape of a message, and how far its object may begin before it.

MESSAGE = re.compile(r'"message"\s*:\s*\{\s*"text"\s*:\s*"((?:[^"\\]|\\.){10,2000}?)"', re.DOTALL)
SCRIPT = re.compile(r"<script\b[^>]*>(.*?)(?:</script\s*>|\Z)", re.DOTALL | re.IGNORECASE)
FAR = 200_000
FOUND = "struct<at:int,raw:string,object:string,total:string,count:string>"
SCOPE = '"feedback"'


def braces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of braces, whether each opens, places of quotes) of a text of JSON. Quotes that are escaped don't count."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(chars))
    # A quote after an odd run of backslashes is part of a string.
    solid = np.maximum.accumulate(np.where(chars == 92, -1, place)) if len(chars) else place
    run = np.r_[0, (place - solid)[:-1]] if len(chars) else place
    quotes = np.flatnonzero((chars == 34) & (run % 2 == 0))
    at = np.flatnonzero((chars == 123) | (chars == 125))
    return at, chars[at] == 123, quotes


def around(text: str, places: list[int], far: int = FAR) -> list[tuple[int, int] | None]:
    """For each place outside of strings the innermost braces around it, as [from, to); None where they don't open within `far` characters before, or never close.

    Braces with an odd number of quotes between them and the place are within a string. Among the others, at the place the
    depth is the sum of those before it; the object there begins at the last brace that opened to this depth, and ends at the
    next one that closes from it. So quotes that have no partner, before the object, do no harm.
    """
    every, opening, quotes = braces(text)
    odd = np.searchsorted(quotes, every) % 2
    out: list[tuple[int, int] | None] = []
    levels = {}
    for p in places:
        side = int(np.searchsorted(quotes, p)) % 2
        if side not in levels:
            at, opens = every[odd == side], opening[odd == side]
            depth = np.cumsum(np.where(opens, 1, -1))
            levels[side] = at, opens, depth, np.where(opens, depth, depth + 1)
        at, opens, depth, level = levels[side]
        k = int(np.searchsorted(at, p))
        d = int(depth[k - 1]) if k else 0
        starts = np.flatnonzero(opens[:k] & (level[:k] == d))
        ends = np.flatnonzero(~opens[k:] & (level[k:] == d))
        ok = len(starts) and len(ends) and p - int(at[starts[-1]]) <= far
        out.append((int(at[starts[-1]]), int(at[k + ends[0]]) + 1) if ok else None)
    return out


class _Numbers:
    """Whole numbers of a key in a page's JSON: the first in a part of the page. The page is searched once."""

    def __init__(self, text: str, key: str) -> None:
        self.text, self.pattern = text, re.compile(rf'"{key}"\s*:\s*(\d+)', re.ASCII)
        self.starts = [m.start() for m in self.pattern.finditer(text)]

    def first(self, since: int, to: int) -> str | None:
        at = bisect_left(self.starts, since)
        m = self.pattern.match(self.text, self.starts[at], to) if at < len(self.starts) and self.starts[at] < to else None
        return m[1] if m else None


def messages_in(html: str | None) -> list[dict]:
    """Messages in a page's scripts (or in its text where they stand in none): their place in the page, their raw text, the object around them and the counts of comments stated within FAR characters."""
    text, out = html or "", []
    places = [(m.start(), m[1]) for m in MESSAGE.finditer(text)]
    if not places:
        return out
    totals, counts = _Numbers(text, "total_comment_count"), _Numbers(text, "comment_count")
    parts, at = [], 0
    for m in SCRIPT.finditer(text):
        parts += [(at, m.start(1)), (m.start(1), m.end(1))]
        at = m.end(1)
    starts = [p for p, _ in places]
    for a, b in [*parts, (at, len(text))]:
        own = places[bisect_left(starts, a):bisect_left(starts, b)]
        if own:
            part = text[a:b]
            for (p, raw), x in zip(own, around(part, [p - a for p, _ in own]), strict=True):
                if x:
                    scope = text.find(SCOPE, p, p + FAR)
                    total = totals.first(scope + len(SCOPE), p + FAR) if scope >= 0 else None
                    out.append({"at": p, "raw": raw, "object": part[x[0]:x[1]], "total": total, "count": counts.first(p, p + FAR)})
    return out


def embedded_posts(pages: DataFrame) -> DataFrame:
    """page_id, post_idx, text, author, date, likes, comments_count, shares, url and post_id of the messages in pages' JSON; of those with one text the first."""
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(messages_in)

    f = F.pandas_udf(find, f"array<{FOUND}>")
    # A message's row holds what is its own: a page beside each of its messages would be their product.
    rows = pages.select("page_id", "url", F.explode(f("html")).alias("m"))
    o = F.col("m.object")
    given = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    count = F.coalesce(F.nullif(F.col("m.total").try_cast("long"), F.lit(0)), F.col("m.count").try_cast("long"), F.lit(0))
    epoch = F.coalesce(F.nullif(json_int(o, "creation_time"), F.lit(0)), json_int(o, "publish_time"))
    rows = rows.select("page_id", "url", F.col("m.at").alias("at"), trimmed(decoded("m.raw")).alias("text"), F.coalesce(given(json_field(o, "name", '"owner"'), json_field(o, "name", '"actor"')), F.lit(UNKNOWN)).alias("author"),
                       F.coalesce(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.when(epoch > 0, epoch)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("")).alias("date"), count.cast("int").alias("comments_count"),
                       F.coalesce(given(json_field(o, "post_id"), json_field(o, "id", '"feedback"'), json_field(o, "video_id")), F.lit("")).alias("post_id"))
    rows = rows.where(F.length("text") >= LEAST_POST).withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "text").orderBy("at"))).where("_n = 1")
    base = F.when(F.col("post_id") == "", F.col("url")).otherwise(F.concat(F.regexp_replace("url", "#[^#]*$", ""), F.lit("#post_"), "post_id"))
    return rows.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).alias("post_idx"), "text", "author", "date", F.lit(0).alias("likes"), "comments_count", F.lit(0).alias("shares"), base.alias("url"), "post_id")


def decoded(raw: Column | str) -> Column:
    """What a JSON string's inside stands for; itself where it is no valid one."""
    r = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), r, F.lit('"}')), "v string")["v"], r)


# Strategies


def dom_posts(pages: DataFrame) -> DataFrame:
    return posts_in(elements(pages)).drop("path").withColumn("post_id", F.lit(""))


def posts_by(pages: DataFrame, *strategies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Posts of every page by the first strategy that finds any, and which that was. Later strategies see the pages only that are left.

    A strategy takes pages(page_id, url, html) and gives the columns that dom_posts gives.
    """
    out, left = None, pages
    for strategy in strategies:
        found = strategy(left).withColumn("strategy", F.lit(strategy.__name__))
        out = found if out is None else out.unionByName(found)
        done = found.select(F.col("page_id").alias("_done")).distinct()
        left = left.join(done, F.col("page_id") == F.col("_done"), "left_anti")
    return out


def hierarchy(pages: DataFrame) -> DataFrame:
    """page_id, url, title, metadata and posts of every page, each with the comments that stand nearest to it."""
    found = elements(pages)
    posts = posts_in(found)
    near = nearest(comments_in(found), posts)
    fields = ["text", "author", "date", "likes", "url"]
    lists = near.groupBy(F.col("page_id").alias("_p"), F.col("post_idx").alias("_i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("comment_idx", *fields))), lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("comments"))
    kind = "array<struct<text:string,author:string,date:string,likes:int,url:string>>"
    full = posts.join(lists, (F.col("page_id") == F.col("_p")) & (F.col("post_idx") == F.col("_i")), "left").withColumn("comments", F.coalesce(F.col("comments").cast(kind), F.array().cast(kind)))
    own = ["text", "author", "date", "likes", "comments_count", "shares", "url", "comments"]
    nested = full.groupBy(F.col("page_id").alias("_g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("post_idx", *own))), lambda p: F.struct(*[p[f].alias(f) for f in own])).alias("posts"))
    return page_metadata(pages).join(nested, F.col("page_id") == F.col("_g"), "left").drop("_g")


def hierarchy_text(page: Column | str = "posts", title: Column | str = "title", url: Column | str = "url") -> Column:
    """A page's hierarchy as text to read: the page, its posts with their counts, their comments cut to 100 characters."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])

    def comment(c: Column, j: Column) -> Column:
        return said("\n    ", j + 1, ". ", c["author"], ": ", F.substring(c["text"], 1, 100), "...\n      Likes: ", c["likes"], ", Fecha: ", c["date"])

    def post(p: Column, i: Column) -> Column:
        head = said("\n\nPUBLICACIÓN ", i + 1, ":\nAutor: ", p["author"], "\nFecha: ", p["date"], "\nLikes: ", p["likes"], "\nComentarios: ", p["comments_count"], "\nCompartidos: ", p["shares"], "\n", "-" * 40, "\nTexto:\n", p["text"])
        return F.concat(head, said("\n\n  COMENTARIOS (", F.size(p["comments"]), "):"), F.array_join(F.transform(p["comments"], comment), ""))

    return F.concat(said("PÁGINA: ", col(title), "\nURL: ", col(url), "\n", "=" * 50), F.coalesce(F.array_join(F.transform(col(page), post), ""), F.lit("")))

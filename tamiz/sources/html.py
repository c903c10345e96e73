"""Raw pages: metadata, reduction, blocks of text with their place in the tree, comments given to the nearest post."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import as_column, trimmed

#: Elements whose text is a block, and those whose content is none.
BLOCKS = frozenset("article p li h1 h2 h3 h4 blockquote td".split())
SILENT = frozenset("script style iframe noscript nav".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_id, url, title, og_title, og_description, og_site_name; null where a page doesn't state it."""
    def og(name: str) -> Column:
        return F.nullif(F.regexp_extract("html", rf"(?is)<meta[^>]*property=[\"']og:{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1), F.lit(""))

    title = F.nullif(trimmed(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1)), F.lit(""))
    return pages.select("page_id", "url", title.alias("title"), og("title").alias("og_title"), og("description").alias("og_description"), og("site_name").alias("og_site_name"))


def reduced(html: Column | str, most: int = 50_000, mark: str | None = "... [TRUNCATED]") -> Column:
    """HTML above `most` characters without scripts, styles, frames and most meta elements; then its body; then cut. No mark, no cut."""
    h = as_column(html)
    small = F.regexp_replace(h, r"(?is)<(script|style|iframe|noscript)\b[^>]*>.*?</\1\s*>", "")
    if mark is None:
        return F.when(F.length(h) <= most, h).otherwise(small)
    small = F.regexp_replace(small, r"(?is)<meta\b(?![^>]*property=[\"']og:(?:title|description|site_name)[\"'])[^>]*>", "")
    small = F.regexp_replace(small, r"(?is)<link\b(?![^>]*rel=[\"']?stylesheet)[^>]*>", "")
    body = F.regexp_extract(small, r"(?is)(<body\b.*</body\s*>)", 1)
    shorter = F.when((F.length(small) > most) & (body != ""), body).otherwise(small)
    cut = F.when(F.length(shorter) > most, F.concat(F.substring(shorter, 1, most), F.lit(mark))).otherwise(shorter)
    return F.when(F.length(h) <= most, h).otherwise(cut)


class _Blocks(HTMLParser):
    """Texts of block elements, each with its path of child numbers from the root."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[list] = [["", 0]]
        self.open: list[tuple[int, str, str, list[str]]] = []
        self.silent = 0
        self.found: list[tuple[str, str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.path[-1][1] += 1
        if tag in VOID:
            return
        self.path.append([tag, 0])
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.open.append((len(self.path), tag, "/".join(str(n) for _, n in self.path[:-1]), []))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.path]:
            return
        while self.path[-1][0] != tag:
            self._close()
        self._close()

    def _close(self) -> None:
        if self.open and self.open[-1][0] == len(self.path):
            _, tag, place, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if text:
                self.found.append((tag, place, text))
        self.silent -= self.path.pop()[0] in SILENT

    def handle_data(self, data: str) -> None:
        if self.open and not self.silent:
            self.open[-1][3].append(data)

    def close(self) -> None:
        super().close()
        while len(self.path) > 1:
            self._close()


def parsed(html: str | None) -> list[dict]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    return [{"tag": t, "place": x, "text": s} for t, x, s in p.found]


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, idx, tag, place and text of every block of every page; the first of those that share their first 200 characters."""
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(parsed)

    f = F.pandas_udf(parse, "array<struct<tag:string,place:string,text:string>>")
    rows = pages.select("page_id", F.posexplode(f("html")).alias("idx", "b")).select("page_id", "idx", "b.*")
    first = rows.groupBy(F.col("page_id").alias("_p"), F.substring(trimmed("text"), 1, 200).alias("_t")).agg(F.min("idx").alias("_i"))
    return rows.join(first, (F.col("page_id") == F.col("_p")) & (F.col("idx") == F.col("_i"))).select("page_id", "idx", "tag", "place", "text")


def tree_distance(a: Column | str, b: Column | str) -> Column:
    """Steps between two places through their nearest common ancestor."""
    x, y = F.split(as_column(a), "/"), F.split(as_column(b), "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    first_off = F.array_position(same, False)
    shared = F.when(first_off == 0, F.size(same)).otherwise(first_off - 1)
    return F.size(x) + F.size(y) - 2 * shared


def nearest_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """comments(page_id, idx, place) with post_idx, the post of the same page with the fewest steps between; the first of several."""
    p = posts.select(F.col("page_id").alias("_p"), F.col("idx").alias("_i"), F.col("place").alias("_l"))
    j = comments.join(p, F.col("page_id") == F.col("_p")).withColumn("_d", tree_distance("place", "_l"))
    return j.groupBy("page_id", "idx", "place").agg(F.min(F.struct("_d", "_i"))["_i"].alias("post_idx"))

"""Addresses: class and post id; predicates on fetched pages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column
from .vocabulary import CAPTCHA_MARKS, LOGIN_MARKS, SOCIAL_DOMAIN


def _part(url: Column, pattern: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1))


def url_class(url: Column | str, domain: str = SOCIAL_DOMAIN) -> Column:
    """page, post, group or unknown; null is unknown."""
    u = as_column(url)
    host = _part(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")
    path = F.regexp_replace(_part(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"), "/+$", "")
    query = _part(u, r"^[^?#]*\?([^#]*)")
    ours = (host == domain) | F.endswith(host, F.lit("." + domain))
    single = path.rlike(r"^/+[^/]+$") & ~path.rlike(r"^/+(?:share|reel|story\.php|photo\.php|groups)")
    return (F.when(~ours | (path == ""), "unknown").when(F.startswith(path, F.lit("/groups/")), "group").when(F.startswith(path, F.lit("/reel/")), "post")
            .when(F.contains(path, F.lit("/posts/")), "post").when(F.contains(path, F.lit("/story.php")) & F.contains(query, F.lit("story_fbid")), "post")
            .when(F.startswith(path, F.lit("/share/")), "post").when(F.contains(path, F.lit("/photo.php")) & F.contains(query, F.lit("fbid")), "post")
            .when(single, "page").otherwise("unknown"))


def url_post_id(url: Column | str) -> Column:
    found = [F.nullif(F.regexp_extract(as_column(url), p, 1), F.lit("")) for p in (r"/posts/(\d+)", r"story_fbid=(\d+)", r"/reel/(\d+)")]
    return F.coalesce(*found)


def is_login_wall(html: Column | str, least: int = 2) -> Column:
    """At least two marks of a login page; null is none."""
    low = F.lower(F.coalesce(as_column(html), F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in LOGIN_MARKS]) >= least


def is_captcha(html: Column | str) -> Column:
    low = F.lower(F.coalesce(as_column(html), F.lit("")))
    return reduce(or_, [F.contains(low, F.lit(m)) for m in CAPTCHA_MARKS])

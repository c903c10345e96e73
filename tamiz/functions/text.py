"""Text cleaning and scalar extraction as column expressions; nothing here leaves the JVM.

Null text gives the value of an empty text, as the docstrings say. Patterns use Unicode classes throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Noise patterns of posts, in the order in which they are removed, with what replaces them.
_NAME = r"[A-Z][\w\.\-áéíóúñÁÉÍÓÚüÜ]{1,30}"
_SITE = r"[A-Za-z0-9]{5,12}\.(?:com|net|org|io|co|info|biz|xyz|site|store|shop|me|to|app)"
POST_NOISE = [
    (r"^(?:Facebook\s*){2,}", ""),
    (r"^\s*+(?:[a-zA-Z0-9]\s*+){3,}+.*?·\s*", ""),  # possessive: long texts without the dot end at once
    (rf"\s*(?:\.{{3}}|…|·)?\s*Ver más\s+{_SITE}\s+{_NAME}\s+", " "),
    (rf"\s+(?:…|\.{{3}})?\s*{_SITE}\s+{_NAME}\s+", " "),
    (r"\s*(?:\.{3}|…|·)\s*Ver más\s+[^\s]+\s+[A-Z][a-zA-Z]*\s+", " "),
    (rf"\s*Ver más comentarios\s+{_NAME}(?:\s+{_NAME}){{0,2}}\s+(?=[A-Za-zÀ-ÿ])", " "),
    (r"(?:…|\.{3}|·)\s*Ver más\s*", " "),
    (r"\s+\d+\s+\d+\s+(?=Comentar\b)", " "),
    (r"\s*Comentar como\s+[A-Z][\w\.\-áéíóúñÁÉÍÓÚüÜ]+(?:\s+[A-Z][\w\.\-áéíóúñÁÉÍÓÚüÜ]+){0,3}\s+", " "),
    (r"\s+\b(?:Compartir|Enviar|Reportar)\b\s+", " "),
    (r"\s*r\s*n\s*a\s*0\s*o\s*i\s*l\s*m\s*\d+\s*\d+\s*\d+\s*(?:Facebook\s*){2,}\s*$", ""),
    (r"\s+(?:[a-zA-Z]\s+\d+\s+|\d+\s+[a-zA-Z]\s+){4,}(?:\d+\s+(?:Facebook\s*)+|\d+|\d+\s+\d+\s+\d+)\s*$", ""),
]
POST_NOISE_AFTER_TAIL = [
    (r"(?:Facebook\s*){2,}\s*$", ""),
    (r"(?:\s+[a-zA-Z0-9]){10,}\s*", " "),
    (r"\s*Compartido con:\s*P[úu]blico\s*", " "),
]
# What a comment's interface leaves at its end.
COMMENT_TAIL = r"\s+(\d+\s*(?:sem|min|h|días?|semanas?|horas?)(?:\s+y\s*medias?)?)\s+M?e\s+gusta\s+Responder\s*(Editado\s+)?(\d+)?\s*$"
COMMENT_BROKEN_TAILS = [r"\s+e\s+gusta\s+Responder\s*$", r"\s+e\s+gusta\s*$", r"\s+e\s+g\s*$"]
COMMENT_BUTTON = r"\s*Ver más (?:comentarios|respuestas)\s*"
COMMENT_AUTHOR = r"^(?:Fan\s+destacado\s+)?(?:[A-Z][\w\.\-áéíóúñÑÁÉÍÓÚüÜ]{1,30}\s+){0,3}(?=\S)"
# How comment texts are made comparable.
COMPARABLE = [
    ("(?iU)", r"^Fan destacado\s+", ""),
    ("(?U)", r"^(?:[A-ZÁÉÍÓÚÑÜ][a-zA-ZÀ-ÿ\-]+(?:\s+(?:de|del|la|las|los|y)\s+[a-zA-ZÀ-ÿ\-]+)?\s+){2,3}", ""),
    ("(?iuU)", r"\s+\d+\s*(?:min|h|d|s|m|sem|mes(?:es)?|año|anos)\b|\s+(?:[A-Za-zÁÉÍÓÚÑÜáéíóúñü]+\s+)?[Gg]usta\b|\s+[Rr]esponder(?:\s+\d+)?\s*$", ""),
    ("(?U)", r"^[^\w¿¡ÁÉÍÓÚÑÜáéíóúñü]+", ""),
    ("(?U)", r"[^\w.!?¿¡ÁÉÍÓÚÑÜáéíóúñü]+$", ""),
]
#: Latin letters with one accent, and the same without: what decomposition and dropping combining marks gives for them.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used: expressions are trees and would repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(as_column(text), r"(?U)^\s+|\s+$", "")


def replaced(text: Column, pattern: str, by: str = "", flags: str = "(?U)") -> Column:
    return F.regexp_replace(text, flags + pattern, by)


def without_accents(text: Column | str) -> Column:
    return F.translate(as_column(text), ACCENTED, PLAIN)


def single_spaced(text: Column) -> Column:
    return trimmed(replaced(text, r"\s+", " "))


def without_short_tail(text: Column, least: int = 7) -> Column:
    """Drop a run of `least` or more short tokens at the end, unless all tokens are short."""
    def cut(tokens: Column) -> Column:
        n = F.size(tokens)
        place = F.array_position(F.transform(F.reverse(tokens), lambda t: ~t.rlike(r"(?U)^(?:[a-zA-Z0-9]|\d{1,3}|Facebook)$")), True)
        return bound(F.when(place == 0, n).otherwise(place - 1).cast("int"),
                     lambda tail: F.when((n >= least) & (tail >= least) & (tail < n), replaced(F.array_join(F.slice(tokens, F.lit(1), n - tail), " "), r"\s+$")).otherwise(F.array_join(tokens, " ")))

    return bound(F.split(text, " "), cut)


def without_repeated_intro(text: Column) -> Column:
    """Collapse a first sentence (25 characters or more) that comes again, with what follows it both times."""
    pattern = r"(?U)^([^.!?…]{25,}[.!?…])\s+"
    spaced = lambda c: F.when(c != "", F.concat(F.lit(" "), c)).otherwise("")
    rest_of = lambda t, start: replaced(F.substring(t, start, F.lit(2147483647)), r"^\s+")

    def found(t: Column, x: Column) -> Column:
        intro, end, second = x["intro"], x["end"], x["second"]

        def parts(y: Column) -> Column:
            between, after = y["between"], y["after"]
            again = F.startswith(after, F.concat(between, F.lit(" "))) | (after == between)
            rest = F.when(again, rest_of(after, F.length(between) + 1)).otherwise(after)
            return F.when(between == "", F.concat(intro, spaced(after))).otherwise(F.concat(intro, F.lit(" "), between, spaced(rest)))

        pieces = F.struct(replaced(F.substring(t, end + 1, second - 1 - end), r"\s+$").alias("between"), rest_of(t, second + F.length(intro)).alias("after"))
        return F.when((F.length(t) >= 80) & (intro != "") & (second > 0), bound(pieces, parts)).otherwise(t)

    def located(t: Column, m: Column) -> Column:
        end = F.length(m["whole"])
        return bound(F.struct(m["intro"].alias("intro"), end.alias("end"), F.call_function("locate", m["intro"], t, end + 16).alias("second")), lambda x: found(t, x))

    return bound(text, lambda t: bound(F.struct(F.regexp_extract(t, pattern, 1).alias("intro"), F.regexp_extract(t, pattern, 0).alias("whole")), lambda m: located(t, m)))


def without_repeated_words(text: Column, longest: int = 4) -> Column:
    """A short word that repeats the one before it goes."""
    def keep(words: Column) -> Column:
        return F.array_join(F.filter(words, lambda w, i: (i == 0) | (F.length(w) > longest) | (w != F.element_at(words, F.greatest(i, F.lit(1)).cast("int")))), " ")

    return bound(F.split(text, " "), keep)


def clean_post(text: Column | str, author: Column | str | None = None) -> Column:
    """A post's text without interface noise; null and empty give ''."""
    t = F.coalesce(as_column(text), F.lit(""))
    for pattern, by in POST_NOISE:
        t = replaced(t, pattern, by)
    t = without_short_tail(t)
    for pattern, by in POST_NOISE_AFTER_TAIL:
        t = replaced(t, pattern, by)
    t = without_repeated_intro(t)
    if author is not None:
        a = F.coalesce(as_column(author), F.lit(""))
        named = (a != "") & (a != "Unknown")
        t = bound(t, lambda x: F.when(named & F.startswith(replaced(x, r"^\s+"), a), replaced(F.substring(replaced(x, r"^\s+"), F.length(a) + 1, F.lit(2147483647)), r"^\s+")).otherwise(x))
    return without_repeated_words(single_spaced(t))


def without_numbers(text: Column | str) -> Column:
    """Digits that are no part of a longer word go."""
    return replaced(F.coalesce(as_column(text), F.lit("")), r"\b\d+\b")


def clean_comment(text: Column | str, author: Column | str | None = None) -> Column:
    """struct(body, time_ago, responses) of a comment; null and empty give ('', null, 0)."""
    ignore = "(?iuU)"

    def parse(t: Column) -> Column:
        found = t.rlike(ignore + COMMENT_TAIL)
        body = F.when(found, replaced(replaced(t, COMMENT_TAIL, "", ignore), r"\s+$")).otherwise(t)
        for pattern in COMMENT_BROKEN_TAILS:
            body = replaced(body, pattern, "", ignore)
        body = without_numbers(replaced(body, COMMENT_BUTTON, " "))
        return F.struct(bound(body, named).alias("body"), F.when(found, F.regexp_extract(t, ignore + COMMENT_TAIL, 1)).alias("time_ago"),
                        F.coalesce(F.when(found, F.regexp_extract(t, ignore + COMMENT_TAIL, 3)).try_cast("int"), F.lit(0)).alias("responses"))

    def named(body: Column) -> Column:
        out = guess = replaced(body, COMMENT_AUTHOR)
        if author is not None:
            a, out = as_column(author), body
            for prefix in (F.concat(F.lit("Fan destacado "), a), a, F.concat(a, F.lit(" ")), F.concat(F.lit("Fan destacado "), a, F.lit(" "))):
                out = F.when(F.startswith(body, prefix), F.substring(body, F.length(prefix) + 1, F.lit(2147483647))).otherwise(out)
            out = F.when(F.coalesce(a, F.lit("")) != "", out).otherwise(guess)
        return single_spaced(out)

    return bound(trimmed(F.coalesce(as_column(text), F.lit(""))), parse)


def comparable(text: Column | str) -> Column:
    """The form in which comments are compared; null and empty give ''."""
    t = trimmed(F.coalesce(as_column(text), F.lit("")))
    for flags, pattern, by in COMPARABLE:
        t = replaced(t, pattern, by, flags)
    return F.lower(single_spaced(t))


def without_obfuscation(text: Column | str) -> Column:
    return trimmed(replaced(as_column(text), r"(?:\s+[a-zA-Z0-9]){10,}\s*", " "))


def letters_only(text: Column | str) -> Column:
    """Letters, digits and spaces."""
    return trimmed(F.regexp_replace(F.regexp_replace(as_column(text), r"(?U)\s", " "), r"[^\p{L}\p{Nd}\p{No} ]", ""))


def first_number(text: Column | str, patterns: list[str]) -> Column:
    """The first number that a pattern's first group finds, by the patterns' order; 0 if none."""
    return F.coalesce(*[F.regexp_replace(F.nullif(F.regexp_extract(as_column(text), p, 1), F.lit("")), "[.,]", "").try_cast("int") for p in patterns], F.lit(0))


def parsed_date(text: Column | str) -> Column:
    """A timestamp without zone from four formats, else null."""
    t = as_column(text)
    shaped = [("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$")]
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([+-]\d{2}:?\d{2}|Z)$"), F.substring(t, 1, 19))
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form))) for form, shape in shaped], F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ss"))).cast("timestamp_ntz")


def iso_time(text: Column | str) -> Column:
    """A timestamp without zone from an ISO text; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(as_column(text), "(Z|[+-]\\d{2}:\\d{2})$", "")).cast("timestamp_ntz")


def month_of(text: Column | str) -> Column:
    return F.coalesce(F.date_format(iso_time(text), "yyyy-MM"), F.lit("Sin fecha"))


def as_count(value: Column | str) -> Column:
    """A count: null, text that is no number, and negatives give 0."""
    return F.greatest(F.lit(0), F.coalesce(as_column(value).cast("string").try_cast("int"), F.lit(0)))


def as_truth(value: Column | str) -> Column:
    """Whether a text says yes; null doesn't."""
    return F.coalesce(F.lower(trimmed(as_column(value).cast("string"))).isin("true", "1", "yes", "si", "sí"), F.lit(False))


def as_number(value: Column | str) -> Column:
    return trimmed(as_column(value).cast("string")).try_cast("double")


def as_markers(value: Column | str) -> Column:
    """A list of markers from a JSON list or from text parted by commas; empty parts go, null gives an empty list."""
    v = trimmed(F.coalesce(as_column(value), F.lit("")))
    json = F.when(v.rlike(r"(?s)^\[.*\]$"), F.from_json(v, "array<string>"))
    return F.filter(F.coalesce(json, F.transform(F.split(v, ","), lambda m: F.trim(m))), lambda m: m.isNotNull() & (m != ""))


def plain_markdown(text: Column | str) -> Column:
    """Markdown without its marks, line by line; text in code fences stays as it is."""
    # Fences open and close in turn, so that every second part between fence lines is code.
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(as_column(text), F.lit("")), F.lit("\n")), r"\n[^\S\n]*```[^\n]*(?=\n)")

    def plain(part: Column) -> Column:
        p = F.regexp_replace(part, r"(?m)^[^\S\n]+|[^\S\n]+$", "")
        for pattern, by in [(r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}(.*?)\*{1,3}", "$1"), (r"_{1,3}(.*?)_{1,3}", "$1"), (r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]\n]+)\]\([^)\n]+\)", "$1"),
                            (r"(?m)^-{3,}$\n?", ""), (r"(?m)^>[^\S\n]+", "")]:
            p = F.regexp_replace(p, pattern, by)
        return p

    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, plain(p)).otherwise(p)), "")
    return readable(joined)


def readable(text: Column | str) -> Column:
    """Without control characters; single spaces, one blank line at most."""
    t = F.regexp_replace(as_column(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    return trimmed(F.regexp_replace(F.regexp_replace(t, " +", " "), r"\n{3,}", "\n\n"))


# Wrappers that models put around a reply.
REPLY_WRAPPERS = ["think", "tool_calls", "system-reminder"]


def reply_body(text: Column | str) -> Column:
    """A model's reply without fences, wrappers and tags, from its first brace to its last; all that is left where it has none. Null gives ''."""
    t = trimmed(F.coalesce(as_column(text), F.lit("")))
    for mark in ("^```json", "^```", r"```\z"):
        t = F.regexp_replace(t, mark, "")
    for tag in REPLY_WRAPPERS:
        t = F.regexp_replace(t, f"(?is)<{tag}>.*?</{tag}>", "")
    t = F.regexp_replace(t, "</?[^>]+>", "")
    return bound(t, lambda x: bound(F.regexp_extract(x, r"(?s)(\{.*\})", 1), lambda braces: trimmed(F.when(braces != "", braces).otherwise(x))))


def _after(text: Column, scope: str | None) -> Column:
    """What follows the first place of a scope; null if it has none."""
    if scope is None:
        return text
    at = F.locate(scope, text)
    return F.when(at > 0, F.substring(text, at + len(scope), F.lit(2147483647)))


def json_field(text: Column | str, key: str, scope: str | None = None) -> Column:
    """The first text value of a key in embedded JSON, decoded where it can be; null if the key isn't there. scope: only after its first place."""
    found = F.regexp_extract(_after(as_column(text), scope), rf'"{key}"\s*:\s*("(?:[^"\\]++|\\.)*+")', 1)
    raw = F.substring(found, 2, F.length(found) - 2)
    return F.when(found != "", F.coalesce(F.from_json(F.concat(F.lit('{"v":'), found, F.lit("}")), "v string")["v"], raw))


def json_int(text: Column | str, key: str, scope: str | None = None) -> Column:
    """The first whole number of a key in embedded JSON; null if there is none."""
    return F.regexp_extract(_after(as_column(text), scope), rf'"{key}"\s*:\s*(\d+)', 1).try_cast("long")


def engagement(*counts: Column | str) -> Column:
    total = F.lit(0)
    for c in counts:
        total = total + F.coalesce(as_column(c), F.lit(0))
    return total


def relative_time(seconds: Column | str) -> Column:
    """How long ago, in the widest unit that fits."""
    s = as_column(seconds)
    part = lambda n, name: F.concat(F.lit("hace "), F.floor(s / n).cast("string"), F.lit(name))
    return F.when(s < 60, F.lit("hace instantes")).when(s < 3600, part(60, " min")).when(s < 86400, part(3600, " h")).otherwise(part(86400, " d"))


def hashed_id(*parts: Column | str) -> Column:
    """16 hexadecimal digits of the md5 of the parts, joined by an underscore; null parts count as empty."""
    return F.substring(F.md5(F.concat_ws("_", *[F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts])), 1, 16)

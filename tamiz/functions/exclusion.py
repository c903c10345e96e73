"""The ordered cascade that tags what can't be classified; the first rule that applies decides."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, bound, letters_only, single_spaced, trimmed, without_accents
from .vocabulary import AGGRESSION, COMMON, GENDER_MARKERS, JUNK, LAUGHTER, REACTIONS, REACTIONS_SHORT, TAIL

# What counts as an address, a mention and a word.
URL_HOST = r"(?i)(https?://|www\.|t\.co/)"
FULL_URL = r"(?iU)https?://\S+|www\.\S+|t\.co/\S+"
MENTION = r"@[A-Za-zÁÉÍÓÚáéíóúÑñÜü0-9._-]+"
WORD = r"(?U)\b[A-Za-zÁÉÍÓÚáéíóúÑñÜü]{2,}\b"
LAUGHTER_REGEX = f"^(?:{'|'.join(LAUGHTER)}){TAIL}$"
REACTION_REGEX = f"^(?:(?:{'|'.join(REACTIONS)}){TAIL}|{'|'.join(REACTIONS_SHORT)})$"


#: (regex, condition) of the whole normalised text, in order.
PATTERNS = [(LAUGHTER_REGEX, "COND_4_SOLO_RISA"), (REACTION_REGEX, "COND_5_REACCION_CORTA")]


def short_code(norm: Column, patterns: list[tuple[str, str]]) -> Column:
    """The condition of the first pattern that a normalised text matches as a whole. Neighbours with one condition are one pattern."""
    out = F.lit(None).cast("string")
    for code, group in reversed([(k, [p for p, _ in g]) for k, g in groupby(patterns, key=lambda x: x[1])]):
        out = F.when(norm.rlike("^(?:" + "|".join(f"(?:{p})" for p in group) + r")\z"), code).otherwise(out)
    return out


def exclusion_code(text: Column | str, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """The condition's code, or null for text that can be classified. patterns: as rules.usable_patterns gives them."""
    t = as_column(text)
    body = trimmed(t)
    repeated = (F.length(body) >= 3) & body.rlike(r"(?s)^ *([^ ])(?: |\1)*$")
    only_url = t.rlike(URL_HOST) & ~F.regexp_replace(t, FULL_URL, " ").rlike(WORD)
    only_mention = body.rlike(MENTION) & ~F.regexp_replace(F.regexp_replace(body, FULL_URL, " "), MENTION, " ").rlike(WORD)
    word = F.lower(F.regexp_extract(letters_only(t), WORD, 0))
    lexical = F.size(F.filter(F.array_distinct(F.split(word, "")), lambda c: c != "")) >= 2
    norm = single_spaced(without_accents(F.lower(t)))
    return (F.when(t.isNull(), "COND_1_NA").when(body == "", "COND_1_VACIO").when(repeated, "COND_3_RUIDO_TIPOGRAFICO").when(only_url, "COND_2_ENLACE_HUERFANO")
            .when(only_mention, "COND_6_TAG_PERSONA").when(~lexical, "COND_3_RUIDO_TIPOGRAFICO").otherwise(short_code(norm, patterns)))


def exclusion(text: Column | str) -> Column:
    """struct(etiqueta, codigo) of the cascade; both null if the text passes."""
    code = exclusion_code(text)
    return F.struct(F.when(code.isNotNull(), JUNK).alias("etiqueta"), code.alias("codigo"))


def common_violence(text: Column | str, aggression: list[str] = AGGRESSION, markers: list[str] = GENDER_MARKERS) -> Column:
    """COMMON for aggression without any mark of gender, else null. Words match anywhere, accents are ignored."""
    norm = without_accents(F.lower(F.coalesce(as_column(text), F.lit(""))))
    has = lambda t, words: reduce(or_, [F.contains(t, F.lit(w)) for w in words], F.lit(False))
    return bound(norm, lambda t: F.when(~has(t, markers) & has(t, aggression), COMMON))

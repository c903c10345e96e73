"""The exclusion cascade and the keyword buckets in plain SQL, for the oracles."""

from __future__ import annotations

from tamiz.functions.exclusion import LAUGHTER_REGEX, REACTION_REGEX
from tamiz.functions.text import ACCENTED, PLAIN
from tamiz.functions.vocabulary import BUCKETS
from tamiz.operators.classify import plain

_SPACE = r"[\s\x{0B}\x{85}\p{Z}]"
_SOLID = r"[^\s\x{0B}\x{85}\p{Z}]"
_WORD_CHAR = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_LETTERS = "[A-Za-zÁÉÍÓÚáéíóúÑñÜü]{2,}"
#: A word between boundaries, which this engine knows for ASCII only.
_WORD = rf"(?:^|[^{_WORD_CHAR}])({_LETTERS})(?:$|[^{_WORD_CHAR}])"
_URL = rf"(?i)https?://{_SOLID}+|www\.{_SOLID}+|t\.co/{_SOLID}+"
_MENTION = r"@[A-Za-zÁÉÍÓÚáéíóúÑñÜü0-9._-]+"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def cascade(source: str, key: str, name: str = "casc") -> str:
    """CTEs that end in `name`(key, codigo): the code of every row of source(key, t)."""
    n = name
    return rf"""{n}1 as (select {key}, t, regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g') as body, regexp_replace(t, '{_URL}', ' ', 'g') as bare,
trim(regexp_replace(regexp_replace(t, '{_SPACE}', ' ', 'g'), '[^\p{{L}}\p{{Nd}}\p{{No}} ]', '', 'g')) as skeleton, trim(regexp_replace(translate(lower(t), '{ACCENTED}', '{PLAIN}'), '{_SPACE}+', ' ', 'g')) as norm from {source}),
{n}2 as (select *, lower(regexp_extract(skeleton, '{_WORD}', 1)) as word from {n}1),
{n} as (select {key}, case when t is null then 'COND_1_NA' when body = '' then 'COND_1_VACIO' when length(body) >= 3 and len(list_filter(list_distinct(string_split(body, '')), lambda c: c <> ' ')) = 1 then 'COND_3_RUIDO_TIPOGRAFICO'
when regexp_matches(t, '(?i)(https?://|www\.|t\.co/)') and not regexp_matches(bare, '{_WORD}') then 'COND_2_ENLACE_HUERFANO'
when regexp_matches(body, '{_MENTION}') and not regexp_matches(regexp_replace(regexp_replace(body, '{_URL}', ' ', 'g'), '{_MENTION}', ' ', 'g'), '{_WORD}') then 'COND_6_TAG_PERSONA'
when not (length(word) >= 2 and len(list_distinct(string_split(word, ''))) >= 2) then 'COND_3_RUIDO_TIPOGRAFICO'
when regexp_matches(norm, '{quoted(LAUGHTER_REGEX)}') then 'COND_4_SOLO_RISA' when regexp_matches(norm, '{quoted(REACTION_REGEX)}') then 'COND_5_REACCION_CORTA' end as codigo from {n}2)"""


def contains_any(words: list[str], column: str = "t") -> str:
    return "(" + " or ".join(f"contains({column}, '{quoted(w)}')" for w in words) + ")"


def keyword_hits(source: str, key: str) -> str:
    """A row (key, i, categoria, dimension, rank, score, bucket) for every bucket that source(key, t), t without accents and case, hits."""
    rows = []
    for i, (name, cat, dim, sev, score, words, context) in enumerate(BUCKETS):
        need = f" and {contains_any(plain(context))}" if context else ""
        rows.append(f"select {key}, {i} as i, '{cat}' as categoria, '{dim}' as dimension, {({'baja': 1, 'media': 2, 'alta': 3})[sev]} as rank, {score} as score, '{name}' as bucket from {source} where {contains_any(plain(words))}{need}")
    return " union all ".join(rows)

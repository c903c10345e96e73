"""Rules as data: the taxonomy from its front matter, glossaries and patterns from Markdown, keyword buckets from a table; all checked before use.

Rules are small and go to every task as part of the plan. What bounds them is checked: more than `most` rows are refused.
"""

from __future__ import annotations

import logging
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions.labels import severity
from tamiz.functions.text import single_spaced, trimmed, without_accents
from tamiz.functions.vocabulary import CATEGORIES

# The severity ranges a category may have, and how many sub-dimensions the categories have in order.
SEVERITY_RANGES = ["baja", "baja-media", "media", "media-alta", "alta", "alta-extrema", "extrema", "ortogonal"]
DIMENSION_COUNTS = [3, 3, 3, 4, 3, 3]
# The conditions that a pattern of a glossary may name; the first stands for all others.
PATTERN_CODES = ["COND_4_SOLO_RISA", "COND_5_REACCION_CORTA"]
MOST = 10_000


class FormatError(ValueError):
    """A rules file that can't be read."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


# Front matter


def _scalar(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def front_matter(text: str) -> dict:
    """The mapping between a text's first two lines of three dashes: scalars, mappings and lists of mappings, by indentation.

    For configuration files of a few hundred lines.
    """
    found = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", text, re.S)
    if not found:
        raise FormatError("no front matter between lines of three dashes at the start")
    # (indent, text, number of the line); an item's dash counts as two spaces before its first key.
    lines = [(len(x) - len(x.lstrip()), x.strip(), n) for n, x in enumerate(found[1].split("\n"), 2) if x.strip()]

    def value(at: int, indent: int):
        return items(at, indent) if lines[at][1].startswith("-") else mapping(at, indent)

    def items(at: int, indent: int):
        out = []
        while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
            own = lines[at][1][1:]
            inner = indent + 1 + len(own) - len(own.lstrip())
            lines[at] = (inner, own.strip(), lines[at][2])
            item, at = mapping(at, inner)
            out.append(item)
        return out, at

    def mapping(at: int, indent: int):
        out = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("-"):
            key, colon, rest = lines[at][1].partition(":")
            if not colon or not key.strip():
                raise FormatError(f"line {lines[at][2]}: a key and a colon were expected: {lines[at][1]!r}")
            if rest.strip():
                out[key.strip()], at = _scalar(rest.strip()), at + 1
            elif at + 1 < len(lines) and lines[at + 1][0] > indent:
                out[key.strip()], at = value(at + 1, lines[at + 1][0])
            else:
                raise FormatError(f"line {lines[at][2]}: nothing stands below {key.strip()!r}")
        if at < len(lines) and lines[at][0] > indent:
            raise FormatError(f"line {lines[at][2]}: unexpected indentation")
        return out, at

    out, at = mapping(0, 0) if lines else ({}, 0)
    if not out or at < len(lines):
        raise FormatError(f"line {lines[at][2]}: what stands here belongs to no key" if at < len(lines) else "empty front matter")
    return out


class Taxonomy(NamedTuple):
    """dimensions: categoria, label, orden, gravedad, dimension, descripcion, pos. exclusions: code, codigo_canonico, descripcion. markers: dimension, marcador. overlaps: dimension, marcador, secundaria."""

    dimensions: DataFrame
    exclusions: DataFrame
    markers: DataFrame
    overlaps: DataFrame


def taxonomy_of(spark: SparkSession, text: str) -> Taxonomy:
    """The taxonomy that a Markdown text's front matter declares; ValueError with all that is wrong with it."""
    raw = front_matter(text)
    dims, markers, overlaps = [], [], []
    for c in raw.get("categorias") or []:
        for d in c.get("subdimensiones") or [{}]:
            dims.append((str(c.get("code", "")).strip(), str(c.get("label") or c.get("code", "")).strip(), c.get("orden") if isinstance(c.get("orden"), int) else None, str(c.get("gravedad", "")).strip().lower(), str(d.get("code", "")).strip(), str(d.get("descripcion", "")).strip(), len(dims)))
            markers += [(dims[-1][4], str(m.get("marker", ""))) for m in d.get("marcadores_canonicos") or []]
            overlaps += [(dims[-1][4], str(m.get("marker", "")), str(m.get("subdim_secundaria", ""))) for m in d.get("marcadores_overlap") or []]
    excluded = [(str(e.get("code", "")).strip(), str(e.get("codigo_canonico", "")).strip(), str(e.get("descripcion", ""))) for e in raw.get("categorias_exclusion") or []]
    out = Taxonomy(spark.createDataFrame(dims, "categoria string, label string, orden int, gravedad string, dimension string, descripcion string, pos int"), spark.createDataFrame(excluded, "code string, codigo_canonico string, descripcion string"),
                   spark.createDataFrame(markers, "dimension string, marcador string"), spark.createDataFrame(overlaps, "dimension string, marcador string, secundaria string"))
    wrong = [r["problem"] for r in problems(out.dimensions, out.exclusions).limit(50).collect()]
    if wrong:
        raise ValueError("the taxonomy is not valid: " + "; ".join(sorted(wrong)))
    return out


def taxonomy(spark: SparkSession, path: str) -> Taxonomy:
    rows = files(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise FormatError(f"{path} names {len(rows) or 'no'} files; a taxonomy is one")
    return taxonomy_of(spark, rows[0]["content"])


def problems(dims: DataFrame, excluded: DataFrame) -> DataFrame:
    """problem: every way in which taxonomy rows break the rules of a closed taxonomy; no rows if it is fine."""
    say = lambda df, when, *text: df.where(when).select(F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in text]).alias("problem"))
    cats = dims.groupBy("categoria").agg(F.countDistinct("orden", "gravedad").alias("heads"), F.min("orden").alias("orden"), F.first("gravedad").alias("gravedad"), F.sort_array(F.collect_list(F.struct("pos", "dimension"))).alias("l"))
    cats = cats.withColumns({"dims": F.transform("l", lambda x: x["dimension"]), "wanted": F.element_at(F.array(*map(F.lit, DIMENSION_COUNTS)), F.when(F.col("orden").between(1, len(DIMENSION_COUNTS)), F.col("orden")).otherwise(1))})
    right = F.transform(F.sequence(F.lit(1), "wanted"), lambda i: F.concat(F.col("orden").cast("string"), F.lit("."), i.cast("string")))
    whole = dims.groupBy().agg(F.countDistinct("categoria").alias("n"), F.sort_array(F.collect_set("orden")).alias("orders"))
    order = dims.groupBy("categoria").agg(F.min("pos").alias("pos"), F.min("orden").alias("orden")).withColumn("before", F.lag("orden").over(Window.orderBy("pos")))  # six rows
    c = F.col("categoria")
    return (say(whole, F.col("n") != len(DIMENSION_COUNTS), F.col("n").cast("string"), f" categories, not {len(DIMENSION_COUNTS)}")
            .unionByName(say(whole, F.col("orders") != F.sequence(F.lit(1), F.lit(len(DIMENSION_COUNTS))), "orders are ", F.array_join("orders", ",")))
            .unionByName(say(order, F.col("before") >= F.col("orden"), c, ": out of order"))
            .unionByName(say(cats, ~c.startswith("VDG_"), c, ": a code starts with VDG_"))
            .unionByName(say(cats, (F.col("heads") != 1) | F.col("orden").isNull(), c, ": one order and one severity are needed"))
            .unionByName(say(cats, ~F.col("gravedad").isin(SEVERITY_RANGES), c, ": unknown severity ", F.col("gravedad")))
            .unionByName(say(cats, F.coalesce(F.col("dims") != right, F.lit(True)), c, ": sub-dimensions are ", F.array_join("dims", ",")))
            .unionByName(say(dims, F.col("descripcion") == "", F.col("dimension"), ": no description"))
            .unionByName(say(dims.groupBy("dimension").count(), F.col("count") > 1, F.col("dimension"), ": twice"))
            .unionByName(say(excluded, ~F.col("code").startswith("EXC_"), F.col("code"), ": an exclusion starts with EXC_"))
            .unionByName(say(excluded, ~F.col("codigo_canonico").rlike("^[A-Za-z0-9]+(?:_+[A-Za-z0-9]+)*$"), F.col("code"), ": no canonical code"))
            .unionByName(say(excluded.groupBy("code").count(), F.col("count") > 1, F.col("code"), ": twice"))
            .unionByName(say(excluded.groupBy("codigo_canonico").count(), F.col("count") > 1, F.col("codigo_canonico"), ": twice")))


def category_views(dims: DataFrame) -> DataFrame:
    """A row a category, in order: categoria, orden, label, gravedad, dimensiones (a list in order)."""
    return dims.groupBy("categoria", "orden", "label", "gravedad").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dimension"))), lambda x: x["dimension"]).alias("dimensiones")).orderBy("orden")


def misaligned(dims: DataFrame) -> DataFrame:
    """categoria, dimension and side ('missing' or 'extra') of what a scanned taxonomy hasn't, or has beyond, what labels are checked by."""
    spark = dims.sparkSession
    known = spark.createDataFrame([(c, d) for c, _, _, ds in CATEGORIES for d, _ in ds], "categoria string, dimension string")
    own = dims.select("categoria", "dimension")
    return known.subtract(own).withColumn("side", F.lit("missing")).unionByName(own.subtract(known).withColumn("side", F.lit("extra")))


def drifted(documents: DataFrame, markers: DataFrame, overlaps: DataFrame) -> DataFrame:
    """path, marcador, narrada, canonica: markers that a narrative document gives to another sub-dimension than the taxonomy does, and that are no declared overlap.

    documents: path, content. A document gives a marker in backquotes to a sub-dimension by an arrow.
    """
    plain = lambda c: single_spaced(without_accents(F.lower(c)))
    pattern = r"`([^`]+?)`\s*→\s*\*?\*?(\d\.\d)\*?\*?"
    said = documents.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("m"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("d"))).alias("x"))
    said = said.select("path", F.col("x.m").alias("marcador"), F.col("x.d").alias("narrada")).withColumn("_m", plain("marcador"))
    canon = markers.groupBy(plain("marcador").alias("_k")).agg(F.max("dimension").alias("canonica"))
    declared = overlaps.select(plain("marcador").alias("_o"), F.col("secundaria").alias("_s"))
    return (said.join(canon, F.col("_m") == F.col("_k")).where("narrada <> canonica").join(declared, (F.col("_m") == F.col("_o")) & (F.col("narrada") == F.col("_s")), "left_anti")
            .select("path", "marcador", "narrada", "canonica"))


# Glossaries


def fenced_lines(documents: DataFrame) -> DataFrame:
    """path, n, line: the lines of the first fenced block of every document(path, content), without blanks and remarks."""
    block = F.regexp_extract("content", r"(?s)```[^\n]*\n(.*?)```", 1)
    lines = documents.select("path", F.posexplode(F.split(block, "\n")).alias("n", "line")).withColumn("line", trimmed("line"))
    return lines.where("line <> '' and not startswith(line, '#')")


def glossary(documents: DataFrame) -> DataFrame:
    """path, token: the words of every document's glossary, in lower case and each once."""
    token = trimmed(F.regexp_replace(F.col("line"), "^`+|`+$", ""))
    return fenced_lines(documents).select("path", F.lower(token).alias("token")).where("token <> ''").distinct()


def patterns(documents: DataFrame) -> DataFrame:
    """path, n, regex, codigo: the patterns of every document's glossary in order; what stands behind # names the condition."""
    parts = F.split("line", "#", 2)
    code = trimmed(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    return fenced_lines(documents).select("path", "n", trimmed(parts[0]).alias("regex"), F.when(code.isin(PATTERN_CODES), code).otherwise(PATTERN_CODES[0]).alias("codigo"))


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules; what goes into every task's plan has to be small")
    return rows


def words_of(tokens: DataFrame, most: int = MOST) -> list[str]:
    """The tokens as a list, for operators that look for words."""
    return sorted(r["token"] for r in _bounded(tokens.select("token").distinct(), most))


def usable_patterns(found: DataFrame, most: int = MOST) -> list[tuple[str, str]]:
    """(regex, codigo) in order, for the cascade. Patterns that Spark's engine doesn't take are left out, with a warning."""
    compile_ = found.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile
    out = []
    for r in _bounded(found.orderBy("path", "n"), most):
        try:
            compile_(r["regex"])
        except Exception as e:
            logging.getLogger(__name__).warning("pattern left out: %r (%s)", r["regex"], type(e).__name__)
            continue
        out.append((r["regex"], r["codigo"]))
    return out


# Keyword buckets


def buckets_of(table: DataFrame, dims: DataFrame, most: int = MOST) -> list[tuple]:
    """Keyword buckets for the rule classifier from table(pos, name, categoria, dimension, severidad, score, words, context), checked against a taxonomy's dimensions.

    A bucket needs a pair of category and sub-dimension that the taxonomy has, a severity and at least one word; ValueError names those that lack it.
    """
    pair = dims.select(F.col("categoria").alias("_c"), F.col("dimension").alias("_d"))
    checked = table.join(F.broadcast(pair), (F.col("categoria") == F.col("_c")) & (F.col("dimension") == F.col("_d")), "left")
    checked = checked.withColumn("bad", F.col("_c").isNull() | (severity("severidad") != F.col("severidad")) | (F.coalesce(F.size("words"), F.lit(0)) < 1) | F.col("score").isNull())
    rows = sorted(_bounded(checked.select("pos", "name", "categoria", "dimension", "severidad", "score", "words", "context", "bad"), most), key=lambda r: r["pos"])
    if bad := [r["name"] for r in rows if r["bad"] is not False]:
        raise ValueError(f"buckets that the taxonomy or the rules don't take: {', '.join(map(str, bad))}")
    return [(r["name"], r["categoria"], r["dimension"], r["severidad"], r["score"], list(r["words"]), list(r["context"] or [])) for r in rows]

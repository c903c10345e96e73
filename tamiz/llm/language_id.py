"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Text: hashed byte n-gram frequencies of each declared language (multinomial; rare languages back off to all languages'
pooled frequencies), fitted on a bounded number of rows a language, against a background that is no language: n-grams nearly as frequent as one another. Declared language and
address suffix weigh by how often they are right, counted in a grouped aggregation over all rows. Host priors are
smoothed hierarchically: all rows, then the registered domain, then the host, each level's counts shrunk to the level
above. What the counts come from is the text evidence alone, so that no evidence is used twice.

The model has one row of 65,536 numbers for each declared language that has rows; it goes to every worker, at 256 kB a language.
Of languages equally likely the first by name is given.

A document is rejected if the background is likelier than its language by more than a margin, or no language reaches
`least` of the posterior.

Null and empty texts, and texts without letters, are rejected with language null; the other evidence alone decides for
texts too short for an n-gram. A null declared language, suffix or
host is no evidence. Repeated rows count each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, read, stored, texts_of

BUCKETS = 1 << 16
GRAM = 4
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class TextModel:
    languages: list[str]
    scores: np.ndarray  # languages x buckets: log frequency over the background's


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram of bytes that starts at each place; A-Z in lower case, all but letters as one space."""
    low = np.where(LETTER[data], LOWER[data], np.uint8(32)).astype(np.uint32)
    if len(low) < GRAM:
        return np.zeros(0, np.int64)
    acc = low[: len(low) - GRAM + 1].copy()
    for i in range(1, GRAM):
        acc = (acc << np.uint32(8)) | low[i:len(low) - GRAM + 1 + i]
    return ((acc * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def fit_text(docs: DataFrame, declared: str, most_rows: int = 2000) -> TextModel:
    """Frequencies from at most `most_rows` rows of each declared language, those smallest by a hash of doc_id.

    Every declared language that has rows is modelled. Counting is a Spark aggregation; the driver gets the number of rows
    of each language, and one count for each language and bucket.
    """
    total = {r[0]: r["count"] for r in docs.where(F.col(declared).isNotNull()).groupBy(declared).count().collect()}
    names = sorted(total)
    if not names:
        return TextModel([], np.zeros((0, BUCKETS), np.float32))
    # Rows below a hash bound that leaves about most_rows of each language: no sort of texts is needed.
    large = [x for n in names if total[n] > most_rows for x in (F.lit(n), F.lit(most_rows / total[n]))]
    chosen = docs.where(F.col(declared).isNotNull())
    if large:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(F.create_map(*large)[F.col(declared)], F.lit(1.0)) * (1 << 30))
    row = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch)
            lang = np.array([row[name] for name in batch.column("tag").to_pylist()], np.int64)
            for i, j in blocks(off, 1 << 20):
                g, at = grams(data[off[i]:off[j]]), off[i:j + 1] - off[i]
                doc = np.repeat(np.arange(j - i), np.diff(at))[: len(g)]
                inside = np.arange(len(g)) + GRAM <= at[doc + 1]
                code, n = np.unique(lang[i + doc[inside]] * BUCKETS + g[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((code // BUCKETS).astype(np.int32)), pa.array((code % BUCKETS).astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    got = (chosen.select("text", F.col(declared).alias("tag")).mapInArrow(count, "lang int, bucket int, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    sums = np.zeros((len(names), BUCKETS))
    np.add.at(sums, (got["lang"].to_numpy(), got["bucket"].to_numpy()), got["n"].to_numpy())
    frequency = smoothed(sums)
    background = background_frequency(frequency.mean(axis=0))
    return TextModel(names, np.log(frequency / background).astype(np.float32))


def smoothed(sums: np.ndarray) -> np.ndarray:
    """Frequencies of buckets in each language, backed off to all languages' pooled ones.

    The weight of the pooled frequencies is the number of different buckets a language shows (Witten and Bell): about half
    for one short text, next to nothing for thousands. Chance has the same share in each language, that of half a count a
    bucket in the largest: a small language is no nearer to chance than a large one, so it doesn't take in what is none.
    """
    pooled = sums.sum(axis=0) + 0.5
    pooled /= pooled.sum()
    n = sums.sum(axis=1, keepdims=True)
    kinds = np.maximum(1, (sums > 0).sum(axis=1, keepdims=True))
    chance = 0.5 * n / max(1.0, n.max())
    return (sums + kinds * pooled + chance) / (np.maximum(1, n) + kinds + chance * BUCKETS)


def background_frequency(mean: np.ndarray) -> np.ndarray:
    """Frequencies of buckets halfway between chance and the languages' mean flattened towards it; they sum to 1."""
    between = np.sqrt(mean * mean.mean())
    return 0.5 * mean.mean() + 0.5 * between / between.sum()


def text_evidence(docs: DataFrame, model: TextModel, keep: list[str], tempered: float = 60.0) -> DataFrame:
    """The columns of keep, and ev: for each language the log likelihood over the background; p: what the text alone makes of the languages.

    Both are null for texts without letters; ev is 0 for texts too short for an n-gram.

    Neighbouring n-grams overlap and words recur: evidence is the mean over n-grams times at most `tempered` of them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    inner = [f for f in docs.select(*keep).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner] + ["ev array<double>", "p array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.scores.T)
        for batch in batches:
            data, off = texts_of(batch)
            out, alone = [], []
            for i, j in blocks(off, 1 << 20):
                part, at = data[off[i]:off[j]], off[i:j + 1] - off[i]
                letters = np.r_[0, np.cumsum(LETTER[part])]
                some = letters[at[1:]] > letters[at[:-1]]
                g = grams(part)
                # An n-gram counts for the document it starts in, if it ends there too and holds a letter.
                place = np.arange(len(g))
                doc = np.repeat(np.arange(j - i), np.diff(at))[: len(g)]
                fine = (place + GRAM <= at[doc + 1]) & (letters[place + GRAM] - letters[place] > 1)
                place, doc = place[fine], doc[fine]
                n = np.bincount(doc, minlength=j - i)
                sums = np.stack([np.bincount(doc, table[g[place], k], j - i) for k in range(table.shape[1])], 1)
                ev = sums / np.maximum(n, 1)[:, None] * np.minimum(n, tempered)[:, None]
                out.append(lists(ev, some))
                alone.append(lists(softmax(ev), some))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.concat_arrays(x) if x else pa.array([], kind) for x in (out, alone))], [*keep, "ev", "p"])

    return docs.select("text", *keep).mapInArrow(run, schema)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; null where some says no."""
    at = np.r_[0, np.cumsum(np.where(some, rows.shape[1], 0))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows[some].reshape(-1)), mask=pa.array(~some))


def dense(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x n, zero where null; which aren't null) of a column of lists."""
    some = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), n))
    out[some] = column.filter(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out, some


def identify(docs: DataFrame, declared: str | None = "lang", suffix: str | None = None, host: str | None = None, domain: str | None = None,
             least: float = 0.5, margin: float = 12.0, strength: float = 20.0, most_rows: int = 2000, model: TextModel | None = None, key: str = "doc_id") -> DataFrame:
    """key, declared, language, posterior, text_language, accepted for every row of docs(key, text, evidence columns).

    declared, suffix, host, domain: names of evidence columns, or None. domain is the level above host.
    """
    base = docs.select(F.col(key).alias("doc_id"), "text", *[(F.col(c) if c else F.lit(None)).cast("string").alias(a) for c, a in ((declared, "declared"), (suffix, "suffix"), (host, "host"), (domain, "domain"))])
    model = model or fit_text(base, "declared", most_rows)
    n = len(model.languages)
    if not n:
        return base.select("doc_id", "declared", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    names = np.array(model.languages, object)
    seen = stored(text_evidence(base, model, ["doc_id", "declared", "suffix", "host", "domain"]))
    known = seen.where("p is not null")

    def per(column: str) -> DataFrame:
        """Expected number of rows of each language for each value of a column: sums as rows, then one list a value."""
        sums = known.where(F.col(column).isNotNull()).select(column, F.posexplode("p").alias("k", "x")).groupBy(column, "k").agg(F.sum("x").alias("x"))
        return sums.groupBy(F.col(column).alias(f"k_{column}")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(f"n_{column}"))

    overall = np.zeros(n)
    for r in known.select(F.posexplode("p").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        overall[r["k"]] = r["x"]
    prior = (overall + 1.0) / (overall.sum() + n)
    # Values of a column may repeat without bound: the joins are on grouped sums, and Spark may split them.
    row, given = seen, [c for c, there in (("declared", declared), ("suffix", suffix), ("domain", domain), ("host", host)) if there]
    for column in given:
        row = row.join(per(column), F.col(column) == F.col(f"k_{column}"), "left").drop(f"k_{column}")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                ev, some = dense(part.column("ev"), n)
                p, _ = dense(part.column("p"), n)

                def shrunk(column: str, parent: np.ndarray, part: pa.RecordBatch = part, p: np.ndarray = p) -> np.ndarray:
                    """Counts plus `strength` rows of the level above, without this row's own: its text is evidence already."""
                    counts, there = dense(part.column(f"n_{column}"), n)
                    own = np.maximum(0.0, counts - np.where(there[:, None], p, 0.0))
                    return (own + strength * parent) / (own.sum(axis=1, keepdims=True) + strength)

                at = np.broadcast_to(prior, ev.shape)
                for column in ("domain", "host"):
                    if column in given:
                        at = shrunk(column, at)
                evidence = ev + np.log(at)
                for column in ("declared", "suffix"):
                    if column in given:
                        # log P(value | language), up to a constant: P(language | value) over the prior.
                        evidence += np.log(shrunk(column, prior) / prior)
                post = softmax(evidence)
                best = post.argmax(axis=1)  # the first by name of equal ones
                each = np.arange(len(best))
                most = post[each, best]
                fine = some & (ev[each, best] > -margin) & (most >= least)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("declared"), pa.array(np.where(some, names[best], None), pa.string()), pa.array(most, mask=~some), pa.array(np.where(some, names[ev.argmax(axis=1)], None), pa.string()), pa.array(fine)],
                                                 ["doc_id", "declared", "language", "posterior", "text_language", "accepted"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return row.select("doc_id", "declared", "ev", "p", *[f"n_{c}" for c in given]).mapInArrow(fuse, f"doc_id {kind}, declared string, language string, posterior double, text_language string, accepted boolean")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared (markup language), suffix, host, domain of pages(page_id, url, html)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    lang = F.lower(F.regexp_extract("html", r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    some = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), some(lang).alias("declared"), some(F.regexp_extract(host, r"\.([a-z]{2,})$", 1)).alias("suffix"),
                        some(host).alias("host"), some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the web pages, with all kinds of evidence."""
    pages = page_evidence(read(spark, sf_dir, "pages"))
    return identify(pages, "declared", "suffix", "host", "domain", key="page_id").withColumnRenamed("doc_id", "page_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare a language in `lang`; `source` is their host."""
    return identify(read(spark, sf_dir, "documents"), declared="lang", host="source")

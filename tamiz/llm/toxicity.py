"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals add up to document scores.

Tokens are runs of letters, digits and bytes above 127, A-Z in lower case, hashed with their neighbours. The field has
two tags. Forward and backward passes run over many documents at once: the chain is cut into blocks whose 2 x 2 transfer
matrices are composed side by side, then joined, so that the marginals are exact for texts of any length.

Labelled tokens come as spans, or are derived from labelled documents (label_tokens): a word is toxic in toxic documents
if nearly all families of near-copies that hold it are toxic. Training uses a bounded number of labelled rows; scoring
reads every whole text. Labels, language, source and doc_id are no inputs of a score.

Null and empty texts have no tokens and get the lowest score. Without labelled rows of both kinds every score is 0.5, so
that nothing is marked. Rows without label are scored all the same. Repeated rows are scored each. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, mixed, read, rolled, texts_of, word_bounds, word_hashes

BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
WORDS, STEMS, NEXT = 1 << 20, 1 << 18, 1 << 16
STEM_BYTES = 7
FLOOR = -12.0


@dataclass
class Field:
    """Weights: of the word, of its first bytes, of its neighbours, of the tags' order (2 x 2), of a first tag; then of the document's score."""

    word: np.ndarray
    stem: np.ndarray
    before: np.ndarray
    after: np.ndarray
    order: np.ndarray
    first: float
    score: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        return cls(np.zeros(WORDS, np.float32), np.zeros(STEMS, np.float32), np.zeros(NEXT, np.float32), np.zeros(NEXT, np.float32), np.zeros((2, 2)), -2.0, np.zeros(3))


@dataclass
class Tokens:
    word: np.ndarray
    stem: np.ndarray
    before: np.ndarray
    after: np.ndarray
    first: np.ndarray  # index of each document's first token, and the number of tokens
    starts: np.ndarray
    ends: np.ndarray
    hash: np.ndarray
    stem_hash: np.ndarray


def tokens(data: np.ndarray, off: np.ndarray) -> Tokens:
    low = LOWER[data]
    starts, ends, first = word_bounds(low, off, BREAK)
    h = word_hashes(low, starts, ends)
    stem = word_hashes(low, starts, np.minimum(ends, starts + STEM_BYTES))
    near = ((h >> np.uint64(40)) & np.uint64(NEXT - 1)).astype(np.int32)
    before, after = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
    before[1:], after[:-1] = near[:-1], near[1:]
    some = first[1:] > first[:-1]
    before[first[:-1][some]] = 0
    after[first[1:][some] - 1] = 0
    return Tokens((h & np.uint64(WORDS - 1)).astype(np.int32), (stem & np.uint64(STEMS - 1)).astype(np.int32), before, after, first, starts, ends, h, stem)


def ratios(u: np.ndarray, begins: np.ndarray, order: np.ndarray, first: float) -> np.ndarray:
    """alpha(1) / alpha(0) at every token of a chain that starts anew where `begins`; u: log potential of tag 1 over tag 0."""
    n = len(u)
    if not n:
        return np.zeros(0)
    a = np.exp(order - order.max())
    steps = max(1, int(np.sqrt(n)))
    wide = -(-n // steps)
    e = np.zeros(steps * wide)
    e[:n] = np.clip(u, -30, 30)
    e = np.exp(e).reshape(wide, steps).T.copy()
    new = np.zeros(steps * wide, bool)
    new[:n] = begins
    new = new.reshape(wide, steps).T.copy()
    start = np.exp(np.clip(first, -30, 30))
    # The transfer of each block: how (alpha(0), alpha(1)) before it become those after it.
    m00, m01, m10, m11 = np.ones(wide), np.zeros(wide), np.zeros(wide), np.ones(wide)
    for t in range(steps):
        x, y, z, w = m00 * a[0, 0] + m01 * a[1, 0], (m00 * a[0, 1] + m01 * a[1, 1]) * e[t], m10 * a[0, 0] + m11 * a[1, 0], (m10 * a[0, 1] + m11 * a[1, 1]) * e[t]
        if (some := new[t]).any():
            x, z = np.where(some, 1.0, x), np.where(some, 1.0, z)
            y, w = np.where(some, start * e[t], y), np.where(some, start * e[t], w)
        scale = 1 / np.maximum(np.maximum(x, y), np.maximum(z, w))
        m00, m01, m10, m11 = x * scale, y * scale, z * scale, w * scale
    enter = np.zeros(wide)
    p, q = 1.0, 0.0
    for b, (x, y, z, w) in enumerate(zip(m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist(), strict=True)):
        enter[b] = q / p if p > 0 else 1e30
        p, q = p * x + q * z, p * y + q * w
        s = p + q or 1.0
        p, q = p / s, q / s
    out = np.empty((steps, wide))
    r = np.minimum(enter, 1e30)
    for t in range(steps):
        r = e[t] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
        r = np.where(new[t], start * e[t], r)
        out[t] = r
    return out.T.reshape(-1)[:n]


def marginals(field: Field, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log odds of tag 1, log potential, forward ratio, backward ratio with the token's own potential)."""
    u = np.clip(field.word[t.word] + field.stem[t.stem] + field.before[t.before] + field.after[t.after], -30, 30).astype(float)
    begins, ends = np.zeros(len(u), bool), np.zeros(len(u), bool)
    some = t.first[1:] > t.first[:-1]
    begins[t.first[:-1][some]] = True
    ends[t.first[1:][some] - 1] = True
    forward = ratios(u, begins, field.order, field.first)
    backward = ratios(u[::-1], ends[::-1], field.order.T, 0.0)[::-1]
    tiny = 1e-300
    return np.log(np.maximum(forward, tiny)) + np.log(np.maximum(backward, tiny)) - u, u, forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(t: Tokens, tags: np.ndarray, rounds: int = 25, rate: float = 0.5, decay: float = 1e-3, neighbour_decay: float = 2.0) -> Field:
    """Penalised likelihood by adaptive gradient steps; expected counts are those of the forward and backward passes.

    Neighbours weigh only where they recur, else rare ones would learn the training texts by heart."""
    field = Field.empty()
    squares = [np.full(x.shape, 1e-8) for x in (field.word, field.stem, field.before, field.after, field.order)]
    square = 1e-8
    y = tags.astype(float)
    begins = np.zeros(len(y), bool)
    begins[t.first[:-1][t.first[1:] > t.first[:-1]]] = True
    later = np.flatnonzero(~begins)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[later - 1].astype(int), tags[later].astype(int)), 1)
    for _ in range(rounds):
        odds, u, forward, backward = marginals(field, t)
        miss = y - _sigmoid(odds)
        # Expected pairs: alpha(i) order(i, j) e_j beta_j, normalised for each token; in parts, to hold few arrays.
        a, expected = np.exp(field.order), np.zeros((2, 2))
        for part in np.array_split(later, max(1, len(later) >> 19)):
            f, b = forward[part - 1], backward[part]
            z = 1 / (a[0, 0] + a[0, 1] * b + a[1, 0] * f + a[1, 1] * f * b)
            expected += [[a[0, 0] * z.sum(), a[0, 1] * (b * z).sum()], [a[1, 0] * (f * z).sum(), a[1, 1] * (f * b * z).sum()]]
        del odds, u, forward, backward
        grads = [np.bincount(t.word, miss, WORDS), np.bincount(t.stem, miss, STEMS), np.bincount(t.before, miss, NEXT), np.bincount(t.after, miss, NEXT), seen - expected]
        for k, (name, g) in enumerate(zip(("word", "stem", "before", "after", "order"), grads, strict=True)):
            value = getattr(field, name)
            g = g - (neighbour_decay if name in ("before", "after") else decay) * value
            squares[k] = squares[k] + g * g
            setattr(field, name, (value + rate * g / np.sqrt(squares[k])).astype(value.dtype))
        g = float(miss[begins].sum())
        square += g * g
        field.first += rate * g / square**0.5
    return field


def summaries(field: Field, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds of each token, highest of each document, expected number of toxic tokens of each document)."""
    odds = marginals(field, t)[0]
    n = len(t.first) - 1
    most, total = np.full(n, FLOOR), np.zeros(n)
    some = t.first[1:] > t.first[:-1]
    if some.any():
        at = t.first[:-1][some]
        most[some] = np.clip(np.maximum.reduceat(odds, at), FLOOR, -FLOOR)
        total[some] = np.add.reduceat(_sigmoid(odds), at)
    return odds, most, total


def fit_score(most: np.ndarray, total: np.ndarray, toxic: np.ndarray, base: float, rounds: int = 400) -> np.ndarray:
    """Logistic weights (constant, highest log odds, log of the expected number), classes weighing as the share `base` of toxic rows says."""
    x = np.stack([np.ones(len(most)), most / 4, np.log1p(total)], 1)
    w, squares = np.zeros(3), np.full(3, 1e-8)
    weight = np.where(toxic == 1, base / max(1, toxic.sum()), (1 - base) / max(1, (toxic == 0).sum()))
    for _ in range(rounds):
        g = x.T @ (weight * (toxic - _sigmoid(x @ w))) - 1e-3 * w * [0, 1, 1]
        squares += g * g
        w += 0.5 * g / np.sqrt(squares)
    return w


def document_scores(w: np.ndarray, most: np.ndarray, total: np.ndarray) -> np.ndarray:
    return _sigmoid(np.stack([np.ones(len(most)), most / 4, np.log1p(total)], 1) @ w)


def families(t: Tokens, n: int = 5, hashes: int = 4) -> np.ndarray:
    """Number of each document's family: documents that share one of a few smallest shingle hashes."""
    count = len(t.first) - 1
    parent = np.arange(count)
    grams = rolled(t.hash, n)
    for s in range(hashes):
        v = mixed(grams ^ np.uint64(s * 0x9E3779B97F4A7C15 % 2**64))
        seen: dict[int, int] = {}
        for d in range(count):
            a, b = t.first[d], t.first[d + 1] - n + 1
            key = int(v[a:b].min()) if b > a else -d - 1
            other = seen.setdefault(key, d)
            x, y = d, other
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
    for d in range(count):
        while parent[d] != parent[parent[d]]:
            parent[d] = parent[parent[d]]
    return parent


def label_tokens(t: Tokens, toxic: np.ndarray, least_share: float = 0.8, doubt: float = 0.01) -> np.ndarray:
    """Tags of tokens from labels of documents: in toxic ones, the words that nearly only toxic families hold.

    A word's share of toxic families must be one that chance would give no word of the vocabulary, but for `doubt`.
    """
    family = families(t)
    doc = np.repeat(np.arange(len(toxic)), np.diff(t.first))
    n_bad, n_good = len(np.unique(family[toxic == 1])), len(np.unique(family[toxic == 0]))
    base, tiny, tags = n_bad / max(1, n_bad + n_good), 1e-12, np.zeros(len(t.hash), bool)
    for item in (t.hash, t.stem_hash):
        items, back = np.unique(item, return_inverse=True)
        key = np.unique(back.astype(np.int64) * (2 * len(family)) + family[doc] * 2 + toxic[doc])
        back, label = key // (2 * len(family)), key % 2
        bad, good = np.bincount(back, label == 1, len(items)), np.bincount(back, label == 0, len(items))
        share = bad / np.maximum(1, bad + good)
        surprise = (bad + good) * (share * np.log((share + tiny) / (base + tiny)) + (1 - share) * np.log((1 - share + tiny) / (1 - base + tiny)))
        chosen = items[(share >= least_share + (1 - least_share) * base) & (surprise > np.log(max(2, len(items)) / doubt))]
        tags |= np.isin(item, chosen)
    return tags & (toxic[doc] == 1)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 1500) -> Field | None:
    """The field from at most `most_rows` labelled rows of each kind (whole texts), those smallest by a hash of doc_id; None without both kinds."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    base = counts[1] / (counts[0] + counts[1])
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(most_rows).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(most_rows)).withColumnRenamed("doc_id", "labelled")
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most 2 x most_rows rows
            .select("doc_id", "text", "toxic").collect())
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    t = joined_tokens([(r["text"] or "").encode() for r in rows])
    tags = label_tokens(t, toxic)
    # The score's weights come from families of documents that the field has not seen.
    unseen = mixed(families(t).astype(np.uint64)) % np.uint64(3) == 0
    if len(set(toxic[unseen].tolist())) == 2 == len(set(toxic[~unseen].tolist())):
        part, own = chosen_documents(t, tags, ~unseen)
        _, most, total = summaries(fit(part, own), t)
        score = fit_score(most[unseen], total[unseen], toxic[unseen], base)
    else:
        _, most, total = summaries(fit(t, tags), t)
        score = fit_score(most, total, toxic, base)
    field = fit(t, tags)
    field.score = score
    return field


def joined_tokens(texts: list[bytes]) -> Tokens:
    """Tokens of all texts, made in blocks, without their places."""
    off = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = [tokens(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in blocks(off, 1 << 19)]
    sizes = np.cumsum([0] + [len(p.word) for p in parts])
    first = np.r_[0, np.concatenate([p.first[1:] + n for p, n in zip(parts, sizes, strict=False)])]
    none = np.zeros(0, np.int64)
    cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Tokens(cat("word"), cat("stem"), cat("before"), cat("after"), first, none, none, cat("hash"), cat("stem_hash"))


def chosen_documents(t: Tokens, tags: np.ndarray, chosen: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The tokens of some documents only."""
    sizes = np.diff(t.first)
    keep = np.repeat(chosen, sizes)
    first = np.r_[0, np.cumsum(np.where(chosen, sizes, 0))]
    return Tokens(t.word[keep], t.stem[keep], t.before[keep], t.after[keep], first, t.starts, t.ends, t.hash[:0], t.stem_hash[:0]), tags[keep]


def spans(t: Tokens, d: int, odds: np.ndarray, at: int) -> list[dict]:
    """Byte offsets within the text of runs of tokens that are likelier toxic, with the highest marginal."""
    a, b = t.first[d], t.first[d + 1]
    bad = np.flatnonzero(odds[a:b] > 0)
    if not len(bad):
        return []
    cut = np.flatnonzero(np.diff(bad) > 1) + 1
    return [{"start": int(t.starts[a + g[0]] - at), "end": int(t.ends[a + g[-1]] - at), "p": float(_sigmoid(odds[a + g]).max())} for g in np.split(bad, cut)]


def toxicity(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, spans (byte offsets of toxic spans) for every row of docs(doc_id, text, ...)."""
    model = docs.sparkSession.sparkContext.broadcast(field)  # fixed size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts_of(batch)
            for i, j in blocks(off, 1 << 20):
                if model.value is None:
                    score, found = np.full(j - i, 0.5), [[]] * (j - i)
                else:
                    t = tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    odds, most, total = summaries(model.value, t)
                    score = document_scores(model.value.score, most, total)
                    found = [spans(t, d, odds, int(off[i + d] - off[i])) if most[d] > 0 else [] for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score), pa.array(found, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    field = train(docs, labels.where(~held_out))
    return toxicity(docs, field).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")

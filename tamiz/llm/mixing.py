"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words by weight; a target stops at `most_times` its source's size and the excess
is shared again. Each document is taken floor(ratio) times, and once more with the remaining probability. Which documents
get the extra copy is decided by the cube method: fractional probabilities move along the null space of the constraints
(number of documents, number of words), so both totals keep their value, until at most two documents of a cell are
undecided. Those go on to a wider cell, level by level; the last ones are rounded so that words stay nearest the target.

Words are maximal runs of bytes outside space and 9-13; null text has none. Sources sort by code point, null last; a
source without words has target 0. Repeated rows are documents of their own. Extra columns are ignored. Reruns agree,
whatever the partitioning: the order within a cell is that of a seeded hash of doc_id, then doc_id, size and a hash of
the text. Rows without doc_id are dealt to cells by the hash of their text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, read, stored

#: Documents in a cell; two of each stay undecided.
CELL = 2_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, most_times: float = 3.0) -> DataFrame:
    """src, source_size, n_docs, target of each source of sizes(src, size); one row a source.

    Sharing the excess again until none is above its cap is the same as one water level for all: sources whose cap
    lies below level x weight get their cap, the others level x weight.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * most_times).withColumn("r", F.col("cap") / F.col("w"))
    below = Window.orderBy("r", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    # The level if exactly the sources before this one are capped. The right one is the first at which this one isn't; later ones are lower.
    per = per.withColumn("level", rest / left)
    level = F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(every)
    return per.select("src", "source_size", "n_docs", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))).cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p through the null space of (1, size), three undecided units at a time, until fewer than three are left."""
    p = p.astype(float).tolist()
    x = size.astype(float).tolist()
    draws = rng.random(len(p) + 8).tolist()
    eps, live, d = 1e-9, [], 0
    for i in range(len(p)):
        if eps < p[i] < 1 - eps:
            live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        ua, ub, uc = x[b] - x[c], x[c] - x[a], x[a] - x[b]
        if ua == ub == uc == 0:
            ua, ub = 1.0, -1.0
        up = down = math.inf
        for k, u in ((a, ua), (b, ub), (c, uc)):
            if u > 0:
                up, down = min(up, (1 - p[k]) / u), min(down, p[k] / u)
            elif u < 0:
                up, down = min(up, -p[k] / u), min(down, (p[k] - 1) / u)
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        p[a] += step * ua
        p[b] += step * ub
        p[c] += step * uc
        live = [k for k in live if eps < p[k] < 1 - eps]
    return np.clip(np.array(p), 0, 1)


def landing(p: np.ndarray, size: np.ndarray, carry: float) -> np.ndarray:
    """Decide the few undecided units: in descending size, each goes to the side that leaves the words nearest their expected total."""
    out = np.round(p)
    undecided = [i for i in np.lexsort((np.arange(len(p)), -size)) if 1e-9 < p[i] < 1 - 1e-9]
    for i in undecided:
        up = carry + size[i] * (1 - p[i])
        down = carry - size[i] * p[i]
        out[i], carry = (1.0, up) if abs(up) < abs(down) else (0.0, down)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, most_times: float = 3.0, seed: int = 11, cell: int = CELL, row: str | None = None) -> DataFrame:
    """doc_id, src, size, source_size, target, times, taken for every row of docs(doc_id, text, source, ...).

    row: name of a long column that tells rows apart, to be returned too; or None.
    """
    sizes = docs.select("doc_id", F.col("source").alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64("text").alias("digest"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"))
    sizes = stored(sizes)
    goal = stored(targets(sizes, weights, share, most_times))
    ratio = F.coalesce(F.expr("try_divide(target, source_size)"), F.lit(0.0))
    rows = (sizes.join(F.broadcast(goal.withColumnRenamed("src", "s")), F.col("src").eqNullSafe(F.col("s"))).drop("s")
            if goal.count() <= 10_000 else sizes.join(goal.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).drop("s"))
    # Sums of doubles may leave a ratio a hair below a whole number.
    rows = rows.withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    cells = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / cell)).cast("long")
    rows = rows.withColumn("own", F.coalesce("doc_id", "digest")).withColumn("cell", F.pmod(F.xxhash64("own", F.lit(seed)), cells)).withColumn("order", F.xxhash64("own", F.lit(seed + 1)))

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size", "digest"], kind="stable")
        rng = np.random.default_rng([seed, int(pdf["cell"].iloc[0]), len(pdf)])
        return pdf.assign(p=flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), rng))

    names = "doc_id long, src string, size long, source_size long, n_docs long, target double, whole long, p double, cell long, order long, digest long, row long"
    rows = stored(rows.select(*[c.split()[0] for c in names.split(", ")]).groupBy("src", "cell").applyInPandas(fly, names))
    undecided = "p > 1e-9 and p < 1 - 1e-9"
    done = [rows.where(f"not ({undecided})")]
    rest = rows.where(undecided)
    # At most two undecided documents a cell are left: fewer cells each time, until one a source remains.
    n_cells = int(math.ceil((goal.agg(F.max("n_docs")).first()[0] or 1) / cell))
    while n_cells > 1:
        n_cells = math.ceil(n_cells / (cell // 2))
        rest = stored(rest.withColumn("cell", F.pmod("cell", F.lit(n_cells))).groupBy("src", "cell").applyInPandas(fly, names))
        done.append(rest.where(f"not ({undecided})"))
        rest = rest.where(undecided)

    def land(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size", "digest"], kind="stable")
        return pdf.assign(p=landing(pdf["p"].to_numpy(), pdf["size"].to_numpy(), 0.0))

    out = rest.groupBy("src").applyInPandas(land, names)
    for part in done:
        out = out.unionByName(part)
    times = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "src", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), *([F.col("row").alias(row)] if row else []))


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

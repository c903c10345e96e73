"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, connected components.

Vectors meet only within one label and one bucket of a table. Equal vectors stand for one another first, so a group of
copies is one row. The number of planes grows with the number of vectors per label, so that buckets keep their size;
the number of tables follows from it and from the wanted recall at the threshold. A bucket with more rows than
`most_rows` is dealt out in pairs of slices, each pair being one task's work; nothing is left out.

A pair that meets in several tables counts in the first of them. Only the links needed to span what one slice pair
has linked leave the task, and one count for each vector.

Null, zero and non-finite vectors, vectors with null parts and rows with a null label link with nothing and are kept
as their own component. Vectors of different lengths never link. Repeated rows with the same vec_id count as one vector
(their copies of other ids count as usual). Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, read, stored

LINKS = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "n", "other")])


def plan(per_label: int, threshold: float, recall: float = 0.9995, bucket: int = 16) -> tuple[int, int]:
    """(planes, tables): buckets of about `bucket` rows, and pairs at the threshold found with the given recall."""
    planes = min(40, max(4, math.ceil(math.log2(max(per_label, 1) / bucket + 1))))
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**planes)) if agree < 1 else 1
    return planes, max(1, tables)


def signs(matrix: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """Bucket of each row in each table: rows x tables."""
    normal = np.random.default_rng([seed, matrix.shape[1]]).standard_normal((matrix.shape[1], tables * planes))
    bits = (matrix @ normal >= 0).reshape(len(matrix), tables, planes)
    return bits @ (1 << np.arange(planes, dtype=np.int64))


def spanning(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links rows-cols."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, rows, low[cols])
        np.minimum.at(new, cols, low[rows])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def linked_pairs(ids, vec, keys, weight, table, threshold, sides) -> pd.DataFrame:
    """Counts and spanning links of one slice pair. sides: 0 and 1 for the two slices of a pair, or all 2 in a slice of its own."""
    order = np.argsort(ids, kind="stable")
    ids, vec, keys, weight, sides = ids[order], vec[order], keys[order], weight[order], sides[order]
    counts = np.zeros(len(ids), np.int64)
    low = np.arange(len(ids))
    step = 512
    for i in range(0, len(ids), step):
        a = slice(i, min(i + step, len(ids)))
        for j in range(i, len(ids), step):
            b = slice(j, min(j + step, len(ids)))
            near = vec[a] @ vec[b].T >= threshold
            near &= ids[a][:, None] < ids[b][None, :]
            near &= (sides[a][:, None] != sides[b][None, :]) | (sides[a][:, None] == 2)
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            if table and len(x):
                first = ~(keys[x, :table] == keys[y, :table]).any(axis=1)
                x, y = x[first], y[first]
            if len(x):
                np.add.at(counts, x, weight[y])
                np.add.at(counts, y, weight[x])
                low = spanning(np.r_[x, np.arange(len(ids))], np.r_[y, low], len(ids))
    some = np.flatnonzero(counts)
    return pd.DataFrame({"node": ids[some], "n": counts[some], "other": ids[low[some]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.98, most_rows: int = 2048, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vec_id of vectors(vec_id, embedding, label)."""
    v = vectors.select("vec_id", F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = v.where("label is not null and vec_id is not null and v is not null "
                   "and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    # Equal vectors of one label stand for one another; the smallest vec_id represents them.
    fine = stored(fine.select("vec_id", "label", "v").withColumn("same", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)))
    reps = stored(fine.groupBy("same").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")))
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    planes, tables = plan(largest, threshold)

    def bucketed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["v"].map(len)
            for dim, part in pdf.groupby(size):
                m = np.array(part["v"].tolist(), float)
                # Scaled by the largest part first, else squares may leave the range of doubles.
                m = m / np.abs(m).max(axis=1, keepdims=True)
                m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
                key = signs(m, planes, tables, seed)
                for t in range(tables):
                    yield pd.DataFrame({"label": part["label"].astype("int64").to_numpy(), "dim": dim, "tab": t, "bucket": key[:, t], "rep": part["rep"].to_numpy(), "weight": part["weight"].to_numpy(), "unit": list(m), "keys": list(key)})

    rows = reps.mapInPandas(bucketed, "label long, dim int, tab int, bucket long, rep long, weight long, unit array<double>, keys array<long>")
    rows = stored(rows)
    at = ["label", "dim", "tab", "bucket"]
    # Slices of a bucket: a row meets its own slice and, as one side, every other slice of its bucket.
    sizes = rows.groupBy(*at).agg(F.count("*").alias("size")).where("size > 1").withColumn("slices", F.ceil(F.col("size") / most_rows).cast("int"))
    work = (rows.join(sizes, at).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            .select(*at, F.least("mine", "with").alias("lo"), F.greatest("mine", "with").alias("hi"), "rep", "weight", "unit", "keys",
                    F.when(F.col("mine") == F.col("with"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1).alias("side")))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return linked_pairs(pdf["rep"].to_numpy(), np.array(pdf["unit"].tolist()), np.array(pdf["keys"].tolist()), pdf["weight"].to_numpy(), int(pdf["tab"].iloc[0]), threshold, pdf["side"].to_numpy())

    links = stored(work.groupBy(*at, "lo", "hi").applyInPandas(link, LINKS))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_rep = (reps.select("same", "rep", "weight").join(counts, F.col("rep") == F.col("node"), "left").drop("node")
               .join(groups, F.col("rep") == F.col("node"), "left")
               .select("same", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("comp")))
    found = fine.select("vec_id", "same").join(per_rep, "same").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("comp").alias("comp"))
    out = vectors.select("vec_id").distinct().join(found.withColumnRenamed("vec_id", "id"), F.col("vec_id") == F.col("id"), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"),
                      (F.coalesce("comp", "vec_id") == F.col("vec_id")).alias("kept"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


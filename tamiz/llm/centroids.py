"""Centroid clustering of quantised vectors: float32 screening with proven error intervals, then exact integers.

Vectors are integers after quantisation. A product of matrices in float32 gives |c|^2 - 2 q.c for every vector q and
centroid c, and a bound on its rounding error an interval around the exact value: the sum of n products, with operands
rounded to float32, is off by at most g(n + 2) |q| |c|, where g(m) = m u / (1 - m u) and u = 2^-24, in whatever order it is
added. A centroid whose interval begins after another one's end can't be the nearest. Where one is left it is the nearest; where
several intervals overlap, their distances are computed in 64-bit integers and the lowest number wins a tie.

Each round is one pass over the stored integers: a task sends a count and sums for each centroid, Spark adds them, and the
driver divides as many rows as there are centroids. Nothing there grows with the number of vectors.

A vector is kept if it has exactly `dims` components, none null or non-finite; a null embedding, or one of another length, is left
out. Every row is a vector of its own, also with a repeated or null vec_id (a null one is never a first centroid; of rows with
one vec_id the smallest components come first). With fewer vectors than `k` there are as many centroids as vectors;
without any the result is empty. Components are to be under 2^26 after quantisation, else a squared distance might leave 64
bits: then the query fails and says so. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, read, stored

HALF_ULP = 2.0**-24
LARGEST = 1 << 26


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and q (integers) of the vectors that are kept."""
    whole = f"size(embedding) = {dims} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    floor = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double")) * scale < LARGEST)
    message = F.lit(f"a component times {scale} is {LARGEST} or more: squared distances might leave 64 bits")
    return vectors.select("vec_id", "embedding").where(whole).select("vec_id", F.when(fits, floor).otherwise(F.raise_error(message)).cast("array<int>").alias("q"))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().reshape(-1, dims)


def nearest(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of every row of q; both int64."""
    dims = q.shape[1]
    gamma = (dims + 2) * HALF_ULP / (1 - (dims + 2) * HALF_ULP)
    own, norms = (centroids * centroids).sum(axis=1), np.sqrt((q * q).sum(axis=1).astype(float))
    score = own - 2.0 * (q.astype(np.float32) @ centroids.T.astype(np.float32)).astype(float)
    # Twice the bound on the product, and a part in 2^40 of all that was computed in doubles.
    off = 2 * gamma * norms[:, None] * np.sqrt(own.astype(float)) * (1 + 2.0**-40) + (own + np.abs(score)) * 2.0**-40
    open_ = score - off <= (score + off).min(axis=1, keepdims=True)
    out = open_.argmax(axis=1)
    rows = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(rows):
        r, c = np.nonzero(open_[rows])
        gap = q[rows[r]] - centroids[c]
        exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        exact[r, c] = (gap * gap).sum(axis=1)
        out[rows] = exact.argmin(axis=1)  # the first of equal ones
    return out


def rounds(kept: DataFrame, centroids: list[list[int]], dims: int, n: int) -> list[list[int]]:
    """Centroids after n rounds over kept(q)."""
    for _ in range(n):
        now = np.array(centroids, np.int64)

        def parts(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, 1 << 14):
                    q = matrix(batch.slice(i, 1 << 14), dims).astype(np.int64)
                    c = nearest(q, now)
                    counts += np.bincount(c, minlength=len(now))
                    for k in np.unique(c):
                        sums[k] += q[c == k].sum(axis=0)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims)), pa.array(np.tile(np.arange(dims), len(some))), pa.array(sums[some].reshape(-1)), pa.array(np.repeat(counts[some], dims))], ["k", "i", "s", "n"])

        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        got = kept.select("q").mapInArrow(parts, "k long, i long, s long, n long").groupBy("k", "i").agg(wide("s"), wide("n")).collect()
        centroids = [list(c) for c in centroids]
        for row in got:
            centroids[row["k"]][row["i"]] = int(row["s"]) // int(row["n"])
    return centroids


def clusters(vectors: DataFrame, k: int = 8, n_rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of vectors(vec_id, embedding, ...)."""
    kept = stored(quantised(vectors, dims, scale))
    first = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(k)
    centroids = rounds(kept, [r["q"] for r in first.collect()], dims, n_rounds)
    last = np.array(centroids, np.int64).reshape(-1, dims)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows if len(last) else 0, 1 << 14):
                part = batch.slice(i, 1 << 14)
                q = matrix(part, dims).astype(np.int64)
                c = nearest(q, last)
                gap = q - last[c]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(c, pa.int32()), pa.array((gap * gap).sum(axis=1))], ["vec_id", "cluster", "distance"])

    found = stored(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    forget(kept)
    # One row for each centroid: the sums of its cluster, and the sum of these.
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    by_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", by_cluster([sums.get(c, 0) for c in range(len(names))], "long").alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), by_cluster(names, "string").alias("centroid_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings"))


def _sql(k: int, n_rounds: int) -> str:
    steps = [f"""kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings
where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
parts as materialized (select rid, unnest(q) as x, generate_subscripts(q, 1) as i from kept),
seeds as (select q, row_number() over (order by sha256(concat('3:', vec_id)), q) - 1 as k from kept where vec_id is not null),
c0 as materialized (select k, unnest(q) as x, generate_subscripts(q, 1) as i from seeds where k < {k})"""]
    for n in range(n_rounds + 1):
        steps.append(f"d{n} as (select rid, k, cast(sum((p.x - c.x) * (p.x - c.x)) as bigint) as d from parts p join c{n} c on c.i = p.i group by rid, k), a{n} as materialized (select rid, arg_min(k, (d, k)) as k, min(d) as d from d{n} group by rid)")
        if n < n_rounds:
            steps.append(f"m{n} as (select a.k, p.i, cast(sum(p.x) as hugeint) as s, count(*) as n from a{n} a join parts p on p.rid = a.rid group by a.k, p.i), c{n + 1} as materialized (select c.k, c.i, cast(case when m.n is null then c.x when m.s % m.n < 0 then m.s // m.n - 1 else m.s // m.n end as bigint) as x from c{n} c left join m{n} m on m.k = c.k and m.i = c.i)")
    return "with " + ",\n".join(steps) + f""",
named as (select k, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{n_rounds} group by k)
select vec_id, cast(a.k as integer) as cluster, d as distance, cast(sum(d) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256 from a{n_rounds} a join kept on kept.rid = a.rid join named on named.k = a.k"""


OP12_SQL = _sql(8, 10)

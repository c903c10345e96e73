"""Vector and word similarity; search of stated queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.text import as_column
from tamiz.sources.tables import written


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, clamp: bool = False) -> Column:
    """Cosine similarity; 0 if either vector is zero. clamp: into 0 to 1."""
    c = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) if clamp else c


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def word_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the sets of lower-case words; 0 if either is empty."""
    words = lambda t: F.filter(F.array_distinct(F.split(F.lower(as_column(t)), r"\s+")), lambda w: w != "")
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


#: Rows of a cell, as planned; rows of the sample that the cells are cut by, of each cell and at most (in numbers); rows of it that bound a query's distances.
CELL, PER_CELL, SAMPLED, SEEN = 512, 16, 2**23, 1024
#: Up to this size no square leaves the doubles.
LARGE = 1e150
#: Queries that meet one part of the cells in one task.
TOGETHER = 100_000


def search(rows: DataFrame, queries: DataFrame, k: int, most_queries: int = 10_000, cosine_distance: bool = False, digits: int | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest rows of every query, ties by vec_id, what has no distance last. digits: distances are rounded to these before they are ranked.

    queries(query_id, query) is a stated set of at most `most_queries` rows. Both sides are written once, of equal vectors the
    k first rows. Squared distances: space is cut into cells by a bounded sample of the rows (a k-d tree); all rows lie in
    cells, and a query goes to every cell that may hold one of its k nearest, as the sample bounds how far these are. The
    result is exact. Vectors that the cells do not part (many independent components) are compared with all rows, as are, by
    a broadcast, queries with fewer than k rows of their length and numbers, and all queries by cosine distance.
    """
    if cosine_distance:
        if queries.count() > most_queries:
            raise ValueError(f"more than {most_queries} queries; search them in parts")
        return _ranked(_pairs(rows, queries, 1 - cosine("embedding", "query")), k, digits)
    q = written(queries.select("query_id", F.col("query").cast("array<double>").alias("query")))
    asked = q.count()
    if asked > most_queries:
        raise ValueError(f"more than {most_queries} queries; search them in parts")
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    r = written(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("_n", first).where(F.col("_n") <= k).drop("_n"))
    even = r.where(_even("embedding"))
    sizes = even.groupBy(F.size("embedding").alias("_size")).agg(F.count("*").alias("_rows"))
    enough = q.join(F.broadcast(sizes.where(F.col("_rows") >= k)), _even("query") & (F.size("query") == F.col("_size")), "left")
    few = enough.where(F.col("_size").isNull()).select(*q.columns)
    near = _near(even, enough.where(F.col("_size").isNotNull()).select(*q.columns), asked, k, 0.0 if digits is None else 1.01 * 10.0 ** -digits)
    return _ranked(near.unionByName(_pairs(r, few, squared_distance("embedding", "query"))), k, digits)


def _even(vector: str) -> Column:
    """Whether a vector has numbers only, none so large that a distance might not be one."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) <= LARGE, F.lit(False))), F.lit(False))


def _pairs(rows: DataFrame, queries: DataFrame, distance: Column) -> DataFrame:
    return rows.crossJoin(F.broadcast(queries)).select("query_id", "vec_id", distance.alias("distance"))


def _ranked(scored: DataFrame, k: int, digits: int | None) -> DataFrame:
    """Spark keeps each task's k best before rows move (a limit on the rank of a window is pushed below the shuffle)."""
    rounded = scored if digits is None else scored.withColumn("distance", F.round("distance", digits))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Cells:
    """Space in cells by a sample: the widest component is cut at its median until a cell has few rows of it. Cells are numbered from `start`, near ones near."""

    def __init__(self, sample: np.ndarray, least: int, start: int):
        self.start, self.sizes, order = start, [], []

        def cut(at: np.ndarray) -> int | tuple:
            x = sample[at]
            wide = int(x.var(0).argmax()) if x.shape[1] else 0
            if len(at) <= least or not x.shape[1] or x[:, wide].min() == x[:, wide].max():
                self.sizes.append(len(at))
                order.append(at)
                return start + len(self.sizes) - 1
            v = x[:, wide]
            middle = np.partition(v, len(v) // 2)[len(v) // 2]
            if middle == v.max():
                middle = v[v < middle].max()
            return wide, middle, cut(at[v <= middle]), cut(at[v > middle])

        self.tree = cut(np.arange(len(sample)))
        self.sample = sample[np.concatenate(order)]
        self.before = np.cumsum([0, *self.sizes])

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell that each vector lies in."""
        out = np.zeros(len(x), np.int64)

        def walk(node: int | tuple, i: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[i] = node
            elif len(i):
                left = x[i, node[0]] <= node[1]
                walk(node[2], i[left])
                walk(node[3], i[~left])

        walk(self.tree, np.arange(len(x)))
        return out

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """No less than each query's k-th squared distance: that among rows of the sample about its cell; infinite where there are fewer."""
        n, seen = len(self.sample), min(len(self.sample), max(SEEN, 4 * k))
        if n < k:
            return np.full(len(q), np.inf)
        home = self.of(q) - self.start
        low = np.clip((self.before[home] + self.before[home + 1] - seen) // 2, 0, n - seen)
        out = np.empty(len(q))
        some = max(1, 2**20 // seen)
        for a in range(0, len(q), some):
            at = low[a:a + some, None] + np.arange(seen)
            d = sum(((self.sample[at, j] - q[a:a + some, j, None]) ** 2 for j in range(q.shape[1])), np.zeros(at.shape))
            out[a:a + some] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return out

    def about(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and cells, as pairs: all cells that reach into a query's bound."""
        found: list[tuple[np.ndarray, int]] = []

        def walk(node: int | tuple, i: np.ndarray, gap: np.ndarray) -> None:
            near = (gap**2).sum(1) * (1 - 1e-9) <= bound[i]
            i, gap = i[near], gap[near]
            if not isinstance(node, tuple):
                found.append((i, node))
            elif len(i):
                wide, middle, left, right = node
                for side, away in ((left, q[i, wide] - middle), (right, middle - q[i, wide])):
                    farther = gap.copy()
                    farther[:, wide] = np.maximum(gap[:, wide], away)
                    walk(side, i, farther)

        walk(self.tree, np.arange(len(q)), np.zeros(q.shape))
        return np.concatenate([i for i, _ in found]), np.concatenate([np.full(len(i), c) for i, c in found])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), len(flat) // max(1, len(vectors)))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _near(rows: DataFrame, queries: DataFrame, asked: int, k: int, margin: float) -> DataFrame:
    """query_id, vec_id, distance: of every query at least the k nearest rows, by distances that differ by no more than margin. All are vectors of numbers."""
    spark, n = rows.sparkSession, rows.count()
    width = (rows.agg(F.max(F.size("embedding"))).first()[0] or 1) if n else 1
    most = max(CELL, min(max(8 * CELL, n * PER_CELL // CELL), SAMPLED // max(1, width)))
    taken = rows.select("embedding").sample(min(1.0, most / max(1, n)), seed=7) if n > most else rows.select("embedding")
    sample = _one(taken.toArrow().column("embedding"))
    lengths = sample.value_lengths().to_numpy(zero_copy_only=False)
    least = max(1, CELL * min(n, most) // max(1, n))
    trees, count = {}, 0
    for size in np.unique(lengths):
        trees[int(size)] = Cells(_matrix(sample.filter(pa.array(lengths == size))), least, count)
        count += len(trees[int(size)].sizes)
    shared = spark.sparkContext.broadcast(trees)
    parts = max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, n // 50_000)))
    salts = -(-asked // TOGETHER) or 1

    def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Cells | int, np.ndarray]]:
        lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths):
            some = batch.filter(pa.array(lengths == size))
            # A length that the sample lacks has one cell.
            yield some, shared.value.get(int(size), count + int(size)), _matrix(some.column(column))

    def part(cells: np.ndarray) -> np.ndarray:
        return np.where(cells < count, cells * parts // max(1, count), cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, cells, x in by_length(batch, "embedding"):
                at = np.full(len(x), cells) if isinstance(cells, int) else cells.of(x)
                yield pa.RecordBatch.from_arrays([pa.array(part(at)), pa.array(at), *some.columns], names=["part", "cell", *some.schema.names])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, cells, x in by_length(batch, "query"):
                if isinstance(cells, int):
                    i, at = np.arange(len(x)), np.full(len(x), cells)
                else:
                    i, at = cells.about(x, cells.bounds(x, k) + margin)
                to = part(at)
                order = np.lexsort((at, to, i))
                i, at, to = i[order], at[order], to[order]
                heads = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (to[1:] != to[:-1])]) if len(i) else np.zeros(0, np.int64)
                own = some.take(pa.array(i[heads]))
                listed = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(i)], pa.int32()), pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(to[heads]), listed, *own.columns], names=["part", "cells", *own.schema.names])

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("cell", "ascending")])
        ids, vectors, queried, asking, cells = _one(left["vec_id"]), _one(left["embedding"]), _one(right["query_id"]), _one(right["query"]), _one(right["cells"])
        heads, at = cells.value_lengths().to_numpy(zero_copy_only=False), cells.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        at, visitor = at[order], np.repeat(np.arange(len(heads)), heads)[order]
        cell = left["cell"].to_numpy()
        out = []
        for c in np.unique(cell):
            a, b = np.searchsorted(cell, [c, c + 1])
            i = visitor[slice(*np.searchsorted(at, [c, c + 1]))]
            if not len(i):
                continue
            own = pc.sort_indices(ids.slice(a, b - a), null_placement="at_start").to_numpy().astype(np.int64) + a
            x, some = _matrix(vectors.take(pa.array(own))), max(1, 2**19 // (b - a))
            for s in range(0, len(i), some):
                q = _matrix(asking.take(pa.array(i[s:s + some])))
                d = np.zeros((len(q), len(x)))
                for j in range(x.shape[1]):
                    d += (x[None, :, j] - q[:, None, j]) ** 2
                far = (np.partition(d, k - 1, axis=1)[:, k - 1] + margin if len(x) > k else np.full(len(q), np.inf))
                y, z = np.nonzero(d <= far[:, None])
                # Of equal distances the k first rows.
                good = (pd.DataFrame({"y": y, "d": d[y, z]}).groupby(["y", "d"], sort=False).cumcount() < k).to_numpy()
                out.append((i[s:s + some][y[good]], own[z[good]], d[y[good], z[good]]))
        y, z, d = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": queried.take(pa.array(y)), "vec_id": ids.take(pa.array(z)), "distance": pa.array(d)})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    dealt = rows.mapInArrow(placed, f"part long, cell long, vec_id {kind(rows, 'vec_id')}, embedding array<double>").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    visits = queries.mapInArrow(sent, f"part long, cells array<long>, query_id {kind(queries, 'query_id')}, query array<double>").withColumn("salt", F.pmod(F.xxhash64("query_id", "query"), F.lit(salts)).cast("int"))
    return dealt.groupBy("part", "salt").cogroup(visits.groupBy("part", "salt")).applyInArrow(compared, f"query_id {kind(queries, 'query_id')}, vec_id {kind(rows, 'vec_id')}, distance double")


def best_similarity(rows: DataFrame, references: DataFrame, most_references: int = 10_000) -> DataFrame:
    """vec_id, best and mean cosine similarity (clamped) to a bounded set references(reference)."""
    if references.count() > most_references:
        raise ValueError(f"more than {most_references} references")
    return rows.crossJoin(F.broadcast(references)).groupBy("vec_id").agg(F.max(cosine("embedding", "reference", True)).alias("best"), F.avg(cosine("embedding", "reference", True)).alias("mean"))


def above(rows: DataFrame, score: str = "score", threshold: float = 0.7, parts: int = 200) -> DataFrame:
    """Rows at or above the threshold with their rank, equal scores with equal ranks.

    No window holds all rows: scores are cut into about `parts` ranges at fixed bounds, ranked within them, and moved on by
    the rows of the higher ranges.
    """
    good = rows.where(F.col(score) >= threshold)
    bounds = sorted(set(good.agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>"), lambda b: b >= F.col(score)))
    ranged = good.withColumn("_r", at)
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))  # as many rows as there are ranges
    before = sizes.select(F.col("_r").alias("_o"), F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_own", F.rank().over(Window.partitionBy("_r").orderBy(F.desc(score))))
    return ranked.join(F.broadcast(before), F.col("_r") == F.col("_o")).select(*rows.columns, (F.col("_own") + F.col("_before")).cast("int").alias("rank"))


def distinct_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Each text once: what an embedding model has to see."""
    return rows.select(text).distinct()

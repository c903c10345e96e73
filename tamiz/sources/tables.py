"""Tables on disk that change by whole partitions: upserts, replaced and deleted parts, repeatable after a lost job."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: In the observed list of partitions: the null one, and what stands between two.
NULL, NEXT = "\x02", "\x01"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir. Only in local mode, a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tamiz-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tamiz-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, worked out once into a fresh shared folder, for what reads them more than once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(seen: Observation) -> dict:
    """What was observed; nothing where Spark found the plan to have no rows and left out the measures with it."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "toPyRow" not in str(e):
            raise
        return {}


class Partitioned:
    """A Parquet table in folders by one column.

    A change reads and writes only the partitions it touches. Spark writes them beside the old ones and puts them in their
    place when all tasks are done, so that a job that fails changes nothing and a job that is run again gives the same table.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by

    def exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _parts(self, rows: DataFrame) -> list:
        """The partitions that rows belong to: as many values at most as the table has folders."""
        return [r[0] for r in rows.select(self.by).distinct().collect()]

    def _in(self, parts: list) -> DataFrame:
        """What the table holds in some partitions; no others are read."""
        known = [p for p in parts if p is not None]
        return self.read().where(F.col(self.by).isin(known) | (F.col(self.by).isNull() if None in parts else F.lit(False)))

    def replace(self, rows: DataFrame, parts: list | None = None) -> None:
        """Rows in place of all that their partitions hold, and of all that the given ones hold, though there be no rows for them."""
        names, seen = self.spark.createDataFrame([], self.schema).columns, Observation()
        full = rows.select(*names).observe(seen, F.array_join(F.collect_set(F.coalesce(F.col(self.by).cast("string"), F.lit(NULL))), NEXT).alias("parts"))
        full.repartition(F.col(self.by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)
        filled = set((measured(seen).get("parts") or "").split(NEXT)) if parts else set()
        for value in parts or []:
            if (NULL if value is None else str(value)) not in filled:  # dynamic overwriting leaves a partition alone that gets no rows
                self._drop(value)

    def replace_of(self, owners: DataFrame, rows: DataFrame, keys: list[str]) -> None:
        """Rows in place of all whose keys owners has; all others stay. owners has the keys and the partition column."""
        parts = self._parts(owners)
        old = self._in(parts).join(owners.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct(), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        self.replace(old.unionByName(rows.select(*old.columns)), parts)

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        """Rows in place of those that have one of their keys; all others stay."""
        self.replace_of(rows, rows, keys)

    def delete(self, where: Column) -> None:
        """Rows for which a condition holds go. Partitions that have none of them are not written."""
        parts = self._parts(self.read().where(where))
        if parts:
            self.replace(self._in(parts).where(~F.coalesce(where, F.lit(False))), parts)

    def _drop(self, value: object) -> None:
        jvm = self.spark.sparkContext._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(self.by, None if value is None else str(value))
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bucket_of(n: int, *keys: str) -> Column:
    """A number below n for a key, the same in every run: what a table without a natural partition is kept by."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

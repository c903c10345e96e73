"""Seeds extended by rounds: what is found from the newest seeds and scores high enough joins them, until nothing new does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.sources.tables import Partitioned

SEEDS = "url string, discovered_from string, score double, round int"


def round_of(found: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """url, discovered_from and score of what was found at or above the threshold and isn't known; of several finds the best, then the first by its origin."""
    good = found.where((F.col("score") >= threshold) & F.col("url").isNotNull())
    best = good.groupBy("url").agg(F.min(F.struct((-F.col("score")).alias("_s"), "discovered_from")).alias("b"))
    new = best.join(known.select(F.col("url").alias("_k")), F.col("url") == F.col("_k"), "left_anti")
    return new.select("url", F.col("b.discovered_from").alias("discovered_from"), (-F.col("b._s")).alias("score"))


class Discovery:
    """Seeds by round, stored below a folder. A run that is lost goes on with the round that wasn't finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = Partitioned(spark, path, SEEDS, "round")

    def seeds(self) -> DataFrame:
        return self.table.read()

    def start(self, seeds: DataFrame) -> None:
        """seeds(url) as round 0, unless a run has begun."""
        if not self.table.exists():
            one = seeds.where("url is not null").select("url").distinct()
            self.table.replace(one.select("url", F.lit(None).cast("string").alias("discovered_from"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("round")))

    def run(self, discover: Callable[[DataFrame], DataFrame], threshold: float = 0.7, most_rounds: int = 1000) -> list[int]:
        """Numbers of new seeds of the rounds of this run. discover: seeds(url) to finds(url, discovered_from, score); it sees each seed once.

        The last stored round is the frontier. Rounds end when one finds nothing new, or at most_rounds.
        """
        counts = []
        while len(counts) < most_rounds:
            known = self.seeds()
            last = known.agg(F.max("round")).first()[0]
            if last is None:
                break
            new = round_of(discover(known.where(F.col("round") == last).select("url")), known, threshold)
            self.table.replace(new.withColumn("round", F.lit(last + 1)))
            n = self.seeds().where(F.col("round") == last + 1).count()
            if not n:
                break
            counts.append(n)
        return counts


def reached(seeds: DataFrame, discover: Callable[[DataFrame], DataFrame], path: str, threshold: float = 0.7) -> DataFrame:
    """url, discovered_from, score and round of all seeds, given and found."""
    d = Discovery(seeds.sparkSession, path)
    d.start(seeds)
    d.run(discover, threshold)
    return d.seeds()

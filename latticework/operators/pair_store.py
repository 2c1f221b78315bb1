"""Costs of pairs of graphs, kept so that no pair is searched twice.

A store is a folder of Parquet files by cost function, in the folder that all
machines share; a pair is stored once, by the smaller stem first, as costs are
symmetric.  Asking for costs joins the wanted pairs with the store, searches
only those that it lacks, appends them, and answers all.  The lacking pairs are
found by an anti join of the canonical pair, so the driver sees none of them.
Pairs that two runs searched at the same time count once, at the smaller cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .cluster import shared_folder

_SCHEMA = "stem_a string, stem_b string, cost double, cost_fn string"


class PairCosts:
    """`costs` for leader_clusters: pairs (stem_a, stem_b) to (stem_a, stem_b, cost) by a search that returns these columns."""

    def __init__(self, spark: SparkSession, name: str, cost_fn: str, search: Callable[[DataFrame], DataFrame], path: str | None = None):
        self.spark, self.cost_fn, self.search = spark, cost_fn, search
        self.path = path or f"{shared_folder(spark)}/pair-costs-{name}"

    def known(self) -> DataFrame:
        """(stem_a, stem_b, cost) of this cost function's pairs so far."""
        try:
            all_ = self.spark.read.schema(_SCHEMA).parquet(self.path)
        except AnalysisException:
            all_ = self.spark.createDataFrame([], _SCHEMA)
        own = all_.where(F.col("cost_fn") == self.cost_fn)
        return own.groupBy("stem_a", "stem_b").agg(F.min("cost").alias("cost"))

    def add(self, costs: DataFrame) -> None:
        """Appends (stem_a, stem_b, cost)."""
        rows = costs.select(F.least("stem_a", "stem_b").alias("stem_a"), F.greatest("stem_a", "stem_b").alias("stem_b"), "cost", F.lit(self.cost_fn).alias("cost_fn"))
        rows.write.mode("append").partitionBy("cost_fn").parquet(self.path)

    def costs(self, pairs: DataFrame) -> DataFrame:
        """(stem_a, stem_b, cost) of the pairs; pairs that the search leaves out (they can't match) are searched again each time, at no cost."""
        wanted = pairs.select("stem_a", "stem_b", F.least("stem_a", "stem_b").alias("low"), F.greatest("stem_a", "stem_b").alias("high"))
        keys = wanted.select(F.col("low").alias("stem_a"), F.col("high").alias("stem_b")).distinct()
        lacking = keys.join(self.known(), ["stem_a", "stem_b"], "left_anti")
        if not lacking.isEmpty():
            self.add(self.search(lacking).select("stem_a", "stem_b", "cost"))
        have = self.known().select(F.col("stem_a").alias("low"), F.col("stem_b").alias("high"), "cost")
        return wanted.join(have, ["low", "high"]).select("stem_a", "stem_b", "cost")

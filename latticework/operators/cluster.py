"""Clustering of graphs that are given as edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; on one machine, where none is set, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def _stored(frame: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the folder that all machines share."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): components of edges (a, b), named by their smallest node; nodes without edges are absent."""
    both = edges.where("a <> b").select("a", "b")
    both = _stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = _stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(most):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(around, "node").select("node", F.least("label", "near").alias("next"), "label")
        # Jump to the label of the label.
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = _stored(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "label"), "labels")
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")


def dbscan(nodes: DataFrame, near: DataFrame, members: int) -> DataFrame:
    """(node, cluster) of every node, from pairs (a, b) within reach; -1 is noise.

    Cores have at least `members` nodes in reach, themselves included; clusters
    are the components of cores, named by the smallest; other nodes in reach
    of cores join the smallest such cluster.
    """
    # The pairs are read several times and found once; they become both ways by one pass over them.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = _stored(near.select(ways).select("e.*").distinct(), "near")
    core = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= members - 1).select("a")
    inner = both.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi")
    labels = components(inner.select("a", "b"))
    cores = core.withColumnRenamed("a", "node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("cluster"))
    border = both.join(cores.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("border"))
    out = nodes.join(cores, "node", "left").join(border, "node", "left")
    return out.select("node", F.coalesce("cluster", "border", F.lit(-1)).alias("cluster"))

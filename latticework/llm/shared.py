"""Helpers that several operators use."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; set here only where the session has none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it back.

    The folder belongs to the caller, who may empty it once the results are written.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Bytes of a batch that a worker gets at once, where the session sets no bound; without one it is 10 000 rows, however long.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def _lean(run):
    """run, after which an idle worker keeps no memory that it no longer uses."""

    def steps(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return steps


def bounded_batches(spark: SparkSession) -> None:
    """Batches for workers are of about BATCH_BYTES from now on, where the session sets no bound."""
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def mapped(frame: DataFrame, run, schema) -> DataFrame:
    """mapInArrow by batches of about BATCH_BYTES (a longer row is a batch of its own), which both sides hold outside the heap."""
    bounded_batches(frame.sparkSession)
    return frame.mapInArrow(_lean(run), schema)


#: A key is hot beyond this share of all rows (so there are at most as many hot keys as its inverse), and this many rows.
HOT_SHARE, HOT_ROWS = 1e-3, 2000


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """Joins rows with facts, of which there is one for a key; counts (keys, n) says how many rows have a key, or more.

    The facts of hot keys, at most 1 / HOT_SHARE, are sent to the rows; only the
    others are joined by a shuffle, so no task gets more of one key than that.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    bar = max(HOT_ROWS, int((total or 0) * HOT_SHARE))
    if (most or 0) <= bar:
        return rows.join(facts, keys, how)
    hot = F.broadcast(counts.where(F.col("n") > bar).select(*keys))
    # Rows of a hot key without a fact stay in a left join.
    crowded = rows if how == "inner" else rows.join(hot, keys, "left_semi")
    return crowded.join(F.broadcast(facts.join(hot, keys, "left_semi")), keys, how).unionByName(rows.join(hot, keys, "left_anti").join(facts, keys, how))


#: Edges of a block of one task.
BLOCK_EDGES = 100_000


def _forests(batches):
    """A spanning forest of each block of edges (a > b), as stars around the smallest node of each tree."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def stars():
        found = [(x, find(x)) for x in list(root)]
        found = [p for p in found if p[0] != p[1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    seen = 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= BLOCK_EDGES:
            yield stars()
            seen = 0
    yield stars()


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a > b) with the same components, without the rings inside blocks of one task.

    Many edges among few nodes become fewer than there are nodes in a block, before any shuffle.
    """
    return mapped(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), _forests, "a long, b long")


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (node, label) with the smallest node as label.

    Thins the edges to forests of blocks, then alternates large and small stars:
    each round links every node's larger neighbours, then its smaller ones, to
    the smallest, until every component is a star.  Each round aggregates per node with map-side combining, joins
    the hubs of large stars apart from the others, and is written to the shared
    folder.
    """
    swapped = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = stored(forest(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), name)
    for _ in range(most):
        both = edges.unionByName(swapped(edges))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        # Only a graph of more than HOT_ROWS edges can have a hot node.
        beside = hot_join(both, least.drop("n"), ["a"], least) if edges.count() > HOT_ROWS else both.join(least, "a")
        large = beside.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # A node has as many larger neighbours as there are least ones beside it, rarely more than a few.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        forked = edges.groupBy("a").count().where("count > 1").select("a")
        chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if forked.unionByName(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"{name}: components did not settle in {most} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

"""Queries over the driver's tables, and the SQL that has the same rows.

Counts, sets, distances and clusters of rows; `engine` has those over graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "q_formula_gcd",
    """
    WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CAST(a / greatest(gcd(gcd(a, n), r), 1) AS BIGINT) AS a, CAST(n / greatest(gcd(gcd(a, n), r), 1) AS BIGINT) AS n, CAST(r / greatest(gcd(gcd(a, n), r), 1) AS BIGINT) AS r FROM c""",
)
def formula_gcd(spark, sf_dir):
    """Counts of each kind, reduced by their greatest common divisor."""
    from latticework.functions.scalar import gcd

    flag = lambda k: F.count_if(F.col("l_returnflag") == k).alias(k.lower())
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flag("A"), flag("N"), flag("R"))
    g = F.greatest(gcd(F.array("a", "n", "r")), F.lit(1))
    return c.select("l_orderkey", *[(F.col(k) / g).cast("long").alias(k) for k in "anr"])


@query("q_antijoin_build", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def antijoin_build(spark, sf_dir):
    """What is still to be built: stems without a result."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


_DISTANCES = """
    WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS dist
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label)"""


def label_distances(spark, sf_dir, within: float | None = None, block: int | None = None) -> DataFrame:
    """Distances of the pairs inside each label, those below `within` or all, made by blocks: rows (label, a, b, dist rounded to 4 places)."""
    from latticework.operators.pairs import pairwise_distances

    return pairwise_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", block, within)


@query("q_pair_distance", _DISTANCES + " SELECT la AS label, a, b, dist FROM d WHERE dist < 1.2")
def pair_distance(spark, sf_dir):
    """Pairs of one label that are nearer than 1.2."""
    return label_distances(spark, sf_dir, 1.2)


@query(
    "q_medoid",
    _DISTANCES
    + """, m AS (SELECT label, node, round(avg(dist), 3) AS mean FROM (SELECT la AS label, a AS node, dist FROM d UNION ALL SELECT la, b, dist FROM d) GROUP BY ALL)
    SELECT label, node, mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean, node) AS k FROM m) WHERE k = 1""",
)
def medoid(spark, sf_dir):
    """The member of each label with the smallest mean distance to the others."""
    from latticework.operators.pairs import PLACES, distance_sums

    m = distance_sums(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    m = m.select("label", "node", F.round(F.col("units") / (F.col("n") * PLACES), 3).alias("mean"))
    return m.groupBy("label").agg(F.min(F.struct("mean", "node")).alias("m")).select("label", "m.node", "m.mean")


@query(
    "q_dbscan_components",
    _DISTANCES
    + """, e AS (SELECT a, b FROM d WHERE dist < 1.2 UNION SELECT b, a FROM d WHERE dist < 1.2),
    core AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 2),
    ce AS (SELECT e.a, e.b FROM e JOIN core x ON x.a = e.a JOIN core y ON y.a = e.b UNION ALL SELECT a, a FROM core),
    r AS (WITH RECURSIVE w AS (SELECT a AS node, a AS root FROM core UNION SELECT ce.b, w.root FROM w JOIN ce ON ce.a = w.node) SELECT node, min(root) AS cluster FROM w GROUP BY node),
    border AS (SELECT e.a AS node, min(r.cluster) AS cluster FROM e JOIN r ON r.node = e.b WHERE e.a NOT IN (SELECT a FROM core) GROUP BY 1)
    SELECT vec_id AS node, coalesce(r.cluster, border.cluster, -1) AS cluster FROM embeddings LEFT JOIN r ON r.node = vec_id LEFT JOIN border ON border.node = vec_id""",
)
def dbscan_components(spark, sf_dir):
    """DBSCAN (eps 1.2, three members with itself) over distances inside labels; clusters are named by their smallest core."""
    return _clusters(table(spark, sf_dir, "embeddings"), "label")


def _clusters(rows: DataFrame, group: str | None) -> DataFrame:
    """(node, cluster) of all embeddings by DBSCAN (eps 1.2, three members with itself) inside groups; only links that matter leave a pair of blocks."""
    from latticework.operators.cluster import dbscan
    from latticework.operators.pairs import dbscan_links

    return dbscan(rows.select(F.col("vec_id").alias("node")), dbscan_links(rows, "vec_id", "embedding", group, 1.2, 3), 3)


_ALL_DISTANCES = """
    WITH RECURSIVE d AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS dist
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


def near_pairs(spark, sf_dir, block: int | None = None) -> DataFrame:
    """Pairs of all embeddings, whatever their labels, that are nearer than 1.2: rows (a, b, dist rounded to 4 places)."""
    from latticework.operators.pairs import pairwise_distances

    return pairwise_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", None, block, within=1.2)


@query("q_pair_distance_all", _ALL_DISTANCES + " SELECT a, b, dist FROM d WHERE dist < 1.2")
def pair_distance_all(spark, sf_dir):
    """Pairs that are nearer than 1.2, over all embeddings."""
    return near_pairs(spark, sf_dir)


@query(
    "q_dbscan_components_all",
    _ALL_DISTANCES
    + """, e AS (SELECT a, b FROM d WHERE dist < 1.2 UNION SELECT b, a FROM d WHERE dist < 1.2),
    core AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 2),
    ce AS (SELECT e.a, e.b FROM e JOIN core x ON x.a = e.a JOIN core y ON y.a = e.b UNION ALL SELECT a, a FROM core),
    w AS (SELECT a AS node, a AS root FROM core UNION SELECT ce.b, w.root FROM w JOIN ce ON ce.a = w.node),
    r AS (SELECT node, min(root) AS cluster FROM w GROUP BY node),
    border AS (SELECT e.a AS node, min(r.cluster) AS cluster FROM e JOIN r ON r.node = e.b WHERE e.a NOT IN (SELECT a FROM core) GROUP BY 1)
    SELECT vec_id AS node, coalesce(r.cluster, border.cluster, -1) AS cluster FROM embeddings LEFT JOIN r ON r.node = vec_id LEFT JOIN border ON border.node = vec_id""",
)
def dbscan_components_all(spark, sf_dir):
    """DBSCAN (eps 1.2, three members with itself) over all embeddings; clusters are named by their smallest core."""
    return _clusters(table(spark, sf_dir, "embeddings"), None)

"""Similarity of graphs by node descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fingerprint import histogram_intersection, list_similarity, map_intersection, normalised, total

# Weights of the parts, and what counts as a poor match.
WEIGHTS = {"cn": 0.20, "sharing": 0.35, "neighbours": 0.10, "core": 0.10, "angles": 0.25}
POOR, PENALTY = 0.5, 0.8


def node_similarities(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(stem_a, stem_b, id_a, id_b, score) of all nodes of each pair of graphs."""
    fields = ["stem", "id", "cn", "core_fraction", "neighbour_cn", "angles5", "sharing"]
    side = lambda x: descriptors.select(*[F.col(c).alias(f"{c}_{x}") for c in fields])
    j = pairs.select("stem_a", "stem_b").join(side("a"), "stem_a").join(side("b"), "stem_b")
    score = (
        WEIGHTS["cn"] * F.least("cn_a", "cn_b") / F.greatest("cn_a", "cn_b", F.lit(1))
        + WEIGHTS["sharing"] * histogram_intersection(F.col("sharing_a"), F.col("sharing_b"))
        + WEIGHTS["neighbours"] * map_intersection(F.col("neighbour_cn_a"), F.col("neighbour_cn_b"))
        + WEIGHTS["core"] * (1 - F.abs(F.col("core_fraction_a") - F.col("core_fraction_b")))
        + WEIGHTS["angles"] * histogram_intersection(F.col("angles5_a"), F.col("angles5_b"))
    )
    return j.select("stem_a", "stem_b", "id_a", "id_b", score.alias("score"))


def topology_scores(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(stem_a, stem_b, score): mean best match both ways, lowered by the share of poor matches and by unlike coordination histograms."""
    s = node_similarities(pairs, descriptors)
    keys = ["stem_a", "stem_b"]

    def way(node):
        best = s.groupBy(*keys, node).agg(F.max("score").alias("m"))
        return best.groupBy(*keys).agg(F.avg("m").alias(f"mean_{node}"), F.avg((F.col("m") < POOR).cast("double")).alias(f"poor_{node}"))

    tall = descriptors.groupBy("stem", "cn").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("stem")))
    cn = pairs.select(*keys).join(tall.select(F.col("stem").alias("stem_a"), "cn", F.col("p").alias("pa")), "stem_a").join(tall.select(F.col("stem").alias("stem_b"), "cn", F.col("p").alias("pb")), ["stem_b", "cn"])
    cn = cn.groupBy(*keys).agg(F.sum(F.least("pa", "pb")).alias("cn_sim"))
    x = way("id_a").join(way("id_b"), keys).join(cn, keys, "left")
    base = (F.col("mean_id_a") + F.col("mean_id_b")) / 2 * (1 - PENALTY * F.greatest("poor_id_a", "poor_id_b")) * (0.2 + 0.8 * F.coalesce("cn_sim", F.lit(0.0)))
    return x.select(*keys, F.greatest(F.least(base, F.lit(1.0)), F.lit(0.0)).alias("score"))


def mapped_scores(matches: DataFrame, pairs: DataFrame, descriptors: DataFrame, lost: float = 0.5) -> DataFrame:
    """(stem_a, stem_b, score): mean similarity over given matches (stem_a, stem_b, id_a, id_b), lowered by `lost` times the share of nodes of a without one."""
    keys = ["stem_a", "stem_b"]
    s = node_similarities(pairs, descriptors).join(matches.select(*keys, "id_a", "id_b"), [*keys, "id_a", "id_b"])
    n = descriptors.groupBy(F.col("stem").alias("stem_a")).agg(F.count(F.lit(1)).alias("n"))
    g = s.groupBy(*keys).agg(F.avg("score").alias("m"), F.countDistinct("id_a").alias("found"))
    return pairs.select(*keys).join(g, keys, "left").join(n, "stem_a").select(*keys, (F.coalesce("m", F.lit(0.0)) * (1 - lost * (1 - F.coalesce("found", F.lit(0)) / F.col("n")))).alias("score"))


def role_scores(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(stem_a, stem_b, score): best matches both ways among nodes of one role; 0.55 for degrees (exp of minus the difference), 0.30 for neighbour histograms, 0.15 for angles."""
    fields = ["stem", "id", "role", "cn", "neighbour_cn", "angles"]
    side = lambda x: descriptors.select(*[F.col(c).alias(f"{c}_{x}") for c in fields])
    j = pairs.select("stem_a", "stem_b").join(side("a"), "stem_a").join(side("b"), "stem_b")
    score = F.when(
        F.col("role_a").eqNullSafe(F.col("role_b")),
        0.55 * F.exp(-F.abs(F.col("cn_a") - F.col("cn_b"))) + 0.30 * map_intersection(F.col("neighbour_cn_a"), F.col("neighbour_cn_b")) + 0.15 * list_similarity(F.col("angles_a"), F.col("angles_b"), 20.0),
    ).otherwise(0.0)
    s = j.select("stem_a", "stem_b", "id_a", "id_b", score.alias("score"))
    keys = ["stem_a", "stem_b"]
    way = lambda c: s.groupBy(*keys, c).agg(F.max("score").alias("m")).groupBy(*keys).agg(F.avg("m").alias(c))
    return way("id_a").join(way("id_b"), keys).select(*keys, ((F.col("id_a") + F.col("id_b")) / 2).alias("score"))


def histogram_of(values, bins: int):
    """Normalised histogram of an array of whole numbers."""
    return normalised(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: total(F.transform(values, lambda v: (v == k).cast("double")))))

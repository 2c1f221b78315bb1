"""Node fingerprints, topology hashes and descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import cn_bucket

SHARING = ("corner", "edge", "face", "multi")
BINS = 18
HASH_LENGTH = 12
WEIGHTS = (0.25, 0.45, 0.30)


def _kind(mode: Column) -> Column:
    return F.when(mode.startswith("multi"), "multi").otherwise(mode)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, of) -> Column:
    """of(value), for which the value is worked out once however often it stands in the expression."""
    return F.transform(F.array(value), of)[0]


def normalised(a: Column) -> Column:
    return let(a, lambda v: let(total(v), lambda t: F.when(t > 0, F.transform(v, lambda x: x / t)).otherwise(v)))


def fingerprints(nodes: DataFrame, poly: DataFrame) -> DataFrame:
    """(stem, id, element, ion_role, cn, bucket, sharing, angles): fractions of sharing modes over incident polyhedral edges, and an 18-bin angle histogram.

    An edge of a node with its own image counts once.  Bins are
    min(rint(angle / 10), 17), rounding halves to even.
    """
    ends = poly.select("stem", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), _kind(F.col("mode_all")).alias("mode"), "angles")
    # A row for each angle; an edge counts by its first one, or by a row without an angle.
    ends = ends.select("stem", "id", "mode", F.posexplode_outer("angles").alias("pos", "angle")).withColumn("bin", F.least(F.rint(F.col("angle") / 10), F.lit(BINS - 1)).cast("int"))
    once = F.coalesce("pos", F.lit(0)) == 0
    bins = [f"_{k}" for k in range(BINS)]
    per = ends.groupBy("stem", "id").agg(*[F.count_if((F.col("mode") == m) & once).cast("double").alias(m) for m in SHARING], *[F.count_if(F.col("bin") == k).cast("double").alias(c) for k, c in enumerate(bins)])
    share = lambda names: F.array(*[F.when(sum(map(F.col, names)) > 0, F.col(c) / sum(map(F.col, names))).otherwise(F.col(c)) for c in names])
    per = per.select("stem", "id", share(SHARING).alias("sharing"), share(bins).alias("angles"))
    out = nodes.select("stem", "id", "element", "ion_role", "cn", cn_bucket(F.col("cn")).alias("bucket")).join(per, ["stem", "id"], "left")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return out.withColumn("sharing", F.coalesce("sharing", zeros(len(SHARING)))).withColumn("angles", F.coalesce("angles", zeros(BINS)))


def fingerprint_distance(cn_a: Column, sharing_a: Column, angles_a: Column, cn_b: Column, sharing_b: Column, angles_b: Column) -> Column:
    """0.25 |cn difference| / max(cn, 1) (1 at most) + 0.45 (1 - sum of minima / sum of maxima) + 0.30 half the L1 distance of the angles; two empty sharing vectors are equal."""
    pair = lambda f, a, b: total(F.zip_with(a, b, f))
    cn = F.least(F.abs(cn_a - cn_b) / F.greatest(cn_a, cn_b, F.lit(1)), F.lit(1.0))
    low, high = pair(lambda x, y: F.least(x, y), sharing_a, sharing_b), pair(lambda x, y: F.greatest(x, y), sharing_a, sharing_b)
    share = F.when(high > 0, 1 - low / high).otherwise(0.0)
    return WEIGHTS[0] * cn + WEIGHTS[1] * share + WEIGHTS[2] * pair(lambda x, y: F.abs(x - y), angles_a, angles_b) / 2


def fingerprint_costs(pairs: DataFrame, prints: DataFrame, same_bucket: bool = True) -> DataFrame:
    """(stem_a, stem_b, id_a, id_b, cost) for nodes of the pairs (stem_a, stem_b); inside coordination buckets only, if asked."""
    side = lambda x: prints.select(*[F.col(c).alias(f"{c}_{x}") for c in ("stem", "id", "cn", "bucket", "sharing", "angles")])
    j = pairs.select("stem_a", "stem_b").join(side("a").hint("merge"), "stem_a")
    on = (j["stem_b"] == F.col("r.stem_b")) & ((j["bucket_a"] == F.col("r.bucket_b")) if same_bucket else F.lit(True))
    j = j.join(side("b").alias("r").hint("merge"), on).select(j["stem_a"], j["stem_b"], "id_a", "id_b", *[f"{c}_{x}" for x in "ab" for c in ("cn", "sharing", "angles")])
    cost = fingerprint_distance(*[F.col(f"{c}_{x}") for x in "ab" for c in ("cn", "sharing", "angles")])
    return j.select("stem_a", "stem_b", "id_a", "id_b", F.round(cost, 9).alias("cost"))


def histogram_intersection(a: Column, b: Column) -> Column:
    """1 - half the L1 distance of the normalised histograms (arrays); both empty 1, one empty 0."""
    both = 1 - total(F.zip_with(normalised(a), normalised(b), lambda p, q: F.abs(F.coalesce(p, F.lit(0.0)) - F.coalesce(q, F.lit(0.0))))) / 2
    return F.when((total(a) == 0) & (total(b) == 0), 1.0).when((total(a) == 0) | (total(b) == 0), 0.0).otherwise(both)


def map_intersection(a: Column, b: Column) -> Column:
    """The same for maps from bin to count."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    values = lambda m: F.transform(keys, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0)).cast("double"))
    return histogram_intersection(values(a), values(b))


def resampled(values: Column, n: int) -> Column:
    """Linear interpolation of a sorted array to n points."""
    at = lambda i: (F.size(values) - 1) * (i / (n - 1) if n > 1 else F.lit(0.0))

    def point(i):
        x = at(i.cast("double"))
        low = F.floor(x).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
        return a + (b - a) * (x - low)

    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))


def list_similarity(a: Column, b: Column, scale: float, n: int = 16) -> Column:
    """exp(-mean |difference| / scale) of two sorted arrays resampled to n points; both empty 1, one empty 0."""
    gap = total(F.zip_with(resampled(a, n), resampled(b, n), lambda x, y: F.abs(x - y))) / n
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.exp(-gap / scale))


def core_graph(nodes: DataFrame, half: DataFrame, core_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Labels (stem, id, label = role_cn of core bonds) and half edges (stem, mid, nbr, n) with multiplicity."""
    kept = half.where("is_core") if core_only else half
    cn = kept.groupBy("stem", F.col("mid").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    labels = nodes.select("stem", "id", "ion_role").join(cn, ["stem", "id"], "left")
    labels = labels.select("stem", "id", F.concat_ws("_", F.coalesce("ion_role", F.lit("unknown")), F.coalesce("n", F.lit(0)).cast("string")).alias("label"))
    return labels, kept.groupBy("stem", "mid", "nbr").agg(F.count(F.lit(1)).cast("int").alias("n"))


def refined_labels(labels: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Labels after `depth` rounds of md5(label | sorted neighbour labels), cut to 12 digits.

    A round is one join of the edges with the labels and one aggregate per
    node; neighbours repeat by their multiplicity.
    """
    for _ in range(depth):
        near = edges.join(labels.select("stem", F.col("id").alias("nbr"), F.col("label").alias("l")), ["stem", "nbr"])
        near = near.groupBy("stem", F.col("mid").alias("id")).agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.array_repeat("l", F.col("n"))))), ",").alias("around"))
        text = F.concat("label", F.lit("|"), F.coalesce("around", F.lit("")))
        labels = labels.join(near, ["stem", "id"], "left").select("stem", "id", F.substring(F.md5(text), 1, HASH_LENGTH).alias("label"))
    return labels


def topology_hashes(nodes: DataFrame, half: DataFrame, depth: int = 3, core_only: bool = True) -> DataFrame:
    """(stem, topology): sorted labels with their counts divided by the greatest common divisor, so a supercell has its cell's hash."""
    from ..functions.scalar import gcd

    labels = refined_labels(*core_graph(nodes, half, core_only), depth)
    counts = labels.groupBy("stem", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("c"))
    g = gcd(F.transform("c", lambda x: x["n"]))
    return counts.select("stem", F.array_join(F.transform("c", lambda x: F.concat(x["label"], F.lit(":"), (x["n"] / g).cast("long").cast("string"))), ";").alias("topology"))


def neighbour_prints(nodes: DataFrame, half: DataFrame) -> DataFrame:
    """(stem, id, print): core coordination number and sorted neighbour elements with counts."""
    near = half.where("is_core").join(nodes.select("stem", F.col("id").alias("nbr"), F.col("element").alias("e")), ["stem", "nbr"])
    per = near.groupBy("stem", "mid", "e").agg(F.count(F.lit(1)).alias("n")).groupBy("stem", F.col("mid").alias("id")).agg(F.sum("n").alias("cn"), F.array_sort(F.collect_list(F.concat("e", F.col("n").cast("string")))).alias("e"))
    x = nodes.select("stem", "id").join(per, ["stem", "id"], "left")
    return x.select("stem", "id", F.concat(F.coalesce("cn", F.lit(0)).cast("string"), F.lit("|"), F.coalesce(F.array_join("e", ","), F.lit(""))).alias("print"))


def descriptors(nodes: DataFrame, half: DataFrame, poly: DataFrame) -> DataFrame:
    """(stem, id, role, cn, core_fraction, neighbour_cn, angles5, sharing, voronoi4, ratios, angles): the node descriptors that graph similarities compare."""
    cn = nodes.select("stem", F.col("id").alias("nbr"), F.col("cn").cast("string").alias("c"))
    near = half.join(cn, ["stem", "nbr"])
    quarter = F.least(F.floor(F.coalesce("vw", F.lit(0.0)) * 4), F.lit(3)).cast("int")
    per = near.groupBy("stem", F.col("mid").alias("id")).agg(
        F.avg(F.col("is_core").cast("double")).alias("core_fraction"), F.collect_list("c").alias("cs"), F.collect_list(quarter).alias("q"), F.array_sort(F.collect_list(F.round(F.col("len"), 6))).alias("lengths")
    )
    ends = poly.select("stem", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), _kind(F.col("mode_all")).alias("mode"), "angles")
    second = ends.groupBy("stem", "id").agg(F.collect_list("mode").alias("modes"), F.array_sort(F.flatten(F.collect_list("angles"))).alias("angles"))
    counts = lambda c, keys: F.transform(keys, lambda k: F.size(F.filter(c, lambda x: x == k)).cast("double"))
    tally = lambda c: F.map_from_entries(F.transform(F.array_distinct(c), lambda k: F.struct(k.alias("k"), F.size(F.filter(c, lambda x: x == k)).alias("n"))))
    x = nodes.select("stem", "id", F.col("ion_role").alias("role"), "element", "cn").join(per, ["stem", "id"], "left").join(second, ["stem", "id"], "left")
    for c, kind in (("cs", "string"), ("q", "int"), ("lengths", "double"), ("modes", "string"), ("angles", "double")):
        x = x.withColumn(c, F.coalesce(c, F.array().cast(f"array<{kind}>")))
    mean = total(F.col("lengths")) / F.greatest(F.size("lengths"), F.lit(1))
    bins = F.transform("angles", lambda a: F.least(F.floor(a / 36), F.lit(4)).cast("int"))
    return x.select(
        "stem", "id", "role", "element", "cn", F.coalesce("core_fraction", F.lit(0.0)).alias("core_fraction"), tally(F.col("cs")).alias("neighbour_cn"),
        counts(bins, F.array(*map(F.lit, range(5)))).alias("angles5"), counts(F.col("modes"), F.array(*map(F.lit, SHARING))).alias("sharing"), counts(F.col("q"), F.array(*map(F.lit, range(4)))).alias("voronoi4"),
        F.transform("lengths", lambda l: l / mean).alias("ratios"), "angles",
    )


def equivalence_classes(prints: DataFrame, within: float = 0.05) -> DataFrame:
    """(stem, id, class): nodes of one element, role and bucket linked by fingerprint distances below `within`, named by the smallest id of the class."""
    from .cluster import components

    side = lambda x: prints.select("stem", "element", "ion_role", "bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "cn", "sharing", "angles")])
    pairs = side("a").join(side("b"), ["stem", "element", "ion_role", "bucket"]).where("id_a < id_b")
    near = pairs.where(fingerprint_distance(*[F.col(f"{c}_{x}") for x in "ab" for c in ("cn", "sharing", "angles")]) < within)
    name = lambda c: F.struct("stem", F.col(c).alias("id"))
    labels = components(near.select(name("id_a").alias("a"), name("id_b").alias("b")))
    flat = labels.select(F.col("node.stem").alias("stem"), F.col("node.id").alias("id"), F.col("label.id").alias("class"))
    return prints.select("stem", "id").join(flat, ["stem", "id"], "left").select("stem", "id", F.coalesce("class", "id").alias("class"))

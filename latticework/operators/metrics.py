"""Metrics and flags of graphs and materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDEAL_ANGLES = (60.0, 90.0, 120.0, 180.0)
# Anions that are assumed where roles are missing.
FALLBACK_ANIONS = ("O", "F", "S", "Se", "Cl", "Br", "I", "N")


def angle_distortion(poly: DataFrame) -> DataFrame:
    """(stem, distortion): population deviation of the distances of all angles from the nearest ideal angle; 0 below two angles."""
    a = poly.select("stem", F.explode("angles").alias("angle"))
    away = F.least(*[F.abs(F.col("angle") - x) for x in IDEAL_ANGLES])
    return a.groupBy("stem").agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.stddev_pop(away)).alias("distortion"))


def bond_distortion(bonds: DataFrame) -> DataFrame:
    """(stem, distortion): mean of |length / sum of radii - 1| over bonds with a ratio; null without any."""
    return bonds.groupBy("stem").agg(F.avg(F.abs(F.col("ratio") - 1)).alias("distortion"))


def flags(nodes: DataFrame) -> DataFrame:
    """(stem, intermetallic, oxide): no cation or anion at all; an anion that is oxygen or holds it."""
    ionic = F.coalesce(F.col("ion_role").isin("cation", "anion"), F.lit(False))
    oxygen = (F.col("ion_role") == "anion") & ((F.col("element") == "O") | F.coalesce(F.exists("species", lambda s: s["symbol"] == "O"), F.lit(False)))
    return nodes.groupBy("stem").agg((~F.bool_or(ionic)).alias("intermetallic"), F.coalesce(F.bool_or(oxygen), F.lit(False)).alias("oxide"))


def species_averages(nodes: DataFrame, null_radius_as_zero: bool = False) -> DataFrame:
    """(stem, oxidation, radius, cn): maps from element to the mean over its nodes; nulls are skipped, or zero for radii if asked."""
    radius = F.coalesce("shannon_r", F.lit(0.0)) if null_radius_as_zero else F.col("shannon_r")
    per = nodes.groupBy("stem", "element").agg(F.avg("oxidation_state").alias("o"), F.avg(radius).alias("r"), F.avg("cn").alias("c"))
    as_map = lambda c: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("element", c)), lambda x: x[c].isNotNull())))
    return per.groupBy("stem").agg(as_map("o").alias("oxidation"), as_map("r").alias("radius"), as_map("c").alias("cn"))


def cn_bucket(cn: Column) -> Column:
    return F.when(cn <= 4, "tet").when(cn <= 6, "oct").otherwise("high")


def buckets(nodes: DataFrame, cn: str = "cn") -> DataFrame:
    """(stem, bucket, role, ids): nodes by coordination bucket and role."""
    return nodes.groupBy("stem", cn_bucket(F.col(cn)).alias("bucket"), F.col("ion_role").alias("role")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


#: Names of coordination shells by number of bonds, and mean angles (or wide ones) from which a name holds.
SHELL_NAMES = {
    1: [(None, "mono")],
    2: [(160, "linear"), (None, "bent")],
    3: [(115, "trig.plan."), (95, "trig.pyr."), (None, "T-shaped")],
    4: [(105, "tetrahedral"), (None, "sq.planar")],
    5: [(100, "trig.bipyr."), (None, "sq.pyr.")],
    7: [(None, "pent.bipyr.")],
    8: [(None, "sq.antipr.")],
    9: [(None, "tricap.TP")],
    12: [(None, "cubocta.")],
}
WIDE = 135


def geometry(cn: Column, mean_angle: Column, wide: Column) -> Column:
    """Label of a coordination shell from its number of bonds, mean angle, and how many angles are WIDE or wider; empty without bonds."""
    label = F.when(cn <= 0, "")
    for n, names in SHELL_NAMES.items():
        for least, name in names:
            fits = cn == n if least is None else (cn == n) & ((mean_angle > least) if (n, least) != (3, 95) else (mean_angle >= least))
            label = label.when(fits, name)
    label = label.when((cn == 6) & (wide >= 2), "octahedral").when(cn == 6, "trig.pris.")
    return label.otherwise(F.concat(F.lit("CN"), cn.cast("string")))


def shell_angles(half: DataFrame) -> DataFrame:
    """(stem, id, cn, mean_angle, straight, wide, label) of each node's shell; straight angles are above 160 degrees."""
    from .graph import dot

    ends = half.groupBy("stem", F.col("mid").alias("id")).agg(F.collect_list(F.struct("vec", "len")).alias("h"))
    cosine = lambda x, y: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x["vec"], y["vec"]) / (x["len"] * y["len"])))
    angles = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: F.degrees(F.acos(cosine(x, y))))))
    x = ends.select("stem", "id", F.size("h").alias("cn"), angles.alias("angles"))
    mean = F.aggregate("angles", F.lit(0.0), lambda s, a: s + a) / F.greatest(F.size("angles"), F.lit(1))
    above = lambda test: F.size(F.filter("angles", test))
    x = x.select("stem", "id", "cn", F.round(mean, 4).alias("mean_angle"), above(lambda a: a > 160).alias("straight"), above(lambda a: a >= WIDE).alias("wide"))
    return x.withColumn("label", geometry(F.col("cn"), F.col("mean_angle"), F.col("wide")))


def collapsed(nodes: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one element and coordination number as one, the smallest id, with their bonds merged by pair: sphere core, extended or mixed."""
    rep = F.min("id").over(Window.partitionBy("stem", "element", "cn")).alias("rep")
    to = nodes.select("stem", "id", rep)
    kept = to.groupBy("stem", F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    x = bonds.join(to.select("stem", F.col("id").alias("source"), F.col("rep").alias("s")), ["stem", "source"]).join(to.select("stem", F.col("id").alias("target"), F.col("rep").alias("t")), ["stem", "target"])
    spheres = F.collect_set("sphere")
    merged = x.groupBy("stem", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(
        F.count(F.lit(1)).alias("images"), F.when(F.size(spheres) > 1, "mixed").otherwise(spheres[0]).alias("sphere"), F.min("bond_length").alias("length")
    )
    return kept, merged


def bonds_of(bonds: DataFrame, sphere: str = "all") -> DataFrame:
    """Bonds of a sphere: core, extended, all or none."""
    if sphere not in ("core", "extended", "all", "none"):
        raise ValueError(sphere)
    return bonds if sphere == "all" else bonds.where(F.lit(False)) if sphere == "none" else bonds.where(F.col("sphere") == sphere)


def poly_of(poly: DataFrame, modes: tuple[str, ...], column: str = "mode_all") -> DataFrame:
    return poly.where(F.col(column).isin(*modes))


def topology_set(nodes: DataFrame) -> DataFrame:
    """(stem, fp): the set of (role, coordination number); two graphs can only match if their sets meet."""
    return nodes.groupBy("stem").agg(F.array_sort(F.collect_set(F.concat_ws(":", "ion_role", F.col("cn").cast("string")))).alias("fp"))


def site_table(nodes: DataFrame) -> DataFrame:
    """(stem, element, role, amount, oxi, radius, cn): elements with their role, by the sign of the oxidation state, else by the list of anions."""
    per = nodes.groupBy("stem", "element").agg(F.count(F.lit(1)).alias("amount"), F.avg("oxidation_state").alias("oxi"), F.avg("shannon_r").alias("radius"), F.avg("cn").alias("cn"))
    role = F.when(F.col("oxi") > 0, "cation").when(F.col("oxi") < 0, "anion").when(F.col("element").isin(*FALLBACK_ANIONS), "anion").otherwise("cation")
    return per.withColumn("role", role)


def abx_sites(nodes: DataFrame, by: str = "radius", binary: bool = True) -> DataFrame:
    """(stem, a, b, x): A the larger cation, B the next, X the anion.

    Cations by (radius, cn), or (cn, radius) with by='cn', largest first; the
    anion by the most negative state, then cn, radius and name.  With one
    cation only it is B, and A is the anion; binary=False leaves it A, and B null.
    """
    sites = site_table(nodes)
    keys = ("radius", "cn") if by == "radius" else ("cn", "radius")
    cations = F.row_number().over(Window.partitionBy("stem", "role").orderBy(*[F.col(k).desc_nulls_last() for k in keys], "element"))
    anions = F.row_number().over(Window.partitionBy("stem", "role").orderBy(F.col("oxi").asc_nulls_last(), F.col("cn").desc_nulls_last(), F.col("radius").desc_nulls_last(), "element"))
    x = sites.withColumn("rank", F.when(F.col("role") == "cation", cations).otherwise(anions))
    site = lambda role, k, name: F.max(F.when((F.col("role") == role) & (F.col("rank") == k), F.struct("element", "radius", "cn", "oxi"))).alias(name)
    found = x.groupBy("stem").agg(site("cation", 1, "a"), site("cation", 2, "b"), site("anion", 1, "x"))
    lone = F.lit(binary) & F.col("a").isNotNull() & F.col("b").isNull()
    return found.select("stem", F.when(lone, F.col("x")).otherwise(F.col("a")).alias("a"), F.when(lone, F.col("a")).otherwise(F.col("b")).alias("b"), "x")


def abx_214(nodes: DataFrame) -> DataFrame:
    """(stem, a, b, x) of 2:1:4 compounds by their amounts; other sites as abx_sites."""
    from ..functions.scalar import gcd

    sites = site_table(nodes)
    g = F.greatest(gcd(F.collect_list("amount").over(Window.partitionBy("stem"))), F.lit(1))
    sites = sites.withColumn("unit", (F.col("amount") / g).cast("long"))
    pick = lambda role, n, name: F.max(F.when((F.col("role") == role) & (F.col("unit") == n), F.struct("cn", "radius", "element", "oxi"))).alias(name)
    sites = sites.withColumn("units", F.array_sort(F.collect_list("unit").over(Window.partitionBy("stem"))))
    by_amount = sites.where("units = array(1L, 2L, 4L)").groupBy("stem").agg(pick("cation", 2, "a2"), pick("cation", 1, "b2"), pick("anion", 4, "x2"))
    same = lambda c: F.when(F.col(f"{c}2").isNotNull(), F.struct(F.col(f"{c}2.element"), F.col(f"{c}2.radius"), F.col(f"{c}2.cn"), F.col(f"{c}2.oxi")))
    return abx_sites(nodes, binary=False).join(by_amount, "stem", "left").select("stem", *[F.coalesce(same(c), F.col(c)).alias(c) for c in "abx"])


def only_anion(nodes: DataFrame, symbol: str = "O") -> DataFrame:
    """(stem): materials whose sole anion is the given one."""
    anions = site_table(nodes).where("role = 'anion'").groupBy("stem").agg(F.collect_set("element").alias("e"))
    return anions.where(F.col("e") == F.array(F.lit(symbol))).select("stem")


def best_family(scores: DataFrame, columns: list[str], least: float) -> DataFrame:
    """Adds family and score: the highest of several score columns, 'Other' below `least`, null without scores; ties go to the first column."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("rank"), F.lit(c).alias("name")) for i, c in enumerate(columns)]))
    return scores.withColumn("score", best["score"]).withColumn("family", F.when(best["score"] >= least, best["name"]).when(best["score"].isNotNull(), "Other"))


def tolerance_factors(r_a12: Column, r_a9: Column, r_b: Column, r_x: Column) -> dict[str, Column]:
    """Goldschmidt's factor, and three ratios for layered perovskites, of radii of A at coordination 12 and 9, B and X."""
    cube = lambda r: F.pow(r, F.lit(3.0))
    return {
        "goldschmidt": (r_a12 + r_x) / (F.sqrt(F.lit(2.0)) * (r_b + r_x)),
        "layer_volume": (cube(r_a9) + cube(r_x)) / (cube(r_a12) + cube(r_b) + 3 * cube(r_x)),
        "ac_ratio": (r_b + r_x) / (2 * (r_b + r_x + r_a9)),
        "other_paper": F.pow(r_b / r_a12, F.lit(2.0)) + F.sqrt(r_x / r_b),
    }


def overlay(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates that are not known yet."""
    return candidates.join(known.select(key), key, "left_anti")

"""Neighbours of all sites within a cut-off as a range join: cell lists and an equi join of grid keys.

Every site's periodic images that may lie within the cut-off of the box of all
sites are rows, named by the cube of the cut-off's size in which they stand; each
site looks into the 27 cubes around its own.  Work and rows grow with sites times
neighbours, and a large structure is as many tasks as its cubes make keys.  The
images of structures of at most SMALL sites meet the sites in the structure's own
row, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dot

CUTOFF = 8.0
SMALL = 32


def cross(a: Column, b: Column) -> Column:
    part = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(part(1, 2), part(2, 0), part(0, 1))


def within(structures: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(stem, id, nbr, img, dist) of structures (stem, lattice, sites (id, frac)); each pair from both ends, a site's own images included.

    Structures without a lattice of some volume, or without sites, have no rows.
    """
    a, b, c = (F.col("lattice")[i] for i in range(3))
    sides = [(b, c), (c, a), (a, b)]
    volume = F.abs(dot(a, cross(b, c)))
    reach = [F.ceil(F.lit(cutoff) * F.sqrt(dot(cross(p, q), cross(p, q))) / volume).cast("int") for p, q in sides]
    shift = lambda s, i: F.floor(s["frac"][i]).cast("int")
    at = lambda s, i: sum((s["frac"][k] - shift(s, k)) * F.col("lattice")[k][i] for k in range(3))
    homes = F.transform("sites", lambda s: F.struct(s["id"].alias("id"), *[at(s, i).alias(f"h{i}") for i in range(3)], *[shift(s, i).alias(f"m{i}") for i in range(3)]))
    cells = structures.where(volume > 1e-9).select("stem", "lattice", "sites", *[r.alias(f"_n{i}") for i, r in enumerate(reach)], homes.alias("_homes"))
    ends = lambda f, sign: [(f(F.col("_homes")[f"h{i}"]) + sign * (cutoff + 1e-6)).alias(f"_{'l' if sign < 0 else 'u'}{i}") for i in range(3)]
    cells = cells.select("*", *ends(F.array_min, -1), *ends(F.array_max, 1))
    few, many = cells.where(F.size("sites") <= SMALL), cells.where(F.size("sites") > SMALL)
    dist = lambda h: F.sqrt(sum(F.pow(F.col(f"_t{i}") - h(i), 2) for i in range(3)))
    found = (F.col("dist") <= cutoff) & (F.col("dist") > 1e-6)

    pairs = _images(few, "_homes").withColumn("_h", F.explode("_homes")).withColumn("dist", dist(lambda i: F.col(f"_h.h{i}"))).where(found)
    near = pairs.select("stem", F.col("_h.id").alias("id"), "nbr", F.array(*[(F.col(f"_b{i}") + F.col(f"_h.m{i}")).cast("int") for i in range(3)]).alias("img"), "dist")

    cube = lambda columns: [F.floor(v / cutoff).cast("long") for v in columns]
    images = _images(many).select("stem", "nbr", *[f"_{c}{i}" for c in "bt" for i in range(3)], *[g.alias(f"_g{i}") for i, g in enumerate(cube([F.col(f"_t{i}") for i in range(3)]))])
    own = many.select("stem", F.explode("_homes").alias("_h")).select("stem", "_h.*")
    for i, g in enumerate(cube([F.col(f"h{i}") for i in range(3)])):
        own = own.withColumn(f"_g{i}", F.explode(F.sequence(g - 1, g + 1)))
    # Both sides grow with the sites, whatever the size of the files they come from.
    j = own.join(images.hint("merge"), ["stem", "_g0", "_g1", "_g2"]).withColumn("dist", dist(lambda i: F.col(f"h{i}"))).where(found)
    far = j.select("stem", "id", "nbr", F.array(*[(F.col(f"_b{i}") + F.col(f"m{i}")).cast("int") for i in range(3)]).alias("img"), "dist")
    return near.unionByName(far)


def _images(cells: DataFrame, *more: str) -> DataFrame:
    """(stem, nbr, image, place) of the images of all sites in the box of their cell's sites and the cut-off around it."""
    # Sites are folded into the cell; what that moves is put back into the image.
    box = [f"_{c}{i}" for c in "nlu" for i in range(3)]
    x = cells.select("stem", "lattice", *more, *box, F.explode("sites").alias("s"))
    folds = [F.floor(F.col("s.frac")[i]).cast("int") for i in range(3)]
    x = x.select("stem", "lattice", *more, *box, F.col("s.id").alias("nbr"), *[(F.col("s.frac")[i] - folds[i]).alias(f"_f{i}") for i in range(3)], *[folds[i].alias(f"_m{i}") for i in range(3)])
    # A folded site lies inside the cell, so images up to the reach and one more on either side are enough.
    for i, s in enumerate("ijk"):
        x = x.withColumn(f"_{s}", F.explode(F.sequence(-F.col(f"_n{i}") - 1, F.col(f"_n{i}") + 1)))
    there = [sum((F.col(f"_f{k}") + F.col(f"_{s}")) * F.col("lattice")[k][i] for k, s in enumerate("ijk")) for i in range(3)]
    x = x.select("stem", *more, *box, "nbr", *[(F.col(f"_{s}") - F.col(f"_m{i}")).alias(f"_b{i}") for i, s in enumerate("ijk")], *[t.alias(f"_t{i}") for i, t in enumerate(there)])
    for i in range(3):
        x = x.where(F.col(f"_t{i}").between(F.col(f"_l{i}"), F.col(f"_u{i}")))
    return x

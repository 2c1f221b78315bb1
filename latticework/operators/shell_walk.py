"""The topology cost of mappings: bonds by element under a mapping, paid for by a walk through ever farther neighbours.

For each pair of partners the bonds of both atoms are counted by the element of
b that their other ends have (through the mapping on a's side).  Where one side
has more bonds to an element, the other side's atom must take up the rest: the
walk goes through its neighbours beyond the bonded shell, nearest first, takes
one bond for each of the wanted element free of charge, and pays SKIP for each
other atom that it passes; bonds that are left at the end of the list cost
LOST each.  Bonds to atoms without a partner cost their share of the
coordination number.  The cost of a mapping is the mean over its pairs, so a
supercell costs what its cell does, and one for each atom without a partner that
is no vacancy.  Bonds between anions of a high Voronoi weight are not taken up
by neighbours that merely stand near (`strict`; without it the first version's
rule).

An atom is one row with its bonds and its outer shell as arrays of bounded
length (at most 14 bonds and 20 neighbours), and a pair of partners is one row
with both; the walk is a higher-order aggregate, so all joins are by stem and
atom and no shell is exploded.  All sides grow with the number of atoms, and
arrays are far larger than their files or blocks, by whose size Spark takes
tables for small: joins are merges, so nothing is gathered in the driver.  Views
cost more than the walk, so they are made once, and a cell is sent as one row to
each mapping that it is in; the rest of a mapping's cost needs no further join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKIP, LOST, UNASSIGNED_COST, VACANCY_COST = 0.1, 1.0, 1.0, 0.0
ECN_LEAST = 0.005
ANION_WEIGHT = 0.08


def atom_views(nodes: DataFrame, half: DataFrame, near: DataFrame) -> DataFrame:
    """(stem, id, element, bonds, outer): each atom's bonds (nbr, n, anions) and the neighbours beyond its bonded shell, nearest first.

    Of the images of a neighbour in `near` (stem, id, rank, nbr), as many as
    there are bonds to it belong to the bonded shell.  anions: both ends are
    anions, and one of the bonds has a Voronoi weight of ANION_WEIGHT or more.
    """
    ends = Window.partitionBy("stem", "eid")
    best = lambda c, default: F.max(F.coalesce(c, F.lit(default))).over(ends)
    strong = half.select("stem", F.col("mid").alias("id"), "nbr", best("ecn", 1.0).alias("_w"), best("vw", 0.0).alias("_v")).where(F.col("_w") >= ECN_LEAST)
    bonds = strong.groupBy("stem", "id", "nbr").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.max("_v") >= ANION_WEIGHT).alias("heavy"))
    lists = bonds.groupBy("stem", "id").agg(F.sort_array(F.collect_list(F.struct("nbr", "n", "heavy"))).alias("_bonds"))
    close = near.groupBy("stem", "id").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr"))).alias("_near"))
    anions = nodes.where("ion_role = 'anion'").groupBy("stem").agg(F.collect_list("id").alias("_anions"))
    x = nodes.select("stem", "id", "element", (F.col("ion_role") == "anion").alias("_own")).join(lists.hint("merge"), ["stem", "id"], "left").join(close.hint("merge"), ["stem", "id"], "left").join(anions.hint("merge"), "stem", "left")
    # Lists of one atom are short: what belongs to its bonded shell is taken out of them without a further join.
    bonded = F.flatten(F.transform("_bonds", lambda b: F.slice(F.filter("_near", lambda y: y["nbr"] == b["nbr"]), 1, b["n"])))
    outer = F.transform(F.coalesce(F.array_except("_near", bonded), F.col("_near")), lambda y: y["nbr"])
    far = lambda b: F.coalesce(F.col("_own"), F.lit(False)) & F.coalesce(F.array_contains("_anions", b["nbr"]), F.lit(False))
    kept = F.transform("_bonds", lambda b: F.struct(b["nbr"].alias("nbr"), b["n"].alias("n"), (b["heavy"] & far(b)).alias("anions")))
    none = "array<struct<nbr:int,n:int,anions:boolean>>"
    return x.select("stem", "id", "element", F.coalesce(kept.cast(none), F.array().cast(none)).alias("bonds"), F.coalesce(outer.cast("array<int>"), F.array().cast("array<int>")).alias("outer"))


def walk(outer: Column, element: Column, needed: Column, closed: Column) -> Column:
    """Cost of `needed` more bonds to `element` from a list of elements, nearest first; closed: none may be taken up."""
    start = F.struct(needed.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def step(s, x):
        fits = F.coalesce(x == element, F.lit(False))
        left = F.when(fits & ~closed, s["left"] - F.least(F.lit(1.0), s["left"])).otherwise(s["left"])
        cost = F.when(fits, s["cost"]).otherwise(s["cost"] + SKIP)
        return F.when(s["left"] > 1e-9, F.struct(left.alias("left"), cost.alias("cost"))).otherwise(s)

    return F.aggregate(outer, start, step, lambda s: s["cost"] + F.when(s["left"] > 1e-9, s["left"] * LOST).otherwise(0.0))


def _by_element(bonds: Column, of) -> Column:
    """Bonds as (element, n, anions), without those whose other end has no partner."""
    return F.filter(F.transform(bonds, lambda b: F.struct(of(b["nbr"]).alias("e"), b["n"].alias("n"), b["anions"].alias("anions"))), lambda b: b["e"].isNotNull())


_total = lambda bonds: F.aggregate(bonds, F.lit(0), lambda s, b: s + b["n"])


def _meeting(mappings: DataFrame, views: DataFrame) -> DataFrame:
    """(stem_a, stem_b, pairs, atoms_a, atoms_b): a row for each mapping, with its pairs of partners in order and the views of both cells.

    Views are made once: a cell goes to the mappings that it is in, as one row.
    """
    keys = ["stem_a", "stem_b"]
    cells = views.groupBy("stem").agg(F.collect_list(F.struct("id", "element", "bonds", "outer")).alias("atoms"))
    pairs = mappings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a_id", "slot", "b_id", "slot_kind"))).alias("pairs"))
    ends = F.array(*[F.struct(F.lit(s == "a").alias("first"), F.col(f"stem_{s}").alias("stem"), (F.col("pairs") if s == "a" else F.lit(None)).alias("pairs")) for s in "ab"])
    sent = pairs.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").join(cells.hint("merge"), "stem")
    side = lambda first, c: F.first(F.when(F.col("first") == first, F.col(c)), ignorenulls=True)
    met = sent.groupBy(*keys).agg(side(True, "pairs").alias("pairs"), side(True, "atoms").alias("atoms_a"), side(False, "atoms").alias("atoms_b"))
    return met.where("pairs is not null and atoms_a is not null and atoms_b is not null")


def pair_costs(mappings: DataFrame, views: DataFrame, strict: bool = True) -> DataFrame:
    """(stem_a, stem_b, a_id, slot, b_id, cost) of every pair of partners; an atom of several partners counts by its first."""
    return _pair_costs(_meeting(mappings, views), strict).select("stem_a", "stem_b", "a_id", "slot", "b_id", "cost")


def _pair_costs(met: DataFrame, strict: bool) -> DataFrame:
    """Costs of the pairs of mappings, with the columns of `met` beside them."""
    by_id = lambda atoms, of: F.map_from_entries(F.transform(atoms, lambda x: F.struct(x["id"].alias("id"), of(x).alias("of"))))
    # Of the bounded number of atoms of one cell: the element of each one's first partner, and b's atoms with a partner.
    x = met.withColumn("elements", by_id("atoms_b", lambda x: x["element"]))
    x = x.withColumn("_all", F.filter("pairs", lambda p: (p["slot_kind"] == "real") & p["a_id"].isNotNull() & F.map_contains_key("elements", p["b_id"])))
    firsts = F.filter("_all", lambda p, i: (i == 0) | (p["a_id"] != F.get(F.col("_all"), i - 1)["a_id"]))
    x = x.withColumn("carried", F.map_from_entries(F.transform(firsts, lambda p: F.struct(p["a_id"], F.try_element_at("elements", p["b_id"])))))
    x = x.withColumn("reached", F.map_filter("elements", lambda k, _: F.exists("_all", lambda p: p["b_id"] == k)))
    for s in "ab":
        x = x.withColumn(f"_of_{s}", by_id(f"atoms_{s}", lambda x: F.struct(x["bonds"].alias("bonds"), x["outer"].alias("outer"))))
    x = x.select(*met.columns, "elements", "carried", "reached", "_of_a", "_of_b", F.explode("_all").alias("p")).select("*", "p.a_id", "p.slot", "p.b_id")
    for s in "ab":
        x = x.withColumn(f"_own_{s}", F.try_element_at(f"_of_{s}", f"{s}_id"))
    x = x.where("_own_a is not null and _own_b is not null")
    x = x.select("*", *[F.col(f"_own_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("bonds", "outer")])
    carried = lambda n: F.try_element_at("carried", n)
    x = x.withColumn("_a", _by_element(F.col("bonds_a"), carried)).withColumn("_b", _by_element(F.col("bonds_b"), lambda n: F.try_element_at("reached", n)))
    x = x.withColumn("_near_a", F.transform("outer_a", carried)).withColumn("_near_b", F.transform("outer_b", lambda n: F.try_element_at("elements", n)))
    count = lambda c, e: F.aggregate(F.filter(c, lambda b: b["e"] == e), F.lit(0), lambda s, b: s + b["n"])
    closed = lambda c, e: F.exists(c, lambda b: (b["e"] == e) & b["anions"]) if strict else F.lit(False)

    def of(e):
        gap = count("_a", e) - count("_b", e)
        return F.when(gap > 0, walk(F.col("_near_b"), e, gap, closed("_a", e))).when(gap < 0, walk(F.col("_near_a"), e, -gap, closed("_b", e))).otherwise(0.0)

    kinds = F.array_distinct(F.concat(F.transform("_a", lambda b: b["e"]), F.transform("_b", lambda b: b["e"])))
    loose = (_total(F.col("bonds_a")) - _total(F.col("_a")) + _total(F.col("bonds_b")) - _total(F.col("_b"))) / F.greatest(_total(F.col("bonds_a")), _total(F.col("bonds_b")), F.lit(1))
    return x.select(*met.columns, "a_id", "slot", "b_id", (F.aggregate(F.transform(kinds, of), F.lit(0.0), lambda s, v: s + v) + loose).alias("cost"))


def topology_costs(mappings: DataFrame, views: DataFrame, strict: bool = True) -> DataFrame:
    """(stem_a, stem_b, pairs, cost) of mappings (stem_a, stem_b, a_id, slot, b_id, slot_kind).

    Rows with a null b_id or a null a_id name atoms without a partner by their
    slot_kind: vacancies cost VACANCY_COST, all others UNASSIGNED_COST, whether
    they are named or not.  A mapping without real pairs has no row.
    """
    met = _meeting(mappings, views)

    def lone(s: str) -> Column:
        """What the atoms of one side without a partner cost, by the best kind that each is named by."""
        named = lambda x, kind: F.exists("pairs", lambda p: (p[f"{s}_id"] == x["id"]) & (p["slot_kind"] == kind))
        price = lambda x: F.when(named(x, "real"), 0.0).when(named(x, "vacancy"), VACANCY_COST).otherwise(UNASSIGNED_COST)
        return F.aggregate(f"atoms_{s}", F.lit(0.0), lambda t, x: t + price(x))

    alone = met.select("stem_a", "stem_b", "pairs", "atoms_a", "atoms_b", (lone("a") + lone("b")).alias("lone"))
    costs = _pair_costs(alone, strict).groupBy("stem_a", "stem_b").agg(F.count(F.lit(1)).alias("pairs"), F.avg("cost").alias("mean"), F.first("lone").alias("lone"))
    return costs.select("stem_a", "stem_b", "pairs", (F.col("mean") + F.col("lone")).alias("cost"))

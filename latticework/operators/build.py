"""Graphs from structures: roles, periodic neighbours with Voronoi weights, and the choice of bonds.

Geometry is one function for each structure (numpy); the rules that choose
bonds are column expressions and windows over its rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import with_spheres

RADIUS = 8.0
VORONOI_MOST = 80
BOND_RATIO = 2.0
SAME_ROLE = 1.15
OPPOSITE_ROLE = 1.2
STRONG = 0.08
WEIGHT_LEAST = 0.005
CAP = 14
FALLBACK_ANIONS = ("O", "F", "S", "Se", "Cl", "Br")


def weighted_average(species: Column, value: str) -> Column:
    """Occupancy-weighted mean of a field of a species array; nulls are skipped, null below a weight of 1e-8."""
    known = F.filter(species, lambda s: s[value].isNotNull())
    weight = F.aggregate(known, F.lit(0.0), lambda t, s: t + s["occupancy"])
    total = F.aggregate(known, F.lit(0.0), lambda t, s: t + s["occupancy"] * s[value])
    return F.when(weight >= 1e-8, total / weight)


def dominant(species: Column) -> Column:
    """Symbol of the species with the highest occupancy; the first of equals."""
    return F.aggregate(species, F.lit(None).cast("struct<s:string,o:double>"), lambda b, s: F.when(b.isNull() | (s["occupancy"] > b["o"]), F.struct(s["symbol"].alias("s"), s["occupancy"].alias("o"))).otherwise(b), lambda b: b["s"])


def whole_state(oxi: Column) -> Column:
    """Oxidation states within 1e-8 of a whole number become it."""
    return F.when(F.abs(oxi - F.rint(oxi)) < 1e-8, F.rint(oxi)).otherwise(oxi)


def site_table(structures: DataFrame, source: str = "given") -> DataFrame:
    """(stem, id, element, species, is_disordered, oxidation_state, ion_role, frac).

    Roles follow the sign of the oxidation state; without any states, common
    anions are anions and the rest cations where both kinds occur; states that
    were guessed (column oxi_source, or `source` for all) and leave neutral
    beside charged sites make all neutral.
    """
    origin = F.col("oxi_source") if "oxi_source" in structures.columns else F.lit(source)
    s = structures.where("error is null").select("stem", origin.alias("_origin"), F.explode("sites").alias("s")).select("stem", "_origin", "s.*")
    s = s.withColumn("oxidation_state", whole_state(weighted_average(F.col("species"), "oxi_state"))).withColumn("element", dominant(F.col("species")))
    w = Window.partitionBy("stem")
    guessed = F.col("_origin").startswith("composition_guess")
    stated = (F.max(F.exists("species", lambda x: x["explicit"]).cast("int")).over(w) == 1) | guessed
    sign = F.when(F.col("oxidation_state") > 1e-8, "cation").when(F.col("oxidation_state") < -1e-8, "anion").otherwise("neutral")
    by_list = F.when(F.col("element").isin(*FALLBACK_ANIONS), "anion").otherwise("cation")
    both = F.size(F.collect_set(by_list).over(w)) > 1
    role = F.when(stated, sign).when(both, by_list).otherwise("neutral")
    s = s.withColumn("ion_role", role)
    mixed = guessed & F.array_contains(F.collect_set("ion_role").over(w), "neutral") & (F.size(F.collect_set("ion_role").over(w)) > 1)
    s = s.withColumn("ion_role", F.when(mixed, "neutral").otherwise(F.col("ion_role")))
    return s.select("stem", "id", "element", "species", (F.size("species") > 1).alias("is_disordered"), "oxidation_state", "ion_role", "frac")


def _clip(polygon: list, normal: np.ndarray, offset: float) -> list:
    """The part of a polygon (points in a plane) where normal . x <= offset."""
    out = []
    for p, q in zip(polygon, polygon[1:] + polygon[:1]):
        a, b = normal @ p - offset, normal @ q - offset
        if a <= 0:
            out.append(p)
        if a * b < 0:
            out.append(p + (q - p) * (a / (a - b)))
    return out


def voronoi_areas(vectors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Face areas of the cell around the origin for planes at offsets[k] along vectors[k]; unbounded faces and missing ones are 0.

    A face starts as a large square in its plane and is cut by the other
    planes from near to far, until none can reach it.
    """
    length = np.linalg.norm(vectors, axis=1)
    normal = vectors / length[:, None]
    order = np.argsort(offsets, kind="stable")
    far = 50.0 * max(1.0, float(np.abs(offsets).max()))
    areas = np.zeros(len(vectors))
    for k in range(len(vectors)):
        n, d = normal[k], offsets[k]
        u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
        u /= np.linalg.norm(u)
        v = np.cross(n, u)
        face = [n * d + far * (s * u + t * v) for s, t in ((1, 1), (-1, 1), (-1, -1), (1, -1))]
        for m in order:
            if m == k:
                continue
            if offsets[m] > max(np.linalg.norm(p) for p in face):
                break
            face = _clip(face, normal[m], offsets[m])
            if len(face) < 3:
                break
        if len(face) < 3 or max(np.linalg.norm(p - n * d) for p in face) > 0.9 * far:
            continue
        c = np.array(face) - face[0]
        areas[k] = 0.5 * abs(sum(np.cross(c[i], c[i + 1]) @ n for i in range(1, len(c) - 1)))
    return areas


_CANDIDATE = "stem string, i int, j int, img array<int>, d double, vec array<double>, w double, w_back double, dmin_i double, dmin_j double, dsr_i double, dsr_j double, role_i string, role_j string"


def neighbours_of(lattice: np.ndarray, frac: np.ndarray, roles: list[str], radii: np.ndarray | None, radius: float = RADIUS) -> list[tuple]:
    """Candidate bonds (i, j, image, distance, vector, weight, weight back, nearest and nearest of the same role at both ends)."""
    inverse = np.linalg.inv(lattice)
    reach = np.ceil(radius * np.linalg.norm(inverse, axis=0)).astype(int) + 1
    grid = np.array(list(product(*(range(-r, r + 1) for r in reach))))
    n = len(frac)
    found, dmin, dsr = [], np.full(n, np.inf), np.full(n, np.inf)
    for i in range(n):
        delta = (frac - frac[i])[:, None] + grid[None]
        vec = delta @ lattice
        d = np.linalg.norm(vec, axis=2)
        j, g = np.nonzero((d <= radius) & (d > 1e-8))
        dist = d[j, g]
        if (j != i).any():
            dmin[i] = dist[j != i].min()
        if roles[i] in ("cation", "anion"):
            same = np.array([roles[x] == roles[i] for x in j], bool)
            if same.any():
                dsr[i] = dist[same].min()
        # Cells are made by other atoms; a node's own images set only its same-role distance.
        order = np.lexsort((*grid[g].T[::-1], j, np.round(dist, 6)))
        order = order[j[order] != i][:VORONOI_MOST]
        v = vec[j, g][order]
        half = dist[order] / 2
        if radii is not None:
            half = (dist[order] ** 2 + radii[i] ** 2 - radii[j[order]] ** 2) / (2 * dist[order])
        area = voronoi_areas(v, half)
        if radii is not None and area.sum() <= 0:
            area = voronoi_areas(v, dist[order] / 2)
        weight = area / area.sum() if area.sum() > 0 else area
        found.append({(int(a), *map(int, grid[b])): (float(x), y, float(w)) for a, b, x, y, w in zip(j[order], g[order], dist[order], v, weight)})
    out = []
    for i in range(n):
        for (j, *img), (d, v, w) in found[i].items():
            back = found[j].get((i, *[-x for x in img]), (0, 0, 0.0))[2]
            if max(w, back) > 0:
                out.append((i, j, img, d, v.tolist(), w, back, dmin[i], dmin[j], dsr[i], dsr[j], roles[i], roles[j]))
    return out


def candidates(structures: DataFrame, sites: DataFrame, radii: DataFrame | None = None, radius: float = RADIUS) -> DataFrame:
    """Candidate bonds of every structure, by direction; radii (stem, id, radius) make the Voronoi cells radical."""
    own = sites.select("stem", "id", "frac", F.coalesce("ion_role", F.lit("neutral")).alias("role"))
    own = own.withColumn("r", F.lit(None).cast("double")) if radii is None else own.join(radii.select("stem", "id", F.col("radius").alias("r")), ["stem", "id"], "left")
    packed = structures.where("error is null").select("stem", "lattice").join(own.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("id", "frac", "role", "r"))).alias("s")), "stem")

    def run(parts):
        for part in parts:
            out = []
            for stem, lattice, s in zip(part["stem"], part["lattice"], part["s"]):
                rows = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in s]
                r = [x[3] for x in rows]
                given = None if any(x is None or np.isnan(x) for x in r) else np.array(r, float)
                ids = [x[0] for x in rows]
                for i, j, *rest in neighbours_of(np.array([list(v) for v in lattice]), np.array([list(x[1]) for x in rows]), [x[2] for x in rows], given, radius):
                    out.append((stem, ids[i], ids[j], *rest))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _CANDIDATE.split(", ")])

    return packed.mapInPandas(run, _CANDIDATE)


def select_bonds(found: DataFrame, rescue: bool = True, cap: int = CAP, least: float = WEIGHT_LEAST, strict: bool = False) -> DataFrame:
    """Bonds (stem, id, source, target, img, bond_length, cart_vec, vw_s, vw_t) chosen from candidates.

    A direction passes within BOND_RATIO of its own nearest neighbour; charged
    ends of one role must be within SAME_ROLE of the larger nearest distance,
    unless (with rescue) the weight is STRONG; ends of opposite roles within
    OPPOSITE_ROLE of the larger same-role distance.  Of both directions the
    heavier is kept; a bond over the cap at either end goes.  With strict, only
    bonds between cations and anions stay, and a node that keeps none regains
    all its contacts of the least weight.
    """
    top = F.greatest("w", "w_back")
    charged = F.col("role_i").isin("cation", "anion") & F.col("role_j").isin("cation", "anion")
    near = F.col("d") <= SAME_ROLE * F.greatest("dmin_i", "dmin_j")
    if rescue:
        near = near | (top >= STRONG)
    ref = F.greatest("dsr_i", "dsr_j")
    opposite = (ref == float("inf")) | (F.col("d") <= OPPOSITE_ROLE * ref)
    x = found.where((F.col("d") <= BOND_RATIO * F.col("dmin_i")) & (~charged | F.when(F.col("role_i") == F.col("role_j"), near).otherwise(opposite)) & (top >= least))
    if strict:
        x = x.where(charged & (F.col("role_i") != F.col("role_j")))
        bonded = x.select("stem", F.explode(F.array("i", "j")).alias("i")).distinct()
        x = x.unionByName(found.where(top >= least).join(bonded, ["stem", "i"], "left_anti"))
    swap = F.col("i") > F.col("j")
    turned = lambda c: F.when(swap, F.transform(c, lambda v: -v)).otherwise(F.col(c))
    x = x.select("stem", F.least("i", "j").alias("source"), F.greatest("i", "j").alias("target"), turned("img").alias("img"), "d", turned("vec").alias("cart_vec"), F.when(swap, F.col("w_back")).otherwise(F.col("w")).alias("vw_s"), F.when(swap, F.col("w")).otherwise(F.col("w_back")).alias("vw_t"))
    keys = ["stem", "source", "target", "img"]
    x = x.groupBy(*keys).agg(F.max_by(F.struct("d", "cart_vec", "vw_s", "vw_t"), F.greatest("vw_s", "vw_t")).alias("m")).select(*keys, "m.*")
    order = [F.greatest("vw_s", "vw_t").desc(), F.col("source").desc(), F.col("target").desc(), F.col("img").desc()]
    ends = x.select(*keys, "vw_s", "vw_t", F.explode(F.array("source", "target")).alias("end"))
    over = ends.withColumn("rank", F.row_number().over(Window.partitionBy("stem", "end").orderBy(*order))).where(F.col("rank") > cap).select(*keys).distinct()
    x = x.join(over, keys, "left_anti")
    number = F.row_number().over(Window.partitionBy("stem").orderBy("source", "target", "img")) - 1
    return x.select("stem", number.alias("id"), "source", "target", "img", F.col("d").alias("bond_length"), "cart_vec", F.round("vw_s", 6).alias("vw_s"), F.round("vw_t", 6).alias("vw_t"))


def edge_attributes(bonds: DataFrame, sites: DataFrame, radii: DataFrame | None = None, chi: DataFrame | None = None) -> DataFrame:
    """Adds ratio (length over the sum of radii) and electronegativity differences; radii: (stem, id, radius), chi: (stem, id, chi_pauling, chi_allen).  Null without values."""
    x = bonds
    for side in ("source", "target"):
        if radii is not None:
            x = x.join(radii.select("stem", F.col("id").alias(side), F.col("radius").alias(f"_r_{side}")), ["stem", side], "left")
        if chi is not None:
            x = x.join(chi.select("stem", F.col("id").alias(side), F.struct("chi_pauling", "chi_allen").alias(f"_c_{side}")), ["stem", side], "left")
    none = F.lit(None).cast("double")
    x = x.withColumn("ratio", F.col("bond_length") / (F.col("_r_source") + F.col("_r_target")) if radii is not None else none)
    for name, key in (("dchi_p", "chi_pauling"), ("dchi_a", "chi_allen")):
        x = x.withColumn(name, F.abs(F.col(f"_c_source.{key}") - F.col(f"_c_target.{key}")) if chi is not None else none)
    return x.drop("_r_source", "_r_target", "_c_source", "_c_target")


MOVED = 0.01


def consistent_radii(structures: DataFrame, sites: DataFrame, shannon: DataFrame, atomic: DataFrame, least: float = WEIGHT_LEAST) -> tuple[DataFrame, DataFrame]:
    """Candidate bonds and radii after two passes.

    The first pass has the radii of the largest known coordination numbers; its
    contacts of the least weight give tentative numbers and their radii.  Only
    structures in which a radius moves by more than MOVED are made anew.
    """
    first = site_radii(sites, shannon, atomic)
    found = candidates(structures, sites, first)
    cn = found.where(F.greatest("w", "w_back") >= least).groupBy("stem", F.col("i").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("cn"))
    second = site_radii(sites, shannon, atomic, sites.select("stem", "id").join(cn, ["stem", "id"], "left"))
    both = first.select("stem", "id", F.col("radius").alias("before")).join(second, ["stem", "id"])
    moved = both.where(F.abs(F.col("radius") - F.col("before")) > MOVED).select("stem").distinct()
    again = candidates(structures.join(moved, "stem", "left_semi"), sites, second)
    stays = lambda x: x.join(moved, "stem", "left_anti")
    return stays(found).unionByName(again), stays(first).unionByName(second.join(moved, "stem", "left_semi"))


def balanced_states(amounts: dict[str, float], states: dict[str, list[tuple[float, bool]]]) -> tuple[dict[str, float], str]:
    """One state for each element so that charges cancel, and how it was found.

    Common states come first, then all; of several solutions the one whose
    states stand earliest in the elements' lists (summed places, then by
    element).  Elements without states, or no solution, give zeros.
    """
    names = sorted(amounts)
    for common, source in ((True, "composition_guess"), (False, "composition_guess_all_oxi")):
        lists = [[(k, s) for k, (s, often) in enumerate(states.get(e, [])) if often or not common] for e in names]
        # Charges reached by the elements so far, each with its best choice: no product of all lists.
        reached: dict[float, tuple[int, tuple[float, ...]]] = {0.0: (0, ())}
        for e, own in zip(names, lists):
            new: dict[float, tuple[int, tuple[float, ...]]] = {}
            for charge, (cost, chosen) in reached.items():
                for k, s in own:
                    at, option = round(charge + s * amounts[e], 6), (cost + k, (*chosen, s))
                    if at not in new or (option[0], [-abs(x) for x in option[1]]) < (new[at][0], [-abs(x) for x in new[at][1]]):
                        new[at] = option
            reached = new
        if len(names) > 1 and 0.0 in reached:
            return dict(zip(names, reached[0.0][1])), source
    return dict.fromkeys(names, 0.0), "unavailable_default_0"


def assign_states(structures: DataFrame, states: DataFrame) -> DataFrame:
    """Structures with oxidation states for all species, and oxi_source: explicit if every species has one, else by balance of charges.

    states: (symbol, oxi, common, place), the states of each element in order
    of preference; a table of the elements, so the driver reads it whole.
    """
    known: dict[str, list[tuple[float, bool]]] = {}
    for r in states.orderBy("symbol", "place").collect():
        known.setdefault(r["symbol"], []).append((float(r["oxi"]), bool(r["common"])))
    each = F.flatten(F.transform("sites", lambda s: s["species"]))
    explicit = F.size("sites") > 0
    explicit = explicit & F.forall(each, lambda x: x["explicit"])

    def guess(parts):
        for part in parts:
            out = []
            for stem, symbols, occupancies in zip(part["stem"], part["symbols"], part["occupancies"]):
                amounts: dict[str, float] = {}
                for e, o in zip(symbols, occupancies):
                    amounts[e] = amounts.get(e, 0.0) + float(o)
                found, source = balanced_states(amounts, known)
                out.append((stem, found, source))
            yield pd.DataFrame(out, columns=["stem", "found", "source"])

    todo = structures.where("error is null").where(~explicit).select("stem", F.transform(each, lambda x: x["symbol"]).alias("symbols"), F.transform(each, lambda x: x["occupancy"]).alias("occupancies"))
    guessed = todo.mapInPandas(guess, "stem string, found map<string,double>, source string")
    x = structures.join(guessed, "stem", "left")
    state = lambda p: F.when(F.col("found").isNull(), p["oxi_state"]).otherwise(F.coalesce(F.try_element_at("found", p["symbol"]), F.lit(0.0)))
    species = lambda s: F.transform(s["species"], lambda p: F.struct(p["symbol"].alias("symbol"), p["occupancy"].alias("occupancy"), state(p).alias("oxi_state"), p["explicit"].alias("explicit")))
    sites = F.transform("sites", lambda s: F.struct(s["id"].alias("id"), s["frac"].alias("frac"), species(s).alias("species")))
    return x.withColumn("sites", sites).withColumn("oxi_source", F.coalesce("source", F.lit("site_explicit"))).drop("found", "source")


def build_graphs(structures: DataFrame, radii: DataFrame | None = None, chi: DataFrame | None = None, rescue: bool = True, shannon: DataFrame | None = None, atomic: DataFrame | None = None, strict: bool = False, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Nodes and bonds of structures (stem, lattice, sites, error), ready for the relational operators.

    Radii are given (stem, id, radius), or made consistent with the bonds from
    tables of Shannon and atomic radii; without either, cells are ordinary.
    """
    from .graph import coordination, half_bonds

    sites = site_table(structures)
    if radii is None and shannon is not None:
        found, radii = consistent_radii(structures, sites, shannon, atomic)
    else:
        found = candidates(structures, sites, radii)
    bonds = edge_attributes(select_bonds(found, rescue, cap, strict=strict), sites, radii, chi)
    bonds = with_spheres(bonds.withColumn("periodic", F.exists("img", lambda v: v != 0)).withColumn("raw_distance", F.col("bond_length")))
    nodes = sites.join(coordination(sites, half_bonds(bonds)), ["stem", "id"])
    r = F.lit(None).cast("double") if radii is None else F.col("radius")
    nodes = nodes if radii is None else nodes.join(radii.select("stem", "id", "radius"), ["stem", "id"], "left")
    return nodes.withColumn("shannon_r", r), bonds


# ---- radii and electronegativities from tables of the caller --------------


def max_known_radii(shannon: DataFrame, most: int = 14) -> DataFrame:
    """(symbol, oxi, radius, cn): mean over spins at the largest tabulated coordination number; shannon: (symbol, oxi, cn, spin, radius)."""
    per = shannon.where((F.col("cn") <= most) & (F.col("oxi") != 0)).groupBy("symbol", "oxi", "cn").agg(F.avg("radius").alias("radius"))
    return per.groupBy("symbol", "oxi").agg(F.max_by("radius", "cn").alias("radius"), F.max("cn").alias("cn"))


def cn_radii(shannon: DataFrame) -> DataFrame:
    """(symbol, oxi, cn, radius, spin): of several spins none, high, then low."""
    rank = F.when(F.coalesce("spin", F.lit("")) == "", 0).when(F.col("spin") == "High Spin", 1).otherwise(2)
    return shannon.groupBy("symbol", "oxi", "cn").agg(F.min_by(F.struct("radius", "spin"), rank).alias("m")).select("symbol", "oxi", "cn", "m.*")


def site_radii(sites: DataFrame, shannon: DataFrame, atomic: DataFrame, cn: DataFrame | None = None) -> DataFrame:
    """(stem, id, radius, source) of sites: exact coordination number if cn (stem, id, cn) is given, else the largest known, else the rounded state's, else the element's (atomic, calculated, van der Waals, 1); disordered sites are averaged by occupancy.

    The tables of radii, of rows for elements and their states, are sent to the sites: few elements hold most of them.
    """
    s = sites.select("stem", "id", F.explode("species").alias("s")).select("stem", "id", "s.symbol", "s.occupancy", F.col("s.oxi_state").alias("oxi"))
    if cn is not None:
        s = s.join(cn.select("stem", "id", "cn"), ["stem", "id"], "left").join(F.broadcast(cn_radii(shannon).select("symbol", "oxi", "cn", F.col("radius").alias("exact"))), ["symbol", "oxi", "cn"], "left")
    else:
        s = s.withColumn("exact", F.lit(None).cast("double"))
    known = max_known_radii(shannon).select("symbol", F.col("oxi").alias("_o"), "radius")
    s = s.join(F.broadcast(known.toDF("symbol", "oxi", "known")), ["symbol", "oxi"], "left")
    s = s.withColumn("_o", F.rint("oxi")).join(F.broadcast(known.toDF("symbol", "_o", "rounded")), ["symbol", "_o"], "left").join(F.broadcast(atomic), "symbol", "left")
    radius = F.coalesce("exact", "known", "rounded", "atomic", "calculated", "van_der_waals", F.lit(1.0))
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in ("exact", "known", "rounded", "atomic", "calculated", "van_der_waals")], F.lit("default"))
    return s.withColumn("r", radius).withColumn("l", label).groupBy("stem", "id").agg((F.sum(F.col("occupancy") * F.col("r")) / F.sum("occupancy")).alias("radius"), F.max_by("l", "occupancy").alias("source"))


def site_electronegativity(sites: DataFrame, table: DataFrame) -> DataFrame:
    """(stem, id, chi_pauling, chi_allen) by occupancy; table: (symbol, pauling, allen), a row for each element, is sent to the sites: few elements hold most of them."""
    s = sites.select("stem", "id", F.explode("species").alias("s")).select("stem", "id", F.col("s.symbol").alias("symbol"), F.col("s.occupancy").alias("o")).join(F.broadcast(table), "symbol", "left")
    mean = lambda c: F.sum(F.col("o") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("o")))
    return s.groupBy("stem", "id").agg(mean("pauling").alias("chi_pauling"), mean("allen").alias("chi_allen"))

"""Structure types, minerals, perovskite environments and candidate lists."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import composition, crystal_system, reduced

# Element sets and names of the classification.
HALOGENS = ("F", "Cl", "Br", "I")
PLANAR = ("C", "N", "B")
PYRAMID_WIDE = ("I", "As", "Te", "Se", "Sb", "Bi")
PYRAMID = {"S": "Sulfite", "Se": "Selenite", "Te": "Tellurite", "As": "Arsenite", "P": "Phosphite", "I": "Iodate", "Cl": "Chlorate", "Br": "Bromate"}
TETRAHEDRAL = {"Si": "Silicate", "Ge": "Germanate", "Sb": "Antimonite", "Bi": "Bismuthate"}
TETRAHEDRAL_METAL = {"V": "Vanadate", "Cr": "Chromate", "Mo": "Molybdate", "W": "Tungstate", "Mn": "Manganate", "Re": "Rhenate"}
ANIONS = {"O": "Oxide", "S": "Sulfide", "Se": "Selenide", "Te": "Telluride", "N": "Nitride", "P": "Phosphide"}
HEXAGONAL = {185: "Hexagonal manganite (P6₃cm)", 186: "Hexagonal perovskite (P6₃mc)", 190: "Hexagonal perovskite (P-6m2)", 193: "Hexagonal perovskite (P6₃/mcm)", 194: "Hexagonal perovskite (P6₃/mmc)"}
LAYERED = {(1, 2, 4): 1, (2, 3, 7): 2, (3, 4, 10): 3}
ENRICHED = ("", "oxide", "sulfide", "selenide", "telluride", "nitride", "phosphide", "halide", "oxyhalide", "rock_salt", "fluorite", "rutile", "wurtzite", "zinc_blende", "spinel")


def features(nodes: DataFrame, poly: DataFrame, meta: DataFrame) -> DataFrame:
    """What the structure types are told by, one row for each graph: mean coordination by element, the cations of highest and lowest (A and B), sharing among B, symmetry."""
    order = F.row_number().over(Window.partitionBy("stem").orderBy("first"))
    per = nodes.groupBy("stem", "element").agg(
        F.min("id").alias("first"), F.max_by("ion_role", "id").alias("role"), F.avg("cn").alias("cn"), F.stddev_pop("cn").alias("spread"), F.avg((F.col("cn") == 6).cast("double")).alias("six")
    )
    per = per.withColumn("order", order)
    one = F.struct("element", "cn", "spread", "six")
    cation = F.col("role") == "cation"
    g = per.groupBy("stem").agg(
        F.max_by(one, F.when(cation, F.struct(F.col("cn"), -F.col("order")))).alias("a"), F.min_by(one, F.when(cation, F.struct(F.col("cn"), -F.col("order")))).alias("b"), F.count_if(cation).alias("cations"),
        F.collect_set(F.when(F.col("role") == "anion", F.col("element"))).alias("anions"), F.coalesce(F.bool_and(F.when(F.col("role") == "anion", F.rint("cn") == 4)), F.lit(False)).alias("anions_four"),
        F.collect_set(F.when(cation, F.rint("cn"))).alias("cation_cns"),
    )
    element = nodes.select("stem", "id", "element")
    ends = poly.select("stem", "a", "b", "mode_all").join(element.toDF("stem", "a", "ea"), ["stem", "a"]).join(element.toDF("stem", "b", "eb"), ["stem", "b"])
    bb = ends.join(g.select("stem", F.col("b.element").alias("be")), "stem").where("ea = be and eb = be").groupBy("stem").agg(F.avg((F.col("mode_all") == "face").cast("double")).alias("face"))
    x = meta.select("stem", "formula", F.coalesce("sg_symbol", F.lit("")).alias("sg_symbol"), F.coalesce("sg_number", F.lit(0)).alias("sg")).join(g, "stem", "left").join(bb, "stem", "left")
    return x.withColumn("face", F.coalesce("face", F.lit(0.0))).withColumn("system", F.coalesce(crystal_system(F.col("sg")), F.lit("cubic")))


def structure_types(feature: DataFrame) -> DataFrame:
    """(stem, type, label): the first rule that holds, in order from anion groups over octahedral frameworks to the kind of anion."""
    sg, a, b, anions, system = F.col("sg"), F.col("a"), F.col("b"), F.col("anions"), F.col("system")
    tag = F.when(F.col("sg_symbol") != "", F.col("sg_symbol")).when(sg > 0, F.concat(F.lit("SG "), sg.cast("string"))).otherwise("?")
    both = F.concat(F.lit(" ("), system, F.lit(", "), tag, F.lit(")"))
    only = F.concat(F.lit(" ("), tag, F.lit(")"))
    halogen, oxide = F.arrays_overlap(anions, F.array(*map(F.lit, HALOGENS))), F.array_contains(anions, "O")
    a_cn, b_cn = F.rint(a["cn"]), F.rint(b["cn"])
    single = F.col("cations") == 1
    chalcogen = F.coalesce(*[F.when(F.array_contains(anions, e) & ~oxide, f"{n} ") for e, n in ANIONS.items() if e != "O"], F.lit(""))
    rules: list[tuple[Column, str | Column, Column]] = []
    rule = lambda when, key, label: rules.append((when, key, label if isinstance(label, Column) else F.lit(label)))
    named = lambda name: F.concat(F.lit(name), both)

    rule(F.col("a").isNull() | (F.col("cations") == 0), "", F.concat(F.lit("Unknown"), only))
    rule(single & halogen & oxide, "oxyhalide", named("Oxyhalide"))
    rule(single & halogen, "halide", named("Halide"))
    planar = (b_cn <= 3) & b["element"].isin(*PLANAR)
    carbon, nitrogen = planar & (b["element"] == "C"), planar & (b["element"] == "N")
    rule(carbon & (sg == 167), "carbonate", "Carbonate (R-3c)")
    rule(carbon & (sg == 62), "carbonate", "Carbonate (Pnma)")
    rule(carbon & sg.isin(160, 166), "carbonate", F.concat(F.lit("Trigonal carbonate"), only))
    rule(carbon, "carbonate", named("Carbonate"))
    rule(nitrogen & sg.isin(161, 167), "nitrate", F.concat(F.lit("Nitrate"), only))
    rule(nitrogen, "nitrate", named("Nitrate"))
    rule(planar, "borate", named("Borate"))
    limit = F.when(b["element"].isin(*PYRAMID_WIDE), 5).otherwise(4)
    for e, name in PYRAMID.items():
        rule((b_cn <= limit) & (b["element"] == e), name.lower(), named(name))
    for e, name in TETRAHEDRAL.items():
        rule((b_cn <= 4) & (b["element"] == e), name.lower(), named(name))
    for e, name in TETRAHEDRAL_METAL.items():
        rule((b_cn == 4) & (b["element"] == e), name.lower(), named(name))
    for n, label in HEXAGONAL.items():
        rule((sg == n) & (a["cn"] >= 7.5) & oxide, "hex_perovskite", label)
    octahedral = (b_cn == 6) & (b["six"] > 0.6)
    counts = reduced(composition(F.col("formula")))
    amount = lambda e: F.coalesce(F.try_element_at(counts, e), F.lit(0))
    key = F.array_sort(F.array(amount(a["element"]), amount(b["element"]), amount(F.lit("O"))))
    for k, n in LAYERED.items():
        rule(octahedral & oxide & (F.col("cations") == 2) & (key == F.array(*[F.lit(x).cast("long") for x in k])) & (a["spread"] > 1.2), "ruddlesden_popper", named(f"Ruddlesden-Popper n={n}"))
    large = octahedral & (a["cn"] >= 7.5)
    rule(large & (sg == 63), "post_perovskite", "Post-perovskite (Cmcm)")
    for n, label in HEXAGONAL.items():
        rule(large & (sg == n), "hex_perovskite", F.lit(label) if n == 185 else F.concat(chalcogen, F.lit(label)))
    rule(large & (F.col("face") > 0.15), "hex_perovskite", F.concat(chalcogen, F.lit("Hexagonal perovskite"), only))
    rule(large & (sg == 221), "perovskite", F.concat(chalcogen, F.lit("Perovskite (cubic, Pm-3m)")))
    rule(large & (sg == 225), "perovskite", F.concat(chalcogen, F.lit("Perovskite (cubic, Fm-3m)")))
    rule(large & (sg == 227), "pyrochlore", "Pyrochlore (Fd-3m)")
    rule(large, "perovskite", F.concat(chalcogen, F.lit("Perovskite"), both))
    equal = octahedral & (a_cn == 6)
    rule(equal & (sg == 148), "ilmenite", "Ilmenite (R-3)")
    rule(equal & sg.isin(165, 167) & (a["element"] == b["element"]), "corundum", "Corundum-related (R-3c)")
    rule(equal & sg.isin(165, 167), "corundum_related", "Corundum-related (R-3c)")
    rule(equal & (sg == 161), "linbo3", "LiNbO₃-type (R3c)")
    rule(equal & (sg == 136), "rutile", "Rutile-type (P4₂/mnm)")
    rule(equal & (sg == 162), "double_oct", "Double-octahedral (P-3m1)")
    rule(equal & single & (system == "cubic"), "rock_salt", F.concat(F.lit("Rock-salt"), only))
    rule(equal, "double_oct", named("Double-octahedral"))
    four = F.col("anions_four")
    rule(single & (a_cn == 8) & (system == "cubic") & four, "fluorite", F.concat(F.lit("Fluorite"), only))
    mixed = (F.col("cations") >= 2) & F.array_contains("cation_cns", 4.0) & F.array_contains("cation_cns", 6.0)
    rule(mixed & (sg == 227), "spinel", "Spinel (Fd-3m)")
    rule(mixed & (system == "cubic"), "spinel", F.concat(F.lit("Spinel-type"), only))
    rule((b_cn == 4) & four & (system == "hexagonal") & sg.isin(186, 194), "wurtzite", F.concat(F.lit("Wurtzite"), only))
    rule((b_cn == 4) & four & (system == "cubic") & sg.isin(216, 225), "zinc_blende", F.concat(F.lit("Zinc-blende"), only))
    rule(halogen & oxide, "oxyhalide", named("Oxyhalide"))
    rule(halogen, "halide", named("Halide"))
    for e, name in ANIONS.items():
        rule(F.array_contains(anions, e), name.lower(), named(name))
    found = reduce(lambda c, r: c.when(r[0], F.struct(F.lit(r[1]).alias("type"), r[2].alias("label"))), rules[1:], F.when(rules[0][0], F.struct(F.lit("").alias("type"), rules[0][2].alias("label"))))
    found = found.otherwise(F.struct(F.lit("").alias("type"), F.concat(F.lit("Unknown"), only).alias("label")))
    return feature.withColumn("_t", found).select("stem", "_t.type", "_t.label")


def mineral_lookup(records: DataFrame, curated: DataFrame) -> DataFrame:
    """(formula_key, sg_number, name): names from records, and curated ones that are not among them by lower-case name; all (name, formula_key, sg_number)."""
    fields = ["name", "formula_key", "sg_number"]
    extra = curated.select(*fields).join(records.select(F.lower("name").alias("_n")), F.lower("name") == F.col("_n"), "left_anti")
    return records.select(*fields).unionByName(extra).where("formula_key is not null").distinct()


def named_minerals(materials: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds mineral to materials (stem, formula_key, sg_number): by formula and space group, else by formula; the first name of several."""
    exact = lookup.groupBy("formula_key", "sg_number").agg(F.min("name").alias("_exact"))
    loose = lookup.groupBy("formula_key").agg(F.min("name").alias("_loose"))
    return materials.join(exact, ["formula_key", "sg_number"], "left").join(loose, "formula_key", "left").withColumn("mineral", F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def labels(types: DataFrame, minerals: DataFrame) -> DataFrame:
    """Generic structure types take the mineral's name, with the label behind it."""
    x = types.join(minerals.select("stem", "mineral"), "stem", "left")
    generic = F.col("type").isin(*ENRICHED) & F.col("mineral").isNotNull()
    return x.withColumn("label", F.when(generic, F.concat("mineral", F.lit(" ["), "label", F.lit("]"))).otherwise(F.col("label")))


# ---- perovskite environments ---------------------------------------------


def octahedra(nodes: DataFrame, poly: DataFrame, least: int = 5, most: int = 7) -> DataFrame:
    """(stem, b_element, octahedra, corner, edge, face, links): the cation with most octahedral sites, and how these are linked."""
    sites = nodes.where(F.col("cn").between(least, most) & (F.col("ion_role") == "cation"))
    b = sites.groupBy("stem", "element").agg(F.count(F.lit(1)).alias("octahedra")).groupBy("stem").agg(F.max(F.struct("octahedra", "element")).alias("m")).select("stem", F.col("m.element").alias("b_element"), F.col("m.octahedra").alias("octahedra"))
    own = sites.join(b, "stem").where("element = b_element").select("stem", "id")
    links = poly.join(own.withColumnRenamed("id", "a"), ["stem", "a"], "left_semi").join(own.withColumnRenamed("id", "b"), ["stem", "b"], "left_semi")
    n = links.groupBy("stem").agg(*[F.count_if(F.col("mode_all") == m).alias(m) for m in ("corner", "edge", "face")], F.count(F.lit(1)).alias("links"))
    return b.join(n, "stem", "left").na.fill(0, ["corner", "edge", "face", "links"])


_NETWORK = "b_element string, sites long, octahedral double, all_octahedral double, largest double, corner double, degree double, high double"


def _network(cations: list[tuple], least: int, most: int) -> tuple:
    """Octahedra of one cell, doubled along each axis so that chains and layers of a small cell come apart; cations are (element, anion neighbours (id, image))."""
    by: dict[str, list[list]] = {}
    for element, ends in cations:
        by.setdefault(element, []).append(ends)
    fits = lambda ends: least <= len(ends) <= most and len(ends) > 0
    if not any(fits(e) for own in by.values() for e in own):
        return (None, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    stats = {e: (sum(map(fits, own)) / len(own), -abs(sum(map(len, own)) / len(own) - 6.0), -len(own)) for e, own in sorted(by.items())}
    b = max(stats, key=lambda e: stats[e])
    cells = list(product((0, 1), repeat=3))
    shells = [{(n, *((c + i) % 2 for c, i in zip(cell, image))) for n, image in ends} for ends in by[b] if fits(ends) for cell in cells]
    at: dict[tuple, list[int]] = {}
    for k, shell in enumerate(shells):
        for x in shell:
            at.setdefault(x, []).append(k)
    shared: Counter = Counter(pair for own in at.values() for pair in combinations(own, 2))
    root = list(range(len(shells)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in shared:
        root[find(y)] = find(x)
    largest = max(Counter(map(find, root)).values())
    others = [len(e) for element, own in by.items() if element != b for e in own] or [len(e) for own in by.values() for e in own]
    return (
        b, len(by[b]), stats[b][0], sum(fits(e) for own in by.values() for e in own) / len(cations), largest / len(shells),
        sum(n == 1 for n in shared.values()) / len(shared) if shared else 0.0, 2 * len(shared) / len(shells), sum(n >= 8 for n in others) / len(others),
    )


def octahedral_network(nodes: DataFrame, half: DataFrame, least: int = 5, most: int = 7) -> DataFrame:
    """(stem, b_element, sites, octahedral, all_octahedral, largest, corner, degree, high) of every graph with cations.

    b_element is the cation most of whose sites have from `least` to `most`
    anions, then the one whose mean is nearest to six, then the rarer, then by
    name; octahedral its share of such sites and all_octahedral that of all
    cations.  Of its octahedra in a cell doubled along each axis: the largest
    network's share, the share of linked pairs with one common anion, and the
    mean number of linked neighbours.  high: the other cations' share with eight
    anions or more (of all cations, if there is no other).  Without octahedra
    all is 0.
    """
    cations = nodes.where("ion_role = 'cation'").select("stem", F.col("id").alias("mid"), "element")
    anions = nodes.where("ion_role = 'anion'").select("stem", F.col("id").alias("nbr"))
    ends = half.join(anions, ["stem", "nbr"], "left_semi").groupBy("stem", "mid").agg(F.collect_list(F.struct("nbr", "img")).alias("ends"))
    one = F.struct("mid", "element", "ends")
    rows = cations.join(ends, ["stem", "mid"], "left").groupBy("stem").agg(F.collect_list(one).alias("cations"))
    kind = dict(nodes.dtypes)["stem"]

    def run(parts):
        values = lambda x: list(x.values()) if isinstance(x, dict) else list(x)
        for part in parts:
            out = []
            for stem, own in zip(part["stem"], part["cations"]):
                plain = [(element, [(n, tuple(image)) for n, image in map(values, ends)] if ends is not None else []) for _, element, ends in sorted(map(values, own), key=lambda x: x[0])]
                out.append((stem, *_network(plain, least, most)))
            yield pd.DataFrame(out, columns=["stem", *[c.split()[0] for c in _NETWORK.split(", ")]])

    return rows.select("stem", "cations").mapInPandas(run, f"stem {kind}, {_NETWORK}")


#: Anions of the perovskite scan; its ratios of anions to cations are 3/2, and (3n + 1) / (2n + 1) of layered ones.
COMMON_ANIONS = ("O", "F", "Cl", "Br", "I", "N", "S", "Se", "Te")


def _ratios(nodes: DataFrame) -> DataFrame:
    """(stem, ratio of anions to cations, cation kinds, whether an anion is common)."""
    n = lambda role: F.count_if(F.col("ion_role") == role)
    kinds = F.count_distinct(F.when(F.col("ion_role") == "cation", F.col("element")))
    common = F.coalesce(F.bool_or((F.col("ion_role") == "anion") & F.col("element").isin(*COMMON_ANIONS)), F.lit(False))
    return nodes.groupBy("stem").agg(F.when(n("cation") > 0, n("anion") / n("cation")).alias("ratio"), kinds.alias("kinds"), common.alias("common"))


def _near(ratio, at: float, within: float):
    return F.greatest(F.lit(0.0), 1 - F.abs(ratio - at) / within)


def perovskites(nodes: DataFrame, half: DataFrame, least: int = 5, most: int = 7) -> DataFrame:
    """(stem, b_element, confidence, family, label): the perovskite scan.

    Confidence: 0.30 of the ratio's score (nearness to 3/2, or to a layered
    ratio), 0.25 of B's octahedral share, 0.25 of the largest network, 0.20 of
    the high coordination of A, and 0.05 for a common anion; 0.65 of that
    without the topology, 0.30 without a common anion.  The family takes two
    kinds of cations, a ratio above 1.15, one of the two matches, and 0.45.
    """
    x = octahedral_network(nodes, half, least, most).join(_ratios(nodes), "stem")
    r = F.col("ratio")
    x = x.withColumn("abx3", _near(r, 1.5, 0.45)).withColumn("layers", F.greatest(*[_near(r, (3 * n + 1) / (2 * n + 1), 0.25) for n in range(1, 9)]))
    score = F.least(F.greatest("abx3", "layers"), F.lit(1.0))
    network = 0.35 * F.least(F.col("octahedral") / 0.75, F.lit(1.0)) + 0.35 * F.col("largest") + 0.15 * F.least(F.col("degree") / 2, F.lit(1.0)) + 0.15 * F.col("high")
    basic = (F.col("sites") > 0) & (F.col("octahedral") >= 0.55) & (F.col("largest") >= 0.30) & (F.col("high") >= 0.20)
    full = basic & (F.col("largest") >= 0.45)
    sum_ = 0.30 * score + 0.25 * F.col("octahedral") + 0.25 * F.col("largest") + 0.20 * F.col("high") + F.when(F.col("common"), 0.05).otherwise(0.0)
    sum_ = sum_ * F.when(basic & (network >= 0.45), 1.0).otherwise(0.65) * F.when(F.col("common"), 1.0).otherwise(0.30)
    x = x.withColumn("confidence", F.round(F.least(sum_, F.lit(1.0)), 4))
    three, layered_ = (F.col("abx3") >= 0.60) & full, (F.col("layers") >= 0.65) & basic
    family = (F.col("kinds") >= 2) & F.col("common") & (r > 1.15) & (three | layered_) & (F.col("confidence") >= 0.45)
    label = F.when(~family, "none").when(layered_ & (F.col("layers") > F.col("abx3") + 0.20), "layered perovskite").otherwise("perovskite")
    return x.select("stem", "b_element", "confidence", family.alias("family"), label.alias("label"))


def layered(nodes: DataFrame, half: DataFrame, strict: bool = False, least: int = 5, most: int = 7) -> DataFrame:
    """(stem, confidence, is_layered): the scan of 2:1:4 compounds.

    Confidence: 0.40 of the ratio's nearness to 4/3, 0.20 of the octahedral
    share's to a third of the cations, 0.15 of the largest network's to a half,
    0.15 of B's links (two are full), 0.10 of the high coordination of A.  A
    compound is layered with octahedra, 0.70 for the ratio, 0.20 for the share
    and for the network, and a confidence of 0.55 (0.75 if strict).
    """
    x = octahedral_network(nodes, half, least, most).join(_ratios(nodes), "stem")
    ratio, share, net = _near(F.col("ratio"), 4 / 3, 0.18), _near(F.col("all_octahedral"), 1 / 3, 0.25), _near(F.col("largest"), 0.5, 0.5)
    sum_ = 0.40 * ratio + 0.20 * share + 0.15 * net + 0.15 * F.least(F.col("degree") / 2, F.lit(1.0)) + 0.10 * F.col("high")
    fits = (F.col("sites") > 0) & (ratio >= 0.70) & (share >= 0.20) & (net >= 0.20) & (F.round(sum_, 4) >= (0.75 if strict else 0.55))
    return x.select("stem", F.round(sum_, 4).alias("confidence"), fits.alias("is_layered"))


def abo3_candidates(states: DataFrame, shannon: DataFrame, known: DataFrame, charge: int = 6) -> DataFrame:
    """Pairs of cations whose states add up to the charge of the anions, with radii: A at coordination 12 (first spin), B at 6 (every spin), O at 6.

    states: (symbol, oxi); shannon: (symbol, oxi, cn, spin, radius); known:
    (formula) reduced formulas that exist.
    """
    spin = F.coalesce(F.nullif("spin", F.lit("")), F.lit("none"))
    rank = F.when(spin == "none", 0).when(spin == "High Spin", 1).otherwise(2)
    at = lambda cn: shannon.where(F.col("cn") == cn).select("symbol", "oxi", spin.alias("spin"), "radius", rank.alias("rank"))
    first = at(12).groupBy("symbol", "oxi").agg(F.min_by(F.struct("radius", "spin"), "rank").alias("m"))
    a = states.where("oxi > 0").distinct().join(first, ["symbol", "oxi"]).select(F.col("symbol").alias("a_element"), F.col("oxi").alias("a_oxi"), F.col("m.spin").alias("a_spin"), F.round("m.radius", 4).alias("r_a"))
    b = at(6).where("oxi > 0").select(F.col("symbol").alias("b_element"), F.col("oxi").alias("b_oxi"), F.col("spin").alias("b_spin"), F.round("radius", 4).alias("r_b")).distinct()
    pairs = a.withColumn("b_oxi", F.lit(charge) - F.col("a_oxi")).join(b, "b_oxi")
    oxygen = at(6).where("symbol = 'O' and oxi = -2").agg(F.round(F.min_by("radius", "rank"), 4).alias("r_x"))
    formula = F.when(F.col("a_element") == F.col("b_element"), F.concat(F.col("a_element"), F.lit("2O3"))).otherwise(F.concat("a_element", "b_element", F.lit("O3")))
    there = known.select("formula", F.lit(True).alias("exists")).distinct()
    x = pairs.withColumn("formula", formula).join(there, "formula", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    # The anion's radius is a table of one row.
    return x.join(F.broadcast(oxygen), F.lit(True), "left")


def element_similarity(pairs: DataFrame) -> DataFrame:
    """Mean distances of structures by the two elements in which they differ: (element_a, element_b, n, mean, least), both ways alike; pairs: (element_a, element_b, distance)."""
    x = pairs.select(F.least("element_a", "element_b").alias("element_a"), F.greatest("element_a", "element_b").alias("element_b"), "distance")
    return x.groupBy("element_a", "element_b").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean"), F.min("distance").alias("least"))

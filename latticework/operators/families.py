"""Families of materials: leader clustering, subfamilies, topology families and their relations.

Leader clustering runs inside classes that can't match across (equal element
ratios, or one family), for all classes at once: round r takes the rth batch of
every class.  Prototypes and memberships are tables in the shared folder; the
driver only counts rounds.  A pair is judged once: an item meets the prototypes
before it, or the others of its batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import gcd
from .cluster import _stored as stored
from .cluster import components
from .fingerprint import HASH_LENGTH
from .pair_store import PairCosts

ZERO = 1e-9


def trivial_groups(symmetry: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(stem, group): materials of one symmetry key whose orbits match, named by the smallest stem.

    symmetry: (stem, key, orbits array<struct<wyckoff:string, x, y, z>>).  Two
    orbits match if every coordinate agrees within the tolerance on the unit
    circle, directly or against 1 - c; orbits of one Wyckoff letter are matched
    one to one.  Materials are compared with the representatives found so far
    before others of their group, so a bucket of equal structures takes one
    comparison for each.
    """

    def near(a, b) -> bool:
        d = np.abs(a - b) % 1.0
        e = np.abs(a - (1 - b)) % 1.0
        return bool((np.minimum(d, 1 - d) <= tolerance).all() or (np.minimum(e, 1 - e) <= tolerance).all())

    def same(x: dict, y: dict) -> bool:
        for letter, own in x.items():
            free = list(range(len(own)))

            def place(i, other=y[letter], own=own, free=free):
                if i == len(own):
                    return True
                for j in list(free):
                    if near(own[i], other[j]):
                        free.remove(j)
                        if place(i + 1):
                            return True
                        free.append(j)
                return False

            if not place(0):
                return False
        return True

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("stem")
        groups: list[tuple[str, list]] = []
        named = {}
        for stem, orbits in zip(part["stem"], part["orbits"]):
            own: dict[str, list] = {}
            for o in orbits:
                w, *c = o.values() if isinstance(o, dict) else o
                own.setdefault(w, []).append(np.array(c, float))
            hits = [k for k, (_, members) in enumerate(groups) if any(same(own, m) for m in members)]
            if not hits:
                groups.append((stem, [own]))
            else:
                # One that links several groups makes them one.
                first = groups[hits[0]]
                for k in reversed(hits[1:]):
                    first[1].extend(groups[k][1])
                    named |= {s: first[0] for s, g in named.items() if g == groups[k][0]} | {groups[k][0]: first[0]}
                    del groups[k]
                if not any(all(np.allclose(p, q) for w in own for p, q in zip(own[w], m[w])) for m in first[1]):
                    first[1].append(own)
            named[stem] = groups[hits[0]][0] if hits else stem
        return pd.DataFrame({"stem": list(named), "group": list(named.values())})

    letters = F.array_join(F.array_sort(F.transform("orbits", lambda o: o["wyckoff"])), ",")
    keyed = symmetry.where("key is not null and orbits is not null").withColumn("_letters", letters)
    grouped = keyed.groupBy("key", "_letters").applyInPandas(group, "stem string, group string")
    # Materials without a symmetry key are groups of their own.
    alone = symmetry.where("key is null or orbits is null").select("stem", F.col("stem").alias("group"))
    return grouped.unionByName(alone)


def pick_prototypes(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """(group, stem): of each group an oxide if there is one, then the least (distortion, stem); scores: (stem, oxide, distortion)."""
    order = F.struct(F.when(F.col("oxide"), 0).otherwise(1).alias("o"), F.coalesce("distortion", F.lit(float("inf"))).alias("d"), F.col("stem").alias("s"))
    return groups.join(scores, "stem").groupBy("group").agg(F.min_by("stem", order).alias("stem"))


def leader_clusters(items: DataFrame, costs_of: Callable[[DataFrame], DataFrame], threshold: float, batch: int = 64) -> DataFrame:
    """(class, stem, prototype, cost): each item joins its cheapest prototype within the threshold, or becomes one.

    items: (class, stem, rank); costs_of turns (stem_a, stem_b) into (stem_a,
    stem_b, cost).  Items of a class come in batches by rank; a batch sees the
    prototypes before it; those left over are compared among themselves, and
    the first of each connected set becomes the prototype.  Costs above the
    threshold, infinite or missing never join; ties go to the older prototype.
    """
    step = ((F.row_number().over(Window.partitionBy("class").orderBy("rank", "stem")) - 1) / batch).cast("int")
    items = stored(items.withColumn("step", step), "leader-items")
    rounds = (items.agg(F.max("step")).first()[0] or 0) + 1
    parts: list[DataFrame] = []
    for r in range(rounds):
        now = items.where(F.col("step") == r)
        pairs = None
        joined = now.select("class", "stem").limit(0).withColumn("prototype", F.lit("")).withColumn("cost", F.lit(0.0))
        if parts:
            prototypes = reduce(DataFrame.unionByName, parts).where("stem = prototype").join(items.select("class", "stem", F.col("rank").alias("age")), ["class", "stem"]).select("class", F.col("stem").alias("stem_b"), "age")
            pairs = now.select("class", F.col("stem").alias("stem_a")).join(prototypes, "class")
            costs = costs_of(pairs.select("stem_a", "stem_b")).where(F.col("cost") <= threshold)
            best = costs.join(pairs, ["stem_a", "stem_b"]).groupBy("class", "stem_a").agg(F.min(F.struct("cost", "age", "stem_b")).alias("m"))
            joined = stored(best.select("class", F.col("stem_a").alias("stem"), F.col("m.stem_b").alias("prototype"), F.col("m.cost").alias("cost")), "leader-joined")
        left = now.join(joined.select("class", "stem"), ["class", "stem"], "left_anti").select("class", "stem", "rank")
        other = left.select("class", F.col("stem").alias("stem_b"), F.col("rank").alias("rank_b"))
        among = left.select("class", F.col("stem").alias("stem_a"), F.col("rank").alias("rank_a")).join(other, "class")
        among = among.where((F.col("rank_a") > F.col("rank_b")) | ((F.col("rank_a") == F.col("rank_b")) & (F.col("stem_a") > F.col("stem_b")))).select("stem_a", "stem_b")
        near = stored(costs_of(among).where(F.col("cost") <= threshold).select("stem_a", "stem_b", "cost"), "leader-near")
        sets = components(near.select(F.col("stem_a").alias("a"), F.col("stem_b").alias("b")))
        whole = left.join(sets, F.col("stem") == F.col("node"), "left").withColumn("set", F.coalesce("label", "stem"))
        first = whole.groupBy("class", "set").agg(F.min_by("stem", F.struct("rank", "stem")).alias("prototype"))
        direct = near.select(F.col("stem_a").alias("stem"), F.col("stem_b").alias("prototype"), "cost").unionByName(near.select(F.col("stem_b").alias("stem"), F.col("stem_a").alias("prototype"), "cost"))
        new = whole.join(first, ["class", "set"]).join(direct, ["stem", "prototype"], "left")
        new = new.select("class", "stem", "prototype", F.when(F.col("stem") == F.col("prototype"), 0.0).otherwise(F.col("cost")).alias("cost"))
        # Rounds are kept beside each other, so none is written twice.
        parts.append(stored(joined.unionByName(new), "leader-round"))
    return reduce(DataFrame.unionByName, parts)


def families(graphs: DataFrame, order: DataFrame, threshold: float = 0.1, batch: int = 64, cost: str = "edge_identity", store: str | None = None) -> DataFrame:
    """L1 families of packed graphs: (class, stem, prototype, cost, family_id, family_size, is_prototype).

    With store, the name of a store of pair costs, pairs that it knows are not searched again.

    order: (stem, intermetallic, distortion).  Classes are element ratios, as
    no others can match; families are numbered from 0 by size, then prototype.
    """
    from .match import compatible, match_pairs

    items = graphs.select("stem", F.array_join(F.transform("ratio", lambda n: n.cast("string")), "-").alias("class")).join(order, "stem")
    items = items.withColumn("rank", F.struct(F.col("intermetallic"), F.coalesce("distortion", F.lit(0.0)))).select("class", "stem", "rank")
    costs = lambda pairs: match_pairs(compatible(graphs, pairs), graphs, cost).select("stem_a", "stem_b", "cost")
    if store:
        costs = PairCosts(graphs.sparkSession, store, cost, costs).costs
    found = leader_clusters(items, costs, threshold, batch)
    sizes = found.groupBy("class", "prototype").agg(F.count(F.lit(1)).alias("family_size"))
    sizes = sizes.withColumn("family_id", F.row_number().over(Window.orderBy(F.desc("family_size"), "prototype")) - 1)
    return found.join(sizes, ["class", "prototype"]).withColumn("is_prototype", F.col("stem") == F.col("prototype"))


def expand_members(families_: DataFrame, groups: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Families of all materials, through the prototype of their trivial group: (stem, family_id, is_trivial_prototype, cost_to_prototype)."""
    via = groups.join(prototypes.select("group", F.col("stem").alias("of")), "group")
    x = via.join(families_.select(F.col("stem").alias("of"), "family_id", "cost"), "of", "left")
    own = F.col("stem") == F.col("of")
    return x.select("stem", "family_id", own.alias("is_trivial_prototype"), F.when(own, F.col("cost")).otherwise(0.0).alias("cost_to_prototype"))


def subfamilies(members: DataFrame, mappings: DataFrame, graphs: DataFrame, cost: str = "bond_angle", threshold: float = 0.05, batch: int = 64) -> DataFrame:
    """L2: members (stem, family_id, distortion) of each family clustered under another cost, along their mappings to the family's prototype.

    mappings: rows (stem_a = member, stem_b = prototype, a_id, slot, b_id,
    slot_kind); a pair of members is scored on the mapping composed through
    the prototype, and has no cost where that is uneven.
    """
    from .match import compose, inverse, score_mappings

    def costs(pairs: DataFrame) -> DataFrame:
        left = mappings.join(pairs.select("stem_a").distinct(), "stem_a", "left_semi")
        right = inverse(mappings.withColumnRenamed("stem_a", "x").join(pairs.select(F.col("stem_b").alias("x")).distinct(), "x", "left_semi").withColumnRenamed("x", "stem_a"))
        whole = compose(left, right, graphs, cost).join(pairs, ["stem_a", "stem_b"], "left_semi")
        uneven = whole.where("not even").select("stem_a", "stem_b").distinct()
        return score_mappings(whole.join(uneven, ["stem_a", "stem_b"], "left_anti"), graphs, cost).select("stem_a", "stem_b", "cost")

    items = members.select(F.col("family_id").alias("class"), "stem", F.coalesce("distortion", F.lit(0.0)).alias("rank"))
    found = leader_clusters(items, costs, threshold, batch)
    number = F.dense_rank().over(Window.partitionBy("class").orderBy("prototype")) - 1
    return found.select("stem", F.col("class").alias("family"), number.alias("subfamily"), F.col("prototype").alias("sub_prototype"), (F.col("stem") == F.col("prototype")).alias("is_sub_proto"), "cost")


def classify(scores: DataFrame, accept: float = 0.75, uncertain: float = 0.5, margin: float = 0.05) -> DataFrame:
    """(stem, label, score, second, status, ambiguous) from (stem, label, score): the best label, and whether it is clear."""
    ranked = scores.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("score", "label")), asc=False).alias("s"))
    best, second = F.col("s")[0], F.get(F.col("s"), F.lit(1))["score"]
    status = F.when(best["score"] >= accept, "classified").when(best["score"] >= uncertain, "uncertain").otherwise("flagged")
    return ranked.select("stem", best["label"].alias("label"), best["score"].alias("score"), second.alias("second"), status.alias("status"), F.coalesce(best["score"] - second <= margin, F.lit(False)).alias("ambiguous"))


# ---- topology families ---------------------------------------------------


def topology_families(hashes: DataFrame, scores: DataFrame) -> DataFrame:
    """(family_id, topology, size, prototype) from (stem, topology) and (stem, formula, distortion, core_bonds_per_fu): numbered from 1 by size, then hash."""
    x = hashes.join(scores, "stem")
    order = F.struct(F.col("distortion").isNull().alias("n"), F.col("distortion").alias("d"), F.col("formula").alias("f"), F.col("stem").alias("s"))
    g = x.groupBy("topology").agg(F.count(F.lit(1)).alias("size"), F.min_by("stem", order).alias("prototype"))
    g = g.withColumn("family_id", F.row_number().over(Window.orderBy(F.desc("size"), "topology")))
    return g.join(scores.select(F.col("stem").alias("prototype"), "core_bonds_per_fu"), "prototype").select("family_id", "topology", "size", "prototype", "core_bonds_per_fu")


def core_bonds_per_unit(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """(stem, units, core_bonds_per_fu, extended)."""
    units = nodes.groupBy("stem", "element").agg(F.count(F.lit(1)).alias("n")).groupBy("stem").agg(gcd(F.collect_list("n")).alias("units"))
    b = bonds.groupBy("stem").agg(F.count_if(F.col("sphere") == "core").alias("core"), F.count_if(F.col("sphere") != "core").alias("extended"))
    return units.join(b, "stem", "left").select("stem", "units", (F.coalesce("core", F.lit(0)) / F.col("units")).alias("core_bonds_per_fu"), F.coalesce("extended", F.lit(0)).alias("extended"))


def _hash(labels: list[str]) -> str:
    names, counts = np.unique(labels, return_counts=True)
    g = int(np.gcd.reduce(counts)) if len(counts) else 1
    return ";".join(f"{a}:{c // g}" for a, c in zip(names, counts))


def _topology(roles: list[str], edges: list[tuple[int, int]], depth: int) -> str:
    near: list[list[int]] = [[] for _ in roles]
    for i, j in edges:
        near[i].append(j)
        near[j].append(i)
    labels = [f"{r}_{len(x)}" for r, x in zip(roles, near)]
    for _ in range(depth):
        labels = [md5(f"{s}|{','.join(sorted(labels[j] for j in x))}".encode()).hexdigest()[:HASH_LENGTH] for s, x in zip(labels, near)]
    return _hash(labels)


def promoted_hashes(nodes: DataFrame, bonds: DataFrame, depth: int = 3) -> DataFrame:
    """(stem, added, topology): the hash after adding the strongest 1, 2, ... extended bonds to the core bonds."""
    atoms = nodes.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("ion_role", F.lit("unknown")).alias("role")))).alias("atoms"))
    weight = F.greatest(F.coalesce("vw_s", F.lit(0.0)), F.coalesce("vw_t", F.lit(0.0)))
    edge = F.struct((F.col("sphere") != "core").alias("ext"), (-weight).alias("w"), "source", "target", "img")
    packed = atoms.join(bonds.groupBy("stem").agg(F.array_sort(F.collect_list(edge)).alias("edges")), "stem")

    def hashes(parts):
        for part in parts:
            out = []
            for stem, own, edges in zip(part["stem"], part["atoms"], part["edges"]):
                atoms = [tuple(a.values()) if isinstance(a, dict) else tuple(a) for a in own]
                at = {a[0]: k for k, a in enumerate(atoms)}
                edges = [tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in edges]
                pairs = [(at[e[2]], at[e[3]]) for e in edges]
                core = sum(not e[0] for e in edges)
                for k in range(core + 1, len(edges) + 1):
                    out.append((stem, k - core, _topology([a[1] for a in atoms], pairs[:k], depth)))
            yield pd.DataFrame(out, columns=["stem", "added", "topology"])

    return packed.mapInPandas(hashes, "stem string, added int, topology string")


def topology_relations(families_: DataFrame, promoted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(child_id, parent_id, edges_added, edges_added_per_fu): families whose prototype becomes another's topology by adding extended bonds.

    The hashes of all prefixes are joined with the families by equality, so
    pairs of families are never enumerated; the parent must have more core
    bonds a formula unit.
    """
    child = families_.select(F.col("family_id").alias("child_id"), F.col("prototype").alias("stem"), F.col("core_bonds_per_fu").alias("c"))
    parent = families_.select(F.col("family_id").alias("parent_id"), "topology", F.col("core_bonds_per_fu").alias("p"))
    j = promoted.join(child, "stem").join(parent, "topology").where("p > c and child_id <> parent_id")
    least = j.groupBy("child_id", "parent_id", "stem").agg(F.min("added").alias("edges_added"))
    return least.join(sizes.select("stem", "units"), "stem").select("child_id", "parent_id", "edges_added", (F.col("edges_added") / F.col("units")).alias("edges_added_per_fu"))


def average_linkage(distances: np.ndarray) -> np.ndarray:
    """Rows (i, j, height, size) of average linkage over a small square matrix (on the driver; meant for prototypes, 5000 at most)."""
    n = len(distances)
    if n > 5000:
        raise ValueError("too many rows for a linkage on the driver")
    d = np.array(distances, float)
    np.fill_diagonal(d, np.inf)
    size, name, alive, out = np.ones(n), np.arange(n), np.ones(n, bool), []
    for step in range(n - 1):
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = sorted(divmod(int(np.argmin(masked)), n))
        out.append((min(name[i], name[j]), max(name[i], name[j]), masked[i, j], size[i] + size[j]))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        size[i] += size[j]
        name[i], alive[j] = n + step, False
    return np.array(out)

"""Matching of graphs: compatible formulas, cost functions, and the search for the cheapest mapping.

Pairs that can't match are dropped relationally, by their reduced element
counts, before any search.  A graph travels as one small row; each pair of
rows is searched by itself, so pairs are the unit of parallel work.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gcd
from .assign import assignments, bijections, count_assignments, hungarian
from .shell_walk import LOST, SKIP, atom_views

VACANCY, UNASSIGNED = "vacancy", "unassigned"
MISMATCH = 0.3
ZERO = 1e-9
ECN_LEAST = 0.005
MODES = ("corner", "edge", "face", "multi")


# ---- packed graphs -------------------------------------------------------


def packed_graphs(nodes: DataFrame, half: DataFrame, poly: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(stem, units, ratio, atoms, bonds, poly, shells): one row for each graph.

    ratio is the sorted list of reduced element counts, units the number of
    formula units; bonds below the least ECoN weight are left out.  shells, for
    the topology cost, are made of `near` (stem, id, rank, nbr), else empty.
    """
    counts = nodes.groupBy("stem", "element").agg(F.count(F.lit(1)).alias("n")).groupBy("stem").agg(F.array_sort(F.collect_list("n")).alias("c"))
    counts = counts.withColumn("units", gcd(F.col("c"))).select("stem", "units", F.transform("c", lambda x: (x / F.col("units")).cast("long")).alias("ratio"))
    atoms = nodes.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("id", "element", "ion_role", F.coalesce("cn_core", F.lit(0)).alias("cn_core")))).alias("atoms"))
    strongest = half.groupBy("stem", "eid").agg(F.max(F.coalesce("ecn", F.lit(1.0))).alias("w")).where(F.col("w") >= ECN_LEAST).select("stem", "eid")
    kept = half.join(strongest, ["stem", "eid"], "left_semi")
    bonds = kept.groupBy("stem", "mid", "nbr").agg(F.count(F.lit(1)).cast("int").alias("n"), F.avg("len").alias("len")).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("mid", "nbr", "n", "len"))).alias("bonds"))
    edges = poly.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.col("mode_all").alias("mode"), F.col("mean_angle").alias("angle")))).alias("poly"))
    packed = counts.join(atoms, "stem").join(bonds, "stem", "left").join(edges, "stem", "left")
    if near is None:
        return packed.withColumn("shells", F.lit(None).cast("array<struct<id:int,outer:array<int>,anions:array<int>>>"))
    anions = F.transform(F.filter("bonds", lambda b: b["anions"]), lambda b: b["nbr"])
    shells = atom_views(nodes, half, near).select("stem", F.struct("id", "outer", anions.alias("anions")).alias("s")).groupBy("stem").agg(F.array_sort(F.collect_list("s")).alias("shells"))
    return packed.join(shells, "stem", "left")


def graph_of(graphs: DataFrame) -> list:
    """The columns of a packed graph that searches need."""
    return [c for c in ("atoms", "bonds", "poly", "shells") if c in graphs.columns]


def compatible(graphs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(stem_a, stem_b): pairs of equal ratio whose numbers of formula units divide; all pairs a < b unless pairs are given."""
    side = lambda x: graphs.select(F.col("stem").alias(f"stem_{x}"), F.col("units").alias(f"units_{x}"), "ratio")
    if pairs is None:
        j = side("a").join(side("b"), "ratio").where("stem_a < stem_b")
    else:
        j = pairs.select("stem_a", "stem_b").join(side("a"), "stem_a").join(side("b"), ["stem_b", "ratio"])
    return j.where("units_a % units_b = 0 or units_b % units_a = 0").select("stem_a", "stem_b")


@dataclass
class Graph:
    """A packed graph as arrays over its atoms."""

    ids: list[int]
    element: list[str]
    role: list[str]
    cn_core: np.ndarray
    bonds: np.ndarray
    length: np.ndarray
    angles: list[list[float]]
    modes: np.ndarray
    groups: dict[str, list[int]] = field(default_factory=dict)
    outer: list[list[int]] = field(default_factory=list)
    anions: set[tuple[int, int]] = field(default_factory=set)

    @classmethod
    def of(cls, row) -> Graph:
        atoms = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in row["atoms"]]
        at = {a[0]: k for k, a in enumerate(atoms)}
        n = len(atoms)
        bonds, length = np.zeros((n, n), int), np.zeros((n, n))
        for x in row["bonds"] if row["bonds"] is not None else ():
            i, j, c, d = x.values() if isinstance(x, dict) else x
            bonds[at[i], at[j]], length[at[i], at[j]] = c, d
        angles, modes = [[] for _ in range(n)], np.zeros((n, len(MODES)))
        for x in row["poly"] if row["poly"] is not None else ():
            a, b, mode, angle = x.values() if isinstance(x, dict) else x
            for k in (at[a], at[b]):
                if angle is not None and not np.isnan(angle):
                    angles[k].append(float(angle))
                kind = "multi" if (mode or "").startswith("multi") else mode
                if kind in MODES:
                    modes[k, MODES.index(kind)] += 1
        modes /= np.maximum(modes.sum(1, keepdims=True), 1)
        out = cls([a[0] for a in atoms], [a[1] for a in atoms], [a[2] for a in atoms], np.array([a[3] for a in atoms]), bonds, length, [sorted(a) for a in angles], modes)
        for k, e in enumerate(out.element):
            out.groups.setdefault(e, []).append(k)
        out.outer = [[] for _ in range(n)]
        for x in row["shells"] if row.get("shells") is not None else ():
            i, outer, anions = x.values() if isinstance(x, dict) else x
            out.outer[at[i]] = [at[j] for j in outer]
            out.anions |= {(at[i], at[j]) for j in anions}
        return out


# ---- cost functions ------------------------------------------------------


class Cost:
    """A cost of a mapping; `pairs` lists (a, b) and image, preimage give partners by atom."""

    partial = False

    def pair(self, a: Graph, b: Graph, i: int, j: int, image: dict, preimage: dict) -> float:
        raise NotImplementedError

    def total(self, a: Graph, b: Graph, image: dict, preimage: dict, sentinels: dict | None = None) -> float:
        found = [self.pair(a, b, i, j, image, preimage) for i, js in image.items() for j in js]
        return (sum(found) / len(found) if found else 0.0) + self.missing(a, b, image, preimage, sentinels)

    def missing(self, a, b, image, preimage, sentinels, vacancy: float = 0.0, unassigned: float = 1.0) -> float:
        """Penalties of atoms without partners: vacancies are free, others cost 1 each."""
        kinds = sentinels or {}
        lone = [("a", i) for i in range(len(a.ids)) if not image.get(i)] + [("b", j) for j in range(len(b.ids)) if not preimage.get(j)]
        return sum(vacancy if kinds.get(x) == VACANCY else unassigned for x in lone)


class EdgeIdentity(Cost):
    """Bonds of a that b lacks under the mapping, and the reverse, at 0.3 each; bonds to atoms without partners as shares of the coordination number."""

    partial = True

    def pair(self, a, b, i, j, image, preimage):
        claimed: dict[int, int] = {}
        cost = loose_a = loose_b = 0.0
        for n in np.flatnonzero(a.bonds[i]).tolist():
            left = int(a.bonds[i, n])
            if not image.get(n):
                loose_a += left
                continue
            for m in image[n]:
                take = min(left, int(b.bonds[j, m]) - claimed.get(m, 0))
                if take > 0:
                    claimed[m] = claimed.get(m, 0) + take
                    left -= take
            cost += MISMATCH * left
        for m in np.flatnonzero(b.bonds[j]).tolist():
            left = int(b.bonds[j, m]) - claimed.get(m, 0)
            if left > 0:
                if preimage.get(m):
                    cost += MISMATCH * left
                else:
                    loose_b += left
        return cost + (loose_a + loose_b) / max(a.bonds[i].sum(), b.bonds[j].sum(), 1)


class CoreCoordination(Cost):
    """Sum of the differences of core coordination numbers."""

    def pair(self, a, b, i, j, image, preimage):
        return float(abs(a.cn_core[i] - b.cn_core[j]))

    def total(self, a, b, image, preimage, sentinels=None):
        return sum(self.pair(a, b, i, j, image, preimage) for i, js in image.items() for j in js)


class _Cohort(Cost):
    """Costs that are averaged over the atoms of a that share a partner, then summed over b (or averaged, with normalise)."""

    def __init__(self, normalise: bool = False):
        self.normalise = normalise

    def total(self, a, b, image, preimage, sentinels=None):
        terms = [sum(self.pair(a, b, i, j, image, preimage) for i in own) / len(own) for j, own in preimage.items() if own]
        return (sum(terms) / len(terms) if self.normalise and terms else sum(terms)) + self.missing(a, b, image, preimage, sentinels)


class BondLength(_Cohort):
    """Mean relative deviation of mean bond lengths to mapped neighbours; 1 for each bond without a counterpart."""

    def pair(self, a, b, i, j, image, preimage):
        total = count = 0.0
        for n in np.flatnonzero(a.bonds[i]).tolist():
            c = int(a.bonds[i, n])
            m = image.get(n, [None])[0] if image.get(n) else None
            count += c
            if m is None or not b.bonds[j, m]:
                total += c
            else:
                x, y = a.length[i, n], b.length[j, m]
                total += c * abs(x - y) / ((x + y) / 2)
        return total / count if count else 0.0


class BondAngle(_Cohort):
    """Mean difference of sorted angle lists, the shorter padded with its mean, as a share of 180 degrees."""

    def pair(self, a, b, i, j, image, preimage):
        x, y = a.angles[i], b.angles[j]
        if not x or not y:
            return float(bool(x) != bool(y))
        n = max(len(x), len(y))
        x, y = ([*v, *[sum(v) / len(v)] * (n - len(v))] for v in (x, y))
        return sum(abs(p - q) for p, q in zip(x, y)) / n / 180


class Polyhedral(_Cohort):
    """Half the L1 distance of the sharing-mode fractions, 1 at most."""

    def pair(self, a, b, i, j, image, preimage):
        return min(1.0, float(np.abs(a.modes[i] - b.modes[j]).sum()) / 2)


class Topology(Cost):
    """Surplus bonds by element, taken up by a walk through farther neighbours (see shell_walk); graphs need `shells`."""

    def __init__(self, strict: bool = True):
        self.strict = strict

    def pair(self, a, b, i, j, image, preimage):
        first = {n: b.element[js[0]] for n, js in image.items() if js}
        gap: dict[str, int] = {}
        closed, loose = {1: set(), -1: set()}, 0
        for g, at, of, sign in ((a, i, first.get, 1), (b, j, lambda m: b.element[m] if preimage.get(m) else None, -1)):
            for n in np.flatnonzero(g.bonds[at]).tolist():
                e = of(n)
                if e is None:
                    loose += int(g.bonds[at, n])
                    continue
                gap[e] = gap.get(e, 0) + sign * int(g.bonds[at, n])
                if self.strict and (at, n) in g.anions:
                    closed[sign].add(e)
        cost = loose / max(a.bonds[i].sum(), b.bonds[j].sum(), 1)
        for e, n in gap.items():
            if n > 0:
                cost += self._walk([b.element[m] for m in b.outer[j]], e, n, e in closed[1])
            elif n < 0:
                cost += self._walk([first.get(m) for m in a.outer[i]], e, -n, e in closed[-1])
        return cost

    @staticmethod
    def _walk(outer, element, needed, closed):
        cost = 0.0
        for e in outer:
            if not needed:
                break
            if e != element:
                cost += SKIP
            elif not closed:
                needed -= 1
        return cost + LOST * needed


class Weighted(Cost):
    """A weighted sum of costs; atoms without partners are judged by the first."""

    def __init__(self, parts: list[tuple[float, Cost]]):
        self.parts = parts

    def total(self, a, b, image, preimage, sentinels=None):
        return sum(w * c.total(a, b, image, preimage, sentinels) for w, c in self.parts)


COSTS: dict[str, type[Cost] | Cost] = {"edge_identity": EdgeIdentity, "cn_core_diff": CoreCoordination, "bond_length": BondLength, "bond_angle": BondAngle, "polyhedral": Polyhedral, "topology": Topology, "topology_loose": Topology(strict=False)}


def register_cost(name: str, cost) -> None:
    COSTS[name] = cost


def _cost(name: str) -> Cost:
    c = COSTS[name]
    return c() if isinstance(c, type) else c


# ---- search --------------------------------------------------------------


@dataclass
class Found:
    cost: float
    image: dict[int, list[int]]
    status: str
    tried: int
    k: int
    swapped: bool
    lone: dict[tuple[str, int], str] = field(default_factory=dict)


def _reverse(image: dict) -> dict:
    out: dict[int, list[int]] = {}
    for i, js in image.items():
        for j in js:
            out.setdefault(j, []).append(i)
    return out


def element_maps(a: Graph, b: Graph):
    """Bijections of elements that keep reduced counts; none if the formulas can't match."""
    ca, cb = ({e: len(x) for e, x in g.groups.items()} for g in (a, b))
    ga, gb = (int(np.gcd.reduce(list(c.values()))) for c in (ca, cb))
    if ga % gb and gb % ga:
        return
    classes = [{}, {}]
    for side, c, g in ((0, ca, ga), (1, cb, gb)):
        for e, n in sorted(c.items()):
            classes[side].setdefault(n // g, []).append(e)
    if {n: len(e) for n, e in classes[0].items()} != {n: len(e) for n, e in classes[1].items()}:
        return
    for combo in product(*(list(bijections(classes[0][n], classes[1][n])) for n in sorted(classes[0]))):
        yield {k: v for part in combo for k, v in part.items()}


def best_mapping(a: Graph, b: Graph, cost: str | Cost = "edge_identity", most_atoms: int = 25, most: int = 100_000) -> Found:
    """The cheapest mapping of a onto b that keeps elements in step.

    The graph with fewer formula units is laid over the other, each atom onto
    k atoms.  All dealings of all element maps are tried, cheapest first kept
    by strict improvement, up to a cost of 1e-9; costs with a partial bound
    are searched depth first with pruning.  Beyond `most` dealings an element
    map is judged by one dealing, least-cost by element.  An element with more
    than `most_atoms` atoms is an error.
    """
    c = _cost(cost) if isinstance(cost, str) else cost
    if max([len(x) for g in (a, b) for x in g.groups.values()], default=0) > most_atoms:
        return Found(float("inf"), {}, "too many atoms", 0, 0, False)
    swapped = len(a.ids) > len(b.ids)
    small, large = (b, a) if swapped else (a, b)
    k = len(large.ids) // max(1, len(small.ids))
    best, tried, status = Found(float("inf"), {}, "incompatible", 0, k, swapped), 0, "exact"

    def judged(dealt: dict) -> None:
        nonlocal best, tried
        tried += 1
        over = {i: list(js) for i, js in dealt.items()}
        image = _reverse(over) if swapped else over
        value = c.total(a, b, image, _reverse(image))
        if value < best.cost:
            best = Found(value, image, status, tried, k, swapped)

    for elements in element_maps(small, large):
        own = [(small.groups[e], large.groups[f]) for e, f in sorted(elements.items())]
        ways = 1
        for rows, _ in own:
            ways *= count_assignments(len(rows), k)
        if ways > most:
            status = "bounded"
            dealt = {}
            for rows, columns in own:
                matrix = np.array([[c.pair(small, large, i, j, {}, {}) if not swapped else c.pair(large, small, j, i, {}, {}) for j in columns] for i in rows])
                left = list(range(len(columns)))
                for _ in range(k):
                    for r, x in zip(rows, (picked := hungarian(matrix[:, left])).tolist()):
                        dealt.setdefault(r, []).append(columns[left[x]])
                    left = [x for n, x in enumerate(left) if n not in set(picked.tolist())]
            judged(dealt)
        elif c.partial and k == 1 and isinstance(c, EdgeIdentity):
            _descend(a, b, c, own, swapped, judged, lambda: best.cost)
        else:
            for combo in product(*(list(assignments(rows, columns, k)) for rows, columns in own)):
                judged({i: js for part in combo for i, js in part.items()})
                if best.cost <= ZERO:
                    break
        if best.cost <= ZERO:
            break
    best.tried = tried
    return best


def _descend(a, b, c, own, swapped, judged, best) -> None:
    """Depth first over one-to-one dealings; a branch ends when the bond mismatches among its atoms alone cost as much as the best."""
    rows = [i for r, _ in own for i in r]
    pool = {i: columns for r, columns in own for i in r}
    x, y = (b.bonds, a.bonds) if swapped else (a.bonds, b.bonds)
    n = len(rows)
    to: dict[int, int] = {}
    used: set[int] = set()

    def go(depth: int, cost: float) -> None:
        if best() <= ZERO:
            return
        if depth == n:
            judged({i: [j] for i, j in to.items()})
            return
        i = rows[depth]
        for j in pool[i]:
            if j in used:
                continue
            more = abs(int(x[i, i]) - int(y[j, j])) + 2 * sum(abs(int(x[i, p]) - int(y[j, q])) for p, q in to.items())
            if (cost + MISMATCH * more) / n < best():
                to[i] = j
                used.add(j)
                go(depth + 1, cost + MISMATCH * more)
                used.discard(j)
                del to[i]

    go(0, 0.0)


def brute_force(a: Graph, b: Graph, cost: str | Cost = "edge_identity", most_atoms: int = 10, most: int = 100_000) -> Found:
    """The cheapest dealing of the larger graph's atoms to the smaller's, whatever their elements; at most `most_atoms` atoms of the larger.

    Atoms with more core bonds than any other can take are tried among equals
    first: if the core coordination numbers of both sides deal out evenly, only
    such dealings are made, else those of equal role, else all.
    """
    c = _cost(cost) if isinstance(cost, str) else cost
    swapped = len(a.ids) > len(b.ids)
    small, large = (b, a) if swapped else (a, b)
    if len(large.ids) > most_atoms or not small.ids:
        return Found(float("inf"), {}, "too many atoms", 0, 0, swapped)
    k, rest = divmod(len(large.ids), len(small.ids))
    best = Found(float("inf"), {}, "incompatible", 0, k, swapped)
    if rest:
        return best

    def classes(print_of):
        left, right = {}, {}
        for side, g in ((left, small), (right, large)):
            for i in range(len(g.ids)):
                side.setdefault(print_of(g, i), []).append(i)
        return [(left[x], right[x]) for x in left] if {x: k * len(v) for x, v in left.items()} == {x: len(v) for x, v in right.items()} else None

    prints = (lambda g, i: (g.role[i], int(g.cn_core[i])), lambda g, i: g.role[i], lambda g, i: 0)
    own = next(x for x in map(classes, prints) if x is not None)
    for combo in product(*(list(assignments(rows, columns, k)) for rows, columns in own)):
        over = {i: list(js) for part in combo for i, js in part.items()}
        image = _reverse(over) if swapped else over
        value = c.total(a, b, image, _reverse(image))
        best.tried += 1
        if value < best.cost:
            best = Found(value, image, "exact", best.tried, k, swapped)
        if best.cost <= ZERO or best.tried >= most:
            break
    if best.tried >= most:
        best.status = "bounded"
    return best


OPTIMIZERS: dict = {"stoichiometry_constrained": best_mapping, "brute_force": brute_force}


def register_optimizer(name: str, search) -> None:
    """search(a, b, cost, most_atoms, most) gives a Found."""
    OPTIMIZERS[name] = search


_RESULT = "stem_a string, stem_b string, cost_fn string, cost double, k int, role_swapped boolean, status string, tried long, mapping array<struct<a_id:int,slot:int,b_id:int,slot_kind:string>>"


def _rows_of(found: Found, a: Graph, b: Graph) -> list[dict]:
    """Rows of a mapping; atoms without a partner are named by their kind, those of b where the search says so."""
    out = [{"a_id": a.ids[i], "slot": s, "b_id": b.ids[j], "slot_kind": "real"} for i, js in sorted(found.image.items()) for s, j in enumerate(js)]
    if found.image:
        out += [{"a_id": a.ids[i], "slot": 0, "b_id": None, "slot_kind": found.lone.get(("a", i), UNASSIGNED)} for i in range(len(a.ids)) if not found.image.get(i)]
        out += [{"a_id": None, "slot": 0, "b_id": b.ids[j], "slot_kind": kind} for (side, j), kind in sorted(found.lone.items()) if side == "b"]
    return out


def match_pairs(pairs: DataFrame, graphs: DataFrame, cost: str = "edge_identity", most_atoms: int = 25, most: int = 100_000, optimizer: str = "stoichiometry_constrained") -> DataFrame:
    """The best mapping of each pair (stem_a, stem_b): cost, k, status (exact, bounded, too many atoms, incompatible, or an error) and the mapping's rows.

    Pairs are dealt out by a hash, so that expensive pairs spread; a failing
    pair has an infinite cost and its error as status.
    """
    side = lambda x: graphs.select(F.struct(*graph_of(graphs)).alias(f"g_{x}"), F.col("stem").alias(f"stem_{x}"))
    rows = pairs.select("stem_a", "stem_b").join(side("a"), "stem_a").join(side("b"), "stem_b").select("stem_a", "stem_b", "g_a", "g_b").repartition("stem_a", "stem_b")
    chosen, optimize = _cost(cost), OPTIMIZERS[optimizer]

    def search(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                try:
                    a, b = Graph.of(r.g_a), Graph.of(r.g_b)
                    f = optimize(a, b, chosen, most_atoms, most)
                    out.append((r.stem_a, r.stem_b, cost, f.cost, f.k, f.swapped, f.status, f.tried, _rows_of(f, a, b)))
                except Exception as e:  # one pair's failure is a row, not the end of the job
                    out.append((r.stem_a, r.stem_b, cost, float("inf"), 0, False, f"error: {e}"[:200], 0, []))
            yield pd.DataFrame(out, columns=["stem_a", "stem_b", "cost_fn", "cost", "k", "role_swapped", "status", "tried", "mapping"])

    return rows.mapInPandas(search, _RESULT)


def symmetric_pairs(pairs: DataFrame, graphs: DataFrame, cost: str = "edge_identity", **options) -> DataFrame:
    """(stem_a, stem_b, cost, cost_ab, cost_ba, consistent, only_ab, only_ba): both directions of each pair, their mean cost, and the atom pairs (a, b) on which they agree.

    A pair that is perfect one way is so the other way, and isn't searched again.
    """
    from .cluster import _stored

    there = _stored(match_pairs(pairs, graphs, cost, **options), "match-there")
    whole = (F.col("cost") <= ZERO) & ~F.exists("mapping", lambda m: m["slot_kind"] != "real")
    back = match_pairs(there.where(~whole).select(F.col("stem_b").alias("stem_a"), F.col("stem_a").alias("stem_b")), graphs, cost, **options)
    real = F.filter("mapping", lambda m: m["slot_kind"] == "real")
    ab = there.select("stem_a", "stem_b", F.col("cost").alias("cost_ab"), F.array_sort(F.transform(real, lambda m: F.struct(m["a_id"].alias("a"), m["b_id"].alias("b")))).alias("ab"))
    ba = back.select(F.col("stem_b").alias("stem_a"), F.col("stem_a").alias("stem_b"), F.col("cost").alias("cost_ba"), F.array_sort(F.transform(real, lambda m: F.struct(m["b_id"].alias("a"), m["a_id"].alias("b")))).alias("ba"))
    x = ab.join(ba, ["stem_a", "stem_b"], "left").withColumn("cost_ba", F.coalesce("cost_ba", F.lit(0.0))).withColumn("ba", F.coalesce("ba", "ab"))
    mean = F.round((F.col("cost_ab") + F.col("cost_ba")) / 2, 6)
    return x.select("stem_a", "stem_b", mean.alias("cost"), "cost_ab", "cost_ba", F.array_intersect("ab", "ba").alias("consistent"), F.array_except("ab", "ba").alias("only_ab"), F.array_except("ba", "ab").alias("only_ba"))


# ---- mappings as tables --------------------------------------------------


def mapping_rows(results: DataFrame) -> DataFrame:
    return results.select("stem_a", "stem_b", F.explode("mapping").alias("m")).select("stem_a", "stem_b", "m.*")


def inverse(mappings: DataFrame) -> DataFrame:
    """The mapping from b to a, slots numbered anew."""
    real = mappings.where("slot_kind = 'real'").groupBy("stem_a", "stem_b", "b_id").agg(F.array_sort(F.collect_list("a_id")).alias("a"))
    return real.select(F.col("stem_b").alias("stem_a"), F.col("stem_a").alias("stem_b"), F.col("b_id").alias("a_id"), F.posexplode("a").alias("slot", "b_id")).withColumn("slot_kind", F.lit("real"))


def invalid(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mapping rows whose atoms don't exist."""
    has = lambda x, c: nodes.select(F.col("stem").alias(f"stem_{x}"), F.col("id").alias(c))
    lost_a = mappings.join(has("a", "a_id"), ["stem_a", "a_id"], "left_anti")
    lost_b = mappings.where("b_id is not null").join(has("b", "b_id"), ["stem_b", "b_id"], "left_anti")
    return lost_a.unionByName(lost_b).distinct()


def compose(to_parent: DataFrame, from_parent: DataFrame, graphs: DataFrame | None = None, cost: str = "edge_identity") -> DataFrame:
    """a -> parent and parent -> b as a -> b: (stem_a, stem_b, a_id, slot, b_id, slot_kind, even).

    Both are real rows (stem_a, stem_b, a_id, b_id).  At an anchor with one
    partner on a side all pairs hold; equal numbers above one are paired at
    least summed cost of their pairs in `graphs` (in order, without graphs);
    with different numbers above one nothing can be paired: `even` is false and
    b_id is null.
    """
    left = to_parent.where("slot_kind = 'real'").select(F.col("stem_a"), F.col("stem_b").alias("parent"), "a_id", F.col("b_id").alias("anchor")).groupBy("stem_a", "parent", "anchor").agg(F.array_sort(F.collect_list("a_id")).alias("left"))
    right = from_parent.where("slot_kind = 'real'").select(F.col("stem_a").alias("parent"), "stem_b", F.col("a_id").alias("anchor"), "b_id").groupBy("stem_b", "parent", "anchor").agg(F.array_sort(F.collect_list("b_id")).alias("right"))
    j = left.join(right, ["parent", "anchor"])
    m, n = F.size("left"), F.size("right")
    cohort = (m == n) & (m > 1) if graphs is not None else F.lit(False)
    pair = lambda a, b: F.struct(a.alias("a_id"), b.alias("b_id"))
    pairs = (
        F.when(m == n, F.arrays_zip(F.col("left").alias("a_id"), F.col("right").alias("b_id")))
        .when((m == 1) | (n == 1), F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: pair(a, b)))))
        .otherwise(F.transform("left", lambda a: pair(a, F.lit(None).cast("int"))))
    )
    even = (m == n) | (m == 1) | (n == 1)
    x = j.where(~cohort).select("stem_a", "stem_b", even.alias("even"), F.explode(pairs).alias("p")).select("stem_a", "stem_b", "p.a_id", "p.b_id", "even")
    if graphs is not None:
        x = x.unionByName(_paired(j.where(cohort), graphs, cost).withColumn("even", F.lit(True)))
    return x.withColumn("slot", F.lit(0)).withColumn("slot_kind", F.when(F.col("even"), "real").otherwise(UNASSIGNED))


def _paired(cohorts: DataFrame, graphs: DataFrame, cost: str) -> DataFrame:
    """(stem_a, stem_b, a_id, b_id): atoms of equally long lists left and right, paired at least summed cost."""
    side = lambda x: graphs.select(F.struct(*graph_of(graphs)).alias(f"g_{x}"), F.col("stem").alias(f"stem_{x}"))
    rows = cohorts.groupBy("stem_a", "stem_b").agg(F.collect_list(F.struct("left", "right")).alias("c")).join(side("a"), "stem_a").join(side("b"), "stem_b")
    chosen = _cost(cost)

    def assign(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                a, b = Graph.of(r.g_a), Graph.of(r.g_b)
                at_a, at_b = ({x: k for k, x in enumerate(g.ids)} for g in (a, b))
                for c in r.c:
                    left, right = (list(map(int, x)) for x in (c.values() if isinstance(c, dict) else c))
                    matrix = np.array([[min(chosen.pair(a, b, at_a[i], at_b[j], {}, {}), 1e9) for j in right] for i in left])
                    out += [(r.stem_a, r.stem_b, i, right[k]) for i, k in zip(left, hungarian(matrix).tolist())]
            yield pd.DataFrame(out, columns=["stem_a", "stem_b", "a_id", "b_id"])

    return rows.mapInPandas(assign, "stem_a string, stem_b string, a_id int, b_id int")


def score_mappings(mappings: DataFrame, graphs: DataFrame, cost: str) -> DataFrame:
    """(stem_a, stem_b, cost_fn, cost) of given mappings under another cost."""
    side = lambda x: graphs.select(F.struct(*graph_of(graphs)).alias(f"g_{x}"), F.col("stem").alias(f"stem_{x}"))
    lists = mappings.where("slot_kind = 'real'").groupBy("stem_a", "stem_b").agg(F.collect_list(F.struct("a_id", "b_id")).alias("m"))
    rows = lists.join(side("a"), "stem_a").join(side("b"), "stem_b").select("stem_a", "stem_b", "g_a", "g_b", "m")
    chosen = _cost(cost)

    def score(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                a, b = Graph.of(r.g_a), Graph.of(r.g_b)
                at_a, at_b = ({x: k for k, x in enumerate(g.ids)} for g in (a, b))
                image: dict[int, list[int]] = {}
                for x in r.m:
                    p, q = x.values() if isinstance(x, dict) else x
                    image.setdefault(at_a[p], []).append(at_b[q])
                out.append((r.stem_a, r.stem_b, cost, chosen.total(a, b, image, _reverse(image))))
            yield pd.DataFrame(out, columns=["stem_a", "stem_b", "cost_fn", "cost"])

    return rows.mapInPandas(score, "stem_a string, stem_b string, cost_fn string, cost double")


def score_symmetric(mappings: DataFrame, graphs: DataFrame, cost: str) -> DataFrame:
    """(stem_a, stem_b, cost_fn, cost): the mean of the scores of given mappings and of their inverses."""
    there = score_mappings(mappings, graphs, cost)
    back = score_mappings(inverse(mappings), graphs, cost).select(F.col("stem_b").alias("stem_a"), F.col("stem_a").alias("stem_b"), F.col("cost").alias("_back"))
    return there.join(back, ["stem_a", "stem_b"]).select("stem_a", "stem_b", "cost_fn", ((F.col("cost") + F.col("_back")) / 2).alias("cost"))


def translated(poly: DataFrame, mappings: DataFrame) -> DataFrame:
    """Polyhedral edges of a, carried to b: (stem_a, stem_b, a, b, mode, angle), one row for each pair of partners."""
    # Mappings grow with the atoms, so they are no broadcast, however small they seem.
    m = mappings.where("slot_kind = 'real'").select("stem_a", "stem_b", "a_id", "b_id").hint("merge")
    p = poly.select(F.col("stem").alias("stem_a"), "a", "b", F.col("mode_all").alias("mode"), F.col("mean_angle").alias("angle"))
    x = p.join(m.select("stem_a", "stem_b", F.col("a_id").alias("a"), F.col("b_id").alias("to_a")), ["stem_a", "a"])
    x = x.join(m.select("stem_a", "stem_b", F.col("a_id").alias("b"), F.col("b_id").alias("to_b")), ["stem_a", "stem_b", "b"])
    return x.select("stem_a", "stem_b", F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"), "mode", "angle")


def polyhedral_f1(poly: DataFrame, mappings: DataFrame) -> DataFrame:
    """(stem_a, stem_b, recall, precision, f1) over distinct (pair, mode) keys of the carried edges."""
    keys, edge = ["stem_a", "stem_b"], ["a", "b", "mode"]
    carried = translated(poly, mappings).select(*keys, *edge).distinct()
    own = poly.select(F.col("stem").alias("stem_b"), "a", "b", F.col("mode_all").alias("mode")).distinct()
    # A pair whose b has no edge keeps a row without one; the edges of both graphs meet once.
    own = mappings.select(*keys).distinct().join(own.hint("merge"), "stem_b", "left").select(*keys, *edge)
    one = lambda x, made: x.withColumn("made", F.lit(made)).withColumn("there", F.when(F.col("mode").isNotNull(), 1 - made).otherwise(0))
    met = one(carried, 1).unionByName(one(own, 0)).repartition(*keys).groupBy(*keys, *edge).agg(F.max("made").alias("made"), F.max("there").alias("there"))
    x = met.groupBy(*keys).agg(F.sum(F.col("made") * F.col("there")).alias("hit"), F.sum("made").alias("made"), F.sum("there").alias("there"))
    share = lambda n: F.when(F.col(n) > 0, F.col("hit") / F.col(n)).otherwise(F.when(F.col("made") + F.col("there") == 0, 1.0).otherwise(0.0))
    x = x.withColumn("recall", share("made")).withColumn("precision", share("there"))
    return x.select(*keys, "recall", "precision", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0).alias("f1"))


def compare(nodes: DataFrame, poly: DataFrame, results: DataFrame) -> DataFrame:
    """(stem_a, stem_b, node_cost, existence, mode_match, reconcilable, angle_similarity): edges of a judged level by level under the mapping.

    Unique keys (pair of b, mode) of the carried edges: does b have an edge
    there, does the mode agree (then how close is the angle, exp(-d / 20)),
    and if not, does the side of lower coordination at both ends share fewer
    atoms, with room for the difference.
    """
    keys = ["stem_a", "stem_b"]
    m = mapping_rows(results).where("slot_kind = 'real'")
    t = translated(poly.withColumn("mode_all", F.concat_ws("|", "mode_all", F.col("n_all").cast("string"))), m)
    t = t.groupBy(*keys, "a", "b", "mode").agg(F.min("angle").alias("angle"))
    t = t.withColumn("shared", F.split("mode", r"\|")[1].cast("int")).withColumn("mode", F.split("mode", r"\|")[0])
    there = poly.groupBy(F.col("stem").alias("stem_b"), "a", "b").agg(F.collect_list(F.struct(F.col("mode_all").alias("mode"), F.col("n_all").alias("shared"), F.col("mean_angle").alias("angle"))).alias("e"))
    cn = m.join(nodes.select(F.col("stem").alias("stem_a"), F.col("id").alias("a_id"), F.col("cn").alias("cn_a")), ["stem_a", "a_id"]).join(nodes.select(F.col("stem").alias("stem_b"), F.col("id").alias("b_id"), F.col("cn").alias("cn_b")), ["stem_b", "b_id"])
    cn = cn.groupBy(*keys, "b_id").agg(F.min(F.col("cn_a") - F.col("cn_b")).alias("d"))
    j = t.join(there, ["stem_b", "a", "b"], "left")
    for c in "ab":
        j = j.join(cn.select(*keys, F.col("b_id").alias(c), F.col("d").alias(f"d{c}")), [*keys, c], "left")
    same = F.filter("e", lambda x: x["mode"] == F.col("mode"))
    gap = F.col("shared") - F.col("e")[0]["shared"]
    fits = ((gap < 0) & (F.col("da") < 0) & (F.col("db") < 0) | (gap > 0) & (F.col("da") > 0) & (F.col("db") > 0)) & (F.least(F.abs("da"), F.abs("db")) >= F.abs(gap))
    j = j.withColumn("exists", F.col("e").isNotNull()).withColumn("hit", F.coalesce(F.size(same) > 0, F.lit(False)))
    j = j.withColumn("close", F.when(F.col("hit"), F.exp(-F.abs(F.col("angle") - same[0]["angle"]) / 20))).withColumn("fits", F.coalesce(~F.col("hit") & fits, F.lit(False)))
    rate = lambda c, of: F.coalesce(F.sum(F.col(c).cast("int")) / F.sum(F.col(of).cast("int")), F.lit(1.0))
    g = j.groupBy(*keys).agg(F.avg(F.col("exists").cast("double")).alias("existence"), rate("hit", "exists").alias("mode_match"), F.avg(F.col("fits").cast("double")).alias("reconcilable"), F.avg("close").alias("angle_similarity"))
    return results.select(*keys, F.col("cost").alias("node_cost")).join(g, keys, "left")


def node_matches(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(stem_a, stem_b, bucket, k, id_a, id_b, cost): atoms assigned inside coordination buckets at least fingerprint cost.

    If every bucket of a divides b's by one whole ratio k, each atom gets k
    partners; otherwise k is the bucket's own ratio, rounded up, and atoms of b
    may be left over.
    """
    from .fingerprint import fingerprint_costs

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        a, b = sorted(part["id_a"].unique()), sorted(part["id_b"].unique())
        matrix = part.pivot(index="id_a", columns="id_b", values="cost").loc[a, b].to_numpy()
        turned = len(a) > len(b)
        if turned:
            matrix = matrix.T
        k = ceil(matrix.shape[1] / matrix.shape[0])
        from .assign import supercell

        rows = []
        for r, cs in enumerate(supercell(matrix, k)):
            for c in cs:
                i, j = (c, r) if turned else (r, c)
                rows.append((part["stem_a"].iloc[0], part["stem_b"].iloc[0], part["bucket"].iloc[0], k, a[i], b[j], matrix[r, c]))
        return pd.DataFrame(rows, columns=["stem_a", "stem_b", "bucket", "k", "id_a", "id_b", "cost"])

    costs = fingerprint_costs(pairs, prints)
    costs = costs.join(prints.select(F.col("stem").alias("stem_a"), F.col("id").alias("id_a"), "bucket"), ["stem_a", "id_a"])
    return costs.groupBy("stem_a", "stem_b", "bucket").applyInPandas(assign, "stem_a string, stem_b string, bucket string, k int, id_a int, id_b int, cost double")

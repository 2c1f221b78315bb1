"""Mappings between graphs of different numbers of atoms, and what becomes of atoms without a partner.

A mapping is found in rounds: in each, the atoms of every role are assigned at
least cost to the other graph's atoms of that role or to a vacancy column of
their own, whose price falls from ABSENT to WELCOME by the share of the atom's
bonds that its absence explains; the costs are those under the mapping of the
round before.  Rounds end when a mapping comes again, or after ROUNDS; the
cheapest mapping met is the answer.

The first mapping pairs atoms by coordination number and sharing modes, between
the elements that a padded assignment over coordination buckets makes partners.

An atom without a partner is a vacancy if the other graph is this one without
it: at each of its neighbours, the bonds that are left without the atom (and
without its unmatched siblings) are as many as the neighbour's partner has.
Atoms of a partly matched class are vacancies too where all matched classes are
multiplied alike (a supercell).  Otherwise it is unassigned; and where both
graphs have such atoms of one role, a pair was possible, and they are unforced.
`lone_atoms` says so for any table of mappings, by joins and aggregates.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assign import hungarian
from .match import UNASSIGNED, VACANCY, Found, Graph, _cost, _reverse, register_optimizer

WELCOME, ABSENT = 0.25, 1.0
ROUNDS = 10
FORBIDDEN = 1e9
PADDING = 100.0
PENALTIES = {VACANCY: 0.0, UNASSIGNED: 1.0, "unforced_vacancy": 2.0, "unforced_unassigned": 2.0}


def _bucket(cn: int) -> str:
    return "tet" if cn <= 4 else "oct" if cn <= 6 else "high"


def element_partners(a: Graph, b: Graph) -> dict[str, str | None]:
    """For each element of a the element of b, or None for a vacancy: least distance of their shares of the coordination buckets.

    The shorter list is padded; an element without a partner costs PADDING.
    """

    def shares(g: Graph):
        own = [(e, _bucket(int(n))) for e, n in zip(g.element, g.bonds.sum(1))]
        totals, each = Counter(x for _, x in own), Counter(own)
        return {e: {x: each[e, x] / n for x, n in totals.items()} for e in sorted(g.groups)}

    left, right = shares(a), shares(b)
    n = max(len(left), len(right))
    matrix = np.full((n, n), PADDING)
    for i, x in enumerate(left.values()):
        for j, y in enumerate(right.values()):
            matrix[i, j] = sum(abs(x.get(k, 0.0) - y.get(k, 0.0)) for k in {*x, *y})
    names = [*right, *[None] * (n - len(right))]
    return {e: names[j] for e, j in zip(left, hungarian(matrix).tolist())} if n else {}


def completion(g: Graph, other: Graph, i: int, partner: dict[int, list[int]], lone: set[int]) -> float:
    """Share of the bonds of atom i whose other ends have as many bonds without it as their partners have."""
    cn, others = g.bonds.sum(1), other.bonds.sum(1)
    siblings = [s for s in lone if s != i and g.element[s] == g.element[i] and cn[s] == cn[i]]
    good = 0
    for k in np.flatnonzero(g.bonds[i]).tolist():
        if partner.get(k):
            left = cn[k] - g.bonds[i, k] - sum(g.bonds[s, k] for s in siblings)
            good += int(g.bonds[i, k]) if left == others[partner[k][0]] else 0
    return good / max(int(cn[i]), 1)


def _uniform(g: Graph, matched: set[int]) -> set[tuple]:
    """Classes (element, coordination number) with matched atoms, if all of these are multiplied alike."""
    kind = [(e, int(n)) for e, n in zip(g.element, g.bonds.sum(1))]
    every, met = Counter(kind), Counter(kind[i] for i in matched)
    return set(met) if len({every[c] / n for c, n in met.items()}) == 1 else set()


def kinds_of(a: Graph, b: Graph, image: dict[int, list[int]]) -> dict[tuple[str, int], str]:
    """Kind of each atom without a partner, by side and index."""
    sides = {"a": (a, b, {i: js for i, js in image.items() if js}), "b": (b, a, _reverse(image))}
    lone = {s: {i for i in range(len(g.ids)) if not p.get(i)} for s, (g, _, p) in sides.items()}
    both = {a.role[i] for i in lone["a"]} & {b.role[j] for j in lone["b"]}
    out = {}
    for s, (g, other, partner) in sides.items():
        alike = _uniform(g, set(partner))
        for i in lone[s]:
            copy = (g.element[i], int(g.bonds[i].sum())) in alike
            vacant = copy or completion(g, other, i, partner, lone[s]) >= 1
            kind = VACANCY if vacant else UNASSIGNED
            out[s, i] = f"unforced_{kind}" if g.role[i] in both and not copy else kind
    return out


def search(a: Graph, b: Graph, cost="edge_identity", most_atoms: int = 200, most: int = 100_000) -> Found:
    """The cheapest one-to-one mapping that the rounds meet, with vacancies; `most` has no meaning here.

    Graphs of more than `most_atoms` atoms are an error.
    """
    c = _cost(cost) if isinstance(cost, str) else cost
    if max(len(a.ids), len(b.ids), 0) > most_atoms:
        return Found(float("inf"), {}, "too many atoms", 0, 0, False)
    partners = element_partners(a, b)
    gap = np.abs(a.bonds.sum(1)[:, None] - b.bonds.sum(1)[None]) + np.abs(a.modes[:, None] - b.modes[None]).sum(2) / 2
    gap = gap + np.array([[0.0 if partners.get(e) == f else 0.5 for f in b.element] for e in a.element]).reshape(gap.shape)
    image: dict[int, list[int]] = {}
    best, seen, tried = Found(float("inf"), {}, "incompatible", 0, 1, False), set(), 0
    for turn in range(ROUNDS + 1):
        preimage = _reverse(image)
        lone = {i for i in range(len(a.ids)) if not image.get(i)}
        new: dict[int, list[int]] = {}
        for role in sorted({*a.role, *b.role}):
            rows, columns = ([i for i, r in enumerate(g.role) if r == role] for g in (a, b))
            if not rows:
                continue
            matrix = np.full((len(rows), len(columns) + len(rows)), FORBIDDEN)
            for x, i in enumerate(rows):
                # A place is judged as if the atom stood there, the rest as they are; structure breaks ties.
                for y, j in enumerate(columns):
                    matrix[x, y] = 1e-3 * gap[i, j] if not turn else min(c.pair(a, b, i, j, image | {i: [j]}, preimage | {j: [i]}), FORBIDDEN) + 1e-3 * gap[i, j]
                share = completion(a, b, i, image, lone | {i}) if turn else 0.0
                matrix[x, len(columns) + x] = ABSENT - (ABSENT - WELCOME) * share
            for x, y in enumerate(hungarian(matrix).tolist()):
                if y < len(columns):
                    new[rows[x]] = [columns[y]]
        kinds = kinds_of(a, b, new)
        tried += 1
        value = c.total(a, b, new, _reverse(new), {k: VACANCY for k in kinds}) + sum(PENALTIES[k] for k in kinds.values())
        if value < best.cost - 1e-12:
            best = Found(value, new, "rounds", tried, 1, False, kinds)
        key = tuple(sorted((i, js[0]) for i, js in new.items()))
        if key in seen or best.cost <= 1e-9 and not kinds:
            break
        seen.add(key)
        image = new
    best.tried = tried
    return best


register_optimizer("vacancies", search)


# ---- tables ----------------------------------------------------------------


def lone_atoms(mappings: DataFrame, nodes: DataFrame, half: DataFrame) -> DataFrame:
    """(stem_a, stem_b, side, id, completion, kind, penalty) of the atoms without a partner.

    mappings: real rows (stem_a, stem_b, a_id, slot, b_id); a partner of several
    counts by its smallest.  nodes: (stem, id, element, ion_role).  Every
    mapping with a real row is judged; graphs of which no atom is mapped have none.
    """
    keys = ["stem_a", "stem_b"]
    real = mappings.where("slot_kind = 'real'")
    near = half.groupBy("stem", F.col("mid").alias("id"), "nbr").agg(F.count(F.lit(1)).alias("n"))
    cn = near.groupBy("stem", "id").agg(F.sum("n").alias("cn"))
    atoms = nodes.select("stem", "id", "element", F.col("ion_role").alias("role")).join(cn, ["stem", "id"], "left").withColumn("cn", F.coalesce("cn", F.lit(0)))

    def side(own: str, other: str) -> DataFrame:
        # A partner learns its bonds where its graph lies; the partners of a graph then travel as one short row, with which its atoms meet.
        there = cn.select(F.col("stem").alias(f"stem_{other}"), F.col("id").alias(f"{other}_id"), F.col("cn").alias("cn_to"))
        partner = real.join(there, [f"stem_{other}", f"{other}_id"], "left").groupBy(*keys, F.col(f"{own}_id").alias("id")).agg(F.min(f"{other}_id").alias("to"), F.min_by("cn_to", f"{other}_id").alias("cn_to"))
        graph = partner.groupBy(*keys).agg(F.collect_list(F.struct("id", "to", "cn_to")).alias("_partners"))
        x = atoms.withColumnRenamed("stem", f"stem_{own}").hint("merge").join(graph, f"stem_{own}")
        x = x.withColumn("_p", F.filter("_partners", lambda p: p["id"] == F.col("id"))).drop("_partners")
        return x.select(*keys, "id", "element", "role", "cn", F.get("_p", F.lit(0))["to"].alias("to"), F.get("_p", F.lit(0))["cn_to"].alias("cn_to"))

    def judged(own: str, other: str) -> DataFrame:
        kind = Window.partitionBy(*keys, "element", "cn")
        classes = side(own, other).withColumn("_all", F.count(F.lit(1)).over(kind)).withColumn("_met", F.count("to").over(kind))
        factor = F.when(F.col("_met") > 0, F.col("_all") / F.col("_met"))
        whole = Window.partitionBy(*keys)
        classes = classes.withColumn("_uniform", F.min(factor).over(whole) == F.max(factor).over(whole))
        classes = classes.withColumn("copy", F.coalesce((F.col("_met") > 0) & F.col("_uniform"), F.lit(False)))
        # Bonds of a class's lone atoms at each neighbour, the atom's own included, against what its partner has.
        # Every bond is seen from both ends, so a neighbour's own row is at hand.
        at = classes.join(near.select(F.col("stem").alias(f"stem_{own}"), "id", "nbr", "n"), [f"stem_{own}", "id"], "left")
        ends = Window.partitionBy(*keys, F.least("id", "nbr"), F.greatest("id", "nbr"))
        left = F.max(F.when(F.col("to").isNotNull(), F.col("cn") - F.coalesce("cn_to", F.lit(0)))).over(ends)
        lone = at.withColumn("_left", left).where("to is null").withColumn("_gone", F.sum("n").over(Window.partitionBy(*keys, "element", "cn", "nbr")))
        good = F.coalesce(F.sum(F.when(F.col("_left") == F.col("_gone"), F.col("n"))), F.lit(0))
        lone = lone.groupBy(*keys, "id", "role", "copy", "cn").agg(good.alias("_good"))
        return lone.select(*keys, F.lit(own).alias("side"), "id", "role", "copy", (F.col("_good") / F.greatest("cn", F.lit(1))).alias("completion"))

    both = judged("a", "b").unionByName(judged("b", "a"))
    sides = F.size(F.collect_set("side").over(Window.partitionBy(*keys, "role"))) == 2
    kind = F.when(F.col("copy") | (F.col("completion") >= 1), VACANCY).otherwise(UNASSIGNED)
    named = both.withColumn("kind", F.when(sides & ~F.col("copy"), F.concat(F.lit("unforced_"), kind)).otherwise(kind))
    prices = F.create_map(*[F.lit(x) for p in PENALTIES.items() for x in p])
    return named.select(*keys, "side", "id", "completion", "kind", F.element_at(prices, F.col("kind")).alias("penalty"))

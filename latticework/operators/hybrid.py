"""Coordination of two graphs made equal by admitting extended bonds, one a round.

Both graphs start from their core bonds.  While some kind of atom (role and
coordination bucket) has different numbers in the two graphs, or, where numbers
agree, different coordination numbers in order, an atom that lacks bonds is
given its strongest extended bond that is not admitted yet.  A bond is admitted
only if it lowers the total difference, and never if it takes its other end's
bucket further from the other graph (the guard against cascades).  Candidates
are tried by need, then strength of the bond, then the atoms' own description,
so the order of sites does not matter where they can be told apart.  At most
ROUNDS bonds are admitted.

The state of a round is the set of admitted bonds of one pair of graphs, a few
dozen numbers; pairs are independent, one row each, and that is what is
distributed.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 20


def _bucket(cn: int) -> str:
    return "tet" if cn <= 4 else "oct" if cn <= 6 else "high"


def difference(one: dict, other: dict) -> float:
    """Of two graphs (role and coordination number by atom): unequal numbers by role and bucket, then unequal sorted coordination numbers by role."""
    count = lambda g: Counter((r, _bucket(n)) for r, n in g.values())
    a, b = count(one), count(other)
    total = 0.0
    size = lambda c, role: max(sum(v for (r, _), v in c.items() if r == role), 1)
    for key in {*a, *b}:
        # Shares of the role, so that a supercell counts like its cell.
        total += 100 * abs(a[key] / size(a, key[0]) - b[key] / size(b, key[0]))
    for role in {r for r, _ in [*a, *b]}:
        x, y = (sorted(n for r, n in g.values() if r == role) for g in (one, other))
        if x and y:
            steps = len(x) * len(y)
            total += sum(abs(x[k // len(y)] - y[k // len(x)]) for k in range(steps)) / steps
    return total


def resolve(a: tuple[dict, list], b: tuple[dict, list], rounds: int = ROUNDS) -> tuple[list, list, float]:
    """Admitted bonds of both graphs (their ids) and the difference that is left.

    A graph is (role and core coordination number by atom, extended bonds (eid, source, target, weight)).
    """
    state = [dict(a[0]), dict(b[0])]
    pool = [sorted(g[1], key=lambda e, s=s: (-round(e[3], 6), sorted((s[e[1]], s[e[2]])), e[0])) for g, s in ((a, state[0]), (b, state[1]))]
    admitted: tuple[list, list] = ([], [])
    left = difference(*state)
    for _ in range(rounds):
        if left <= 1e-9:
            break
        best = None
        for side in (0, 1):
            for e in pool[side]:
                trial = dict(state[side])
                for end in (e[1], e[2]):
                    role, n = trial[end]
                    trial[end] = role, n + 1
                now = difference(trial, state[1]) if side == 0 else difference(state[0], trial)
                # The guard: a bond that leaves things as they are, or worse, is never admitted.
                if now < left - 1e-9 and (best is None or now < best[0] - 1e-9):
                    best = now, side, e, trial
        if best is None:
            break
        left, side, e, trial = best
        state[side] = trial
        pool[side].remove(e)
        admitted[side].append(e[0])
    return *admitted, left


def hybrid_bonds(pairs: DataFrame, nodes: DataFrame, bonds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(stem_a, stem_b, admitted_a, admitted_b, left) of pairs (stem_a, stem_b): ids of the extended bonds that are to count as core for this pair.

    nodes: (stem, id, ion_role, cn_core); bonds: (stem, id, source, target, sphere, ecn_s, ecn_t).
    """
    atoms = nodes.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("id", F.col("ion_role").alias("role"), F.coalesce("cn_core", F.lit(0)).cast("int").alias("cn")))).alias("atoms"))
    loose = bonds.where("sphere <> 'core'").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("id", "source", "target", F.greatest(F.coalesce("ecn_s", F.lit(0.0)), F.coalesce("ecn_t", F.lit(0.0))).alias("w")))).alias("loose"))
    packed = atoms.join(loose, "stem", "left")
    side = lambda s: packed.select(F.col("stem").alias(f"stem_{s}"), F.col("atoms").alias(f"atoms_{s}"), F.col("loose").alias(f"loose_{s}"))
    rows = pairs.select("stem_a", "stem_b").join(side("a"), "stem_a").join(side("b"), "stem_b").repartition("stem_a", "stem_b")
    kind = dict(pairs.dtypes)["stem_a"]

    def graph(atoms, loose):
        values = lambda x: list(x.values()) if isinstance(x, dict) else list(x)
        own = {i: (r, n) for i, r, n in map(values, atoms)}
        return own, [tuple(values(x)) for x in loose] if loose is not None else []

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                x, y, left = resolve(graph(r.atoms_a, r.loose_a), graph(r.atoms_b, r.loose_b), rounds)
                out.append((r.stem_a, r.stem_b, sorted(x), sorted(y), left))
            yield pd.DataFrame(out, columns=["stem_a", "stem_b", "admitted_a", "admitted_b", "left"])

    return rows.mapInPandas(run, f"stem_a {kind}, stem_b {kind}, admitted_a array<int>, admitted_b array<int>, left double")

"""Refinement of mappings inside groups of equivalent atoms.

Which of several equivalent atoms of a goes to which of their images is often
left open by a cost of atoms; polyhedral edges can tell.  The images of the
atoms of one class are dealt anew so that more keys (pair of b, sharing mode) of
the carried edges of a are edges of b: by all permutations up to EXHAUSTIVE
atoms, else by exchanges of two images as long as one helps.  Classes are taken
in turn until none helps; the measure is F1 over distinct keys, which never
falls.  One pair of graphs is one unit of work; pairs are independent rows.
"""

from __future__ import annotations

from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXHAUSTIVE = 8
ROUNDS = 10


def f1(image: dict[int, int], edges: list, wanted: set) -> float:
    """F1 of the keys of edges (p, q, mode), carried by the image, against wanted keys; edges of atoms without an image are not carried."""
    made = {(*sorted((image[p], image[q])), mode) for p, q, mode in edges if p in image and q in image}
    hit = len(made & wanted)
    return 1.0 if not made and not wanted else 2 * hit / (len(made) + len(wanted)) if hit else 0.0


def refined(image: dict[int, int], edges: list, wanted: set, classes: list[list[int]], exhaustive: int = EXHAUSTIVE) -> dict[int, int]:
    """The image with its values dealt anew inside the classes."""
    image = dict(image)
    best = f1(image, edges, wanted)
    for _ in range(ROUNDS):
        before = best
        for members in classes:
            members = [m for m in members if m in image]
            own = [image[m] for m in members]
            if len(members) < 2 or best >= 1:
                continue
            if len(members) <= exhaustive:
                top = max(permutations(own), key=lambda p: f1(image | dict(zip(members, p)), edges, wanted))
                trial = image | dict(zip(members, top))
                if f1(trial, edges, wanted) > best + 1e-12:
                    image, best = trial, f1(trial, edges, wanted)
                continue
            climbing = True
            while climbing:
                climbing = False
                for x, y in combinations(members, 2):
                    trial = image | {x: image[y], y: image[x]}
                    now = f1(trial, edges, wanted)
                    if now > best + 1e-12:
                        image, best, climbing = trial, now, True
        if best <= before + 1e-12:
            break
    return image


def refine_mappings(mappings: DataFrame, poly: DataFrame, classes: DataFrame, exhaustive: int = EXHAUSTIVE) -> DataFrame:
    """(stem_a, stem_b, a_id, slot, b_id, slot_kind, f1_before, f1_after) of real rows of one slot, dealt anew.

    poly: (stem, a, b, mode_all); classes: (stem, id, class) of atoms that are
    equivalent in their graph.  Atoms without a class, and atoms with several
    slots, stay as they are; the smallest partner of such an atom carries its edges.
    """
    keys = ["stem_a", "stem_b"]
    real = mappings.where("slot_kind = 'real'")
    maps = real.groupBy(*keys, "a_id").agg(F.min("b_id").alias("b_id"), F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a_id", "b_id", "n"))).alias("m"))
    edges = poly.groupBy("stem").agg(F.array_sort(F.collect_set(F.struct("a", "b", F.col("mode_all").alias("mode")))).alias("e"))
    own = classes.groupBy("stem", "class").agg(F.array_sort(F.collect_list("id")).alias("ids")).groupBy("stem").agg(F.array_sort(F.collect_list("ids")).alias("c"))
    named = lambda t, c, s: t.select(F.col("stem").alias(f"stem_{s}"), F.col(c).alias(f"{c}_{s}"))
    rows = maps.join(named(edges, "e", "a"), "stem_a", "left").join(named(edges, "e", "b"), "stem_b", "left").join(named(own, "c", "a"), "stem_a", "left")
    rows = rows.select(*keys, "m", "e_a", "e_b", "c_a").repartition(*keys)
    kind = dict(mappings.dtypes)["stem_a"]

    def run(parts):
        plain = lambda x: [tuple(v.values()) if isinstance(v, dict) else tuple(v) for v in x] if x is not None else []
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                image = {i: j for i, j, _ in plain(r.m)}
                free = {i for i, _, n in plain(r.m) if n == 1}
                wanted = {(*sorted((p, q)), mode) for p, q, mode in plain(r.e_b)}
                groups = [[int(i) for i in ids if int(i) in free] for ids in (r.c_a if r.c_a is not None else [])]
                found = refined(image, plain(r.e_a), wanted, groups, exhaustive)
                scores = f1(image, plain(r.e_a), wanted), f1(found, plain(r.e_a), wanted)
                out += [(r.stem_a, r.stem_b, i, 0, found[i], "real", *scores) for i in sorted(free)]
            yield pd.DataFrame(out, columns=["stem_a", "stem_b", "a_id", "slot", "b_id", "slot_kind", "f1_before", "f1_after"])

    return rows.mapInPandas(run, f"stem_a {kind}, stem_b {kind}, a_id int, slot int, b_id int, slot_kind string, f1_before double, f1_after double")

"""Symmetry of crystal structures from their sites alone.

For each structure: the translations that map it onto itself give the primitive
lattice, whose shortest independent vectors are its basis; the integer matrices
that keep the basis's metric (for such a basis their entries are -1, 0 or 1) are
tried with each translation that carries a site of the rarest species onto
another; those that map every site onto one of its species are the operations.
Orbits are the classes of sites under them.

The key names the point group, the rotation axes with the index of the lattice
of their shortest vectors (which tells centrings apart), how many operations
have no screw or glide part, and the orbits' sizes with their site symmetry.
It does not depend on the origin, the cell or the order of the sites, nor on
which elements the sites have.

Structures that are equal row for row are judged once.  One structure is one
unit of work; its work grows with the square of its sites.  A structure without
a lattice or without sites has null results and its error.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.01

#: The 32 point groups by how many operations they have of the types 2 3 4 6 -1 m -3 -4 -6.
POINT_GROUPS = """
1 000000000
-1 000010000
2 100000000
m 000001000
2/m 100011000
222 300000000
mm2 100002000
mmm 300013000
4 102000000
-4 100000020
4/m 102011020
422 502000000
4mm 102004000
-42m 300002020
4/mmm 502015020
3 020000000
-3 020010200
32 320000000
3m 020003000
-3m 320013200
6 120200000
-6 020001002
6/m 120211202
622 720200000
6mm 120206000
-62m 320004002
6/mmm 720217202
23 380000000
m-3 380013800
432 986000000
-43m 380006060
m-3m 986019860
"""
_NAMES = {counts: name for name, counts in (line.split() for line in POINT_GROUPS.split("\n") if line)}
#: Type of an operation by determinant and trace.
_TYPES = {(1, 3): "1", (1, -1): "2", (1, 0): "3", (1, 1): "4", (1, 2): "6", (-1, -3): "-1", (-1, 1): "m", (-1, 0): "-3", (-1, -1): "-4", (-1, -2): "-6"}
_ORDERS = {"1": 1, "2": 2, "3": 3, "4": 4, "6": 6, "-1": 2, "m": 2, "-3": 6, "-4": 4, "-6": 6}


def _unimodular() -> np.ndarray:
    every = np.array(list(product((-1, 0, 1), repeat=9))).reshape(-1, 3, 3)
    return every[np.abs(np.rint(np.linalg.det(every))) == 1]


_MATRICES: list[np.ndarray] = []


def shortest_basis(lattice: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The three shortest independent vectors (rows) of the lattice that the rows of `lattice` and the fractional shifts generate."""
    basis, points = lattice, shifts
    while True:
        steps = np.array(list(product(range(-2, 3), repeat=3)), float)
        vectors = (np.concatenate([points, np.zeros((1, 3))])[:, None] + steps[None]).reshape(-1, 3) @ basis
        length = np.linalg.norm(vectors, axis=1)
        vectors, length = vectors[length > 1e-6], length[length > 1e-6]
        # Of vectors of equal length any will do; the order makes the choice the same each time.
        order = np.lexsort((*np.round(vectors, 4).T, np.round(length, 4)))
        chosen: list[np.ndarray] = []
        for v in vectors[order]:
            trial = np.array([*chosen, v])
            if np.linalg.matrix_rank(trial, 1e-4 * length.max()) == len(trial):
                chosen.append(v)
                if len(chosen) == 3:
                    break
        found = np.array(chosen)
        if abs(np.linalg.norm(found, axis=1).sum() - np.linalg.norm(basis, axis=1).sum()) < 1e-6 and len(points) == 0:
            return found
        # Shifts are whole vectors of the new basis; another round finds shorter ones of a skew cell.
        basis, points = found, np.empty((0, 3))


def _image(frac: np.ndarray, kinds: np.ndarray, basis: np.ndarray, moved: np.ndarray, tolerance: float):
    """Which site each moved site falls on, or None."""
    gap = moved[:, None] - frac[None]
    gap -= np.rint(gap)
    far = np.linalg.norm(gap @ basis, axis=2)
    far[kinds[:, None] != kinds[None]] = np.inf
    to = far.argmin(1)
    if (far[np.arange(len(to)), to] > tolerance).any() or len(np.unique(to)) < len(to):
        return None
    return to


def _rarest(kinds: np.ndarray) -> np.ndarray:
    names, counts = np.unique(kinds, return_counts=True)
    return np.flatnonzero(kinds == names[np.lexsort((names, counts))[0]])


def operations(lattice: np.ndarray, frac: np.ndarray, kinds: np.ndarray, tolerance: float = TOLERANCE):
    """(basis, matrices, shifts, images of the given sites, number of translations) of a structure; kinds are whole numbers."""
    some = _rarest(kinds)
    shifts = []
    for j in some[1:]:
        t = frac[j] - frac[some[0]]
        if _image(frac, kinds, lattice, frac + t, tolerance) is not None:
            shifts.append(t - np.floor(t + 1e-9))
    basis = shortest_basis(lattice, np.array(shifts).reshape(-1, 3))
    if np.linalg.det(basis) < 0:
        basis = -basis
    own = frac @ lattice @ np.linalg.inv(basis)
    # One site of each set that the translations make one.
    gap = own[:, None] - own[None]
    gap -= np.rint(gap)
    same = (np.linalg.norm(gap @ basis, axis=2) <= tolerance) & (kinds[:, None] == kinds[None])
    first = same.argmax(1)
    sites = np.unique(first)
    where = np.searchsorted(sites, first)
    own, own_kinds = own[sites], kinds[sites]
    if not _MATRICES:
        _MATRICES.append(_unimodular())
    metric = basis @ basis.T
    sizes = np.sqrt(np.diag(metric))
    moved = np.transpose(_MATRICES[0], (0, 2, 1)) @ metric @ _MATRICES[0]
    fits = (np.abs(moved - metric) <= 2 * tolerance * np.minimum.outer(sizes, sizes)).all((1, 2))
    some = _rarest(own_kinds)
    found, parts, images = [], [], []
    for w in _MATRICES[0][fits]:
        turned = own @ w.T
        for j in some:
            t = own[j] - turned[some[0]]
            to = _image(own, own_kinds, basis, turned + t, tolerance)
            if to is not None:
                found.append(w)
                parts.append(t)
                images.append(to[where])
                break
    return basis, np.array(found), np.array(parts), np.array(images), len(shifts) + 1, where


def _plain(w: np.ndarray, t: np.ndarray, order: int) -> bool:
    """Whether an operation has no screw or glide part, whatever whole vectors are added to it."""
    powers, total = np.eye(3), np.zeros((3, 3))
    for _ in range(order):
        total += powers
        powers = powers @ w
    steps = np.array(list(product(range(-2, 3), repeat=3)), float)
    return bool((np.abs((t - np.rint(t) + steps) @ total.T / order).max(1) < 1e-3).any())


def _axes(matrices: np.ndarray, kinds: list[str]) -> list[tuple[int, int, int]]:
    """(order, number of axes, index of the lattice of their shortest vectors, 0 if they span less than space) of each class of rotation axes."""
    axes: dict[tuple, int] = {}
    for w, kind in zip(matrices, kinds):
        proper = w * round(np.linalg.det(w))
        if (proper == np.eye(3)).all():
            continue
        # The axis is what the rotation keeps: the mean of its powers has it as its only column.
        mean = sum(np.linalg.matrix_power(proper, k) for k in range(_ORDERS[_TYPES[1, int(np.trace(proper))]]))
        column = mean[:, np.abs(mean).max(0).argmax()]
        column = np.rint(column).astype(int) // np.gcd.reduce(np.rint(column).astype(int))
        sign = next(int(np.sign(x)) for x in column if x)
        axis = tuple(int(x) for x in column * sign)
        axes[axis] = max(axes.get(axis, 1), _ORDERS[_TYPES[1, int(np.trace(proper))]])
    left, out = dict(axes), []
    while left:
        seed = min(left)
        images = {tuple(int(x) for x in w @ np.array(seed)) for w in matrices}
        orbit = [a for a in left if a in images or tuple(-x for x in a) in images]
        vectors = np.array(orbit)
        index = 0
        for k in range(2, len(vectors)):
            for i in range(k):
                for j in range(i):
                    d = abs(round(np.linalg.det(vectors[[i, j, k]])))
                    index = int(np.gcd(index, d))
        out.append((left[seed], len(orbit), index))
        for a in orbit:
            del left[a]
    return sorted(out)


def _distances(frac: np.ndarray, basis: np.ndarray, i: int, most: int = 3) -> list[float]:
    """Distances of a site to its nearest shells of others, by the cube root of four volumes of an atom each way."""
    steps = np.array(list(product(range(-2, 3), repeat=3)), float)
    far = np.sort(np.linalg.norm((frac[:, None] - frac[i] + steps[None]).reshape(-1, 3) @ basis, axis=1))
    far = far[far > 1e-6] / (4 * (abs(np.linalg.det(basis)) / len(frac)) ** (1 / 3))
    shells = far[np.append(True, np.diff(far) > 1e-3)]
    return [float(x) for x in shells[:most]] + [0.0] * (most - len(shells[:most]))


def analysed(lattice, sites, tolerance: float) -> dict:
    lattice = np.array([list(v) for v in lattice], float)
    ids = [s["id"] for s in sites]
    frac = np.array([list(s["frac"]) for s in sites], float)
    labels = [",".join(sorted(f"{p['symbol']}:{p['occupancy']:.3f}" for p in s["species"])) for s in sites]
    kinds = np.unique(labels, return_inverse=True)[1]
    basis, matrices, parts, images, translations, where = operations(lattice, frac, kinds, tolerance)
    types = [_TYPES[round(np.linalg.det(w)), int(np.trace(w))] for w in matrices]
    counts = "".join(str(types.count(t)) for t in ("2", "3", "4", "6", "-1", "m", "-3", "-4", "-6"))
    plain = sum(_plain(w, t, _ORDERS[k]) for w, t, k in zip(matrices, parts, types))
    orbit = images.min(0)
    own = frac @ lattice @ np.linalg.inv(basis)
    firsts = np.array([np.flatnonzero(where == o)[0] for o in range(where.max() + 1)])
    orbits, named = [], []
    for o in np.unique(orbit):
        size = len(np.unique(where[orbit == o]))
        symmetry = len(matrices) // size
        orbits.append((f"{size}.{symmetry}", *_distances(own[firsts], basis, int(o))))
    for k, i in enumerate(ids):
        named.append({"id": int(i), "orbit": int(min(ids[n] for n in np.flatnonzero(orbit == orbit[k])))})
    axes = ";".join(f"{n}:{many}:{index}" for n, many, index in _axes(matrices, types))
    group = _NAMES.get(counts)
    key = f"{group}|{axes}|{plain}|{','.join(sorted(o[0] for o in orbits))}"
    rows = [dict(zip(("wyckoff", "x", "y", "z"), o)) for o in sorted(orbits)]
    return {"point_group": group, "operations": len(matrices), "translations": translations, "key": key, "orbits": rows, "site_orbits": named, "error": None}


_FIELDS = "point_group string, operations int, translations int, key string, orbits array<struct<wyckoff:string,x:double,y:double,z:double>>, site_orbits array<struct<id:int,orbit:int>>, error string"


def symmetries(structures: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(stem, point_group, operations, translations, key, orbits, site_orbits, error) of structures (stem, lattice, sites).

    operations are those of the primitive cell, translations the primitive cells
    of the given one.  orbits feed families.trivial_groups: a name of size and
    site symmetry, and relative distances to the nearest three shells in place
    of coordinates.  site_orbits name each site's orbit by its smallest id.
    """

    def run(parts):
        fields = ["name", *[f.split()[0] for f in _FIELDS.split(", ")]]
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                try:
                    if r.lattice is None or r.sites is None or not len(r.sites):
                        raise ValueError("no lattice or no sites")
                    rows.append(dict.fromkeys(fields) | {"name": r.name} | analysed(r.lattice, r.sites, tolerance))
                except Exception as e:  # one structure's failure is a row, not the end of the job
                    rows.append(dict.fromkeys(fields) | {"name": r.name, "error": str(e)[:200]})
            yield pd.DataFrame(rows, columns=fields, dtype=object)

    name = F.sha2(F.to_json(F.struct("lattice", "sites")), 256)
    named = structures.select("stem", name.alias("name"), "lattice", "sites")
    one = named.groupBy("name").agg(F.first("lattice").alias("lattice"), F.first("sites").alias("sites"))
    return named.select("stem", "name").join(one.mapInPandas(run, f"name string, {_FIELDS}"), "name").drop("name")

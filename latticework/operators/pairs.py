"""Pairs of rows inside groups, made by blocks.

A group is cut into blocks by a hash of its keys, and each pair of blocks is a
group of one task, which compares them by one product of matrices a slice.  A
block has at most BLOCK rows, so each row is sent once for every BLOCK rows of
its group; a small group has up to SPREAD blocks, so that its pairs are many
tasks.  What a task holds is bounded by its two blocks and a slice.

Squared distances of a product of matrices have rounding errors; wherever
these could change a distance's fourth place, it is computed again from the
difference of the vectors.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block at most; a group of more than LEAST rows for each is cut into up to SPREAD smaller blocks.
BLOCK, LEAST, SPREAD = 16_384, 512, 10
#: Distances that a slice of a pair of blocks computes at once, edges that are kept before they are thinned, tasks at most, and groups whose numbers of blocks are sent to all.
SLICE, EDGES, TASKS, GROUPS = 2_000_000, 2_000_000, 10_000, 100_000
PLACES = 1e4


def _vectors(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows; null components are NaN."""
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x from the same rows of y."""
    return np.sqrt(((x - y) ** 2).sum(1))


def _squares(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """For slices of x: the first row, squared distances from all of y, and a bound on their errors (infinite where a component is not finite or too large)."""
    nx, ny = (x**2).sum(1), (y**2).sum(1)
    right = np.concatenate([-2 * y.T, np.ones((1, len(y))), ny[None]])
    step = max(1, SLICE // len(y))
    for at in range(0, len(x), step):
        own = slice(at, at + step)
        left = np.concatenate([x[own], nx[own, None], np.ones((len(x[own]), 1))], axis=1)
        error = float(4 * (x.shape[1] + 8) * np.finfo(float).eps * (nx[own].max() + ny.max()))
        yield at, left @ right, error if np.isfinite(error) else np.inf


def _rounded(x: np.ndarray, y: np.ndarray, d2: np.ndarray, error: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of x and j of y in whole units of the fourth place, halves up."""
    out, again = np.empty(len(i)), np.arange(len(i))
    if np.isfinite(error):
        scaled = np.sqrt(np.maximum(d2, 0)) * PLACES + 0.5
        out = np.floor(scaled)
        reach = 1.01 * PLACES * error / np.sqrt(np.maximum(d2, error)) + 1e-9
        again = np.flatnonzero(np.abs(scaled - out - 0.5) >= 0.5 - reach)
    for k in range(0, len(again), 100_000):
        a = again[k : k + 100_000]
        out[a] = np.floor(_exact(x[i[a]], y[j[a]]) * PLACES + 0.5)
    return out


def _found(x, y, kx, ky, same: bool, limit: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i of x and j of y with their distances in units of the fourth place, by slices: those below the limit, in these units, or all."""
    for at, d2, error in _squares(x, y):
        if limit is None or not np.isfinite(error):
            near = np.ones(d2.shape, bool)
        else:
            near = d2 <= (limit / PLACES) ** 2 + error
        if same:
            near &= ky[None] > kx[at : at + len(d2), None]
        i, j = np.nonzero(near)
        units = _rounded(x, y, d2[i, j], error, i + at, j)
        i = i + at
        if limit is not None:
            # A distance counts as rounded.
            keep = units < limit
            i, j, units = i[keep], j[keep], units[keep]
        yield i, j, units


def _thinned(u: np.ndarray, v: np.ndarray, nodes: int, members: int) -> np.ndarray:
    """Which edges of a part of a graph suffice for DBSCAN with so many members of a core.

    Nodes with members - 1 edges in the part are cores whatever the rest of the
    graph is.  All edges at other nodes stay, as many of each core as make it
    one, and a spanning forest of the edges among cores.
    """
    need = members - 1
    sure = np.bincount(u, minlength=nodes) + np.bincount(v, minlength=nodes) >= need
    inner = sure[u] & sure[v]
    keep = ~inner
    ends, edge = np.concatenate([u, v]), np.concatenate([np.arange(len(u))] * 2)
    for _ in range(need):
        pick = np.full(nodes, -1)
        pick[ends] = edge
        keep[pick[pick >= 0]] = True
        left = edge != pick[ends]
        ends, edge = ends[left], edge[left]
    label, rest = np.arange(nodes), np.flatnonzero(inner)
    while len(rest):
        lu, lv = label[u[rest]], label[v[rest]]
        apart = lu != lv
        rest, lu, lv = rest[apart], lu[apart], lv[apart]
        # Each tree that has a smaller one beside it is hung below one such.
        big, small, hung = np.maximum(lu, lv), np.minimum(lu, lv), np.full(nodes, -1)
        hung[big] = np.arange(len(rest))
        roots = np.flatnonzero(hung >= 0)
        keep[rest[hung[roots]]] = True
        label[roots] = small[hung[roots]]
        while (label != label[label]).any():
            label = label[label]
    return keep


def _compared(rows: DataFrame, key: str, vector: str, group: str | None, block: int | None, run: Callable, fields: str) -> DataFrame:
    """The rows (group, fields) that run(x, y, kx, ky, same) yields, as tuples of arrays, for each pair of blocks; x and y are vectors, kx and ky keys."""
    of = F.lit(0) if group is None else F.col(group)
    x = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & of.isNotNull()).select(of.alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"))
    n = F.count(F.lit(1))
    cut = F.ceil(n / block) if block else F.greatest(F.ceil(n / BLOCK), F.least(F.ceil(n / LEAST), F.lit(SPREAD)))
    blocks = x.groupBy("g").agg(cut.cast("long").alias("n"))
    groups, total = blocks.agg(n, F.coalesce(F.sum(F.col("n") * (F.col("n") + 1) / 2), F.lit(0))).first()
    tasks = int(min(max(total, rows.sparkSession.sparkContext.defaultParallelism), TASKS))
    x = x.join(F.broadcast(blocks) if groups <= GROUPS else blocks, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("n")))
    # Each row goes to the n pairs of blocks that its block is in.
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    x = x.select("g", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "k", "v").repartition(tasks, "g", "p", "q")
    kinds = dict(rows.dtypes)
    schema = f"g {kinds.get(group, 'int')}, {fields}"

    def pairs(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, p, q = keys
        sides = {s: ([], []) for s in (True, False)}
        for batch in batches:
            left = np.asarray(batch.column("b").to_numpy(zero_copy_only=False)) == p.as_py()
            for s in sides:
                some = batch.filter(pa.array(left if s else ~left))
                if len(some):
                    sides[s][0].append(some.column("k").to_numpy(zero_copy_only=False))
                    sides[s][1].append(_vectors(some.column("v")))
        same = p.as_py() == q.as_py()
        (kx, vx), (ky, vy) = sides[True], sides[True] if same else sides[False]
        if not kx or not ky:
            return
        kx, vx, ky, vy = np.concatenate(kx), np.concatenate(vx), np.concatenate(ky), np.concatenate(vy)
        for columns in run(vx, vy, kx, ky, same):
            yield pa.RecordBatch.from_arrays([pa.repeat(of, len(columns[0])), *map(pa.array, columns)], names)

    names = ["g", *[f.split()[0] for f in fields.split(", ")]]
    made = x.groupBy("g", "p", "q").applyInArrow(pairs, schema)
    return made.withColumnRenamed("g", group) if group else made.drop("g")


def _units_below(within: float) -> float:
    """The number of units of the fourth place from which a distance is not below `within`."""
    units = np.ceil(within * PLACES) - 1
    while units / PLACES < within:
        units += 1
    return float(units)


def pairwise_distances(rows: DataFrame, key: str, vector: str, group: str | None, block: int | None = None, within: float | None = None) -> DataFrame:
    """(group, a, b, dist) for all a < b inside each group; Euclidean, rounded to 4 places.

    Without a group all rows are one, and the group is left out.  With `within`
    only smaller distances are given; the others never leave their task.
    `block` sets the rows of a block.  Null vectors and keys have no pairs.
    """
    limit = None if within is None else _units_below(within)

    def run(x, y, kx, ky, same):
        for i, j, units in _found(x, y, kx, ky, same, limit):
            a, b = kx[i], ky[j]
            yield np.minimum(a, b), np.maximum(a, b), units / PLACES

    kind = dict(rows.dtypes)[key]
    return _compared(rows, key, vector, group, block, run, f"a {kind}, b {kind}, dist double")


def distance_sums(rows: DataFrame, key: str, vector: str, group: str | None, block: int | None = None) -> DataFrame:
    """(group, node, units, n): the sum of the distances of each row to the others of its group, each rounded to whole units of the fourth place, and their number.

    A pair of blocks gives a row for each of its rows, so no distance leaves its task.
    """

    def run(x, y, kx, ky, same):
        sums, counts = [np.zeros(len(kx)), np.zeros(len(ky))], [np.zeros(len(kx), np.int64), np.zeros(len(ky), np.int64)]
        for i, j, units in _found(x, y, kx, ky, same, None):
            for s, c, k in zip(sums, counts, (i, j)):
                s += np.bincount(k, units, len(s))
                c += np.bincount(k, minlength=len(c))
        for s, c, k in zip(sums, counts, (kx, ky)):
            yield k[c > 0], s[c > 0], c[c > 0]

    made = _compared(rows, key, vector, group, block, run, f"node {dict(rows.dtypes)[key]}, units double, n long")
    of = [group] if group else []
    return made.groupBy(*of, "node").agg(F.sum("units").alias("units"), F.sum("n").alias("n"))


def dbscan_links(rows: DataFrame, key: str, vector: str, group: str | None, within: float, members: int, block: int | None = None) -> DataFrame:
    """(a, b): pairs nearer than `within` that suffice for `cluster.dbscan` with so many members: it has the same answer as with all of them.

    A pair of blocks gives at most `members` of them for each of its rows
    (see _thinned), however many are near, but all pairs are compared.
    """
    limit = _units_below(within)

    def run(x, y, kx, ky, same):
        names, place = np.unique(kx if same else np.concatenate([kx, ky]), return_inverse=True)
        px, py, repeated = place[: len(kx)], place[-len(ky) :], len(names) < len(place)
        u, v, fresh = np.empty(0, np.int64), np.empty(0, np.int64), []

        def thinned():
            a, b = (np.concatenate([e, *f]) for e, f in zip((u, v), zip(*fresh)))
            if repeated:
                # Rows of one key are one node.
                a, b = np.unique(np.stack([a, b]), axis=1)
            keep = _thinned(a, b, len(names), members)
            return a[keep], b[keep], []

        for i, j, _ in _found(x, y, kx, ky, same, limit):
            fresh.append((px[i], py[j]))
            if sum(len(f[0]) for f in fresh) > EDGES:
                u, v, fresh = thinned()
        if fresh:
            u, v, fresh = thinned()
        a, b = names[u], names[v]
        yield np.minimum(a, b), np.maximum(a, b)

    kind = dict(rows.dtypes)[key]
    return _compared(rows, key, vector, group, block, run, f"a {kind}, b {kind}").select("a", "b")

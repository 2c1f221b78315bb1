"""Exact search for mappings of larger cells: assignment where costs separate, branch and bound where they do not.

Costs whose pairs do not depend on the rest of the mapping are sums over pairs,
so the best mapping of an element map is one least-cost assignment of slots,
whatever the size of the cell.  Other costs are searched depth first over the
atoms of the larger graph, each dealt to an atom of its element's partner with
room left.  A partial mapping's bound is the sum of what its pairs cost already,
whatever the atoms still to come; such a bound never falls, so branches at or
above the best mapping's cost are left.  Atoms are taken along bonds, children in
the order of their bounds.

A search ends after `most` nodes; its answer is then `bounded`, with the gap
to the smallest bound that was not looked into.  Costs without a bound of this
kind are an error.
"""

from __future__ import annotations

import numpy as np

from .assign import hungarian
from .match import MISMATCH, ZERO, BondAngle, BondLength, CoreCoordination, Cost, EdgeIdentity, Found, Graph, Polyhedral, _cost, _reverse, element_maps, register_optimizer

SEPARABLE = (CoreCoordination, BondAngle, Polyhedral)


def _assigned(a: Graph, b: Graph, c: Cost, small: Graph, large: Graph, swapped: bool, elements: dict, k: int) -> dict[int, list[int]]:
    """The least-cost dealing of the larger graph's atoms, k to each of the smaller's, by a cost of pairs alone."""
    over: dict[int, list[int]] = {}
    for e, f in elements.items():
        rows, columns = small.groups[e], large.groups[f]
        matrix = np.array([[c.pair(a, b, j, i, {}, {}) if swapped else c.pair(a, b, i, j, {}, {}) for j in columns] for i in rows])
        for r, x in enumerate(hungarian(np.repeat(matrix, k, axis=0)).tolist()):
            over.setdefault(rows[r // k], []).append(columns[x])
    return over


def _edge_bound(small: Graph, large: Graph, to: np.ndarray, room: np.ndarray) -> float:
    """What a partial dealing (to: small atom of each large one, or -1) costs at least in mismatched bonds, summed over pairs."""
    done = np.flatnonzero(to >= 0)
    if not len(done):
        return 0.0
    dealt = np.zeros((len(done), len(small.ids)))
    for s in np.unique(to[done]):
        dealt[:, s] = large.bonds[np.ix_(done, np.flatnonzero(to == s))].sum(1)
    gap = dealt - small.bonds[to[done]]
    # Where all of a small atom's partners are dealt, missing bonds count too.
    return MISMATCH * float(np.where(room[None] == 0, np.abs(gap), np.maximum(gap, 0)).sum())


def _length_bound(a: Graph, b: Graph, image: dict, k: int, swapped: bool) -> float:
    """Bond lengths between pairs that are dealt; each atom of b counts the mean of its cohort."""
    total = 0.0
    for i, js in image.items():
        for j in js:
            cost, count = 0.0, int(a.bonds[i].sum())
            for n in np.flatnonzero(a.bonds[i]).tolist():
                if not image.get(n) or (not swapped and len(image[n]) < k):
                    continue
                m = image[n][0]
                size = int(a.bonds[i, n])
                x, y = a.length[i, n], b.length[j, m]
                cost += size * (abs(x - y) / ((x + y) / 2) if b.bonds[j, m] else 1.0)
            total += cost / count if count else 0.0
    return total


def _order(large: Graph) -> list[int]:
    """Atoms of the larger graph, each with as many bonds as possible to those before it."""
    left, out = set(range(len(large.ids))), []
    weight = np.zeros(len(large.ids))
    while left:
        nxt = max(left, key=lambda i: (weight[i], int(large.bonds[i].sum()), -i))
        out.append(nxt)
        left.discard(nxt)
        weight += large.bonds[nxt]
    return out


def branch_and_bound(a: Graph, b: Graph, cost: str | Cost = "edge_identity", most_atoms: int = 200, most: int = 20_000) -> Found:
    """The cheapest mapping that keeps elements in step, as best_mapping finds it, for cells that enumeration can't do."""
    c = _cost(cost) if isinstance(cost, str) else cost
    if max(len(a.ids), len(b.ids), 0) > most_atoms:
        return Found(float("inf"), {}, "too many atoms", 0, 0, False)
    if not isinstance(c, (*SEPARABLE, EdgeIdentity, BondLength)):
        raise ValueError(f"no bound for {type(c).__name__}")
    swapped = len(a.ids) > len(b.ids)
    small, large = (b, a) if swapped else (a, b)
    k = len(large.ids) // max(1, len(small.ids))
    best, nodes, open_, cap, budget = Found(float("inf"), {}, "incompatible", 0, k, swapped), 0, float("inf"), float("inf"), most

    def judged(over: dict[int, list[int]]) -> None:
        nonlocal best
        over = {i: sorted(js) for i, js in over.items()}
        image = _reverse(over) if swapped else over
        value = c.total(a, b, image, _reverse(image))
        if value < best.cost:
            best = Found(value, image, "exact", nodes, k, swapped)

    pairs = len(large.ids)
    order = _order(large)
    for elements in element_maps(small, large):
        judged(_assigned(a, b, c, small, large, swapped, elements, k))
        if best.cost <= ZERO:
            break
        if isinstance(c, SEPARABLE):
            continue
        back = {f: e for e, f in elements.items()}
        to, room = np.full(len(large.ids), -1), np.full(len(small.ids), k)

        def bound(to=to, room=room) -> float:
            if isinstance(c, EdgeIdentity):
                return _edge_bound(small, large, to, room) / pairs
            over: dict[int, list[int]] = {}
            for x, s in enumerate(to.tolist()):
                if s >= 0:
                    over.setdefault(s, []).append(x)
            cohort = k if swapped else 1
            size = len(b.ids) if c.normalise else 1
            return _length_bound(a, b, _reverse(over) if swapped else over, k, swapped) / cohort / size

        def go(depth: int, to=to, room=room, back=back, bound=bound) -> None:
            nonlocal nodes, open_
            if depth == len(order):
                over: dict[int, list[int]] = {}
                for x, s in enumerate(to.tolist()):
                    over.setdefault(s, []).append(x)
                judged(over)
                return
            x, children = order[depth], []
            for s in small.groups[back[large.element[x]]]:
                if room[s]:
                    to[x], room[s] = s, room[s] - 1
                    children.append((bound(), s))
                    to[x], room[s] = -1, room[s] + 1
            for low, s in sorted(children):
                if low >= best.cost - 1e-12 or low > cap or best.cost <= ZERO:
                    break
                if nodes >= budget:
                    open_ = min(open_, low)
                    break
                nodes += 1
                to[x], room[s] = s, room[s] - 1
                go(depth + 1)
                to[x], room[s] = -1, room[s] + 1

        # First only what costs nothing so far, as the depths of a costly branch would hide a perfect mapping beside it.
        cap, budget, open_before = ZERO, nodes + (most - nodes) // 2, open_
        go(0)
        cap, budget, open_ = float("inf"), most, open_before
        if best.cost > ZERO:
            go(0)
        if best.cost <= ZERO:
            break
    best.tried = nodes
    if open_ < best.cost - 1e-12 and best.image:
        best.status = f"bounded, gap {best.cost - open_:.6f}"
    return best


register_optimizer("branch_and_bound", branch_and_bound)

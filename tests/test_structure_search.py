"""Topology costs, symmetry from sites, vacancies, range joins and the store of pair costs, on generated structures and by brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import families, graph, match, neighbours, shell_walk, symmetry, vacancies
from latticework.plans import crystals


class With:
    """Tables of built structures with their neighbours."""

    def __init__(self, spark, structures):
        from latticework.operators import build

        self.structures = structures
        nodes, bonds = build.build_graphs(structures, rescue=False)
        self.nodes, self.bonds = families.stored(nodes, "t-nodes"), families.stored(bonds, "t-bonds")
        self.half = graph.half_bonds(self.bonds)
        self.near = families.stored(graph.nearest(neighbours.within(structures, 8.0)), "t-near")
        self.views = families.stored(shell_walk.atom_views(self.nodes, self.half, self.near), "t-views")
        poly = graph.polyhedral_edges(self.nodes, self.half)
        self.packed = families.stored(match.packed_graphs(self.nodes, self.half, poly, self.near), "t-packed")


def doubled(rows, axis: int = 2):
    """Structures with their cells doubled along an axis, shifted and in another order of sites."""
    out = []
    for r in rows:
        lattice = [list(v) for v in r.lattice]
        lattice[axis] = [2 * x for x in lattice[axis]]
        sites = []
        for copy in (1, 0):
            for s in reversed(r.sites):
                f = [(x + 0.13) % 1 for x in s.frac]
                f[axis] = (f[axis] + copy) / 2
                sites.append((len(sites), f, s.species))
        out.append((r.stem + "-double", r.formula, lattice, r.sg_symbol, r.sg_number, sites, None))
    return out


@pytest.fixture(scope="module")
def world(spark):
    s = crystals.structures(spark)
    twice = spark.createDataFrame(doubled([r for r in s.collect() if r.stem.startswith(("NaCl", "TiO2", "SrTiO3"))]), s.schema)
    return With(spark, s.unionByName(twice))


def rows_of(frame):
    return {(r.stem_a, r.stem_b): r for r in frame.collect()}


def stems(world, *starts):
    return [next(r.stem for r in world.packed.select("stem").collect() if r.stem.startswith(s) and not r.stem.endswith("double")) for s in starts]


def test_supercells_cost_nothing_under_topology(spark, world):
    pairs = [(s, s + "-double") for s in stems(world, "NaCl", "TiO2", "SrTiO3")]
    found = match.match_pairs(spark.createDataFrame(pairs, "stem_a string, stem_b string"), world.packed, "topology", most=3000)
    got = found.collect()
    assert len(got) == 3 and all(r.cost < 1e-9 for r in got)
    # The mappings of the search cost the same by joins.
    again = rows_of(shell_walk.topology_costs(match.mapping_rows(found), world.views))
    assert all(again[p].cost < 1e-9 for p in pairs)


def test_search_and_joins_agree_on_any_mapping(spark, world):
    a, b = stems(world, "NaCl", "CsCl")
    c, d = stems(world, "TiO2", "CaF2")
    maps = []
    rng = np.random.default_rng(4)
    ids = {r.stem: sorted(x["id"] for x in r.atoms) for r in world.packed.collect()}
    for k, (x, y) in enumerate([(a, b), (c, d), (a, c), (d, b)]):
        own = [i for i in ids[x] if k == 0 or rng.random() < 0.7] or ids[x]
        for i in own:
            maps.append((x, y, i, 0, int(rng.choice(ids[y])), "real"))
    m = spark.createDataFrame(maps, "stem_a string, stem_b string, a_id int, slot int, b_id int, slot_kind string")
    for strict, name in ((True, "topology"), (False, "topology_loose")):
        joined = rows_of(shell_walk.topology_costs(m, world.views, strict))
        scored = rows_of(match.score_mappings(m, world.packed, name))
        assert len(joined) == 4 and any(r.cost > 0 for r in joined.values())
        for p, r in joined.items():
            assert abs(r.cost - scored[p].cost) < 1e-9


def test_fewer_bonds_never_cost_less(spark, world):
    """An atom that loses bonds one by one pays more and more, or the same."""
    (a,) = stems(world, "SrTiO3")
    m = world.nodes.where(F.col("stem") == a).select(F.col("stem").alias("stem_a"), F.lit("less").alias("stem_b"), F.col("id").alias("a_id"), F.lit(0).alias("slot"), F.col("id").alias("b_id"), F.lit("real").alias("slot_kind"))
    whole = world.views.where(F.col("stem") == a)
    before = -1.0
    for gone in range(4):
        kept = F.when(F.col("id") == 0, F.slice("bonds", gone + 1, 99)).otherwise(F.col("bonds"))
        # Nothing beyond the shell may take up the loss.
        less = whole.withColumn("stem", F.lit("less")).withColumn("bonds", kept).withColumn("outer", F.array().cast("array<int>"))
        cost = shell_walk.topology_costs(m, whole.unionByName(less)).first().cost
        assert cost >= before
        before = cost
    assert before > 0


def test_anion_bonds_are_not_absorbed(spark):
    """Two anions bonded in a, apart in b with the other near: free by the loose rule, lost by the strict one."""
    none = []
    views = spark.createDataFrame(
        [("a", 0, "Si", [(1, 1, True)], none), ("a", 1, "Si", [(0, 1, True)], none), ("b", 0, "O", none, [1]), ("b", 1, "O", none, [0]), ("c", 0, "O", none, [2, 1]), ("c", 1, "O", none, [2, 0]), ("c", 2, "Sr", none, none)],
        "stem string, id int, element string, bonds array<struct<nbr:int,n:int,anions:boolean>>, outer array<int>",
    )
    m = spark.createDataFrame([(x, y, i, 0, i, "real") for x, y in (("a", "b"), ("a", "c")) for i in (0, 1)], "stem_a string, stem_b string, a_id int, slot int, b_id int, slot_kind string")
    loose = {k: round(r.cost, 6) for k, r in rows_of(shell_walk.topology_costs(m, views, False)).items()}
    strict = {k: round(r.cost, 6) for k, r in rows_of(shell_walk.topology_costs(m, views)).items()}
    # In c the walk passes Sr first, and Sr itself has no partner.
    assert loose == {("a", "b"): 0.0, ("a", "c"): 1.1} and strict == {("a", "b"): 1.0, ("a", "c"): 2.1}
    free = m.unionByName(spark.createDataFrame([("a", "c", None, 0, 2, "vacancy")], m.schema))
    assert round(rows_of(shell_walk.topology_costs(free, views, False))["a", "c"].cost, 6) == 0.1


def test_costs_of_rows_without_partners(spark):
    """Real rows without an atom are no pairs; an atom named by several rows has the best of their kinds; unknown graphs have no row."""
    views = spark.createDataFrame([(s, i, "Si", [], []) for s, n in (("a", 3), ("b", 2)) for i in range(n)], "stem string, id int, element string, bonds array<struct<nbr:int,n:int,anions:boolean>>, outer array<int>")
    rows = [("a", "b", 0, 0, 1, "real"), ("a", "b", None, 0, 0, "real"), ("a", "b", 1, 0, None, "vacancy"), ("a", "b", 1, 0, None, "unassigned"), ("a", "b", 7, 0, 1, "real"), ("a", "c", 0, 0, 0, "real"), ("b", "b", 0, 0, 0, "real"), ("b", "a", 0, 0, None, "vacancy"), (None, "b", 0, 0, 0, "real")]
    m = spark.createDataFrame(rows, "stem_a string, stem_b string, a_id int, slot int, b_id int, slot_kind string")
    got = {(r.stem_a, r.stem_b): (r.pairs, r.cost) for r in shell_walk.topology_costs(m, views).collect()}
    # Atom 2 of a is not named; atom 0 of b is by a real row.
    assert got == {("a", "b"): (1, 1.0), ("b", "b"): (1, 2.0)}
    assert {(r.stem_a, r.stem_b, r.a_id, r.b_id, r.cost) for r in shell_walk.pair_costs(m, views).collect()} == {("a", "b", 0, 1, 0.0), ("b", "b", 0, 0, 0.0)}


# ---- symmetry ----------------------------------------------------------------

KNOWN = {
    "rock_salt": ("m-3m", 48, {1: 2}), "cscl": ("m-3m", 48, {1: 2}), "zinc_blende": ("-43m", 24, {1: 2}), "fluorite": ("m-3m", 48, {1: 1, 2: 1}), "rutile": ("4/mmm", 16, {2: 1, 4: 1}), "perovskite": ("m-3m", 48, {1: 2, 3: 1}),
}


def moved(rows, seed):
    """The same crystals in other cells: skew, shifted, and with their sites in another order."""
    rng, out = np.random.default_rng(seed), []
    for r in rows:
        lattice = np.array([list(v) for v in r.lattice])
        change = np.array([[1, 0, 0], [rng.integers(-2, 3), 1, 0], [rng.integers(-2, 3), rng.integers(-2, 3), 1]])
        new = change @ lattice
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        frac = (np.array([list(s.frac) for s in r.sites]) @ np.linalg.inv(change) + rng.random(3)) % 1
        order = rng.permutation(len(frac))
        out.append((r.stem, (new @ turn).tolist(), [(int(k), frac[i].tolist(), r.sites[i].species) for k, i in enumerate(order)]))
    return out


def test_symmetry_of_known_types(spark):
    s = crystals.structures(spark)
    got = {r.stem: r for r in symmetry.symmetries(s).collect()}
    keys = {}
    for stem, r in got.items():
        kind = stem.split("_", 1)[1].rsplit("-", 1)[0]
        sizes = {}
        for o in r.orbits:
            sizes[int(o.wyckoff.split(".")[0])] = sizes.get(int(o.wyckoff.split(".")[0]), 0) + 1
        assert (r.point_group, r.operations, sizes) == KNOWN[kind], stem
        keys.setdefault(kind, set()).add(r.key)
    # One key for each type, and types apart; rock salt and caesium chloride differ in centring alone.
    assert all(len(k) == 1 for k in keys.values()) and len(set().union(*keys.values())) == 6
    for seed in range(3):
        other = spark.createDataFrame(moved(s.collect(), seed), s.select("stem", "lattice", "sites").schema)
        for r in symmetry.symmetries(other).collect():
            assert (r.key, r.point_group, r.operations) == (got[r.stem].key, got[r.stem].point_group, got[r.stem].operations)
            assert [o.wyckoff for o in r.orbits] == [o.wyckoff for o in got[r.stem].orbits]
            assert all(abs(p.x - q.x) < 1e-3 and abs(p.y - q.y) < 1e-3 for p, q in zip(r.orbits, got[r.stem].orbits))


def test_trivial_groups_without_given_symmetry(spark):
    s = crystals.structures(spark)
    again = spark.createDataFrame([(stem + "-moved", lattice, sites) for stem, lattice, sites in moved(s.collect(), 9)], s.select("stem", "lattice", "sites").schema)
    found = symmetry.symmetries(s.select("stem", "lattice", "sites").unionByName(again))
    groups = {}
    for r in families.trivial_groups(found.select("stem", "key", "orbits")).collect():
        groups.setdefault(r.group, set()).add(r.stem.split("_", 1)[1].split("-")[0])
    assert len(groups) == 6 and all(len(kinds) == 1 for kinds in groups.values())


def test_symmetry_of_nothing(spark):
    schema = crystals.structures(spark).select("stem", "lattice", "sites").schema
    rows = [("no cell", None, []), ("no sites", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], []), ("none", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], None)]
    got = symmetry.symmetries(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and all(r.key is None and r.error for r in got)
    assert symmetry.symmetries(spark.createDataFrame([], schema)).count() == 0
    assert {r.group for r in families.trivial_groups(symmetry.symmetries(spark.createDataFrame(rows, schema)).select("stem", "key", "orbits")).collect()} == {"no cell", "no sites", "none"}


# ---- vacancies ---------------------------------------------------------------


def without(packed_row, gone: int) -> dict:
    """A packed graph without one atom and its bonds."""
    r = packed_row.asDict(recursive=True)
    r["atoms"] = [x for x in r["atoms"] if x["id"] != gone]
    r["bonds"] = [x for x in r["bonds"] if gone not in (x["mid"], x["nbr"])]
    r["poly"] = [x for x in r["poly"] or [] if gone not in (x["a"], x["b"])]
    r["shells"] = [dict(x, outer=[j for j in x["outer"] if j != gone]) for x in r["shells"] or [] if x["id"] != gone]
    return r


@pytest.mark.parametrize("cost", ["edge_identity", "topology"])
def test_a_missing_site_is_a_vacancy(world, cost):
    """A crystal without one site maps onto the whole one, and exactly that site is the vacancy."""
    for start in ("SrTiO3", "TiO2", "CsCl"):
        row = next(r for r in world.packed.collect() if r.stem.startswith(start) and not r.stem.endswith("double"))
        whole = match.Graph.of(row.asDict(recursive=True))
        for gone in {whole.element[k]: i for k, i in enumerate(whole.ids)}.values():
            part = match.Graph.of(without(row, gone))
            for a, b, side in ((part, whole, "b"), (whole, part, "a")):
                found = vacancies.search(a, b, cost)
                lone = [((b if s == "b" else a).element[k], s, kind) for (s, k), kind in found.lone.items()]
                assert lone == [(whole.element[whole.ids.index(gone)], side, "vacancy")], (start, gone, side, lone)
                assert found.cost <= 1.0


def test_vacancies_in_mapping_rows(spark, world):
    row = next(r for r in world.packed.collect() if r.stem.startswith("SrTiO3") and not r.stem.endswith("double"))
    sr = next(x["id"] for x in row.atoms if x["element"] == "Sr")
    cut = without(row, sr) | {"stem": "ReO3-like"}
    packed = spark.createDataFrame([row.asDict(recursive=True), cut], world.packed.schema)
    m = match.match_pairs(spark.createDataFrame([(row.stem, "ReO3-like"), ("ReO3-like", row.stem)], "stem_a string, stem_b string"), packed, optimizer="vacancies")
    got = {(r.stem_a == row.stem, r.a_id, r.b_id, r.slot_kind) for r in match.mapping_rows(m).collect() if r.slot_kind != "real"}
    assert got == {(True, sr, None, "vacancy"), (False, None, sr, "vacancy")}


def test_kinds_by_joins_and_by_search_agree(spark, world):
    ids = {r.stem: sorted(x["id"] for x in r.atoms) for r in world.packed.collect()}
    graphs = {r.stem: match.Graph.of(r.asDict(recursive=True)) for r in world.packed.collect()}
    rng, maps = np.random.default_rng(6), []
    names = sorted(ids)
    for k in range(14):
        x, y = names[k % len(names)], names[(k * 5 + 2) % len(names)]
        n = min(len(ids[x]), len(ids[y]))
        keep = rng.integers(1, n + 1)
        maps += [(x, y, i, 0, j, "real") for i, j in zip(rng.permutation(ids[x])[:keep].tolist(), rng.permutation(ids[y])[:keep].tolist())]
    maps = [m for m in maps if m[:2] in {q[:2] for q in maps}]
    frame = spark.createDataFrame(maps, "stem_a string, stem_b string, a_id int, slot int, b_id int, slot_kind string")
    half = world.half
    got = {(r.stem_a, r.stem_b, r.side, r.id): r.kind for r in vacancies.lone_atoms(frame, world.nodes, half).collect()}
    want = {}
    for x, y in {m[:2] for m in maps}:
        a, b = graphs[x], graphs[y]
        image = {}
        for p, q, i, _, j, _ in maps:
            if (p, q) == (x, y):
                image.setdefault(a.ids.index(i), []).append(b.ids.index(j))
        want |= {(x, y, s, (a if s == "a" else b).ids[k]): kind for (s, k), kind in vacancies.kinds_of(a, b, image).items()}
    assert got == want and len(set(want.values())) >= 2


def test_element_partners_against_enumeration(world):
    graphs = [match.Graph.of(r.asDict(recursive=True)) for r in world.packed.collect()]

    def shares(g):
        cn, total, out = g.bonds.sum(1), {}, {}
        for e, n in zip(g.element, cn):
            k = vacancies._bucket(int(n))
            total[k] = total.get(k, 0) + 1
            out.setdefault(e, {}).setdefault(k, 0)
            out[e][k] += 1
        return {e: {k: n / total[k] for k, n in v.items()} for e, v in out.items()}

    for a in graphs[:8]:
        for b in graphs[:8]:
            left, right = shares(a), shares(b)
            size = max(len(left), len(right))
            names, others = sorted(left) + [None] * (size - len(left)), sorted(right) + [None] * (size - len(right))
            price = lambda x, y: 100.0 if x is None or y is None else sum(abs(left[x].get(k, 0) - right[y].get(k, 0)) for k in {*left[x], *right[y]})
            least = min(sum(price(x, y) for x, y in zip(names, p)) for p in permutations(others))
            found = vacancies.element_partners(a, b)
            free = [y for y in others if y is not None and y not in found.values()]
            assert abs(sum(price(x, y) for x, y in found.items()) + 100.0 * len(free) - least) < 1e-9


# ---- range join ----------------------------------------------------------------


def test_neighbours_against_all_images(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(4):
        lattice = np.eye(3) * rng.uniform(3, 6, 3) + rng.uniform(-1.5, 1.5, (3, 3)) * (k > 0)
        frac = rng.uniform(-1.2, 1.2, (5, 3))
        rows.append((f"s{k}", lattice.tolist(), [(i, f.tolist()) for i, f in enumerate(frac)]))
        steps = np.array([(i, j, m) for i in range(-7, 8) for j in range(-7, 8) for m in range(-7, 8)])
        for i in range(5):
            for j in range(5):
                far = np.linalg.norm((frac[j] + steps - frac[i]) @ lattice, axis=1)
                want |= {(f"s{k}", i, j, tuple(s)): d for s, d in zip(steps.tolist(), far.tolist()) if 1e-6 < d <= 5.0}
    schema = "stem string, lattice array<array<double>>, sites array<struct<id:int,frac:array<double>>>"
    frame = spark.createDataFrame([*rows, ("flat", [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [(0, [0.0, 0.0, 0.0])]), ("none", None, None)], schema)
    found = neighbours.within(frame, 5.0)
    got = {(r.stem, r.id, r.nbr, tuple(r.img)): r.dist for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---- store of pair costs -------------------------------------------------------


def test_no_pair_is_searched_twice(spark, world, tmp_path):
    from latticework.operators.pair_store import PairCosts

    searched = []

    def search(pairs):
        rows = [tuple(sorted((r.stem_a, r.stem_b))) for r in pairs.collect()]
        searched.extend(rows)
        return match.match_pairs(match.compatible(world.packed, pairs), world.packed).select("stem_a", "stem_b", "cost")

    a, b, c, d = stems(world, "NaCl", "KCl", "MgO", "CsCl")
    frame = lambda *pairs: spark.createDataFrame(list(pairs), "stem_a string, stem_b string")
    store = PairCosts(spark, "t", "edge_identity", search, str(tmp_path / "store"))
    one = rows_of(store.costs(frame((a, b), (b, a), (a, c))))
    assert set(one) == {(a, b), (b, a), (a, c)} and one[a, b].cost == one[b, a].cost
    assert sorted(searched) == sorted([tuple(sorted((a, b))), tuple(sorted((a, c)))])
    # A second run knows both pairs, whichever way round, and searches the new one alone; another cost knows nothing.
    again = PairCosts(spark, "t", "edge_identity", search, str(tmp_path / "store"))
    two = rows_of(again.costs(frame((c, a), (b, a), (a, d))))
    assert len(searched) == 3 and set(two) == {(c, a), (b, a), (a, d)} and two[b, a].cost == one[a, b].cost
    assert PairCosts(spark, "t", "topology", search, str(tmp_path / "store")).known().count() == 0
    assert again.costs(frame()).count() == 0 and len(searched) == 3


def test_families_with_a_store_search_nothing_again(spark, world):
    order = spark.createDataFrame([(r.stem, False, 0.0) for r in world.packed.select("stem").collect()], "stem string, intermetallic boolean, distortion double")
    first = families.families(world.packed, order, store="families-test")
    known = sorted(map(tuple, spark.read.parquet(families.PairCosts(spark, "families-test", "edge_identity", None).path).collect()))
    second = families.families(world.packed, order, store="families-test")
    assert sorted(map(tuple, first.select("stem", "prototype", "cost").collect())) == sorted(map(tuple, second.select("stem", "prototype", "cost").collect()))
    assert sorted(map(tuple, spark.read.parquet(families.PairCosts(spark, "families-test", "edge_identity", None).path).collect())) == known


# ---- exact search -------------------------------------------------------------


def random_graph(rng, counts: dict, most: int = 2):
    """A graph of random bonds, lengths, angles and modes."""
    element = [e for e, n in counts.items() for _ in range(n)]
    n = len(element)
    bonds = rng.integers(0, most + 1, (n, n)) * (rng.random((n, n)) < 0.5)
    bonds = np.triu(bonds) + np.triu(bonds, 1).T
    length = rng.uniform(1.5, 3, (n, n))
    modes = rng.random((n, 4))
    g = match.Graph(list(range(n)), element, ["cation"] * n, rng.integers(1, 7, n), bonds, (length + length.T) / 2, [sorted(rng.uniform(60, 180, rng.integers(1, 4)).tolist()) for _ in range(n)], modes / modes.sum(1, keepdims=True))
    for i, e in enumerate(element):
        g.groups.setdefault(e, []).append(i)
    return g


@pytest.mark.parametrize("cost", ["edge_identity", "bond_length", "cn_core_diff", "bond_angle", "polyhedral"])
def test_branch_and_bound_equals_enumeration(cost):
    from latticework.operators import exact

    rng = np.random.default_rng(11)
    for k, (x, y) in enumerate([({"A": 2, "B": 3}, {"C": 2, "D": 3}), ({"A": 1, "B": 2}, {"A": 2, "B": 4}), ({"A": 2, "B": 4}, {"C": 1, "D": 2}), ({"A": 2, "B": 2}, {"C": 2, "D": 2}), ({"A": 4}, {"B": 4})] * 2):
        a, b = random_graph(rng, x), random_graph(rng, y)
        want, got = match.best_mapping(a, b, cost, most=10**7), exact.branch_and_bound(a, b, cost, most=10**6)
        assert got.status == "exact" and abs(got.cost - want.cost) < 1e-9, (k, cost, got.cost, want.cost)
    assert exact.branch_and_bound(random_graph(rng, {"A": 2}), random_graph(rng, {"A": 1, "B": 1}), cost).status == "incompatible"


def test_large_cells_are_solved_exactly(world):
    """An element of 48 atoms in a cell, which enumeration refuses: a permuted copy is found at no cost, and a node budget states its gap."""
    from latticework.operators import exact

    rng = np.random.default_rng(2)
    n = 48
    ring = np.zeros((n, n), int)
    for i in range(n):
        for d in (1, 5):
            ring[i, (i + d) % n] += 1
            ring[(i + d) % n, i] += 1
    plain = random_graph(rng, {"A": n})
    plain.bonds = ring
    p = rng.permutation(n)
    other = random_graph(rng, {"B": n})
    other.bonds = ring[np.ix_(p, p)]
    assert match.best_mapping(plain, other).status == "too many atoms"
    found = exact.branch_and_bound(plain, other)
    assert found.cost < 1e-9 and found.status == "exact"
    other.bonds = random_graph(rng, {"B": n}).bonds
    cut = exact.branch_and_bound(plain, other, most=50)
    assert cut.status.startswith("bounded, gap ") and float(cut.status.split()[-1]) > 0
    with pytest.raises(ValueError):
        exact.branch_and_bound(plain, other, "topology")


# ---- hybrid bonds --------------------------------------------------------------


def test_bonds_split_by_hand_are_admitted_again(spark, world):
    """Core bonds of one atom that are made extended come back, whatever the order of sites, and nothing else does."""
    from latticework.operators import hybrid

    (start,) = stems(world, "SrTiO3")
    nodes = world.nodes.where(F.col("stem") == start).select("stem", "id", "ion_role", F.col("cn").alias("cn_core"))
    bonds = world.bonds.where(F.col("stem") == start).select("stem", "id", "source", "target", F.lit("core").alias("sphere"), "ecn_s", "ecn_t")
    own = bonds.collect()
    ti = next(r.id for r in nodes.join(world.nodes.select("stem", "id", "element"), ["stem", "id"]).collect() if r.element == "Ti")
    split = sorted(r.id for r in own if ti in (r.source, r.target))[:2]
    for turn in (lambda i: i, lambda i: 40 - i):
        lost = {}
        for r in own:
            if r.id in split:
                for end in (r.source, r.target):
                    lost[end] = lost.get(end, 0) + 1
        less = [("split", turn(r.id), r.ion_role, r.cn_core - lost.get(r.id, 0)) for r in nodes.collect()]
        cut = [("split", r.id, turn(r.source), turn(r.target), "extended" if r.id in split else "core", r.ecn_s, r.ecn_t) for r in own]
        all_nodes = nodes.withColumn("cn_core", F.col("cn_core").cast("int")).unionByName(spark.createDataFrame(less, "stem string, id int, ion_role string, cn_core int"))
        all_bonds = bonds.unionByName(spark.createDataFrame(cut, bonds.schema))
        pairs = spark.createDataFrame([(start, "split"), ("split", start), (start, start)], "stem_a string, stem_b string")
        got = {(r.stem_a, r.stem_b): (r.admitted_a, r.admitted_b, r.left) for r in hybrid.hybrid_bonds(pairs, all_nodes, all_bonds).collect()}
        assert got == {(start, "split"): ([], split, 0.0), ("split", start): (split, [], 0.0), (start, start): ([], [], 0.0)}
    one = hybrid.hybrid_bonds(pairs.limit(1), all_nodes, all_bonds, rounds=1).first()
    assert len(one.admitted_b) == 1 and one.left > 0


def test_no_bond_is_admitted_that_makes_things_worse():
    from latticework.operators import hybrid

    a = {0: ("cation", 4), 1: ("anion", 4)}
    # The only extended bond would take both atoms of b past those of a.
    x, y, left = hybrid.resolve((a, []), (dict(a), [(7, 0, 1, 0.4)]))
    assert (x, y, left) == ([], [], 0.0)
    x, y, left = hybrid.resolve((a, []), ({0: ("cation", 3), 1: ("anion", 4)}, [(7, 0, 1, 0.4)]))
    assert y == [] and left == 1.0


# ---- refinement inside groups ----------------------------------------------------


def test_refinement_reaches_the_optimum_and_never_falls():
    from latticework.operators import refine

    rng = np.random.default_rng(5)
    for n in (3, 5, 6, 12):
        edges = [(int(p), int(q), m) for p in range(n) for q in range(p + 1, n) for m in ("corner", "edge") if rng.random() < 0.3]
        turn = rng.permutation(n)
        wanted = {(*sorted((int(turn[p]), int(turn[q]))), m) for p, q, m in edges}
        image = {i: int(j) for i, j in enumerate(rng.permutation(n))}
        found = refine.refined(image, edges, wanted, [list(range(n))])
        assert sorted(found.values()) == list(range(n))
        assert refine.f1(found, edges, wanted) >= refine.f1(image, edges, wanted)
        if n <= 8:
            assert refine.f1(found, edges, wanted) == 1.0
        # Two classes: images stay inside them.
        half = refine.refined(image, edges, wanted, [[0, 1], list(range(2, n))])
        assert {half[0], half[1]} == {image[0], image[1]} and refine.f1(half, edges, wanted) >= refine.f1(image, edges, wanted)


def test_mappings_are_refined_pair_by_pair(spark):
    from latticework.operators import refine

    poly = spark.createDataFrame([("a", 0, 1, "edge"), ("a", 1, 2, "corner"), ("b", 0, 1, "corner"), ("b", 1, 2, "edge"), ("c", 0, 1, "edge")], "stem string, a int, b int, mode_all string")
    m = spark.createDataFrame([("a", y, i, 0, i, "real") for y in "bc" for i in range(3 if y == "b" else 2)] + [("a", "d", 0, 0, 0, "real"), ("a", "d", 0, 1, 1, "real")], "stem_a string, stem_b string, a_id int, slot int, b_id int, slot_kind string")
    classes = spark.createDataFrame([("a", i, 0) for i in range(3)], "stem string, id int, class int")
    got = {(r.stem_b, r.a_id): (r.b_id, r.f1_before, r.f1_after) for r in refine.refine_mappings(m, poly, classes).collect()}
    assert {k: v[0] for k, v in got.items()} == {("b", 0): 2, ("b", 1): 1, ("b", 2): 0, ("c", 0): 0, ("c", 1): 1}
    assert got["b", 0][1:] == (0.0, 1.0) and got["c", 0][1:] == (1.0, 1.0)
    assert refine.refine_mappings(m.limit(0), poly, classes).count() == 0

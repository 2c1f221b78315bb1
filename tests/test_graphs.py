"""The graph engine on generated structures, against values known for these structure types."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import assign, build, classify, cluster, families, fingerprint, graph, match, metrics, search, similarity
from latticework.plans import crystals
from latticework.sources import cif, graphs, sinks


@pytest.fixture(scope="module")
def built(spark):
    return crystals.Built(spark)


def by_kind(rows, field):
    out = {}
    for r in rows:
        out.setdefault(r.stem.split("_", 1)[1].rsplit("-", 1)[0], set()).add(field(r))
    return out


def test_coordination_numbers(built):
    rows = graph.coordination(built.nodes, built.half).join(built.nodes.select("stem", "id", "ion_role", "element"), ["stem", "id"]).collect()
    got = by_kind(rows, lambda r: (r.ion_role, r.cn))
    assert got["rock_salt"] == {("cation", 6), ("anion", 6)}
    assert got["cscl"] == {("cation", 8), ("anion", 8)}
    assert got["zinc_blende"] == {("cation", 4), ("anion", 4)}
    assert got["fluorite"] == {("cation", 8), ("anion", 4)}
    assert got["rutile"] == {("cation", 6), ("anion", 3)}
    assert got["perovskite"] == {("cation", 12), ("cation", 6), ("anion", 6)}


def test_voronoi_cell_of_a_cubic_lattice_is_a_cube():
    vectors = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1], [1, 1, 0], [1, 1, 1]], float)
    areas = build.voronoi_areas(vectors, np.linalg.norm(vectors, axis=1) / 2)
    assert np.allclose(areas[:6], 1) and np.allclose(areas[6:], 0)
    assert build.voronoi_areas(vectors[:3], np.full(3, 0.5)).sum() == 0


def test_econ_of_equal_bonds_is_the_coordination_number(built):
    weights = graph.econ_weights(built.half).where("stem like '%rock_salt%'").agg(F.min("ecn_new"), F.max("ecn_new")).first()
    assert abs(weights[0] - 1) < 1e-9 and abs(weights[1] - 1) < 1e-9


def test_econ_against_a_loop(spark):
    lengths = [1.9, 1.95, 2.0, 2.0, 2.3, 2.9]
    mean = min(lengths)
    for _ in range(20):
        w = [math.exp(1 - (x / mean) ** 6) for x in lengths]
        new = sum(a * b for a, b in zip(w, lengths)) / sum(w)
        done, mean = abs(new - mean) < 1e-6, new
        if done:
            break
    half = spark.createDataFrame([("s", 0, x) for x in lengths], "stem string, mid int, len double")
    got = [r.ecn_new for r in graph.econ_weights(half).orderBy("len").collect()]
    assert np.allclose(got, [math.exp(1 - (x / mean) ** 6) for x in lengths])


def test_sharing_modes(built):
    rows = built.poly.join(built.nodes.select("stem", F.col("id").alias("a"), F.col("ion_role").alias("ra")), ["stem", "a"]).where("path_type = 'cation-anion-cation'").collect()
    got = by_kind(rows, lambda r: r.mode_all)
    assert got["rock_salt"] == {"corner", "edge"}
    assert got["zinc_blende"] == {"corner"}
    assert got["fluorite"] == {"edge"}
    assert "corner" in got["perovskite"]


def test_polyhedral_edges_against_enumeration(built):
    """Counts of second-neighbour edges by plain enumeration over half bonds."""
    half = [r for r in built.half.where("stem like 'TiO2%'").collect()]
    want = {}
    for m in {r.mid for r in half}:
        own = [r for r in half if r.mid == m]
        for i in range(len(own)):
            for j in range(i):
                x, y = own[i], own[j]
                d = [q - p for p, q in zip(x.img, y.img)]
                a, b = x.nbr, y.nbr
                if a > b or (a == b and [-v for v in d] < d):
                    a, b, d = b, a, [-v for v in d]
                want[a, b, tuple(d)] = want.get((a, b, tuple(d)), 0) + 1
    got = {(r.a, r.b, tuple(r.img)): r.n_all for r in built.poly.where("stem like 'TiO2%'").collect()}
    assert got == want


def test_topology_hash_is_that_of_the_type(built):
    rows = fingerprint.topology_hashes(built.nodes, built.half).collect()
    assert all(len(v) == 1 for v in by_kind(rows, lambda r: r.topology).values())
    assert len({r.topology for r in rows}) == len(crystals.TYPES)


def test_fingerprints_and_equivalence(built):
    prints = fingerprint.fingerprints(built.nodes, built.poly)
    for r in prints.collect():
        assert abs(sum(r.sharing) - 1) < 1e-9 and abs(sum(r.angles) - 1) < 1e-9
    classes = fingerprint.equivalence_classes(prints)
    assert {r["n"] for r in classes.groupBy("stem").agg(F.countDistinct("class").alias("n")).collect()} == {2, 3}


def test_matching_costs(built):
    pairs = match.compatible(built.packed)
    rows = match.match_pairs(pairs, built.packed).collect()
    for r in rows:
        same = r.stem_a.split("_", 1)[1].rsplit("-", 1)[0] == r.stem_b.split("_", 1)[1].rsplit("-", 1)[0]
        assert (r.cost < 1e-9) == same and r.status in ("exact", "bounded")
    assert any(r.k == 2 for r in rows) or any(r.k == 4 for r in rows)


def test_other_costs_and_composition(built):
    pairs = match.compatible(built.packed).where("stem_a like '%rutile%' and stem_b like '%rutile%'")
    rows = match.mapping_rows(match.match_pairs(pairs, built.packed))
    # The cells differ by 3 % in length, which each of six atoms adds.
    assert abs(match.score_mappings(rows, built.packed, "bond_length").first().cost - 6 * 0.03 / 1.015) < 1e-6
    for name in ("bond_angle", "polyhedral", "cn_core_diff", "edge_identity"):
        assert match.score_mappings(rows, built.packed, name).first().cost < 1e-6
    assert match.invalid(rows, built.nodes).count() == 0
    whole = match.compose(rows, match.inverse(rows))
    assert whole.where("a_id <> b_id").count() == 0 and whole.where("even").count() == 6
    assert match.polyhedral_f1(built.poly, rows).first().f1 == 1.0


def test_pair_errors_are_rows(built, spark):
    big = match.match_pairs(match.compatible(built.packed).limit(1), built.packed, most_atoms=0).first()
    assert big.status == "too many atoms" and math.isinf(big.cost)


def test_families(built):
    rows = families.families(built.packed, built.order(), batch=2).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.family_id, set()).add(r.stem.split("_", 1)[1].rsplit("-", 1)[0])
    assert all(len(v) == 1 for v in kinds.values()) and len(kinds) == len(crystals.TYPES)
    assert all(r.family_size == sum(x.family_id == r.family_id for x in rows) for r in rows)


def test_leader_clusters_follow_order(spark):
    value = {"a": 0.0, "b": 0.04, "c": 0.08, "d": 1.0, "e": 1.03}
    costs = lambda pairs: pairs.select("stem_a", "stem_b", F.abs(F.element_at(F.create_map(*[F.lit(x) for k in value.items() for x in k]), F.col("stem_a")) - F.element_at(F.create_map(*[F.lit(x) for k in value.items() for x in k]), F.col("stem_b"))).alias("cost"))
    items = spark.createDataFrame([("x", k, float(i)) for i, k in enumerate(value)], "class string, stem string, rank double")
    got = {r.stem: r.prototype for r in families.leader_clusters(items, costs, 0.05, batch=1).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}


def test_trivial_groups(spark):
    orbit = lambda x: [("a", 0.0, 0.0, 0.0), ("b", x, x, x)]
    rows = [("m1", "225", orbit(0.25)), ("m2", "225", orbit(0.255)), ("m3", "225", orbit(0.745)), ("m4", "225", orbit(0.4)), ("m5", "136", orbit(0.25)), ("m6", None, None)]
    got = {r.stem: r.group for r in families.trivial_groups(spark.createDataFrame(rows, "stem string, key string, orbits array<struct<wyckoff:string,x:double,y:double,z:double>>")).collect()}
    assert got == {"m1": "m1", "m2": "m1", "m3": "m1", "m4": "m4", "m5": "m5", "m6": "m6"}


def test_structure_types(built):
    got = {r.stem.split("_")[0]: r.type for r in classify.structure_types(classify.features(built.nodes, built.poly, built.meta)).collect()}
    assert got == {"NaCl": "halide", "KCl": "halide", "MgO": "rock_salt", "CsCl": "halide", "TlBr": "halide", "ZnS": "zinc_blende", "CaF2": "halide", "ThO2": "fluorite", "TiO2": "rutile", "SnO2": "rutile", "SrTiO3": "perovskite", "BaZrO3": "perovskite"}


def test_template_search(built):
    bridge = search.Template([search.TemplateNode("Ti", "cation", 6), search.TemplateNode("O", "anion"), search.TemplateNode("Ti", "cation", 6)], [(0, 1, None, False), (1, 2, None, False)])
    found = search.matches(built.nodes, search.simple_graph(built.bonds), bridge)
    assert {r.stem.split("_")[0] for r in found.collect()} == {"TiO2"}
    assert search.best_matches(found, 1).first().score == 1.0


def test_topology_scores(built):
    d = fingerprint.descriptors(built.nodes, built.half, built.poly)
    rows = similarity.topology_scores(match.compatible(built.packed), d).collect()
    same = [r.score for r in rows if r.stem_a.split("_", 1)[1].rsplit("-", 1)[0] == r.stem_b.split("_", 1)[1].rsplit("-", 1)[0]]
    assert min(same) > 0.99 and min(r.score for r in rows) < 0.6


def test_metrics(built):
    assert {r.intermetallic for r in metrics.flags(built.nodes).collect()} == {False}
    sites = {r.stem.split("_")[0]: (r.a.element, r.b and r.b.element, r.x.element) for r in metrics.abx_sites(built.nodes, "cn").collect()}
    assert sites["SrTiO3"] == ("Sr", "Ti", "O") and sites["NaCl"] == ("Cl", "Na", "Cl")
    shells = {(r.stem.split("_")[0], r.label) for r in metrics.shell_angles(built.half).collect()}
    assert ("NaCl", "octahedral") in shells and ("ZnS", "tetrahedral") in shells
    assert metrics.bonds_of(built.bonds, "none").count() == 0


def test_hungarian_against_enumeration():
    draw = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = draw.random((n, m))
        got = cost[np.arange(n), assign.hungarian(cost)].sum()
        want = min(sum(cost[i, j] for i, j in a.items()) for a in ({i: v[0] for i, v in x.items()} for x in assign.assignments(list(range(n)), list(range(m)), 1)))
        assert abs(got - want) < 1e-12
    assert [len(x) for x in assign.supercell(draw.random((2, 6)), 3)] == [3, 3]


def test_components_and_dbscan(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long")
    assert {r.node: r.label for r in cluster.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 9, 20)], "node long")
    assert {r.node: r.cluster for r in cluster.dbscan(nodes, edges, 3).collect()} == {1: 2, 2: 2, 3: 2, 8: -1, 9: -1, 20: -1}


def test_average_linkage():
    x = np.array([0.0, 0.1, 5.0, 5.2])
    rows = families.average_linkage(np.abs(x[:, None] - x[None]))
    assert [tuple(map(int, r[:2])) for r in rows] == [(0, 1), (2, 3), (4, 5)] and abs(rows[2][2] - 5.05) < 1e-9


CIF = """data_TiO2
_cell_length_a 4.6
_cell_length_b 4.6
_cell_length_c 2.96
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_symmetry_space_group_name_H-M 'P 42/m n m'
_symmetry_Int_Tables_number 136
_chemical_formula_sum 'Ti2 O4'
loop_
_symmetry_equiv_pos_as_xyz
'x, y, z'
'-x, -y, z'
'-y+1/2, x+1/2, z+1/2'
'y+1/2, -x+1/2, z+1/2'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
Ti1 Ti4+ 0 0 0 1
O1 O2- 0.305 0.305 0 1
"""


def test_cif_reader(spark, tmp_path):
    (tmp_path / "TiO2_x.cif").write_text(CIF)
    (tmp_path / "bad.cif").write_text("nothing here")
    rows = {r.stem: r for r in cif.read_structures(spark, str(tmp_path)).collect()}
    assert rows["bad"].error and len(rows["TiO2_x"].sites) == 6 and rows["TiO2_x"].sg_number == 136
    nodes, bonds = build.build_graphs(cif.read_structures(spark, str(tmp_path)), rescue=False)
    assert {(r.element, r.cn) for r in nodes.collect()} == {("Ti", 6), ("O", 3)} and bonds.count() == 12


def test_documents_of_both_generations(spark, tmp_path):
    node = {"id": 0, "element": "Na", "ion_role": "cation", "coordination_number": 6}
    edge = {"id": 0, "source": 0, "target": 1, "to_jimage": [0, 0, 0], "bond_length": 2.8, "cart_vec": [2.8, 0, 0]}
    old = {"metadata": {"formula": "NaCl"}, "nodes": [node, {**node, "id": 1, "element": "Cl"}], "edges": [edge], "polyhedral_edges": [{"id": 0, "node_a": 0, "node_b": 1, "to_jimage": [0, 0, 0], "mode": "edge", "shared_count": 2}]}
    new = json.loads(json.dumps(old))
    new["polyhedral_edges"][0] = {"id": 0, "node_a": 0, "node_b": 1, "to_jimage": [0, 0, 0], "mode_all": "edge", "mode_core": "edge", "shared_count_all": 2, "shared_count_core": 2}
    for name, doc in (("NaCl_mp-1", old), ("NaCl_mp-2", new)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "NaCl_mp-3.json").write_text('{"nodes": [')
    (tmp_path / "families_x.json").write_text("{}")
    docs = graphs.read_documents(spark, str(tmp_path), skip=("families",))
    assert {r.stem: r.error for r in docs.collect()} == {"NaCl_mp-1": None, "NaCl_mp-2": None, "NaCl_mp-3": "unreadable"} or docs.where("error is null").count() == 2
    t = graphs.tables(docs)
    assert {(r.mode_all, r.n_all) for r in t.poly.collect()} == {("edge", 2)} and t.poly.count() == 2
    wanted = spark.createDataFrame([("NaCl_mp-1",), ("KCl_mp-9",)], "stem string")
    assert [r.stem for r in graphs.missing(wanted, docs).collect()] == ["KCl_mp-9"]
    protos = spark.createDataFrame([("a", "NaCl_mp-2"), ("b", "X_mp-1")], "label string, wanted string")
    assert {r.label: r.stem for r in graphs.resolve_prototypes(protos, docs).collect()} == {"a": "NaCl_mp-2", "b": "NaCl_mp-1"}


def test_mapping_json_round_trip(built):
    rows = match.mapping_rows(match.match_pairs(match.compatible(built.packed).limit(3), built.packed)).select("stem_a", "stem_b", "a_id", "slot", "b_id", "slot_kind")
    assert sinks.mapping_rows(sinks.mapping_json(rows)).exceptAll(rows).count() == 0


def test_sinks(spark, tmp_path):
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "stem string, group string")
    assert [r["size"] for r in sinks.trivial_table(groups, groups.select("stem")).collect()] == [2, 1]
    with pytest.raises(ValueError):
        sinks.trivial_table(groups, spark.createDataFrame([("z",)], "stem string"))
    sinks.write_csv(groups, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    text = [r.value for r in sinks.gml(spark.createDataFrame([(1, "p", 2)], "family_id int, prototype string, size long"), spark.createDataFrame([(1, 1, 3)], "child_id int, parent_id int, edges_added int")).collect()]
    assert text[0] == "graph [" and text[-1] == "]" and len(text) == 5


def test_documents_round_trip(built, spark, tmp_path):
    """Tables written as documents and read back are the same tables."""
    from latticework.plans import workflows

    made = workflows.documents(built.nodes, built.bonds, built.poly, built.structures.select("stem", "formula", "sg_symbol", "sg_number", "lattice"))
    t = graphs.tables(made.withColumn("error", F.lit(None).cast("string")).select("stem", made["metadata"], "nodes", "edges", "polyhedral_edges").withColumn("metadata", F.from_json(F.to_json("metadata"), graphs._struct(graphs._META))).withColumn("nodes", F.from_json(F.to_json("nodes"), f"array<{graphs._struct(graphs._NODE)}>")).withColumn("edges", F.from_json(F.to_json("edges"), f"array<{graphs._struct(graphs._EDGE)}>")).withColumn("polyhedral_edges", F.from_json(F.to_json("polyhedral_edges"), f"array<{graphs._struct(graphs._POLY)}>")))
    keys = ["stem", "source", "target", "img", "sphere", "vw_s", "vw_t"]
    assert t.bonds.select(*keys).exceptAll(built.bonds.select(*keys)).count() == 0 and t.bonds.count() == built.bonds.count()
    cn = ["stem", "id", "element", "ion_role", "cn", "cn_core"]
    assert t.nodes.select(*cn).exceptAll(built.nodes.select(*cn)).count() == 0
    edges = ["stem", "a", "b", "img", "n_all", "mode_all", "mean_angle"]
    assert t.poly.select(*edges).exceptAll(built.poly.select(*edges)).count() == 0


def test_workflows(built, spark):
    from latticework.plans import workflows

    near = spark.createDataFrame([], "stem string, id int, rank int, nbr int, img array<int>, dist double")
    t = graphs.GraphTables(built.meta, built.nodes, built.bonds, built.poly, near)
    labelled = workflows.label_by_prototypes(t, spark.createDataFrame([("salt", "NaCl_rock_salt-0"), ("rutile", "TiO2_rutile-8")], "label string, stem string"))
    got = {r.stem.split("_")[0]: (r.label, r.status) for r in labelled.collect()}
    assert got["MgO"] == ("salt", "classified") and got["SnO2"] == ("rutile", "classified") and got["CsCl"][1] == "flagged"
    made, failed = workflows.build_missing(built.structures, spark.createDataFrame([("NaCl_rock_salt-0", [], [])], "stem string, nodes array<int>, edges array<int>"), "1-1-O3")
    assert failed.count() == 0 and {r.stem.split("_")[0] for r in made.select("stem").collect()} == {"SrTiO3", "BaZrO3"}


def _random_half(spark, seed=4):
    """Half bonds among three cations and three anions, with bonds between like ions, an atom's own images and a null role."""
    draw = random.Random(seed)
    rows = []
    for stem in "pqrs":
        for eid in range(draw.randrange(5, 12)):
            a, b = draw.randrange(6), draw.randrange(6)
            img, vec = [draw.randrange(-1, 2) for _ in range(3)], [draw.uniform(0.5, 3) * draw.choice((-1, 1)) for _ in range(3)]
            size = math.sqrt(sum(v * v for v in vec))
            core = draw.random() < 0.8
            rows.append((stem, eid, 0, a, b, img, vec, size, core))
            rows.append((stem, eid, 1, b, a, [-v for v in img], [-v for v in vec], size, core))
    roles = {i: "cation" if i < 3 else "anion" if i < 5 else None for i in range(6)}
    nodes = spark.createDataFrame([(s, i, r) for s in "pqrs" for i, r in roles.items()], "stem string, id int, ion_role string")
    return rows, roles, nodes, spark.createDataFrame(rows, "stem string, eid int, dir int, mid int, nbr int, img array<int>, vec array<double>, len double, is_core boolean")


def test_torsions_against_enumeration(spark):
    """Ligands and pairs of bonds are rows of generated code: no lambda is evaluated for each of them."""
    rows, roles, nodes, half = _random_half(spark)
    paths, found = {}, {}
    for x, y in itertools.combinations(sorted(rows, key=lambda r: r[:3]), 2):
        if x[0] == y[0] and x[3] == y[3]:
            there = [q - p for p, q in zip(x[5], y[5])]
            back = [-v for v in there]
            turned = (x[4], back) > (y[4], there) if x[4] != y[4] else back < there
            p, q = (y, x) if turned else (x, y)
            paths.setdefault((x[0], p[4], q[4], tuple(back if turned else there)), []).append((x[3], p[6]))
    flat = lambda v, axis: np.array(v) - np.array(axis) * np.dot(v, axis) / np.dot(axis, axis)
    for (stem, a, b, img), ((mid, axis), *more) in paths.items():
        if more or (roles[a], roles[mid], roles[b]) != ("cation", "anion", "cation"):
            continue
        legs = [[flat(r[6], axis) for r in rows if r[0] == stem and r[3] == end and r[4] != mid and r[8]] for end in (a, b)]
        angles = [math.degrees(math.acos(max(-1, min(1, np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))))) for u in legs[0] for v in legs[1] if np.linalg.norm(u) > 1e-6 and np.linalg.norm(v) > 1e-6]
        if angles:
            found[stem, a, b, img] = min(angles)
    made = graph.corner_torsions(nodes, half)
    got = {(r.stem, r.a, r.b, tuple(r.img)): r.torsion for r in made.collect()}
    assert found and got.keys() == found.keys()
    assert all(abs(got[k] - v) < 1e-3 for k, v in found.items())
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_spheres_gather_lengths_alone(spark):
    """Weights of both ends, with a bond without a length and one without an end; vectors are not gathered by node."""
    rows = [("s", 0, 0, 1, 2.0), ("s", 1, 0, 1, 2.1), ("s", 2, 0, 2, 3.5), ("s", 3, 1, 2, None), ("s", 4, None, 2, 2.5), ("s", 5, None, None, 1.0), ("t", 0, 0, 0, 2.0)]
    bonds = spark.createDataFrame([(*r[:4], [1, 0, 0], [r[4], 0.0, 0.0], r[4], 0.1, 0.2) for r in rows], "stem string, id int, source int, target int, img array<int>, cart_vec array<double>, bond_length double, vw_s double, vw_t double")
    made = graph.with_spheres(bonds)
    got = {(r.stem, r.id): r for r in made.collect()}
    assert got.keys() == {(r[0], r[1]) for r in rows if (r[2], r[3]) != (None, None)}
    lengths = {}
    for s, _, a, b, size in rows:
        for end in (a, b):
            if end is not None and size is not None:
                lengths.setdefault((s, end), []).append(size)
    for s, i, a, b, size in rows[:5]:
        for end, ecn in ((a, got[s, i].ecn_s), (b, got[s, i].ecn_t)):
            if end is None or size is None:
                assert ecn is None
                continue
            mean = min(lengths[s, end])
            for _ in range(20):
                w = [math.exp(1 - (x / mean) ** 6) for x in lengths[s, end]]
                new = sum(x * y for x, y in zip(w, lengths[s, end])) / sum(w)
                done, mean = abs(new - mean) < 1e-6, new
                if done:
                    break
            assert abs(ecn - math.exp(1 - (size / mean) ** 6)) < 1e-5
    lists = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
    assert lists and not any("vec" in x or "img" in x for x in lists)

import time
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import formula as f
from latticework.operators import cluster, pairs
from latticework.plans import catalog, engine  # noqa: F401
from latticework.streaming import incremental

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("text", "key", "ratio"),
    [("CaTiO3", "Ca1O3Ti1", "1-1-3"), ("Ca5(PO4)3F", "Ca5F1O12P3", "1-3-5-12"), ("Ca(Al(OH)2)2", "Al2Ca1H4O4", "1-2-4-4"), ("Fe4O6", "Fe2O3", "2-3"), ("", "", ""), ("Mg[Al2O4]", "Al2Mg1O4", "1-2-4")],
)
def test_formulas(spark, text, key, ratio):
    assert one(spark, text, lambda c: f.formula_key(f.reduced(f.composition(c)))) == key
    assert one(spark, text, lambda c: f.ratio(f.reduced(f.composition(c)))) == ratio


def test_formula_predicates(spark):
    counts = lambda c: f.reduced(f.composition(c))
    assert one(spark, "SrTiO3", lambda c: f.is_abo3(counts(c))) and not one(spark, "O2TiSr", lambda c: f.is_abo3(counts(c)))
    assert one(spark, "La2NiO4", lambda c: f.matches_ratio(counts(c), "214")) and one(spark, "SrTiO3", lambda c: f.matches_ratio(counts(c), "1-1-O3"))
    assert not one(spark, "SrTiN3", lambda c: f.matches_ratio(counts(c), "1-1-O3"))
    assert one(spark, "NaCl", lambda c: f.has_element(counts(c), "cl")) and f.parse_ratio("2:1:4") == ("1-2-4", {})
    with pytest.raises(ValueError):
        f.parse_ratio("x?")


def test_names(spark):
    assert one(spark, "CaSO4·2H2O", f.ima_formula) == "CaSO4" and one(spark, "(Mg,Fe)2SiO4", f.ima_formula) == "Mg2SiO4"
    assert one(spark, "Fe^2+^_2_O<i>3</i>", f.rruff_formula) == "Fe2O3" and one(spark, "Mg_1.6_Fe_0.4_SiO_4_", f.rruff_formula) == "Mg2Fe1SiO4"
    assert one(spark, "Ca2(Mg,Fe2+)5(OH)2", f.ima_formula) == "Ca2Mg5(OH)2" and one(spark, "Cu(IV)O2, OH", f.ima_formula) == "CuO2"
    # Screw axes at the first place make no cubic symbol.
    for s, name in {"P4_3": "tetragonal", "P4_322": "tetragonal", "P4_32_12": "tetragonal", "P4_332": "cubic", "P2_13": "cubic", "Pa-3": "cubic"}.items():
        assert one(spark, s, f.symbol_system) == name
    systems = {"Fm-3m": "cubic", "P4/mmm": "tetragonal", "Pnma": "orthorhombic", "P2_1/c": "monoclinic", "R3m": "trigonal", "P6_3/mmc": "hexagonal", "P-1": "triclinic", "I4/mcm": "tetragonal", "Ia-3d": "cubic"}
    assert all(one(spark, s, f.symbol_system) == name for s, name in systems.items())
    assert one(spark, "x/SrTiO3_mp-5229.cif", f.material_id) == "mp-5229" and one(spark, "x/SrTiO3_mp-5229.cif", f.stem) == "SrTiO3_mp-5229"
    assert one(spark, "SrTiO3_mp-5229", f.formula_part) == "SrTiO3" and one(spark, " YES", f.truthy) and not one(spark, None, f.truthy)
    assert one(spark, '{"a": 1, "b": "x"}', f.safe_map) == {"a": 1.0} and one(spark, "oops", f.safe_map) == {}
    assert spark.range(1).select(f.crystal_system(F.lit(227)), f.crystal_system(F.lit(0))).first()[:] == ("cubic", None)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_against_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    relation = duck.sql(catalog.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    # Numbers are compared as numbers, whatever their types.
    shown = lambda v: repr(float(v)) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect())
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in relation.fetchall())


def test_pairs_and_clusters_cross_labels(spark, tmp_path):
    """Nearness links embeddings of different labels, and of none."""
    rows = [(k, "ab"[k % 2] if k < 4 else None, [0.1 * k, 0.0]) for k in range(6)] + [(9, "a", [50.0, 0.0]), (10, "b", None)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = catalog.near_pairs(spark, str(tmp_path), block=2).collect()
    assert sorted((r.a, r.b, r.dist) for r in near) == [(a, b, round(0.1 * (b - a), 4)) for a in range(6) for b in range(a + 1, 6)]
    assert {tuple(r) for r in catalog.QUERIES["q_pair_distance_all"](spark, str(tmp_path)).collect()} == {tuple(r) for r in near}
    got = {r.node: r.cluster for r in catalog.QUERIES["q_dbscan_components_all"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(6), 0) | {9: -1, 10: -1}


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "1 hour")
    run = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    same = incremental.windowed_counts(events, "1 hour").select("start", "event_type", "n")
    assert spark.table("w").select("start", "event_type", "n").exceptAll(same).count() == 0 and same.count() == spark.table("w").count()
    assert incremental.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_new_documents_are_handled_once(spark, tmp_path):
    import json

    seen = []
    doc = {"metadata": {"formula": "X"}, "nodes": [{"id": 0, "element": "X"}], "edges": []}
    (tmp_path / "in").mkdir()

    def go():
        known = lambda s: s.createDataFrame([(x,) for x in seen], "stem string") if seen else None
        handle = lambda t, n: seen.extend(r.stem for r in t.meta.select("stem").collect())
        incremental.on_new_graphs(incremental.document_stream(spark, f"{tmp_path}/in"), known, handle, f"{tmp_path}/check").awaitTermination(120)

    for k in range(2):
        (tmp_path / "in" / f"m{k}.json").write_text(json.dumps(doc))
        go()
        time.sleep(0.1)
    assert sorted(seen) == ["m0", "m1"]


def test_pairs_by_products_are_exact(spark, monkeypatch):
    """Products of matrices lose places where vectors are long or nearly equal; such distances are computed again."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=(60, 8)) * 1e-3 + 1e6, np.full((4, 8), 0.25)]).astype(np.float32)
    rows = [(i, x[i].tolist(), i % 3) for i in range(len(x))] + [(500, None, 0), (501, [1.0] * 8, None), (502, [float("nan")] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    t = spark.createDataFrame(rows, "k long, v array<float>, g int")
    monkeypatch.setattr(pairs, "SLICE", 100)
    y = x.astype(float)
    far = {(g, i, j): np.floor(np.sqrt(((y[i] - y[j]) ** 2).sum()) * 1e4 + 0.5) / 1e4 for j in range(len(x)) for i in range(j) for g in [i % 3] if i % 3 == j % 3}
    got = {tuple(r)[:3]: r.dist for r in pairs.pairwise_distances(t, "k", "v", "g", 13).collect()}
    assert {k: d for k, d in got.items() if 502 not in k} == far and sum(502 in k and np.isnan(d) for k, d in got.items()) == sum(i % 3 == 1 for i in range(len(x)))
    near = {tuple(r) for r in pairs.pairwise_distances(t, "k", "v", "g", 13, 1.2).collect()}
    assert near == {(*k, d) for k, d in far.items() if d < 1.2} and len(near) > 100
    sums = {r.node: (r.units, r.n) for r in pairs.distance_sums(t.where("k < 500"), "k", "v", "g", 13).collect()}
    assert sums == {i: (sum(round(d * 1e4) for k, d in far.items() if i in k[1:]), sum(i in k[1:] for k in far)) for i in range(len(x))}


def test_few_links_give_the_clusters_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 2)) * 0.2, rng.normal(size=(60, 2)) * 4])
    t = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in enumerate(x)] + [(0, x[1].tolist(), 0)], "k long, v array<double>, g int")
    monkeypatch.setattr(pairs, "EDGES", 500)
    nodes = t.select(F.col("k").alias("node")).distinct()
    for members in (2, 3, 5):
        every = pairs.pairwise_distances(t, "k", "v", "g", 70, 0.5).select("a", "b")
        links = pairs.dbscan_links(t, "k", "v", "g", 0.5, members, 70)
        assert links.count() < every.count() / 3
        assert {tuple(r) for r in cluster.dbscan(nodes, links, members).collect()} == {tuple(r) for r in cluster.dbscan(nodes, every, members).collect()}

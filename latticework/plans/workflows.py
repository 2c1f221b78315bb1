"""Workflows made of the operators: building missing graphs, families down to subfamilies, prototype labels, and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import composition, formula_part, matches_ratio, reduced
from ..operators import build, families, fingerprint, graph, match, metrics, search, similarity
from ..sources.graphs import GraphTables, missing


def documents(nodes: DataFrame, bonds: DataFrame, poly: DataFrame, meta: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(stem, metadata, nodes, edges, polyhedral_edges): graph documents of tables, with the newest field names; the inverse of sources.graphs.tables."""
    hist = lambda mode, name: graph.sharing_histogram(nodes, poly, mode).select("stem", "id", F.create_map(*[x for c in ("corner", "edge", "face", "other") for x in (F.lit(c), F.col(c))]).alias(name))
    n = nodes.join(hist("mode_all", "sharing_mode_hist_all"), ["stem", "id"], "left").join(hist("mode_core", "sharing_mode_hist_core"), ["stem", "id"], "left")
    if near is not None:
        lists = near.groupBy("stem", "id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("nbr").alias("node_id"), F.col("img").alias("to_jimage"), F.col("dist").alias("distance")))).alias("_n"))
        n = n.join(lists, ["stem", "id"], "left").withColumn("nearest_neighbors", F.transform("_n", lambda x: F.struct(x["node_id"].alias("node_id"), x["to_jimage"].alias("to_jimage"), x["distance"].alias("distance"))))
    else:
        n = n.withColumn("nearest_neighbors", F.lit(None).cast("array<struct<node_id:int,to_jimage:array<int>,distance:double>>"))
    species = F.transform("species", lambda s: F.struct(s["symbol"].alias("symbol"), s["occupancy"].alias("occupancy"), s["oxi_state"].alias("oxi_state")))
    node = F.struct(
        "id", "element", species.alias("species"), "is_disordered", "oxidation_state", "ion_role", F.col("frac").alias("frac_coords"), F.col("cn").alias("coordination_number"), "cn_core", "cn_extended", "ecn_value",
        "sharing_mode_hist_all", "sharing_mode_hist_core", "nearest_neighbors", F.col("shannon_r").alias("shannon_radius_angstrom"),
    )
    edge = F.struct(
        "id", "source", "target", F.col("img").alias("to_jimage"), "periodic", F.col("sphere").alias("coordination_sphere"), "bond_length", "cart_vec", F.col("raw_distance").alias("raw_neighbor_distance"), F.col("ratio").alias("bond_length_over_sum_radii"),
        F.col("dchi_p").alias("delta_chi_pauling"), F.col("dchi_a").alias("delta_chi_allen"), F.col("vw_s").alias("voronoi_weight_source"), F.col("vw_t").alias("voronoi_weight_target"), F.col("ecn_s").alias("ecn_weight_source"), F.col("ecn_t").alias("ecn_weight_target"),
    )
    face = F.struct(
        "id", F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("img").alias("to_jimage"), "path_type", F.col("n_all").alias("shared_count_all"), F.col("n_core").alias("shared_count_core"), "mode_all", "mode_core", F.col("angles").alias("angles_deg"), "path_lengths",
        F.col("mean_angle").alias("mean_angle_deg"), F.col("std_angle").alias("std_angle_deg"), F.col("mean_path").alias("mean_path_length"), F.col("std_path").alias("std_path_length"), "direct_distance",
    )
    gathered = lambda x, s, name: x.groupBy("stem").agg(F.array_sort(F.collect_list(s), lambda a, b: a["id"] - b["id"]).alias(name))
    info = meta.select("stem", F.struct("formula", F.col("sg_symbol").alias("spacegroup_symbol"), F.col("sg_number").alias("spacegroup_number"), F.col("lattice").alias("lattice_matrix")).alias("metadata"))
    out = info.join(gathered(n, node, "nodes"), "stem").join(gathered(bonds, edge, "edges"), "stem", "left").join(gathered(poly, face, "polyhedral_edges"), "stem", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select("stem", "metadata", "nodes", none("edges").alias("edges"), none("polyhedral_edges").alias("polyhedral_edges"))


def build_missing(structures: DataFrame, existing: DataFrame, proportion: str | None = None, radii: DataFrame | None = None, rescue: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents of structures that have none yet, and the failures (stem, error).

    proportion keeps structures of one element ratio, such as '113', '2:1:4'
    or '1-1-O3', by the formula in front of the stem's database id.
    """
    wanted = structures
    if proportion:
        wanted = wanted.where(matches_ratio(reduced(composition(formula_part(F.col("stem")))), proportion))
    todo = missing(wanted, existing)
    nodes, bonds = build.build_graphs(todo, radii, rescue=rescue)
    poly = graph.polyhedral_edges(nodes, graph.half_bonds(bonds))
    made = documents(nodes, bonds, poly, todo.select("stem", "formula", "sg_symbol", "sg_number", "lattice"))
    failed = todo.where("error is not null").select("stem", "error")
    return made, failed


def family_levels(t: GraphTables, symmetry: DataFrame | None = None, l1: float = 0.1, l2: float = 0.05, l2_cost: str = "bond_angle", batch: int = 64) -> dict[str, DataFrame]:
    """Trivial groups (with symmetry), families of their prototypes, members and subfamilies."""
    half = graph.half_bonds(t.bonds)
    packed = families.stored(match.packed_graphs(t.nodes, half, t.poly), "packed")
    scores = metrics.flags(t.nodes).join(metrics.angle_distortion(t.poly), "stem", "left").select("stem", "intermetallic", "oxide", F.coalesce("distortion", F.lit(0.0)).alias("distortion"))
    groups = packed.select("stem", F.col("stem").alias("group")) if symmetry is None else families.trivial_groups(symmetry)
    prototypes = families.stored(families.pick_prototypes(groups, scores), "prototypes")
    chosen = packed.join(prototypes.select("stem"), "stem", "left_semi")
    level1 = families.families(chosen, scores.select("stem", "intermetallic", "distortion"), l1, batch)
    pairs = level1.select(F.col("stem").alias("stem_a"), F.col("prototype").alias("stem_b"))
    maps = families.stored(match.mapping_rows(match.match_pairs(pairs, packed)), "maps")
    level2 = families.subfamilies(level1.join(scores, "stem").select("stem", "family_id", "distortion"), maps, packed, l2_cost, l2, batch)
    return {"groups": groups, "prototypes": prototypes, "families": level1, "members": families.expand_members(level1, groups, prototypes), "subfamilies": level2, "mappings": maps}


def label_by_prototypes(t: GraphTables, prototypes: DataFrame, accept: float = 0.75, uncertain: float = 0.5) -> DataFrame:
    """(stem, label, score, second, status, ambiguous): materials against labelled prototypes (label, stem) by topology score.

    Pairs whose sets of (role, coordination number) don't meet are left out
    before any score is made; the list of prototypes is a small input, joined
    through these sets.
    """
    half = graph.half_bonds(t.bonds)
    kinds = metrics.topology_set(t.nodes).select("stem", F.explode("fp").alias("kind"))
    wanted = kinds.join(prototypes.select("label", "stem"), "stem").select("label", F.col("stem").alias("stem_b"), "kind")
    pairs = kinds.select(F.col("stem").alias("stem_a"), "kind").join(wanted, "kind").select("stem_a", "stem_b", "label").distinct()
    scores = similarity.topology_scores(pairs.select("stem_a", "stem_b").distinct(), fingerprint.descriptors(t.nodes, half, t.poly))
    found = families.classify(pairs.join(scores, ["stem_a", "stem_b"]).select(F.col("stem_a").alias("stem"), "label", "score"), accept, uncertain)
    rest = t.meta.select("stem").join(found, "stem", "left_anti").select("stem", *[F.lit(None).cast(k).alias(c) for c, k in (("label", "string"), ("score", "double"), ("second", "double"))], F.lit("flagged").alias("status"), F.lit(False).alias("ambiguous"))
    return found.unionByName(rest)


def nested_clusters(items: DataFrame, levels: list) -> DataFrame:
    """Clusters inside clusters: items (class, stem, rank) by each (costs_of, threshold) in turn; the last level's prototypes with the path of all levels."""
    out = items.withColumn("path", F.array().cast("array<string>"))
    for costs_of, threshold in levels:
        found = families.leader_clusters(out.select("class", "stem", "rank"), costs_of, threshold)
        out = out.join(found.select("stem", "prototype"), "stem").withColumn("path", F.concat("path", F.array("prototype"))).withColumn("class", F.array_join("path", "/")).drop("prototype")
    return out.select("stem", "class", "path")


def similarity_leaders(t: GraphTables, order: DataFrame, cut: float = 0.25, sure: float = 0.99) -> DataFrame:
    """Leader clusters by topology score (at least 1 - cut), with the flag of members that two larger clusters would take."""
    half = graph.half_bonds(t.bonds)
    d = families.stored(fingerprint.descriptors(t.nodes, half, t.poly), "descriptors")
    costs = lambda pairs: similarity.topology_scores(pairs, d).select("stem_a", "stem_b", (1 - F.col("score")).alias("cost"))
    items = order.select(F.lit("all").alias("class"), "stem", F.col("distortion").alias("rank"))
    found = families.stored(families.leader_clusters(items, costs, cut), "leaders")
    big = found.groupBy("prototype").count().where("count > 1").select(F.col("prototype").alias("stem"))
    # Only graphs that share a kind of node (role and coordination number) can be alike.
    kinds = metrics.topology_set(t.nodes).select("stem", F.explode("fp").alias("kind"))
    heads = kinds.join(big, "stem", "left_semi").withColumnRenamed("stem", "stem_b")
    pairs = kinds.withColumnRenamed("stem", "stem_a").join(heads, "kind").where("stem_a <> stem_b").select("stem_a", "stem_b").distinct()
    near = costs(pairs).where(F.col("cost") <= cut).groupBy(F.col("stem_a").alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("least"))
    return found.join(near, "stem", "left").select("stem", "prototype", "cost", F.coalesce((F.col("n") >= 2) & (1 - F.col("least") < sure), F.lit(False)).alias("ambiguous"))


def scan_fragment(t: GraphTables, template: search.Template, most: int = 20) -> DataFrame:
    """The graphs that hold a fragment, the best match of each, the highest scores first."""
    return search.best_matches(search.matches(t.nodes, search.simple_graph(t.bonds), template), most)

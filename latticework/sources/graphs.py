"""Graph documents: reader, normaliser, and flat tables.

A document is {metadata, nodes, edges, polyhedral_edges}.  Four generations of
field names exist; the schema names them all, and the tables use the newest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = """id int, element string, species array<struct<symbol:string,occupancy:double,oxi_state:double>>, is_disordered boolean,
 oxidation_state double, ion_role string, frac_coords array<double>, cart_coords array<double>, chi_pauling double, chi_allen double,
 coordination_number int, cn_core int, cn_extended int, ecn_value double, sharing_mode_hist map<string,int>, sharing_mode_hist_all map<string,int>,
 sharing_mode_hist_core map<string,int>, nearest_neighbors array<struct<node_id:int,to_jimage:array<int>,distance:double>>,
 shannon_radius_angstrom double, shannon_radius_source string"""
_EDGE = """id int, source int, target int, to_jimage array<int>, periodic boolean, coordination_sphere string, bond_length double,
 cart_vec array<double>, raw_neighbor_distance double, bond_length_over_sum_radii double, delta_chi_pauling double, delta_chi_allen double,
 voronoi_weight_source double, voronoi_weight_target double, ecn_weight_source double, ecn_weight_target double"""
_POLY = """id int, node_a int, node_b int, to_jimage array<int>, path_type string, shared_count int, shared_count_all int, shared_count_core int,
 mode string, mode_all string, mode_core string, angles_deg array<double>, path_lengths array<double>, mean_angle_deg double, std_angle_deg double,
 mean_path_length double, std_path_length double, direct_distance double, torsion_core_deg double, torsion_all_deg double"""
_META = "formula string, spacegroup_symbol string, spacegroup_number int, num_sites int, edge_method string, oxidation_state_source string, ion_role_source string, lattice_matrix array<array<double>>"


def _struct(fields: str) -> str:
    """A DDL list of columns as a struct type."""
    out, depth, part = [], 0, ""
    for c in fields.replace("\n", " ") + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = part.split(maxsplit=1)
            out.append(f"{name}:{kind.strip()}")
            part = ""
        else:
            part += c
    return f"struct<{','.join(out)}>"


DOCUMENT = f"stem string, metadata {_struct(_META)}, nodes array<{_struct(_NODE)}>, edges array<{_struct(_EDGE)}>, polyhedral_edges array<{_struct(_POLY)}>"


def read_documents(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """One row for each JSON file: stem, the document, and `error` for those that can't be read or lack nodes or edges.

    Files whose name begins with one of `skip` are left out.  The stem is the
    file's name without its extension.
    """
    raw = spark.read.schema(DOCUMENT.replace("stem string, ", "") + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1)
    docs = raw.withColumn("stem", F.url_decode(name))
    for prefix in skip:
        docs = docs.where(~F.col("stem").startswith(prefix))
    error = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.col("nodes").isNull() | F.col("edges").isNull(), "no nodes or edges")
    return docs.select("stem", "metadata", "nodes", "edges", "polyhedral_edges", error.alias("error"))


def valid(documents: DataFrame) -> DataFrame:
    """Documents that have lists of nodes and edges."""
    return documents.where("nodes is not null and edges is not null")


@dataclass
class GraphTables:
    """Flat tables of a collection of graphs, keyed by stem."""

    meta: DataFrame
    nodes: DataFrame
    bonds: DataFrame
    poly: DataFrame
    neighbours: DataFrame


def tables(documents: DataFrame) -> GraphTables:
    """The flat tables of documents, with the newest field names."""
    docs = valid(documents)
    m = docs.select("stem", "metadata.*")
    meta = m.select("stem", F.coalesce("formula", "stem").alias("formula"), F.col("spacegroup_symbol").alias("sg_symbol"), F.col("spacegroup_number").alias("sg_number"), "num_sites", "edge_method", F.col("lattice_matrix").alias("lattice"))
    n = docs.select("stem", F.explode("nodes").alias("n")).select("stem", "n.*")
    nodes = n.select(
        "stem", "id", "element", "ion_role", "oxidation_state", F.coalesce("is_disordered", F.lit(False)).alias("is_disordered"), "species",
        F.col("frac_coords").alias("frac"), F.col("cart_coords").alias("cart"), "chi_pauling", "chi_allen",
        F.col("coordination_number").alias("cn"), F.coalesce("cn_core", "coordination_number").alias("cn_core"), "cn_extended", "ecn_value",
        F.col("shannon_radius_angstrom").alias("shannon_r"), F.col("shannon_radius_source").alias("shannon_src"),
        F.coalesce("sharing_mode_hist_all", "sharing_mode_hist").alias("hist_all"), F.coalesce("sharing_mode_hist_core", "sharing_mode_hist").alias("hist_core"),
    )
    e = docs.select("stem", F.explode("edges").alias("e")).select("stem", "e.*")
    bonds = e.select(
        "stem", "id", "source", "target", F.col("to_jimage").alias("img"), F.coalesce("coordination_sphere", F.lit("core")).alias("sphere"), "bond_length", "cart_vec",
        F.col("raw_neighbor_distance").alias("raw_distance"), F.col("bond_length_over_sum_radii").alias("ratio"), F.col("delta_chi_pauling").alias("dchi_p"), F.col("delta_chi_allen").alias("dchi_a"),
        F.col("voronoi_weight_source").alias("vw_s"), F.col("voronoi_weight_target").alias("vw_t"), F.col("ecn_weight_source").alias("ecn_s"), F.col("ecn_weight_target").alias("ecn_t"),
    )
    p = docs.select("stem", F.explode("polyhedral_edges").alias("p")).select("stem", "p.*")
    poly = p.select(
        "stem", "id", F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("to_jimage").alias("img"), "path_type",
        F.coalesce("shared_count_all", "shared_count").alias("n_all"), F.coalesce("shared_count_core", "shared_count").alias("n_core"),
        F.coalesce("mode_all", "mode").alias("mode_all"), F.coalesce("mode_core", "mode").alias("mode_core"), F.col("angles_deg").alias("angles"), "path_lengths",
        F.col("mean_angle_deg").alias("mean_angle"), F.col("std_angle_deg").alias("std_angle"), F.col("mean_path_length").alias("mean_path"), F.col("std_path_length").alias("std_path"), "direct_distance",
    )
    near = docs.select("stem", F.explode("nodes").alias("n")).select("stem", F.col("n.id").alias("id"), F.posexplode("n.nearest_neighbors").alias("rank", "x"))
    near = near.select("stem", "id", "rank", F.col("x.node_id").alias("nbr"), F.col("x.to_jimage").alias("img"), F.col("x.distance").alias("dist"))
    return GraphTables(meta, nodes, bonds, poly, near)


def missing(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of `wanted` (stem, ...) without a valid document: what is still to be built."""
    return wanted.join(valid(documents).select("stem"), "stem", "left_anti")


def resolve_prototypes(prototypes: DataFrame, documents: DataFrame) -> DataFrame:
    """(label, stem) of each prototype (label, wanted): by stem, else by material id, else by a trailing number; then the smallest stem."""
    material = lambda c: F.regexp_extract(c, r"_(m?n?p-\d+)$", 1)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1)
    keys = lambda c: F.array(F.struct(F.lit(0).alias("rank"), c.alias("key")), F.struct(F.lit(1).alias("rank"), material(c).alias("key")), F.struct(F.lit(2).alias("rank"), number(c).alias("key")))
    left = prototypes.select("label", F.explode(keys(F.col("wanted"))).alias("k")).select("label", "k.*")
    right = documents.select("stem", F.explode(keys(F.col("stem"))).alias("k")).select("stem", "k.*")
    found = left.where("key <> ''").join(right, ["rank", "key"])
    return found.groupBy("label").agg(F.min(F.struct("rank", "stem")).alias("m")).select("label", "m.stem")

"""Generated crystal structures of common types, and queries of the graph engine over them.

The driver's tables hold no crystals; each supplier is given one of those made
here by its key.  A crystal is built once, and what is found of it is a row for
each supplier that has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import composition, formula_key, ratio, reduced
from ..operators import build, classify, families, fingerprint, graph, match, metrics, search, similarity
from ..sources import sinks
from .catalog import query, table

_FCC = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]
_shift = lambda points, s: [tuple((a + b) % 1 for a, b in zip(p, s)) for p in points]

#: name: cell as (a, b, c), sites as (element place, fractional), space group
TYPES = {
    "rock_salt": ((5.0, 5.0, 5.0), [(0, p) for p in _FCC] + [(1, p) for p in _shift(_FCC, (0.5, 0.5, 0.5))], ("Fm-3m", 225)),
    "cscl": ((4.1, 4.1, 4.1), [(0, (0, 0, 0)), (1, (0.5, 0.5, 0.5))], ("Pm-3m", 221)),
    "zinc_blende": ((5.4, 5.4, 5.4), [(0, p) for p in _FCC] + [(1, p) for p in _shift(_FCC, (0.25, 0.25, 0.25))], ("F-43m", 216)),
    "fluorite": ((5.5, 5.5, 5.5), [(0, p) for p in _FCC] + [(1, p) for s in ((0.25, 0.25, 0.25), (0.75, 0.75, 0.75)) for p in _shift(_FCC, s)], ("Fm-3m", 225)),
    "rutile": ((4.6, 4.6, 2.96), [(0, (0, 0, 0)), (0, (0.5, 0.5, 0.5)), *[(1, p) for p in ((0.305, 0.305, 0), (0.695, 0.695, 0), (0.195, 0.805, 0.5), (0.805, 0.195, 0.5))]], ("P4_2/mnm", 136)),
    "perovskite": ((3.9, 3.9, 3.9), [(0, (0.5, 0.5, 0.5)), (1, (0, 0, 0)), (2, (0.5, 0, 0)), (2, (0, 0.5, 0)), (2, (0, 0, 0.5))], ("Pm-3m", 221)),
}

#: type, elements with states, scale of the cell
CRYSTALS = [
    ("rock_salt", (("Na", 1), ("Cl", -1)), 1.12), ("rock_salt", (("Mg", 2), ("O", -2)), 0.84), ("rock_salt", (("K", 1), ("Cl", -1)), 1.26), ("cscl", (("Cs", 1), ("Cl", -1)), 1.0), ("cscl", (("Tl", 1), ("Br", -1)), 0.97),
    ("zinc_blende", (("Zn", 2), ("S", -2)), 1.0), ("fluorite", (("Ca", 2), ("F", -1)), 1.0), ("fluorite", (("Th", 4), ("O", -2)), 1.02), ("rutile", (("Ti", 4), ("O", -2)), 1.0), ("rutile", (("Sn", 4), ("O", -2)), 1.03),
    ("perovskite", (("Sr", 2), ("Ti", 4), ("O", -2)), 1.0), ("perovskite", (("Ba", 2), ("Zr", 4), ("O", -2)), 1.07),
]


def _formula(kind: str, elements: tuple) -> str:
    counts = [sum(p == i for p, _ in TYPES[kind][1]) for i in range(len(elements))]
    return "".join(e + (str(n // min(counts)) if n > min(counts) else "") for (e, _), n in zip(elements, counts))


STEMS = [f"{_formula(kind, elements)}_{kind}-{k}" for k, (kind, elements, _) in enumerate(CRYSTALS)]


def structures(spark: SparkSession, chosen=None) -> DataFrame:
    """(stem, formula, lattice, sg_symbol, sg_number, sites, error) of generated crystals."""
    rows = []
    for k, (kind, elements, scale) in enumerate(CRYSTALS if chosen is None else chosen):
        cell, sites, (symbol, number) = TYPES[kind]
        formula = _formula(kind, elements)
        lattice = [[x * scale if i == j else 0.0 for j in range(3)] for i, x in enumerate(cell)]
        placed = [(i, list(map(float, f)), [(elements[p][0], 1.0, float(elements[p][1]), True)]) for i, (p, f) in enumerate(sites)]
        rows.append((f"{formula}_{kind}-{k}", formula, lattice, symbol, number, placed, None))
    schema = "stem string, formula string, lattice array<array<double>>, sg_symbol string, sg_number int, sites array<struct<id:int,frac:array<double>,species:array<struct<symbol:string,occupancy:double,oxi_state:double,explicit:boolean>>>>, error string"
    return spark.createDataFrame(rows, schema)


def of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, stem): the crystal of each supplier, by its key."""
    names = spark.createDataFrame([(k, r) for k, r in enumerate(STEMS)], "k long, stem string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(STEMS)).alias("k")).join(F.broadcast(names), "k").select("s_suppkey", "stem")


class Built:
    """Tables of the generated crystals, of those that suppliers have where a folder of tables is given."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.structures = structures(spark)
        self.suppliers = None
        if sf_dir is not None:
            # Each crystal is built once, however many suppliers have it.
            self.suppliers = of_suppliers(spark, sf_dir)
            self.structures = self.structures.join(self.suppliers.select("stem").distinct(), "stem", "left_semi")
        nodes, bonds = build.build_graphs(self.structures, rescue=False)
        self.nodes, self.bonds = families.stored(nodes, "crystal-nodes"), families.stored(bonds, "crystal-bonds")
        self.half = graph.half_bonds(self.bonds)
        self.poly = families.stored(graph.polyhedral_edges(self.nodes, self.half), "crystal-poly")
        self.meta = self.structures.select("stem", "formula", "sg_symbol", "sg_number")
        self.packed = match.packed_graphs(self.nodes, self.half, self.poly)

    def order(self) -> DataFrame:
        return metrics.flags(self.nodes).join(metrics.angle_distortion(self.poly), "stem", "left").select("stem", "intermetallic", "distortion")


def _over_crystals(name: str, sql: str | None = None):
    """Registers a query over the crystals of all suppliers: what holds for a crystal (or the first of a pair) is a row for each supplier that has it."""

    def for_suppliers(x: Built, found: DataFrame) -> DataFrame:
        first = next((c for c in ("stem", "stem_a", "prototype") if c in found.columns), None)
        return found if first is None else found.join(x.suppliers.withColumnRenamed("stem", first), first)

    def add(run):
        def over(spark, sf_dir):
            x = Built(spark, sf_dir)
            return for_suppliers(x, run(x))

        query(name, sql)(over)
        return run

    return add


#: Known coordination numbers of the elements of each type, in their order, and the shortest bond as SQL over the cell's edges a and c.
COORDINATION = {"rock_salt": (6, 6), "cscl": (8, 8), "zinc_blende": (4, 4), "fluorite": (8, 4), "rutile": (6, 3), "perovskite": (12, 6, 6)}
SHORTEST = {"rock_salt": "a / 2", "cscl": "a * sqrt(3) / 2", "zinc_blende": "a * sqrt(3) / 4", "fluorite": "a * sqrt(3) / 4", "rutile": "sqrt(2 * (0.195 * a) ** 2 + c ** 2 / 4)", "perovskite": "a / 2"}


def _known(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(str(r) for r in rows)}) v({names})"


_SITES = [(k, STEMS[k], e, sum(p == i for p, _ in TYPES[kind][1]), COORDINATION[kind][i]) for k, (kind, elements, _) in enumerate(CRYSTALS) for i, (e, _) in enumerate(elements)]
_CELLS = [(k, STEMS[k], kind, TYPES[kind][0][0] * scale, TYPES[kind][0][2] * scale, sum(s * n for j, _, e, s, n in _SITES if j == k and dict(elements)[e] > 0)) for k, (kind, elements, scale) in enumerate(CRYSTALS)]


@_over_crystals("g_site_coordination", f"SELECT s_suppkey, stem, element, sites, cn FROM supplier JOIN {_known(_SITES, 'k, stem, element, sites, cn')} ON s_suppkey % {len(STEMS)} = k")
def site_coordination(x: Built):
    """Sites and coordination number of every element of the built crystals, against those known of their types."""
    return graph.coordination(x.nodes, x.half).join(x.nodes.select("stem", "id", "element"), ["stem", "id"]).groupBy("stem", "element", "cn").agg(F.count(F.lit(1)).alias("sites"))


@_over_crystals(
    "g_cell_bonds",
    f"SELECT s_suppkey, stem, bonds, round(CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SHORTEST.items())} END, 4) AS shortest FROM supplier JOIN {_known(_CELLS, 'k, stem, kind, a, c, bonds')} ON s_suppkey % {len(STEMS)} = k",
)
def cell_bonds(x: Built):
    """Bonds of a cell and the shortest of them, against those known of the types."""
    return x.bonds.groupBy("stem").agg(F.count(F.lit(1)).alias("bonds"), F.round(F.min("bond_length"), 4).alias("shortest"))


@_over_crystals("g_build_bonds")
def build_bonds(x: Built):
    return x.bonds.select("stem", "source", "target", "img", F.round("bond_length", 6).alias("length"), "vw_s", "vw_t", "ecn_s", "ecn_t", "sphere")


@_over_crystals("g_coordination")
def coordination(x: Built):
    return graph.coordination(x.nodes, x.half)


@_over_crystals("g_polyhedral_edges")
def polyhedra(x: Built):
    return x.poly


@_over_crystals("g_sharing_histogram")
def sharing(x: Built):
    return graph.sharing_histogram(x.nodes, x.poly)


@_over_crystals("g_fingerprints")
def prints(x: Built):
    return fingerprint.fingerprints(x.nodes, x.poly)


@_over_crystals("g_topology_families")
def topology(x: Built):
    scores = families.core_bonds_per_unit(x.nodes, x.bonds).join(x.meta.select("stem", "formula"), "stem").withColumn("distortion", F.lit(None).cast("double"))
    return families.topology_families(fingerprint.topology_hashes(x.nodes, x.half), scores)


@_over_crystals("g_match_pairs")
def pairs(x: Built):
    return match.match_pairs(match.compatible(x.packed), x.packed).select("stem_a", "stem_b", F.round("cost", 6).alias("cost"), "k", "status")


@_over_crystals("g_families")
def leader(x: Built):
    return families.families(x.packed, x.order()).select("stem", "prototype", "family_id", "family_size", "is_prototype", F.round("cost", 6).alias("cost"))


@_over_crystals("g_structure_types")
def types(x: Built):
    return classify.structure_types(classify.features(x.nodes, x.poly, x.meta))


@_over_crystals("g_template_search")
def templates(x: Built):
    bridge = search.Template([search.TemplateNode(role="cation", cn=6), search.TemplateNode(role="anion"), search.TemplateNode(role="cation", cn=6)], [(0, 1, None, False), (1, 2, None, False)])
    return search.matches(x.nodes, search.simple_graph(x.bonds), bridge)


@_over_crystals("g_topology_scores")
def scores(x: Built):
    return similarity.topology_scores(match.compatible(x.packed), fingerprint.descriptors(x.nodes, x.half, x.poly)).withColumn("score", F.round("score", 6))


@_over_crystals("g_species_averages")
def averages(x: Built):
    return metrics.species_averages(x.nodes)


_CELLS_OF = [(k, STEMS[k], kind in ("perovskite",)) for k, (kind, _, _) in enumerate(CRYSTALS)]


@_over_crystals("g_perovskite_family", f"SELECT s_suppkey, stem, family FROM supplier JOIN {_known(_CELLS_OF, 'k, stem, family').replace('True', 'true').replace('False', 'false')} ON s_suppkey % {len(STEMS)} = k")
def perovskite_family(x: Built):
    """Which crystals the scan takes for perovskites: those of that type."""
    return classify.perovskites(x.nodes, x.half).select("stem", "family")


@_over_crystals("g_perovskites")
def perovskites(x: Built):
    return classify.perovskites(x.nodes, x.half)


@_over_crystals("g_mapping_json")
def mappings(x: Built):
    return sinks.mapping_json(match.mapping_rows(match.match_pairs(match.compatible(x.packed), x.packed)))


@_over_crystals("g_formula_keys")
def formulas(x: Built):
    counts = reduced(composition(F.col("formula")))
    return x.meta.select("stem", formula_key(counts).alias("key"), ratio(counts).alias("ratio"))

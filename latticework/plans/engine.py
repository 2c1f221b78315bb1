"""Queries that run the operators of the graph engine over the driver's tables, and the SQL that has the same rows.

Each order is a small periodic graph: its lines are bonds between parts (four
cations, by the part's key) and suppliers (three anions, by the supplier's
key), with an image, a vector and weights from the line's numbers.  Orders are
independent, so the work grows with the table and no graph is large.
"""

from __future__ import annotations

from functools import reduce as fold
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formula
from ..operators import build, classify, families, fingerprint, graph, match, metrics, neighbours, search, shell_walk, symmetry, vacancies
from ..operators.cluster import shared_folder
from .catalog import query, table

#: Elements by node: symbol, role, oxidation state, radius.
ELEMENTS = [("Ca", "cation", 2.0, 1.0), ("Ti", "cation", 4.0, 0.6), ("Mg", "cation", 2.0, 0.72), ("Sr", "cation", 2.0, None), ("O", "anion", -2.0, 1.4), ("O", "anion", -2.0, 1.4), ("S", "anion", -2.0, 1.84)]
_pick = lambda k, kind: F.element_at(F.array(*[F.lit(e[k]).cast(kind) for e in ELEMENTS]), F.col("id") + 1)


class Orders:
    """The graphs of all orders.

    What several queries need (bonds with their weights, nodes, polyhedral
    edges) is a table in the shared folder, written when it is first asked for
    and read by all queries of the session after that; its inputs are taken not
    to change meanwhile.  A table that is gone is written again.

    Lines are dealt by their order once; the tables are bucketed by order in as
    many buckets, one for ROWS lines, so what is counted, ranked or joined inside
    an order is not dealt again, and a task is as large whatever the table's size.
    """

    ROWS = 250_000

    _of: dict[tuple, Orders] = {}

    def __init__(self, spark, sf_dir: str):
        self.spark, self._tables = spark, {}
        # Joins by order and atom need no exchange of rows that are dealt by order.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # Atoms and pairs are many small groups: lists of them are gathered from sorted rows, not in tables of objects that overflow.
        spark.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
        line = table(spark, sf_dir, "lineitem")
        self.buckets = max(spark.sparkContext.defaultParallelism, -(-line.count() // self.ROWS))
        line = line.repartition(self.buckets, "l_orderkey")
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
        x, y, z = F.col("l_quantity") / 10, F.col("l_discount") * 20, F.col("l_tax") * 20 + 0.5
        self.plain = line.select(
            F.col("l_orderkey").alias("stem"), place.cast("int").alias("id"), (F.col("l_partkey") % 4).cast("int").alias("source"), (4 + F.col("l_suppkey") % 3).cast("int").alias("target"),
            F.array(F.col("l_linenumber") % 3 - 1, F.col("l_quantity").cast("int") % 2, F.lit(0)).alias("img"), F.array(x, y, z).alias("cart_vec"), F.sqrt(x * x + y * y + z * z).alias("bond_length"),
            F.col("l_discount").alias("vw_s"), F.col("l_tax").alias("vw_t"), (F.col("l_quantity") / 25).alias("ratio"),
        )

    @classmethod
    def of(cls, spark, sf_dir: str) -> Orders:
        """The graphs of a folder, one object a session."""
        key = spark.sparkContext.applicationId, id(spark), sf_dir
        if key not in cls._of:
            cls._of[key] = cls(spark, sf_dir)
        return cls._of[key]

    def _kept(self, name: str, make) -> DataFrame:
        files = self.spark._jvm.org.apache.hadoop.fs
        if name in self._tables:
            path, found = self._tables[name]
            at = files.Path(path)
            if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                return found
        own = f"orders_{name}_{uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{own}"
        make().write.bucketBy(self.buckets, "stem").format("parquet").option("path", path).saveAsTable(own)
        # Files are a fraction of what they hold in memory, so their size must not make a table a broadcast.
        self._tables[name] = path, self.spark.table(own).hint("merge")
        return self._tables[name][1]

    @property
    def bonds(self) -> DataFrame:
        return self._kept("bonds", lambda: graph.with_spheres(self.plain))

    @property
    def half(self) -> DataFrame:
        return graph.half_bonds(self.bonds)

    @property
    def sites(self) -> DataFrame:
        return self._kept("sites", self._made_sites)

    def _made_sites(self) -> DataFrame:
        ids = self.bonds.select("stem", F.explode(F.array("source", "target")).alias("id")).distinct()
        species = F.array(F.struct(_pick(0, "string").alias("symbol"), F.lit(1.0).alias("occupancy"), _pick(2, "double").alias("oxi_state")))
        return ids.select("stem", "id", _pick(0, "string").alias("element"), _pick(1, "string").alias("ion_role"), _pick(2, "double").alias("oxidation_state"), _pick(3, "double").alias("shannon_r"), species.alias("species"))

    @property
    def nodes(self) -> DataFrame:
        return self._kept("nodes", lambda: self.sites.join(graph.coordination(self.sites, self.half), ["stem", "id"]))

    @property
    def poly(self) -> DataFrame:
        return self._kept("poly", lambda: graph.polyhedral_edges(self.nodes, self.half))


_MEAN = "list_sum(list_transform(l, lambda v: v * exp(1 - pow(v / s, 6)))) / list_sum(list_transform(l, lambda v: exp(1 - pow(v / s, 6))))"
_E = ", ".join(f"({i}, '{s}', '{r}', {o}, {'NULL' if q is None else q})" for i, (s, r, o, q) in enumerate(ELEMENTS))
GRAPHS = f"""
    WITH e AS (SELECT id, element, role, CAST(oxi AS DOUBLE) AS oxi, CAST(r AS DOUBLE) AS r FROM (VALUES {_E}) v(id, element, role, oxi, r)),
    b0 AS (SELECT l_orderkey AS stem, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS id,
      CAST(l_partkey % 4 AS INTEGER) AS source, CAST(4 + l_suppkey % 3 AS INTEGER) AS target, l_linenumber % 3 - 1 AS i1, CAST(l_quantity AS INTEGER) % 2 AS i2,
      l_quantity / 10 AS x, l_discount * 20 AS y, l_tax * 20 + 0.5 AS z, sqrt(x * x + y * y + z * z) AS len, l_discount AS vs, l_tax AS vt, l_quantity / 25 AS ratio FROM lineitem),
    ls AS (SELECT stem, mid, list(len) AS l, min(len) AS m FROM (SELECT stem, source AS mid, len FROM b0 UNION ALL SELECT stem, target, len FROM b0) GROUP BY ALL),
    fx AS (SELECT stem, mid, abs(list_reduce(list_prepend(m, list_transform(range(20), lambda t: CAST(0 AS DOUBLE))),
      lambda s, t: CASE WHEN s < 0 THEN s WHEN abs({_MEAN} - s) < 1e-6 THEN -({_MEAN}) ELSE {_MEAN} END)) AS mean FROM ls),
    b AS (SELECT b0.*, round(exp(1 - pow(len / f.mean, 6)), 6) AS es, round(exp(1 - pow(len / g.mean, 6)), 6) AS et, CASE WHEN greatest(es, et) >= 0.5 THEN 'core' ELSE 'extended' END AS sphere
      FROM b0 JOIN fx f ON f.stem = b0.stem AND f.mid = b0.source JOIN fx g ON g.stem = b0.stem AND g.mid = b0.target),
    h AS (SELECT stem, id AS eid, 0 AS dir, source AS mid, target AS nbr, i1, i2, x, y, z, len, sphere = 'core' AS core, vs AS vw, es AS ecn FROM b
      UNION ALL SELECT stem, id, 1, target, source, -i1, -i2, -x, -y, -z, len, sphere = 'core', vt, et FROM b),
    n AS (SELECT stem, mid AS id, count(*) AS cn, count(*) FILTER (core) AS cn_core, sum(ecn) AS ecn, any_value(element) AS element, any_value(role) AS role, any_value(oxi) AS oxi, any_value(r) AS r FROM h JOIN e ON e.id = h.mid GROUP BY ALL)"""
PATHS = (
    GRAPHS
    + """,
    p0 AS (SELECT x.stem, x.mid, x.nbr AS xn, y.nbr AS yn, y.i1 - x.i1 AS d1, y.i2 - x.i2 AS d2, xn > yn OR (xn = yn AND (d1 > 0 OR (d1 = 0 AND d2 > 0))) AS sw, x.core AND y.core AS core,
      degrees(acos(greatest(-1.0, least(1.0, (x.x * y.x + x.y * y.y + x.z * y.z) / (x.len * y.len))))) AS angle, x.len + y.len AS plen, sqrt((y.x - x.x) ** 2 + (y.y - x.y) ** 2 + (y.z - x.z) ** 2) AS direct,
      CASE WHEN sw THEN y.x ELSE x.x END AS ax, CASE WHEN sw THEN y.y ELSE x.y END AS ay, CASE WHEN sw THEN y.z ELSE x.z END AS az
      FROM h x JOIN h y ON x.stem = y.stem AND x.mid = y.mid AND x.eid < y.eid),
    p AS (SELECT stem, mid, least(xn, yn) AS a, greatest(xn, yn) AS b, CASE WHEN sw THEN -d1 ELSE d1 END AS g1, CASE WHEN sw THEN -d2 ELSE d2 END AS g2, core, angle, plen, direct, ax, ay, az FROM p0),
    q AS (SELECT stem, a, b, g1, g2, count(*) AS n_all, count(*) FILTER (core) AS n_core, avg(angle) AS ma, stddev_pop(angle) AS sa, avg(plen) AS mp, stddev_pop(plen) AS sp, min(direct) AS direct, list(round(angle, 4)) AS angles,
      CASE n_all WHEN 1 THEN 'corner' WHEN 2 THEN 'edge' WHEN 3 THEN 'face' ELSE 'multi_' || n_all END AS mode, CASE n_core WHEN 1 THEN 'corner' WHEN 2 THEN 'edge' WHEN 3 THEN 'face' END AS mode_core FROM p GROUP BY ALL)"""
)
_FOUR = ("corner", "edge", "face", "multi")
_SHARES = ", ".join(f"count(*) FILTER (kind = '{m}') / count(*) AS s{k}" for k, m in enumerate(_FOUR))
PRINTS = (
    PATHS
    + f""",
    ends AS (SELECT stem, unnest(list_distinct([a, b])) AS id, CASE WHEN n_all > 3 THEN 'multi' ELSE mode END AS kind, angles FROM q),
    sh AS (SELECT stem, id, {_SHARES} FROM ends GROUP BY ALL),
    bn AS (SELECT stem, id, least(round_even(v / 10, 0), 17) AS bin FROM (SELECT stem, id, unnest(angles) AS v FROM ends)),
    hs AS (SELECT stem, id, {", ".join(f"count(*) FILTER (bin = {k}) / count(*) AS a{k}" for k in range(18))} FROM bn GROUP BY ALL),
    f AS (SELECT n.stem, n.id, n.element, n.role, n.cn, CASE WHEN n.cn <= 4 THEN 'tet' WHEN n.cn <= 6 THEN 'oct' ELSE 'high' END AS bucket,
      {", ".join(f"coalesce(s{k}, 0) AS s{k}" for k in range(4))}, {", ".join(f"coalesce(a{k}, 0) AS a{k}" for k in range(18))}
      FROM n LEFT JOIN sh USING (stem, id) LEFT JOIN hs USING (stem, id))"""
)


def over(name: str, sql: str):
    """Registers a query over the graphs of all orders."""

    def add(run):
        query(name, sql)(lambda spark, sf_dir: run(Orders.of(spark, sf_dir)))
        return run

    return add


# ---- half bonds, coordination, weights -----------------------------------


@over("q_half_bonds_degree", GRAPHS + " SELECT stem, id, cn, cn_core, cn - cn_core AS cn_extended FROM n")
def degrees(x: Orders):
    return graph.coordination(x.sites, x.half).select("stem", "id", "cn", "cn_core", "cn_extended")


@over("q_adjacency", GRAPHS + " SELECT stem, mid, nbr, count(*) AS n FROM h WHERE core GROUP BY ALL")
def adjacency(x: Orders):
    return graph.adjacency(x.half, core_only=True)


@over("q_econ", GRAPHS + " SELECT stem, id, es AS ecn_s, et AS ecn_t, sphere FROM b")
def econ(x: Orders):
    return x.bonds.select("stem", "id", "ecn_s", "ecn_t", "sphere")


@over("q_extended_pool", GRAPHS + " SELECT stem, mid, eid, row_number() OVER (PARTITION BY stem, mid ORDER BY ecn DESC, nbr, eid, dir) - 1 AS rank FROM h WHERE NOT core")
def pool(x: Orders):
    return graph.extended_pool(x.half).select("stem", "mid", "eid", "rank")


_NEAREST = GRAPHS + ", c AS (SELECT *, row_number() OVER (PARTITION BY stem, mid ORDER BY round(len, 6), nbr, i1, i2) - 1 AS rank FROM h)"
_near = lambda x: graph.nearest(x.half.select("stem", F.col("mid").alias("id"), "nbr", "img", F.col("len").alias("dist")), 3)


@over("q_topk_cap", _NEAREST + " SELECT stem, mid AS id, rank, nbr, round(len, 6) AS dist FROM c WHERE rank < 3")
def nearest(x: Orders):
    return _near(x).drop("img")


@over("q_neighbour_sets", _NEAREST + " SELECT stem, mid AS id, nbr, min(round(len, 6)) AS dist, count(*) AS images FROM c WHERE rank < 3 GROUP BY ALL")
def neighbour_sets(x: Orders):
    return graph.neighbour_sets(_near(x)).withColumn("images", F.size("images"))


# ---- polyhedral edges ------------------------------------------------------


@over("q_poly_share", PATHS + " SELECT stem, a, b, g1, g2, CASE WHEN a < 4 THEN 'cation-anion-cation' ELSE 'anion-cation-anion' END AS path_type, n_all, n_core, mode AS mode_all, mode_core FROM q")
def poly_share(x: Orders):
    return x.poly.select("stem", "a", "b", F.col("img")[0].alias("g1"), F.col("img")[1].alias("g2"), "path_type", "n_all", "n_core", "mode_all", "mode_core")


@over("q_poly_geometry", PATHS + " SELECT stem, a, b, g1, g2, round(ma, 4) AS mean_angle, round(sa, 4) AS std_angle, round(mp, 6) AS mean_path, round(sp, 6) AS std_path, round(direct, 6) AS direct FROM q")
def poly_geometry(x: Orders):
    return x.poly.select("stem", "a", "b", F.col("img")[0].alias("g1"), F.col("img")[1].alias("g2"), "mean_angle", "std_angle", "mean_path", "std_path", F.col("direct_distance").alias("direct"))


_ENDS = PATHS + ", t AS (SELECT stem, unnest([a, b]) AS id, {0} AS m FROM q WHERE {0} IS NOT NULL), z AS (SELECT n.stem, n.id, {1}, count(m) FILTER (m NOT IN ('corner', 'edge', 'face')) AS other FROM n LEFT JOIN t USING (stem, id) GROUP BY ALL)"
_THREE = ", ".join(f"count(m) FILTER (m = '{m}') AS {m}" for m in _FOUR[:3])


@over("q_share_hist", _ENDS.format("mode", _THREE) + " SELECT stem, id, corner, edge, face, other FROM z")
def share_hist(x: Orders):
    return graph.sharing_histogram(x.nodes, x.poly)


@over(
    "q_share_fractions",
    _ENDS.format("mode_core", _THREE) + " SELECT stem, id, " + ", ".join(f"round({c} / greatest(corner + edge + face + other, 1), 7) AS {c}" for c in ("corner", "edge", "face", "other")) + " FROM z",
)
def share_fractions(x: Orders):
    return graph.sharing_fractions(x.nodes, x.poly, "mode_core").select("stem", "id", *[F.round(c, 7).alias(c) for c in ("corner", "edge", "face", "other")])


_FLAT = ", ".join(f"l.{c} - a{c} * (l.x * ax + l.y * ay + l.z * az) / (ax * ax + ay * ay + az * az) AS {c}" for c in "xyz")


@over(
    "q_torsions",
    PATHS
    + f""", o AS (SELECT stem, a, b, g1, g2, any_value(mid) AS mid, any_value(ax) AS ax, any_value(ay) AS ay, any_value(az) AS az FROM p GROUP BY ALL HAVING count(*) = 1 AND a < 4),
    u AS (SELECT o.stem, a, b, g1, g2, {_FLAT} FROM o JOIN h l ON l.stem = o.stem AND l.mid = o.a AND l.nbr <> o.mid AND l.core),
    v AS (SELECT o.stem, a, b, g1, g2, {_FLAT} FROM o JOIN h l ON l.stem = o.stem AND l.mid = o.b AND l.nbr <> o.mid AND l.core)
    SELECT stem, a, b, g1, g2, round(min(degrees(acos(greatest(-1.0, least(1.0, (u.x * v.x + u.y * v.y + u.z * v.z) / sqrt(u.x ** 2 + u.y ** 2 + u.z ** 2) / sqrt(v.x ** 2 + v.y ** 2 + v.z ** 2)))))), 4) AS torsion
    FROM u JOIN v USING (stem, a, b, g1, g2) WHERE u.x ** 2 + u.y ** 2 + u.z ** 2 > 1e-12 AND v.x ** 2 + v.y ** 2 + v.z ** 2 > 1e-12 GROUP BY ALL""",
)
def torsions(x: Orders):
    return graph.corner_torsions(x.nodes, x.half).select("stem", "a", "b", F.col("img")[0].alias("g1"), F.col("img")[1].alias("g2"), "torsion")


# ---- fingerprints, hashes --------------------------------------------------

_PRINT = [f"s{k}" for k in range(4)] + [f"a{k}" for k in range(18)]


@over("q_angle_hist", PRINTS + " SELECT stem, id, element, role, cn, bucket, " + ", ".join(f"round({c}, 7) AS {c}" for c in _PRINT) + " FROM f")
def prints(x: Orders):
    f = fingerprint.fingerprints(x.nodes, x.poly)
    return f.select("stem", "id", "element", F.col("ion_role").alias("role"), "cn", "bucket", *[F.round(F.col("sharing")[k], 7).alias(f"s{k}") for k in range(4)], *[F.round(F.col("angles")[k], 7).alias(f"a{k}") for k in range(18)])


_sum = lambda form: " + ".join(form)
_LOW, _HIGH = _sum(f"least(x.s{k}, y.s{k})" for k in range(4)), _sum(f"greatest(x.s{k}, y.s{k})" for k in range(4))
_GAP = _sum(f"abs(x.a{k} - y.a{k})" for k in range(18))
_DISTANCE = f"0.25 * least(abs(x.cn - y.cn) / greatest(x.cn, y.cn, 1), 1.0) + 0.45 * (CASE WHEN {_HIGH} > 0 THEN 1 - ({_LOW}) / ({_HIGH}) ELSE 0 END) + 0.30 * ({_GAP}) / 2"


@over("q_fingerprint_costs", PRINTS + f" SELECT x.stem AS stem_a, y.stem AS stem_b, x.id AS id_a, y.id AS id_b, round({_DISTANCE}, 6) AS cost FROM f x JOIN f y ON y.stem = x.stem + 1 AND x.bucket = y.bucket WHERE x.stem % 4 = 0")
def costs(x: Orders):
    pairs = x.nodes.where("stem % 4 = 0").select(F.col("stem").alias("stem_a"), (F.col("stem") + 1).alias("stem_b")).distinct()
    return fingerprint.fingerprint_costs(pairs, fingerprint.fingerprints(x.nodes, x.poly)).withColumn("cost", F.round("cost", 6))


@over(
    "q_hist_intersection",
    PRINTS + f" SELECT x.stem, x.id AS id_a, y.id AS id_b, round(CASE WHEN x.a0 IS NULL THEN 0 WHEN {_sum(f'x.a{k}' for k in range(18))} = 0 AND {_sum(f'y.a{k}' for k in range(18))} = 0 THEN 1 WHEN {_sum(f'x.a{k}' for k in range(18))} = 0 OR {_sum(f'y.a{k}' for k in range(18))} = 0 THEN 0 ELSE 1 - ({_GAP}) / 2 END, 6) AS overlap FROM f x JOIN f y ON x.stem = y.stem AND x.id < y.id",
)
def overlaps(x: Orders):
    f = fingerprint.fingerprints(x.nodes, x.poly)
    j = f.select("stem", F.col("id").alias("id_a"), F.col("angles").alias("x")).join(f.select("stem", F.col("id").alias("id_b"), F.col("angles").alias("y")).hint("merge"), "stem").where("id_a < id_b")
    return j.select("stem", "id_a", "id_b", F.round(fingerprint.histogram_intersection(F.col("x"), F.col("y")), 6).alias("overlap"))


_STEP = "SELECT c.stem, c.id, substr(md5(c.l || '|' || coalesce(string_agg(m.l, ',' ORDER BY m.l), '')), 1, 12) AS l FROM {0} c LEFT JOIN k ON k.stem = c.stem AND k.mid = c.id LEFT JOIN {0} m ON m.stem = k.stem AND m.id = k.nbr GROUP BY c.stem, c.id, c.l"
WL = (
    GRAPHS
    + f""", k AS (SELECT stem, mid, nbr FROM h WHERE core), w0 AS (SELECT stem, id, role || '_' || cn_core AS l FROM n), w1 AS ({_STEP.format("w0")}), w2 AS ({_STEP.format("w1")}),
    wc AS (SELECT stem, l, count(*) AS n FROM w2 GROUP BY ALL), wg AS (SELECT stem, list_reduce(list(n), lambda x, y: gcd(x, y)) AS g FROM wc GROUP BY stem),
    wt AS (SELECT stem, string_agg(l || ':' || CAST(n // g AS BIGINT), ';' ORDER BY l) AS topology FROM wc JOIN wg USING (stem) GROUP BY stem)"""
)


@over("q_wl_hash", WL + " SELECT stem, topology FROM wt")
def wl_hash(x: Orders):
    return fingerprint.topology_hashes(x.nodes, x.half, 2)


_UNITS = ", un AS (SELECT stem, list_reduce(list(c), lambda x, y: gcd(x, y)) AS units FROM (SELECT stem, element, count(*) AS c FROM n GROUP BY ALL) GROUP BY stem), cb AS (SELECT un.stem, units, count(b.id) FILTER (sphere = 'core') / units AS per, count(b.id) FILTER (sphere <> 'core') AS extended FROM un LEFT JOIN b USING (stem) GROUP BY un.stem, units)"


@over("q_core_bonds", GRAPHS + _UNITS + " SELECT stem, units, round(per, 6) AS core_bonds_per_fu, extended FROM cb")
def core_bonds(x: Orders):
    return families.core_bonds_per_unit(x.nodes, x.bonds).withColumn("core_bonds_per_fu", F.round("core_bonds_per_fu", 6))


@over(
    "q_topology_families",
    WL
    + _UNITS
    + """, fm AS (SELECT topology, count(*) AS size, min(stem) AS prototype FROM wt GROUP BY topology)
    SELECT row_number() OVER (ORDER BY size DESC, topology) AS family_id, topology, size, prototype, round(per, 6) AS core_bonds_per_fu FROM fm JOIN cb ON cb.stem = prototype""",
)
def topology_families(x: Orders):
    scores = families.core_bonds_per_unit(x.nodes, x.bonds).withColumn("formula", F.lit("")).withColumn("distortion", F.lit(None).cast("double"))
    return families.topology_families(fingerprint.topology_hashes(x.nodes, x.half, 2), scores).withColumn("core_bonds_per_fu", F.round("core_bonds_per_fu", 6))


@over(
    "q_neighbour_prints",
    GRAPHS
    + """, g AS (SELECT h.stem, mid, m.element, count(*) AS c FROM h JOIN n m ON m.stem = h.stem AND m.id = h.nbr WHERE core GROUP BY ALL)
    SELECT n.stem, n.id, coalesce(sum(c), 0) || '|' || coalesce(string_agg(g.element || c, ',' ORDER BY g.element || c), '') AS print FROM n LEFT JOIN g ON g.stem = n.stem AND g.mid = n.id GROUP BY n.stem, n.id""",
)
def neighbour_prints(x: Orders):
    return fingerprint.neighbour_prints(x.nodes, x.half)


# ---- metrics ---------------------------------------------------------------


@over(
    "q_distortions",
    PATHS
    + """, v AS (SELECT stem, unnest(angles) AS v FROM q), d AS (SELECT stem, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(least(abs(v - 60), abs(v - 90), abs(v - 120), abs(v - 180))) END, 5) AS angles FROM v GROUP BY stem)
    SELECT stem, angles, round(avg(abs(ratio - 1)), 6) AS bonds FROM b LEFT JOIN d USING (stem) GROUP BY ALL""",
)
def distortions(x: Orders):
    angles = metrics.angle_distortion(x.poly).select("stem", F.round("distortion", 5).alias("angles"))
    return metrics.bond_distortion(x.bonds).select("stem", F.round("distortion", 6).alias("bonds")).join(angles, "stem", "left")


@over("q_flags", GRAPHS + " SELECT stem, false AS intermetallic, bool_or(element = 'O') AS oxide FROM n GROUP BY stem")
def flags(x: Orders):
    return metrics.flags(x.nodes)


@over("q_species_averages", GRAPHS + " SELECT stem, element, avg(oxi) AS oxidation, avg(r) AS radius, round(avg(cn), 6) AS cn FROM n GROUP BY ALL")
def species_averages(x: Orders):
    m = metrics.species_averages(x.nodes)
    return m.select("stem", "radius", "oxidation", F.explode("cn").alias("element", "cn")).select("stem", "element", F.try_element_at("oxidation", F.col("element")).alias("oxidation"), F.try_element_at("radius", F.col("element")).alias("radius"), F.round("cn", 6).alias("cn"))


@over("q_buckets", GRAPHS + " SELECT stem, CASE WHEN cn <= 4 THEN 'tet' WHEN cn <= 6 THEN 'oct' ELSE 'high' END AS bucket, role, string_agg(id, ',' ORDER BY id) AS ids FROM n GROUP BY ALL")
def buckets(x: Orders):
    return metrics.buckets(x.nodes).withColumn("ids", F.array_join("ids", ","))


@over(
    "q_shells",
    GRAPHS
    + """, a AS (SELECT x.stem, x.mid AS id, degrees(acos(greatest(-1.0, least(1.0, (x.x * y.x + x.y * y.y + x.z * y.z) / (x.len * y.len))))) AS v FROM h x JOIN h y ON x.stem = y.stem AND x.mid = y.mid AND x.eid < y.eid)
    SELECT n.stem, n.id, cn, round(coalesce(avg(v), 0), 4) AS mean_angle, count(v) FILTER (v > 160) AS straight FROM n LEFT JOIN a USING (stem, id) GROUP BY ALL""",
)
def shells(x: Orders):
    return metrics.shell_angles(x.half).select("stem", "id", "cn", "mean_angle", "straight")


_SHELL = f"""CASE {" ".join("WHEN cn = " + str(n) + (f" AND mean {'>=' if (n, least) == (3, 95) else '>'} {least}" if least else "") + f" THEN '{name}'" for n, names in metrics.SHELL_NAMES.items() for least, name in names)}
      WHEN cn = 6 AND wide >= 2 THEN 'octahedral' WHEN cn = 6 THEN 'trig.pris.' ELSE 'CN' || cn END"""


@over(
    "q_geometry",
    GRAPHS
    + f""", a AS (SELECT x.stem, x.mid AS id, degrees(acos(greatest(-1.0, least(1.0, (x.x * y.x + x.y * y.y + x.z * y.z) / (x.len * y.len))))) AS v FROM h x JOIN h y ON x.stem = y.stem AND x.mid = y.mid AND x.eid < y.eid),
    c AS (SELECT n.stem, n.id, cn, round(coalesce(avg(v), 0), 4) AS mean, count(v) FILTER (v >= 135) AS wide FROM n LEFT JOIN a USING (stem, id) GROUP BY ALL)
    SELECT stem, id, cn, wide, {_SHELL} AS label FROM c""",
)
def shell_labels(x: Orders):
    return metrics.shell_angles(x.half).select("stem", "id", "cn", "wide", "label")


@over(
    "q_collapsed",
    GRAPHS
    + """, r AS (SELECT stem, id, min(id) OVER (PARTITION BY stem, element, cn) AS rep FROM n)
    SELECT b.stem, least(s.rep, t.rep) AS a, greatest(s.rep, t.rep) AS b, count(*) AS images, CASE WHEN count(DISTINCT sphere) > 1 THEN 'mixed' ELSE min(sphere) END AS sphere, round(min(len), 6) AS length
    FROM b JOIN r s ON s.stem = b.stem AND s.id = b.source JOIN r t ON t.stem = b.stem AND t.id = b.target GROUP BY ALL""",
)
def collapsed(x: Orders):
    return metrics.collapsed(x.nodes, x.bonds)[1].withColumn("length", F.round("length", 6))


@over("q_bond_filter", GRAPHS + " SELECT stem, count(*) AS n FROM b WHERE sphere = 'extended' GROUP BY stem")
def bond_filter(x: Orders):
    return metrics.bonds_of(x.bonds, "extended").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@over("q_poly_filter", PATHS + " SELECT stem, count(*) AS n FROM q WHERE mode IN ('edge', 'face') GROUP BY stem")
def poly_filter(x: Orders):
    return metrics.poly_of(x.poly, ("edge", "face")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@over("q_topology_set", GRAPHS + " SELECT stem, string_agg(DISTINCT role || ':' || cn, ',' ORDER BY role || ':' || cn) AS fp FROM n GROUP BY stem")
def topology_set(x: Orders):
    return metrics.topology_set(x.nodes).withColumn("fp", F.array_join("fp", ","))


_SITES = GRAPHS + ", s AS (SELECT stem, element, any_value(role) AS role, count(*) AS amount, avg(oxi) AS oxi, avg(r) AS radius, avg(cn) AS cn FROM n GROUP BY stem, element)"
_RANKED = _SITES + ", k AS (SELECT *, CASE role WHEN 'cation' THEN row_number() OVER (PARTITION BY stem, role ORDER BY radius DESC NULLS LAST, cn DESC, element) ELSE row_number() OVER (PARTITION BY stem, role ORDER BY oxi NULLS LAST, cn DESC, radius DESC NULLS LAST, element) END AS rank FROM s)"


@over("q_abx_sites", _RANKED + ", z AS (SELECT stem, max(element) FILTER (role = 'cation' AND rank = 1) AS a, max(element) FILTER (role = 'cation' AND rank = 2) AS b, max(element) FILTER (role = 'anion' AND rank = 1) AS x FROM k GROUP BY stem) SELECT stem, CASE WHEN a IS NOT NULL AND b IS NULL THEN x ELSE a END AS a, coalesce(b, a) AS b, x FROM z")
def abx(x: Orders):
    return metrics.abx_sites(x.nodes).select("stem", *[F.col(f"{c}.element").alias(c) for c in "abx"])


@over(
    "q_abx_214",
    _RANKED
    + """, g AS (SELECT stem, list_reduce(list(amount), lambda x, y: gcd(x, y)) AS g, list_sort(list(amount)) AS am FROM s GROUP BY stem), u AS (SELECT k.*, am, g.g, amount // g.g AS unit FROM k JOIN g USING (stem)),
    z AS (SELECT stem, max(element) FILTER (role = 'cation' AND rank = 1) AS a, max(element) FILTER (role = 'cation' AND rank = 2) AS b, max(element) FILTER (role = 'anion' AND rank = 1) AS x,
      string_agg(unit, ',' ORDER BY unit) = '1,2,4' AS is214, max(element) FILTER (role = 'cation' AND unit = 2) AS a2, max(element) FILTER (role = 'cation' AND unit = 1) AS b2, max(element) FILTER (role = 'anion' AND unit = 4) AS x2 FROM u GROUP BY stem)
    SELECT stem, CASE WHEN is214 THEN coalesce(a2, a) ELSE a END AS a, CASE WHEN is214 THEN coalesce(b2, b) ELSE b END AS b, CASE WHEN is214 THEN coalesce(x2, x) ELSE x END AS x FROM z""",
)
def abx_214(x: Orders):
    return metrics.abx_214(x.nodes).select("stem", *[F.col(f"{c}.element").alias(c) for c in "abx"])


@over("q_only_anion", GRAPHS + " SELECT stem FROM n GROUP BY stem HAVING count(*) FILTER (element = 'O') > 0 AND count(*) FILTER (element = 'S') = 0")
def only_anion(x: Orders):
    return metrics.only_anion(x.nodes)


# ---- search ----------------------------------------------------------------


_SIMPLE = GRAPHS + ", g AS (SELECT stem, source AS a, target AS b, count(*) AS n, arg_max(ratio, (vs, -id)) AS ratio, arg_max(sphere = 'core', (vs, -id)) AS core FROM b GROUP BY ALL)"


@over("q_simple_graph", _SIMPLE + " SELECT stem, a, b, n, ratio, core FROM g")
def simple(x: Orders):
    return search.simple_graph(x.bonds)


@over(
    "q_khop",
    _SIMPLE
    + """, w AS (SELECT stem, a, b FROM g UNION ALL SELECT stem, b, a FROM g), s AS (SELECT stem, min(id) AS centre FROM n GROUP BY stem),
    r AS (SELECT stem, centre, centre AS id, 0 AS hops FROM s UNION ALL SELECT s.stem, centre, w.b, 1 FROM s JOIN w ON w.stem = s.stem AND w.a = centre
      UNION ALL SELECT s.stem, centre, v.b, 2 FROM s JOIN w ON w.stem = s.stem AND w.a = centre JOIN w v ON v.stem = s.stem AND v.a = w.b)
    SELECT stem, centre, id, min(hops) AS hops FROM r GROUP BY ALL""",
)
def khop(x: Orders):
    return search.neighbourhood(search.simple_graph(x.bonds), x.nodes.groupBy("stem").agg(F.min("id").alias("centre")), 2)


_BRIDGE = search.Template([search.TemplateNode("Ca", "cation", 2), search.TemplateNode("O", "anion", 2), search.TemplateNode(None, "cation", 1)], [(0, 1, None, False), (1, 2, None, False)])
_gauss = lambda c, n: f"exp(-0.5 * pow(({c} - {n}) / 2.0, 2))"
_BRIDGE_SCORE = f"round((0.4 + 0.3 * {_gauss('x.cn', 2)} + 0.4 + 0.3 * {_gauss('y.cn', 2)} + 0.4 + 0.3 * {_gauss('z.cn', 1)}) / 3 + 0.3, 4)"
_BRIDGES = (
    _SIMPLE
    + f""", found AS (SELECT x.stem, x.id AS n0, y.id AS n1, z.id AS n2, {_BRIDGE_SCORE} AS score FROM n x JOIN g e1 ON e1.stem = x.stem AND e1.a = x.id JOIN n y ON y.stem = x.stem AND y.id = e1.b JOIN g e2 ON e2.stem = x.stem AND e2.b = y.id JOIN n z ON z.stem = x.stem AND z.id = e2.a
    WHERE x.element = 'Ca' AND abs(x.cn - 2) <= 2 AND y.element = 'O' AND abs(y.cn - 2) <= 2 AND abs(z.cn - 1) <= 2 AND x.id <> z.id)"""
)


@over("q_template_search", _BRIDGES + " SELECT stem, n0, n1, n2, score FROM found")
def template(x: Orders):
    return search.matches(x.nodes, search.simple_graph(x.bonds), _BRIDGE)


# ---- mappings --------------------------------------------------------------


def _mappings(x: Orders) -> DataFrame:
    """Every graph of an even stem laid over the next by equal ids."""
    own = x.nodes.where("stem % 2 = 0").select(F.col("stem").alias("stem_a"), (F.col("stem") + 1).alias("stem_b"), F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    real = own.join(x.nodes.select(F.col("stem").alias("stem_b"), F.col("id").alias("b_id")), ["stem_b", "b_id"])
    return real.select("stem_a", "stem_b", "a_id", F.lit(0).alias("slot"), "b_id", F.lit("real").alias("slot_kind"))


_MAPPED = ", m AS (SELECT x.stem AS stem_a, y.stem AS stem_b, x.id AS a_id, y.id AS b_id FROM n x JOIN n y ON y.stem = x.stem + 1 AND y.id = x.id WHERE x.stem % 2 = 0)"


#: Sites of an order on a grid of a cubic cell: quarters along x and halves along y; the largest parity of a place's lines is its element.
_GRID = "g AS (SELECT l_orderkey AS stem, CAST(l_partkey % 4 AS INTEGER) AS x, CAST(2 * (l_suppkey % 2) AS INTEGER) AS y, CAST(max(l_linenumber % 2) AS INTEGER) AS e FROM lineitem GROUP BY ALL)"


@query(
    "q_symmetry",
    f"""WITH {_GRID}, s AS (SELECT stem, x * 4 + y AS id, x, y, 0 AS z, e FROM g),
    p AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) v(a, b, c)), q AS (SELECT * FROM (VALUES (-1), (1)) v(q)),
    w AS (SELECT a, b, c, i.q AS i, j.q AS j, k.q AS k FROM p, q i, q j, q k),
    t AS (SELECT stem, e, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY id) AS r FROM s) WHERE r = 1),
    m AS (SELECT s.stem, w.*, s.id, s.e, i * [x, y, z][a + 1] AS u, j * [x, y, z][b + 1] AS v, k * [x, y, z][c + 1] AS o FROM s, w),
    d AS (SELECT t.stem, w.*, f.x - i * [t.x, t.y, t.z][a + 1] AS dx, f.y - j * [t.x, t.y, t.z][b + 1] AS dy, f.z - k * [t.x, t.y, t.z][c + 1] AS dz FROM t JOIN s f ON f.stem = t.stem AND f.e = t.e, w),
    h AS (SELECT d.stem, d.a, d.b, d.c, d.i, d.j, d.k, dx, dy, dz, m.id, s.id AS too FROM d JOIN m USING (stem, a, b, c, i, j, k)
      JOIN s ON s.stem = d.stem AND s.e = m.e AND (s.x - u - dx) % 4 = 0 AND (s.y - v - dy) % 4 = 0 AND (s.z - o - dz) % 4 = 0),
    n AS (SELECT stem, count(*) AS n FROM s GROUP BY stem),
    ok AS (SELECT h.stem, a, b, c, i, j, k, dx, dy, dz FROM h JOIN n USING (stem) GROUP BY ALL HAVING count(*) = any_value(n)),
    ops AS (SELECT stem, count(*) AS operations FROM ok GROUP BY stem)
    SELECT h.stem, h.id, CAST(min(too) AS INTEGER) AS orbit, any_value(operations) AS operations FROM h JOIN ok USING (stem, a, b, c, i, j, k, dx, dy, dz) JOIN ops USING (stem) GROUP BY h.stem, h.id""",
)
def cell_symmetry(spark, sf_dir):
    """Operations (with translations) and orbits of the sites of every order, which stand on a grid of a cubic cell."""
    found = symmetry.symmetries(_cells(spark, sf_dir))
    total = (F.col("operations") * F.col("translations")).cast("long").alias("operations")
    return found.select("stem", total, F.explode("site_orbits").alias("o")).select("stem", "o.id", "o.orbit", "operations")


def _cells(spark, sf_dir) -> DataFrame:
    """Structures (stem, lattice, sites) of all orders on the grid."""
    place = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stem"), (F.col("l_partkey") % 4).cast("int").alias("x"), (2 * (F.col("l_suppkey") % 2)).cast("int").alias("y"), (F.col("l_linenumber") % 2).alias("e"))
    place = place.groupBy("stem", "x", "y").agg(F.max("e").alias("e"))
    species = F.array(F.struct(F.when(F.col("e") == 1, "Na").otherwise("Cl").alias("symbol"), F.lit(1.0).alias("occupancy")))
    site = F.struct((F.col("x") * 4 + F.col("y")).alias("id"), F.array(F.col("x") / 4, F.col("y") / 4, F.lit(0.0)).alias("frac"), species.alias("species"))
    cells = place.groupBy("stem").agg(F.array_sort(F.collect_list(site)).alias("sites"))
    return cells.withColumn("lattice", F.array(*[F.array(*[F.lit(4.0 if i == j else 0.0) for j in range(3)]) for i in range(3)]))


@query(
    "q_range_neighbours",
    f"""WITH {_GRID}, s AS (SELECT stem, x * 4 + y AS id, x, y FROM g), v AS (SELECT * FROM (VALUES (-1), (0), (1)) v(i))
    SELECT a.stem, a.id, b.id AS nbr, i.i AS i0, j.i AS i1, k.i AS i2, round(sqrt((b.x + 4 * i.i - a.x) ** 2 + (b.y + 4 * j.i - a.y) ** 2 + (4 * k.i) ** 2), 6) AS dist
    FROM s a JOIN s b USING (stem), v i, v j, v k WHERE (b.x + 4 * i.i - a.x) ** 2 + (b.y + 4 * j.i - a.y) ** 2 + (4 * k.i) ** 2 BETWEEN 1 AND 16""",
)
def range_neighbours(spark, sf_dir):
    """Neighbours within 4 of all sites of the cells of orders, images included."""
    n = neighbours.within(_cells(spark, sf_dir), 4.0)
    return n.select("stem", "id", "nbr", *[F.col("img")[i].alias(f"i{i}") for i in range(3)], F.round("dist", 6).alias("dist"))


@over("q_inverse_map", GRAPHS + _MAPPED + " SELECT stem_b AS stem_a, stem_a AS stem_b, b_id AS a_id, 0 AS slot, a_id AS b_id FROM m")
def inverse_map(x: Orders):
    return match.inverse(_mappings(x)).drop("slot_kind")


@over("q_compose_map", GRAPHS + _MAPPED + ", t AS (SELECT stem_a, a_id FROM m) SELECT stem_a, stem_a AS stem_b, a_id, a_id AS b_id, true AS even FROM t")
def round_trip(x: Orders):
    """A mapping and its inverse make the identity of what is mapped."""
    there = _mappings(x)
    return match.compose(there, match.inverse(there)).select("stem_a", "stem_b", "a_id", "b_id", "even")


@over(
    "q_invalid_map",
    GRAPHS + _MAPPED + ", z AS (SELECT stem_a, stem_b, a_id, b_id + 1 AS b_id FROM m) SELECT z.stem_a, z.stem_b, z.a_id, z.b_id FROM z LEFT JOIN n ON n.stem = z.stem_b AND n.id = z.b_id WHERE n.id IS NULL",
)
def invalid_map(x: Orders):
    return match.invalid(_mappings(x).withColumn("b_id", F.col("b_id") + 1), x.nodes).select("stem_a", "stem_b", "a_id", "b_id")


_CARRIED = PATHS + _MAPPED + ", c AS (SELECT m.stem_a, m.stem_b, least(m.b_id, k.b_id) AS a, greatest(m.b_id, k.b_id) AS b, mode, ma FROM q JOIN m ON m.stem_a = q.stem AND m.a_id = q.a JOIN m k ON k.stem_a = q.stem AND k.a_id = q.b)"


@over("q_translate_edges", _CARRIED + " SELECT stem_a, stem_b, a, b, mode, round(ma, 4) AS angle FROM c")
def translate(x: Orders):
    return match.translated(x.poly, _mappings(x))


@over(
    "q_poly_f1",
    _CARRIED
    + """, d AS (SELECT DISTINCT stem_a, stem_b, a, b, mode FROM c), o AS (SELECT DISTINCT m.stem_a, m.stem_b, q.a, q.b, q.mode FROM q JOIN m ON m.stem_b = q.stem), j AS (SELECT DISTINCT stem_a, stem_b FROM m),
    hit AS (SELECT stem_a, count(*) AS n FROM d JOIN o USING (stem_a, stem_b, a, b, mode) GROUP BY 1), made AS (SELECT stem_a, count(*) AS n FROM d GROUP BY 1), there AS (SELECT stem_a, count(*) AS n FROM o GROUP BY 1),
    y AS (SELECT stem_a, stem_b, coalesce(hit.n, 0) AS h, coalesce(made.n, 0) AS md, coalesce(there.n, 0) AS th FROM j LEFT JOIN hit USING (stem_a) LEFT JOIN made USING (stem_a) LEFT JOIN there USING (stem_a)),
    s AS (SELECT *, CASE WHEN md > 0 THEN h / md WHEN md + th = 0 THEN 1 ELSE 0 END AS recall, CASE WHEN th > 0 THEN h / th WHEN md + th = 0 THEN 1 ELSE 0 END AS precision FROM y)
    SELECT stem_a, stem_b, round(recall, 7) AS recall, round(precision, 7) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 7) AS f1 FROM s""",
)
def poly_f1(x: Orders):
    return match.polyhedral_f1(x.poly, _mappings(x)).select("stem_a", "stem_b", *[F.round(c, 7).alias(c) for c in ("recall", "precision", "f1")])


_STRONG = "k AS (SELECT h.stem, h.mid, h.nbr, count(*) AS n FROM h JOIN b ON b.stem = h.stem AND b.id = h.eid WHERE greatest(es, et) >= 0.005 GROUP BY ALL)"
_WALK = (
    GRAPHS
    + _MAPPED
    + f""", {_STRONG},
    cand AS (SELECT x.stem, x.id, y.id AS nbr, i AS image, (x.id * 3 + y.id * 5) % 7 + x.id * y.id / 10.0 + 4 * i AS dist FROM n x JOIN n y USING (stem), (VALUES (0), (1), (2)) v(i)),
    nr AS (SELECT *, row_number() OVER (PARTITION BY stem, id ORDER BY dist, nbr, image) AS rank FROM cand QUALIFY rank <= 8),
    o AS (SELECT nr.stem, nr.id, nr.nbr, row_number() OVER (PARTITION BY nr.stem, nr.id ORDER BY rank) AS step
      FROM (SELECT *, row_number() OVER (PARTITION BY stem, id, nbr ORDER BY rank) AS place FROM nr) nr LEFT JOIN k ON k.stem = nr.stem AND k.mid = nr.id AND k.nbr = nr.nbr WHERE place > coalesce(n, 0)),
    pa AS (SELECT m.stem_a, m.stem_b, m.a_id, m.b_id, e.element AS el, sum(k.n) AS c FROM m JOIN k ON k.stem = m.stem_a AND k.mid = m.a_id LEFT JOIN m t ON t.stem_a = m.stem_a AND t.a_id = k.nbr LEFT JOIN n e ON e.stem = t.stem_b AND e.id = t.b_id GROUP BY ALL),
    pb AS (SELECT m.stem_a, m.stem_b, m.a_id, m.b_id, CASE WHEN t.b_id IS NOT NULL THEN e.element END AS el, sum(k.n) AS c FROM m JOIN k ON k.stem = m.stem_b AND k.mid = m.b_id JOIN n e ON e.stem = k.stem AND e.id = k.nbr LEFT JOIN m t ON t.stem_a = m.stem_a AND t.b_id = k.nbr GROUP BY ALL),
    d AS (SELECT stem_a, stem_b, a_id, b_id, el, sum(c) AS gap FROM (SELECT * FROM pa WHERE el IS NOT NULL UNION ALL SELECT stem_a, stem_b, a_id, b_id, el, -c FROM pb WHERE el IS NOT NULL) GROUP BY ALL HAVING sum(c) <> 0),
    s AS (SELECT d.*, step, e.element = el AS fits FROM d LEFT JOIN o ON o.stem = d.stem_b AND o.id = d.b_id LEFT JOIN n e ON e.stem = o.stem AND e.id = o.nbr WHERE gap > 0
      UNION ALL SELECT d.*, step, coalesce(e.element = el, false) FROM d LEFT JOIN o ON o.stem = d.stem_a AND o.id = d.a_id LEFT JOIN m t ON t.stem_a = d.stem_a AND t.a_id = o.nbr LEFT JOIN n e ON e.stem = t.stem_b AND e.id = t.b_id WHERE gap < 0),
    w AS (SELECT *, coalesce(sum(CAST(fits AS INTEGER)) OVER (PARTITION BY stem_a, a_id, el ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM s),
    c AS (SELECT stem_a, a_id, el, 0.1 * count(*) FILTER (step IS NOT NULL AND NOT fits AND had < abs(any_gap)) + greatest(any_value(abs(any_gap)) - count(*) FILTER (fits), 0) AS cost FROM (SELECT *, gap AS any_gap FROM w) GROUP BY ALL),
    cn AS (SELECT stem, mid, sum(n) AS c FROM k GROUP BY ALL),
    pc AS (SELECT m.stem_a, m.stem_b, m.a_id, m.b_id, coalesce((SELECT sum(cost) FROM c WHERE c.stem_a = m.stem_a AND c.a_id = m.a_id), 0)
      + (coalesce((SELECT sum(c) FROM pa WHERE pa.stem_a = m.stem_a AND pa.a_id = m.a_id AND el IS NULL), 0) + coalesce((SELECT sum(c) FROM pb WHERE pb.stem_a = m.stem_a AND pb.a_id = m.a_id AND el IS NULL), 0))
        / greatest(coalesce(x.c, 0), coalesce(y.c, 0), 1) AS cost FROM m LEFT JOIN cn x ON x.stem = m.stem_a AND x.mid = m.a_id LEFT JOIN cn y ON y.stem = m.stem_b AND y.mid = m.b_id)"""
)


def _near_ids(x: Orders) -> DataFrame:
    """Made-up distances between all sites of an order and three images of each, from their ids: neighbours within and beyond the bonds."""
    own = x.sites.select("stem", "id")
    both = own.join(own.select("stem", F.col("id").alias("nbr")), "stem").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    dist = (F.col("id") * 3 + F.col("nbr") * 5) % 7 + F.col("id") * F.col("nbr") / 10 + 4 * F.col("i")
    return graph.nearest(both.select("stem", "id", "nbr", F.array("i").alias("img"), dist.alias("dist")), 8)


@over("q_topology_pairs", _WALK + " SELECT stem_a, stem_b, a_id, b_id, round(cost, 6) AS cost FROM pc")
def topology_pairs(x: Orders):
    views = shell_walk.atom_views(x.nodes, x.half, _near_ids(x))
    return shell_walk.pair_costs(_mappings(x), views).select("stem_a", "stem_b", "a_id", "b_id", F.round("cost", 6).alias("cost"))


@over(
    "q_topology_cost",
    _WALK
    + """ SELECT stem_a, stem_b, count(*) AS pairs, round(avg(cost) + (SELECT count(*) FROM n WHERE n.stem = stem_a) + (SELECT count(*) FROM n WHERE n.stem = stem_b) - 2 * count(*), 6) AS cost FROM pc GROUP BY stem_a, stem_b""",
)
def topology_cost(x: Orders):
    views = shell_walk.atom_views(x.nodes, x.half, _near_ids(x))
    return shell_walk.topology_costs(_mappings(x), views).withColumn("cost", F.round("cost", 6))


def _lone_sql(own: str, other: str) -> str:
    """Atoms of one side without a partner, with the share of their bonds that their absence explains."""
    return f""", e{own} AS (SELECT j.stem_a, j.stem_b, n.id, n.element, n.role, coalesce(x.c, 0) AS cn, m.{other}_id AS too, coalesce(y.c, 0) AS cn_too FROM (SELECT DISTINCT stem_a, stem_b FROM m) j JOIN n ON n.stem = j.stem_{own}
      LEFT JOIN m ON m.stem_a = j.stem_a AND m.{own}_id = n.id LEFT JOIN cn x ON x.stem = n.stem AND x.mid = n.id LEFT JOIN cn y ON y.stem = j.stem_{other} AND y.mid = m.{other}_id),
    f{own} AS (SELECT stem_a, max(f) = min(f) AS uniform FROM (SELECT stem_a, element, cn, count(*) / count(too) AS f FROM e{own} GROUP BY ALL HAVING count(too) > 0) GROUP BY ALL),
    l{own} AS (SELECT *, uniform AND EXISTS (SELECT 1 FROM e{own} s WHERE s.stem_a = e.stem_a AND s.element = e.element AND s.cn = e.cn AND s.too IS NOT NULL) AS copy FROM e{own} e JOIN f{own} USING (stem_a) WHERE too IS NULL),
    g{own} AS (SELECT l.stem_a, l.id, sum(k.n) AS good FROM l{own} l JOIN k ON k.stem = l.stem_{own} AND k.mid = l.id JOIN e{own} e ON e.stem_a = l.stem_a AND e.id = k.nbr AND e.too IS NOT NULL
      WHERE e.cn - (SELECT sum(z.n) FROM l{own} s JOIN k z ON z.stem = s.stem_{own} AND z.mid = s.id WHERE s.stem_a = l.stem_a AND s.element = l.element AND s.cn = l.cn AND z.nbr = k.nbr) = e.cn_too GROUP BY ALL),
    r{own} AS (SELECT l.stem_a, l.stem_b, '{own}' AS side, l.id, role, copy, coalesce(good, 0) / greatest(cn, 1) AS completion FROM l{own} l LEFT JOIN g{own} g ON g.stem_a = l.stem_a AND g.id = l.id)"""


@over(
    "q_vacancies",
    GRAPHS
    + _MAPPED
    + ", k AS (SELECT stem, mid, nbr, count(*) AS n FROM h GROUP BY ALL), cn AS (SELECT stem, mid, sum(n) AS c FROM k GROUP BY ALL)"
    + _lone_sql("a", "b")
    + _lone_sql("b", "a")
    + """, u AS (SELECT * FROM ra UNION ALL SELECT * FROM rb), w AS (SELECT u.*, CASE WHEN copy OR completion >= 1 THEN 'vacancy' ELSE 'unassigned' END AS what,
      NOT copy AND EXISTS (SELECT 1 FROM u o WHERE o.stem_a = u.stem_a AND o.role = u.role AND o.side <> u.side) AS unforced FROM u)
    SELECT stem_a, stem_b, side, id, round(completion, 6) AS completion, CASE WHEN unforced THEN 'unforced_' || what ELSE what END AS kind, CASE WHEN unforced THEN 2.0 WHEN what = 'vacancy' THEN 0.0 ELSE 1.0 END AS penalty FROM w""",
)
def lone(x: Orders):
    return vacancies.lone_atoms(_mappings(x), x.nodes, x.half).withColumn("completion", F.round("completion", 6))


_PACKED = GRAPHS + ", el AS (SELECT stem, element, count(*) AS c FROM n GROUP BY ALL), pk AS (SELECT stem, list_reduce(list(c), lambda x, y: gcd(x, y)) AS units, list_sort(list(c)) AS cs FROM el GROUP BY stem), rt AS (SELECT stem, units, list_transform(cs, lambda t: t // units) AS ratio FROM pk)"


@over("q_compatible", _PACKED + " SELECT x.stem AS stem_a, y.stem AS stem_b FROM rt x JOIN rt y ON x.stem % 8 = 0 AND y.stem BETWEEN x.stem + 1 AND x.stem + 3 AND x.ratio = y.ratio AND (x.units % y.units = 0 OR y.units % x.units = 0)")
def compatible(x: Orders):
    packed = match.packed_graphs(x.nodes, x.half, x.poly)
    pairs = x.nodes.where("stem % 8 = 0").select(F.col("stem").alias("stem_a"), F.explode(F.expr("sequence(stem + 1, stem + 3)")).alias("stem_b")).distinct()
    return match.compatible(packed, pairs)


# ---- families, classes -------------------------------------------------------


@query(
    "q_prototype_pick",
    "SELECT p_brand AS \"group\", p_partkey AS stem FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END, p_size, p_partkey) AS k FROM part) WHERE k = 1",
)
def prototype_pick(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return families.pick_prototypes(part.select(F.col("p_partkey").alias("stem"), F.col("p_brand").alias("group")), part.select(F.col("p_partkey").alias("stem"), (F.col("p_type") == "ECONOMY").alias("oxide"), F.col("p_size").cast("double").alias("distortion")))


@query(
    "q_expand_members",
    """
    WITH k AS (SELECT p_brand, p_partkey, p_size, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END, p_size, p_partkey) AS of FROM part)
    SELECT k.p_partkey AS stem, o.p_size AS family_id, k.p_partkey = of AS is_trivial_prototype, CASE WHEN k.p_partkey = of THEN round(o.p_retailprice, 2) ELSE 0 END AS cost_to_prototype FROM k JOIN part o ON o.p_partkey = of""",
)
def expand_members(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    groups = part.select(F.col("p_partkey").alias("stem"), F.col("p_brand").alias("group"))
    members = part.select(F.col("p_partkey").alias("stem"), F.col("p_size").alias("family_id"), F.round("p_retailprice", 2).alias("cost"))
    return families.expand_members(members, groups, prototype_pick(spark, sf_dir))


@query(
    "q_leader_assign",
    """
    WITH d AS (SELECT x.vec_id AS stem, 'p' || p.vec_id AS label, round(1 / (1 + list_distance(CAST(x.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))), 6) AS score FROM embeddings x, embeddings p WHERE p.vec_id < 8),
    r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY score DESC, label DESC) AS k, lead(score) OVER (PARTITION BY stem ORDER BY score DESC, label DESC) AS second FROM d)
    SELECT stem, label, score, second, CASE WHEN score >= 0.75 THEN 'classified' WHEN score >= 0.46 THEN 'uncertain' ELSE 'flagged' END AS status, score - second <= 0.005 AS ambiguous FROM r WHERE k = 1""",
)
def leader_assign(spark, sf_dir):
    """The best of eight fixed prototypes and whether it is clear; eight rows are literals of the plan, whatever the table's size."""
    rows = table(spark, sf_dir, "embeddings")
    far = lambda e: F.sqrt(F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in e]), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))
    scored = [F.struct(F.lit(f"p{r.vec_id}").alias("label"), F.round(1 / (1 + far(r.embedding)), 6).alias("score")) for r in rows.where("vec_id < 8").orderBy("vec_id").collect()]
    scores = rows.select(F.col("vec_id").alias("stem"), F.explode(F.array(*scored)).alias("s")).select("stem", "s.*")
    return families.classify(scores, uncertain=0.46, margin=0.005)


@query("q_best_family", "SELECT p_partkey, CASE WHEN greatest(a, b) >= 30 THEN CASE WHEN a >= b THEN 'a' ELSE 'b' END ELSE 'Other' END AS family, greatest(a, b) AS score FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice % 50 AS b FROM part)")
def best_family(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") % 50).alias("b"))
    return metrics.best_family(part, ["a", "b"], 30.0).select("p_partkey", "family", "score")


@query("q_overlay", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def overlay(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    return metrics.overlay(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), known, "c_nationkey")


_RADII = "0.5 + p_size / 40.0 AS ra, 0.4 + p_size / 50.0 AS rn, 0.3 + (p_partkey % 7) / 10.0 AS rb, 1.2 + (p_partkey % 3) / 10.0 AS rx"


@query(
    "q_tolerance_factors",
    f"""
    WITH r AS (SELECT p_partkey, {_RADII} FROM part)
    SELECT p_partkey, round((ra + rx) / (sqrt(2) * (rb + rx)), 7) AS goldschmidt, round((rn ** 3 + rx ** 3) / (ra ** 3 + rb ** 3 + 3 * rx ** 3), 7) AS layer_volume, round((rb + rx) / (2 * rb + 2 * rx + 2 * rn), 7) AS ac_ratio, round((rb / ra) ** 2 + sqrt(rx / rb), 7) AS other_paper FROM r""",
)
def tolerance(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("p_partkey", "0.5D + p_size / 40D AS ra", "0.4D + p_size / 50D AS rn", "0.3D + (p_partkey % 7) / 10D AS rb", "1.2D + (p_partkey % 3) / 10D AS rx")
    return r.select("p_partkey", *[F.round(c, 7).alias(k) for k, c in metrics.tolerance_factors(F.col("ra"), F.col("rn"), F.col("rb"), F.col("rx")).items()])


_OCTA = (
    GRAPHS.replace("WITH e", "WITH RECURSIVE e", 1)
    + """, c AS (SELECT stem, id, element, cn, cn BETWEEN 2 AND 4 AS fits FROM n WHERE role = 'cation'),
    st AS (SELECT stem, element, count(*) AS sites, avg(CAST(fits AS INTEGER)) AS octahedral, abs(avg(cn) - 6) AS off FROM c GROUP BY ALL),
    bs AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY octahedral DESC, off, sites, element) AS rank FROM st QUALIFY rank = 1),
    cl AS (SELECT x.i AS c1, y.i AS c2, z.i AS c3 FROM (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(i), (VALUES (0), (1)) z(i)),
    sh AS (SELECT DISTINCT c.stem, c.id * 8 + c1 * 4 + c2 * 2 + c3 AS k, nbr, (c1 + i1 + 2) % 2 AS e1, (c2 + i2 + 2) % 2 AS e2, c3 AS e3 FROM c JOIN bs ON bs.stem = c.stem AND bs.element = c.element AND fits JOIN h ON h.stem = c.stem AND h.mid = c.id, cl),
    pr AS (SELECT x.stem, x.k AS a, y.k AS b, count(*) AS shared FROM sh x JOIN sh y ON x.stem = y.stem AND x.nbr = y.nbr AND x.e1 = y.e1 AND x.e2 = y.e2 AND x.e3 = y.e3 AND x.k < y.k GROUP BY ALL),
    ed AS (SELECT stem, a, b FROM pr UNION ALL SELECT stem, b, a FROM pr),
    rc AS (SELECT DISTINCT stem, k AS node, k AS root FROM sh UNION SELECT rc.stem, ed.b, rc.root FROM rc JOIN ed ON ed.stem = rc.stem AND ed.a = rc.node),
    lg AS (SELECT stem, max(c) / sum(c) AS largest FROM (SELECT stem, root, count(*) AS c FROM (SELECT stem, node, min(root) AS root FROM rc GROUP BY ALL) GROUP BY ALL) GROUP BY stem),
    lk AS (SELECT stem, count(*) AS links, count(*) FILTER (shared = 1) AS ones FROM pr GROUP BY stem), nk AS (SELECT stem, count(DISTINCT k) AS n FROM sh GROUP BY stem),
    hi AS (SELECT c.stem, coalesce(avg(CASE WHEN c.element <> bs.element THEN CAST(cn >= 8 AS INTEGER) END), avg(CAST(cn >= 8 AS INTEGER))) AS high, avg(CAST(fits AS INTEGER)) AS every FROM c JOIN bs USING (stem) GROUP BY c.stem),
    oc AS (SELECT bs.stem, CASE WHEN every > 0 THEN bs.element END AS b_element, CASE WHEN every > 0 THEN sites ELSE 0 END AS sites, octahedral, every AS all_octahedral, coalesce(largest, 0) AS largest, coalesce(ones / links, 0) AS corner, coalesce(2 * links / nk.n, 0) AS degree, CASE WHEN every > 0 THEN high ELSE 0 END AS high
      FROM bs JOIN hi USING (stem) LEFT JOIN lg USING (stem) LEFT JOIN lk USING (stem) LEFT JOIN nk USING (stem))"""
)
_SEVEN = ("octahedral", "all_octahedral", "largest", "corner", "degree", "high")


@over("q_octahedral_network", _OCTA + f" SELECT stem, b_element, sites, {', '.join(f'round({c}, 6) AS {c}' for c in _SEVEN)} FROM oc")
def octahedral_network(x: Orders):
    found = classify.octahedral_network(x.nodes, x.half, 2, 4)
    return found.select("stem", "b_element", "sites", *[F.round(c, 6).alias(c) for c in _SEVEN])


@over(
    "q_layered_scan",
    _OCTA
    + """, rt AS (SELECT stem, count(*) FILTER (role = 'anion') / count(*) FILTER (role = 'cation') AS r FROM n GROUP BY stem),
    sc AS (SELECT stem, sites, greatest(0, 1 - abs(r - 4 / 3) / 0.18) AS a, greatest(0, 1 - abs(all_octahedral - 1 / 3) / 0.25) AS b, greatest(0, 1 - abs(largest - 0.5) / 0.5) AS c, least(degree / 2, 1) AS d, high FROM oc JOIN rt USING (stem)),
    sm AS (SELECT *, round(0.40 * a + 0.20 * b + 0.15 * c + 0.15 * d + 0.10 * high, 4) AS s FROM sc)
    SELECT stem, CAST(s AS DOUBLE) AS confidence, sites > 0 AND a >= 0.70 AND b >= 0.20 AND c >= 0.20 AND s >= 0.55 AS is_layered FROM sm""",
)
def layered_scan(x: Orders):
    return classify.layered(x.nodes, x.half, least=2, most=4)


@over("q_octahedra", PATHS + """
    , s AS (SELECT stem, id, element FROM n WHERE role = 'cation' AND cn BETWEEN 2 AND 4), o AS (SELECT stem, element, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT stem, max((c, element)) AS m FROM o GROUP BY stem),
    w AS (SELECT s.stem, s.id FROM s JOIN m ON m.stem = s.stem AND m.m[2] = s.element), l AS (SELECT q.* FROM q JOIN w x ON x.stem = q.stem AND x.id = q.a JOIN w y ON y.stem = q.stem AND y.id = q.b)
    SELECT m.stem, m.m[2] AS b_element, m.m[1] AS octahedra, count(mode) FILTER (mode = 'corner') AS corner, count(mode) FILTER (mode = 'edge') AS edge, count(mode) FILTER (mode = 'face') AS face, count(mode) AS links FROM m LEFT JOIN l USING (stem) GROUP BY ALL""")
def octahedra(x: Orders):
    return classify.octahedra(x.nodes, x.poly, 2, 4)


@query("q_element_similarity", "SELECT least(c_nationkey, c_custkey % 25) AS element_a, greatest(c_nationkey, c_custkey % 25) AS element_b, count(*) AS n, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least FROM customer GROUP BY ALL")
def element_similarity(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("element_a"), (F.col("c_custkey") % 25).alias("element_b"), F.col("c_acctbal").alias("distance"))
    return classify.element_similarity(pairs).withColumn("mean", F.round("mean", 4))


@query(
    "q_named_minerals",
    """
    WITH l AS (SELECT DISTINCT p_name AS name, p_brand AS formula_key, p_size % 5 AS sg FROM part WHERE p_type = 'ECONOMY'), x AS (SELECT formula_key, sg, min(name) AS m FROM l GROUP BY ALL), y AS (SELECT formula_key, min(name) AS m FROM l GROUP BY ALL)
    SELECT p_partkey AS stem, coalesce(x.m, y.m) AS mineral FROM part LEFT JOIN x ON x.formula_key = p_brand AND x.sg = p_size % 5 LEFT JOIN y ON y.formula_key = p_brand""",
)
def named_minerals(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    records = part.where("p_type = 'ECONOMY'").select(F.col("p_name").alias("name"), F.col("p_brand").alias("formula_key"), (F.col("p_size") % 5).alias("sg_number"))
    lookup = classify.mineral_lookup(records, records.limit(0))
    return classify.named_minerals(part.select(F.col("p_partkey").alias("stem"), F.col("p_brand").alias("formula_key"), (F.col("p_size") % 5).alias("sg_number")), lookup).select("stem", "mineral")


# ---- formulas and names ----------------------------------------------------

_AMOUNTS = "1 + p_partkey % 3 AS a, 1 + p_size % 4 AS b, 2 + p_partkey % 5 AS c, 1 + p_size % 2 AS d"


@query(
    "q_formulas",
    f"""
    WITH p AS (SELECT p_partkey, {_AMOUNTS} FROM part), t AS (SELECT p_partkey, a AS ca, b * d AS ti, c * d + 1 AS o, gcd(gcd(a, b * d), c * d + 1) AS g FROM p)
    SELECT p_partkey, 'Ca' || CAST(ca // g AS BIGINT) || 'O' || CAST(o // g AS BIGINT) || 'Ti' || CAST(ti // g AS BIGINT) AS key, list_aggregate(list_transform(list_sort([ca // g, o // g, ti // g]), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), 'string_agg', '-') AS ratio,
      CAST((ca + ti + o) // g AS BIGINT) AS atoms, ca // g = 1 AND ti // g = 1 AND o // g = 3 AS abo3, list_sort([ca // g, o // g, ti // g]) = [1, 2, 4] AS is_214 FROM t""",
)
def formulas(spark, sf_dir):
    """Formulas with a group and a repeated element: Ca a (Ti b O c) d O."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", *[x.strip() for x in _AMOUNTS.split(",")])
    text = F.concat(F.lit("Ca"), "a", F.lit("(Ti"), "b", F.lit("O"), "c", F.lit(")"), "d", F.lit("O"))
    amounts = formula.composition(F.col("f"))
    p = p.select("p_partkey", text.cast("string").alias("f")).select("p_partkey", amounts.alias("amounts")).withColumn("counts", formula.reduced(F.col("amounts")))
    counts = F.col("counts")
    return p.select("p_partkey", formula.formula_key(counts).alias("key"), formula.ratio(counts).alias("ratio"), formula.atoms_per_unit(F.col("amounts")).alias("atoms"), formula.is_abo3(counts).alias("abo3"), formula.matches_ratio(counts, "214").alias("is_214"))


@query("q_safe_map", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def safe_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(formula.safe_map(F.col("props")), F.lit("k")).alias("k"))


@query(
    "q_names",
    """
    SELECT p_partkey, 'mp-' || p_partkey AS material_id, replace(p_name, ' ', '_') || '_mp-' || p_partkey AS stem, replace(p_name, ' ', '_') AS formula_part, p_type = 'ECONOMY' AS economy,
      CASE WHEN n <= 2 THEN 'triclinic' WHEN n <= 15 THEN 'monoclinic' WHEN n <= 74 THEN 'orthorhombic' WHEN n <= 142 THEN 'tetragonal' WHEN n <= 167 THEN 'trigonal' WHEN n <= 194 THEN 'hexagonal' ELSE 'cubic' END AS system
    FROM (SELECT *, 1 + p_partkey % 230 AS n FROM part)""",
)
def names(spark, sf_dir):
    path = F.concat(F.lit("graphs/"), F.regexp_replace("p_name", " ", "_"), F.lit("_mp-"), F.col("p_partkey").cast("string"), F.lit(".json"))
    p = table(spark, sf_dir, "part").withColumn("path", path).withColumn("stem", formula.stem(F.col("path")))
    flag = formula.truthy(F.when(F.col("p_type") == "ECONOMY", " Yes ").otherwise("no"))
    return p.select("p_partkey", formula.material_id(F.col("path")).alias("material_id"), "stem", formula.formula_part(F.col("stem")).alias("formula_part"), flag.alias("economy"), formula.crystal_system(1 + F.col("p_partkey") % 230).alias("system"))


# ---- builder ---------------------------------------------------------------


def _structures(spark, sf_dir) -> DataFrame:
    """Orders as structures: each line a site of two species, the second without a state in odd lines."""
    line = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    species = F.expr("""array(struct('Ca' as symbol, l_discount + 0.3D as occupancy, cast(2 as double) as oxi_state, l_returnflag = 'A' as explicit),
        struct('O' as symbol, l_tax + 0.3D as occupancy, if(l_linenumber % 2 = 1, null, cast(-2 as double)) as oxi_state, false as explicit))""")
    sites = line.select(F.col("l_orderkey").alias("stem"), F.struct(place.cast("int").alias("id"), F.array(F.lit(0.0)).alias("frac"), species.alias("species")).alias("site"))
    return sites.groupBy("stem").agg(F.collect_list("site").alias("sites")).withColumn("error", F.lit(None).cast("string"))


@query(
    "q_weighted_avg",
    """
    WITH s AS (SELECT l_orderkey AS stem, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS id, l_discount + 0.3 AS u, l_tax + 0.3 AS v, l_linenumber % 2 = 1 AS odd, l_returnflag = 'A' AS stated FROM lineitem),
    w AS (SELECT *, CASE WHEN odd THEN 2.0 ELSE (2 * u - 2 * v) / (u + v) END AS x, CASE WHEN v > u THEN 'O' ELSE 'Ca' END AS element, bool_or(stated) OVER (PARTITION BY stem) AS known FROM s),
    z AS (SELECT *, CASE WHEN abs(x - round_even(x, 0)) < 1e-8 THEN round_even(x, 0) ELSE x END AS state, count(DISTINCT element) OVER (PARTITION BY stem) > 1 AS both_kinds FROM w)
    SELECT stem, id, element, round(state, 6) AS state, CASE WHEN known THEN CASE WHEN state > 1e-8 THEN 'cation' WHEN state < -1e-8 THEN 'anion' ELSE 'neutral' END WHEN both_kinds THEN CASE element WHEN 'O' THEN 'anion' ELSE 'cation' END ELSE 'neutral' END AS role FROM z""",
)
def site_table(spark, sf_dir):
    """Dominant species, occupancy-weighted states without the missing ones, and roles."""
    return build.site_table(_structures(spark, sf_dir)).select("stem", "id", "element", F.round("oxidation_state", 6).alias("state"), F.col("ion_role").alias("role"))


_CAND = """
    WITH c AS (SELECT l_orderkey AS stem, CAST(l_partkey % 6 AS INTEGER) AS i, CAST(l_suppkey % 6 AS INTEGER) AS j, l_linenumber - 4 AS g, l_quantity / 20 + 1 AS d, l_discount AS w, l_tax AS wb, 1 + l_quantity / 50 AS di, 1.2 + l_discount AS dj,
      CASE WHEN l_returnflag = 'N' THEN 'Infinity'::DOUBLE ELSE 1.5 + l_tax END AS si, 1.4 + l_discount AS sj, CASE l_partkey % 6 % 3 WHEN 0 THEN 'cation' WHEN 1 THEN 'anion' ELSE 'neutral' END AS ri, CASE l_suppkey % 6 % 3 WHEN 0 THEN 'cation' WHEN 1 THEN 'anion' ELSE 'neutral' END AS rj FROM lineitem)"""


def _candidates(spark, sf_dir) -> DataFrame:
    role = lambda c: F.when(F.col(c) % 6 % 3 == 0, "cation").when(F.col(c) % 6 % 3 == 1, "anion").otherwise("neutral")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stem"), (F.col("l_partkey") % 6).cast("int").alias("i"), (F.col("l_suppkey") % 6).cast("int").alias("j"), F.array(F.col("l_linenumber") - 4, F.lit(0), F.lit(0)).alias("img"), (F.col("l_quantity") / 20 + 1).alias("d"),
        F.array("l_quantity", "l_discount", "l_tax").alias("vec"), F.col("l_discount").alias("w"), F.col("l_tax").alias("w_back"), (1 + F.col("l_quantity") / 50).alias("dmin_i"), (F.lit(1.2) + F.col("l_discount")).alias("dmin_j"),
        F.when(F.col("l_returnflag") == "N", float("inf")).otherwise(F.lit(1.5) + F.col("l_tax")).alias("dsr_i"), (F.lit(1.4) + F.col("l_discount")).alias("dsr_j"), role("l_partkey").alias("role_i"), role("l_suppkey").alias("role_j"),
    )


@query(
    "q_select_bonds",
    _CAND
    + """, k AS (SELECT stem, least(i, j) AS source, greatest(i, j) AS target, CASE WHEN i > j THEN -g ELSE g END AS g, greatest(w, wb) AS w FROM c
      WHERE d <= 2.0 * di AND greatest(w, wb) >= 0.005 AND (ri = 'neutral' OR rj = 'neutral' OR CASE WHEN ri = rj THEN d <= 1.15 * greatest(di, dj) OR greatest(w, wb) >= 0.08 ELSE greatest(si, sj) = 'Infinity'::DOUBLE OR d <= 1.2 * greatest(si, sj) END)),
    u AS (SELECT stem, source, target, g, max(w) AS w FROM k GROUP BY ALL), x AS (SELECT *, unnest([source, target]) AS e FROM u), y AS (SELECT *, row_number() OVER (PARTITION BY stem, e ORDER BY w DESC, source DESC, target DESC, g DESC) AS r FROM x),
    z AS (SELECT DISTINCT stem, source, target, g FROM y WHERE r > 2)
    SELECT u.stem, u.source, u.target, u.g, u.w, row_number() OVER (PARTITION BY u.stem ORDER BY u.source, u.target, u.g) - 1 AS id FROM u LEFT JOIN z USING (stem, source, target, g) WHERE z.stem IS NULL""",
)
def select_bonds(spark, sf_dir):
    """The builder's guards, the heavier of both directions, and a cap of two bonds a node."""
    return build.select_bonds(_candidates(spark, sf_dir), True, 2).select("stem", "source", "target", F.col("img")[0].alias("g"), F.greatest("vw_s", "vw_t").alias("w"), "id")


@over(
    "q_edge_attributes",
    GRAPHS
    + """, t AS (SELECT id, CAST(CASE element WHEN 'Ca' THEN 1.0 WHEN 'Ti' THEN 1.54 WHEN 'O' THEN 3.44 END AS DOUBLE) AS p FROM e)
    SELECT stem, b.id, CAST(round(len / (s.r + u.r), 6) AS DOUBLE) AS ratio, CAST(round(abs(v.p - w.p), 6) AS DOUBLE) AS dchi FROM b JOIN e s ON s.id = source JOIN e u ON u.id = target JOIN t v ON v.id = source JOIN t w ON w.id = target""",
)
def edge_attributes(x: Orders):
    chi = x.sites.sparkSession.createDataFrame([("Ca", 1.0, 1.03), ("Ti", 1.54, 1.38), ("O", 3.44, 3.61)], "symbol string, pauling double, allen double")
    radii = x.sites.select("stem", "id", F.col("shannon_r").alias("radius"))
    found = build.edge_attributes(x.bonds.drop("ratio"), x.sites, radii, build.site_electronegativity(x.sites, chi))
    return found.select("stem", "id", F.round("ratio", 6).alias("ratio"), F.round("dchi_p", 6).alias("dchi"))


_SHANNON = [("Ca", 2.0, 6, "", 1.14), ("Ca", 2.0, 12, "", 1.48), ("Ti", 4.0, 6, "", 0.745), ("Ti", 4.0, 4, "", 0.56), ("Ti", 3.0, 6, "", 0.81), ("Mg", 3.0, 6, "High Spin", 0.9), ("Mg", 3.0, 6, "Low Spin", 0.8), ("O", -2.0, 3, "", 1.22), ("O", -2.0, 2, "", 1.21)]


@over(
    "q_site_radii",
    GRAPHS
    + """, exact AS (SELECT * FROM (VALUES ('Ca', 6, 1.14), ('Ca', 12, 1.48), ('Ti', 6, 0.745), ('Ti', 4, 0.56), ('O', 3, 1.22), ('O', 2, 1.21)) v(element, cn, r)), known AS (SELECT * FROM (VALUES ('Ca', 1.48), ('Ti', 0.745), ('O', 1.22)) v(element, r)), atomic AS (SELECT * FROM (VALUES ('Mg', 1.5), ('S', 1.0)) v(element, r))
    SELECT stem, id, CAST(round(coalesce(x.r, k.r, a.r, 1.0), 6) AS DOUBLE) AS radius, CASE WHEN x.r IS NOT NULL THEN 'exact' WHEN k.r IS NOT NULL THEN 'known' WHEN a.r IS NOT NULL THEN 'atomic' ELSE 'default' END AS source
    FROM n LEFT JOIN exact x ON x.element = n.element AND x.cn = n.cn LEFT JOIN known k ON k.element = n.element LEFT JOIN atomic a ON a.element = n.element""",
)
def site_radii(x: Orders):
    """Radii by exact coordination number, the largest known, the element, or 1."""
    spark = x.sites.sparkSession
    shannon = spark.createDataFrame(_SHANNON, "symbol string, oxi double, cn int, spin string, radius double")
    atomic = spark.createDataFrame([("Mg", 1.5, None, None), ("S", 1.0, None, None)], "symbol string, atomic double, calculated double, van_der_waals double")
    return build.site_radii(x.sites, shannon, atomic, x.nodes.select("stem", "id", "cn")).withColumn("radius", F.round("radius", 6))


@query(
    "q_max_radii",
    """
    WITH s AS (SELECT p_brand AS symbol, CAST(p_size % 4 - 1 AS DOUBLE) AS oxi, 1 + p_partkey % 16 AS cn, p_retailprice AS radius FROM part), m AS (SELECT symbol, oxi, cn, avg(radius) AS radius FROM s WHERE cn <= 14 AND oxi <> 0 GROUP BY ALL)
    SELECT symbol, oxi, round(arg_max(radius, cn), 6) AS radius, max(cn) AS cn FROM m GROUP BY symbol, oxi""",
)
def max_radii(spark, sf_dir):
    """The mean radius at the largest tabulated coordination number, of parts as a table of radii."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), (F.col("p_size") % 4 - 1).cast("double").alias("oxi"), (1 + F.col("p_partkey") % 16).cast("int").alias("cn"), F.lit("").alias("spin"), F.col("p_retailprice").alias("radius"))
    return build.max_known_radii(part).withColumn("radius", F.round("radius", 6))


@query(
    "q_candidates",
    """
    WITH st AS (SELECT DISTINCT 'E' || p_size AS symbol, CAST(1 + p_partkey % 5 AS DOUBLE) AS oxi FROM part), sh AS (SELECT DISTINCT symbol, oxi FROM st),
    k AS (SELECT DISTINCT 'E' || (p_partkey % 50) || 'E' || p_size || 'O3' AS formula FROM part)
    SELECT a.symbol AS a_element, a.oxi AS a_oxi, b.symbol AS b_element, b.oxi AS b_oxi, CASE WHEN a.symbol = b.symbol THEN a.symbol || '2O3' ELSE a.symbol || b.symbol || 'O3' END AS f, k.formula IS NOT NULL AS "exists", round(1 + a.oxi / 8, 4) AS r_a, round(0.5 + b.oxi / 8, 4) AS r_b, CAST(1.26 AS DOUBLE) AS r_x
    FROM sh a JOIN sh b ON a.oxi + b.oxi = 6 LEFT JOIN k ON k.formula = CASE WHEN a.symbol = b.symbol THEN a.symbol || '2O3' ELSE a.symbol || b.symbol || 'O3' END""",
)
def candidates(spark, sf_dir):
    """Pairs of cations whose charges add up, and whether their formula is known; elements are sizes of parts."""
    part = table(spark, sf_dir, "part")
    states = part.select(F.concat(F.lit("E"), "p_size").alias("symbol"), (1 + F.col("p_partkey") % 5).cast("double").alias("oxi")).distinct()
    at = lambda cn, base: states.select("symbol", "oxi", F.lit(cn).alias("cn"), F.lit("").alias("spin"), (F.lit(base) + F.col("oxi") / 8).alias("radius"))
    oxygen = spark.createDataFrame([("O", -2.0, 6, "", 1.26)], "symbol string, oxi double, cn int, spin string, radius double")
    known = part.select(F.concat(F.lit("E"), (F.col("p_partkey") % 50).cast("string"), F.lit("E"), "p_size", F.lit("O3")).alias("formula"))
    found = classify.abo3_candidates(states, fold(DataFrame.unionByName, [at(12, 1.0), at(6, 0.5), oxygen]), known)
    return found.select("a_element", "a_oxi", "b_element", "b_oxi", F.col("formula").alias("f"), "exists", "r_a", "r_b", "r_x")

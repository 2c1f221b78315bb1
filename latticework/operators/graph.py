"""Relational operators on periodic graphs.

The work-horse is the view of half bonds: each bond seen from both of its
ends.  A node is (stem, id); an edge is (stem, source, target, image).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 20
CORE_WEIGHT = 0.5


def negated(array: Column) -> Column:
    return F.transform(array, lambda x: -x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def dot3(a: Column, b: Column) -> Column:
    """The same for vectors of three components, as plain sums and products."""
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def half_bonds(bonds: DataFrame) -> DataFrame:
    """(stem, eid, dir, mid, nbr, img, vec, len, is_core, vw, ecn): every bond from both ends, in one pass."""
    core = (F.col("sphere") == "core").alias("is_core")
    ends = F.array(
        F.struct(F.lit(0).alias("dir"), F.col("source").alias("mid"), F.col("target").alias("nbr"), F.col("img"), F.col("cart_vec").alias("vec"), F.col("vw_s").alias("vw"), F.col("ecn_s").alias("ecn")),
        F.struct(F.lit(1).alias("dir"), F.col("target").alias("mid"), F.col("source").alias("nbr"), negated(F.col("img")).alias("img"), negated(F.col("cart_vec")).alias("vec"), F.col("vw_t").alias("vw"), F.col("ecn_t").alias("ecn")),
    )
    return bonds.select("stem", F.col("id").alias("eid"), F.col("bond_length").alias("len"), core, F.explode(ends).alias("h")).select("stem", "eid", "h.dir", "h.mid", "h.nbr", "h.img", "h.vec", "len", "is_core", "h.vw", "h.ecn")


def adjacency(half: DataFrame, core_only: bool = False) -> DataFrame:
    """(stem, mid, nbr, n): multiset of neighbours."""
    half = half.where("is_core") if core_only else half
    return half.groupBy("stem", "mid", "nbr").agg(F.count(F.lit(1)).cast("int").alias("n"))


def econ_weights(half: DataFrame) -> DataFrame:
    """Adds `ecn_new` to half bonds: Hoppe's weights exp(1 - (l / mean)^6) with the self-consistent mean length of each node.

    At most 20 rounds from the shortest length, until a change below 1e-6; all
    inside one aggregate over the node's lengths and their sixth powers, which
    are gathered beside the half bonds, so a round takes no powers but the mean's.
    """
    weight = "exp(1 - y.p / s.q)"
    mean = f"aggregate(ls, named_struct('a', 0D, 'b', 0D), (t, y) -> named_struct('a', t.a + y.x * {weight}, 'b', t.b + {weight}), t -> t.a / t.b)"
    fixed = f"""aggregate(sequence(1, 20), named_struct('l', least, 'q', pow(least, 6D), 'done', least is null), (s, i) ->
        if(s.done, s, transform(array({mean}), m -> named_struct('l', m, 'q', pow(m, 6D), 'done', abs(m - s.l) < 1e-6))[0]), s -> s.l)"""
    rest = [c for c in half.columns if c not in ("stem", "mid")]
    length = F.when(F.col("len").isNotNull(), F.struct(F.col("len").alias("x"), F.pow("len", F.lit(6.0)).alias("p")))
    nodes = half.where("stem is not null and mid is not null").groupBy("stem", "mid").agg(F.collect_list(F.struct(*rest)).alias("h"), F.collect_list(length).alias("ls"), F.min("len").alias("least"))
    out = nodes.select("stem", "mid", "h", F.expr(fixed).alias("mean")).select("stem", "mid", "mean", F.explode("h").alias("h")).select("stem", "mid", "mean", "h.*")
    return out.select(*half.columns, F.exp(1 - F.pow(F.col("len") / F.col("mean"), 6)).alias("ecn_new"))


def with_spheres(bonds: DataFrame, threshold: float = CORE_WEIGHT) -> DataFrame:
    """Bonds with ECoN weights of both ends (6 places) and the sphere: core if either weight reaches the threshold.

    Only numbers and lengths of bonds are gathered by node; the weights are joined to the bonds.
    """
    ends = bonds.where("stem is not null and id is not null").select("stem", F.col("id").alias("eid"), F.col("bond_length").alias("len"), F.posexplode(F.array("source", "target")).alias("dir", "mid"))
    weights = econ_weights(ends).groupBy("stem", "eid").agg(F.max(F.when(F.col("dir") == 0, F.col("ecn_new"))).alias("s"), F.max(F.when(F.col("dir") == 1, F.col("ecn_new"))).alias("t"))
    x = bonds.drop("ecn_s", "ecn_t", "sphere").join(weights.withColumnRenamed("eid", "id").hint("merge"), ["stem", "id"])
    x = x.withColumn("ecn_s", F.round("s", 6)).withColumn("ecn_t", F.round("t", 6)).drop("s", "t")
    return x.withColumn("sphere", F.when(F.greatest("ecn_s", "ecn_t") >= threshold, "core").otherwise("extended"))


def coordination(nodes: DataFrame, half: DataFrame) -> DataFrame:
    """(stem, id, cn, cn_core, cn_extended, ecn_value) of every node, those without bonds included."""
    n = half.groupBy("stem", F.col("mid").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("cn"), F.count_if("is_core").cast("int").alias("cn_core"), F.round(F.sum("ecn"), 4).alias("ecn_value"))
    x = nodes.select("stem", "id").join(n, ["stem", "id"], "left")
    x = x.select("stem", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cn", "cn_core")], F.coalesce("ecn_value", F.lit(0.0)).alias("ecn_value"))
    return x.withColumn("cn_extended", F.col("cn") - F.col("cn_core"))


def nearest(candidates: DataFrame, most: int = NEAREST) -> DataFrame:
    """(stem, id, rank, nbr, img, dist): the nearest of candidates (stem, id, nbr, img, dist) at each node; ties by neighbour, then image."""
    rank = F.row_number().over(Window.partitionBy("stem", "id").orderBy(F.round("dist", 6), "nbr", "img")) - 1
    return candidates.withColumn("rank", rank).where(F.col("rank") < most).select("stem", "id", "rank", "nbr", "img", F.round("dist", 6).alias("dist"))


def neighbour_sets(near: DataFrame) -> DataFrame:
    """(stem, id, nbr, dist, images): least distance and all sorted distances to each neighbour."""
    return near.groupBy("stem", "id", "nbr").agg(F.min("dist").alias("dist"), F.array_sort(F.collect_list("dist")).alias("images"))


def extended_pool(half: DataFrame) -> DataFrame:
    """Extended half bonds of each node, strongest first: adds rank."""
    order = Window.partitionBy("stem", "mid").orderBy(F.desc("ecn"), "nbr", "eid", "dir")
    return half.where("not is_core").withColumn("rank", F.row_number().over(order) - 1)


def sharing_mode(n: Column) -> Column:
    """corner, edge, face or multi_N; null without shared atoms."""
    return F.when(n == 1, "corner").when(n == 2, "edge").when(n == 3, "face").when(n > 3, F.concat(F.lit("multi_"), n.cast("string")))


def polyhedral_paths(nodes: DataFrame, half: DataFrame) -> DataFrame:
    """All paths A - M - B through two bonds of M: (stem, a, b, img, mid, core, path_type, angle, path_length, direct, cations).

    to_a is the vector from M to A; cations, whether both A and B are.

    The pairs of a node come from the array of its bonds, so their number is
    bounded by its degree (the builder's cap is 14), and no join of the bond
    table with itself is needed.
    """
    role = nodes.select("stem", F.col("id").alias("_id"), F.col("ion_role").alias("_role"))
    of = lambda c: role.withColumnRenamed("_id", c).withColumnRenamed("_role", f"role_{c}")
    bond = F.struct("eid", "dir", "nbr", "img", "vec", "len", "is_core", "role_nbr")
    ends = half.join(of("nbr"), ["stem", "nbr"]).groupBy("stem", "mid").agg(F.sort_array(F.collect_list(bond)).alias("h"))
    # A bond with each of those after it; both steps are generated code, where nested lambdas are not.
    first = ends.where(F.size("h") > 1).join(of("mid"), ["stem", "mid"]).select("stem", "mid", "role_mid", "h", F.posexplode("h").alias("i", "x"))
    p = first.select("stem", "mid", "role_mid", "x", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("y"))
    apart = lambda c, u, v: F.array(*[F.col(f"{v}.{c}")[i] - F.col(f"{u}.{c}")[i] for i in range(3)])
    delta, back = apart("img", "x", "y"), apart("img", "y", "x")
    swap = (F.col("x.nbr") > F.col("y.nbr")) | ((F.col("x.nbr") == F.col("y.nbr")) & (back < delta))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot3(F.col("x.vec"), F.col("y.vec")) / (F.col("x.len") * F.col("y.len"))))
    gap = apart("vec", "x", "y")
    # Read from a to b or from b to a, the named kinds of path are the same.
    roles = F.concat_ws("-", "x.role_nbr", "role_mid", "y.role_nbr")
    path = F.when(roles.isin("cation-anion-cation", "anion-cation-anion"), roles).otherwise("other")
    return p.select(
        "stem", "mid", F.least("x.nbr", "y.nbr").alias("a"), F.greatest("x.nbr", "y.nbr").alias("b"), F.when(swap, back).otherwise(delta).alias("img"), F.when(swap, F.col("y.vec")).otherwise(F.col("x.vec")).alias("to_a"),
        (F.col("x.is_core") & F.col("y.is_core")).alias("core"), F.degrees(F.acos(cosine)).alias("angle"), (F.col("x.len") + F.col("y.len")).alias("path_length"), F.sqrt(dot3(gap, gap)).alias("direct"),
        path.alias("path_type"), F.coalesce((F.col("x.role_nbr") == "cation") & (F.col("y.role_nbr") == "cation"), F.lit(False)).alias("cations"),
    )


def polyhedral_edges(nodes: DataFrame, half: DataFrame) -> DataFrame:
    """Second-neighbour edges with the shared count and mode, angles, path lengths and the commonest path type (ties: the first by name)."""
    p = polyhedral_paths(nodes, half)
    n = lambda kind: F.count_if(F.col("path_type") == kind)
    kinds = ("anion-cation-anion", "cation-anion-cation", "other")
    commonest = F.when((n(kinds[0]) >= n(kinds[1])) & (n(kinds[0]) >= n(kinds[2])), kinds[0]).when(n(kinds[1]) >= n(kinds[2]), kinds[1]).otherwise(kinds[2])
    g = p.groupBy("stem", "a", "b", "img").agg(
        F.count(F.lit(1)).cast("int").alias("n_all"), F.count_if("core").cast("int").alias("n_core"), commonest.alias("path_type"), F.collect_list(F.round("angle", 4)).alias("angles"), F.collect_list(F.round("path_length", 6)).alias("lengths"),
        F.avg("angle").alias("ma"), F.stddev_pop("angle").alias("sa"), F.avg("path_length").alias("mp"), F.stddev_pop("path_length").alias("sp"), F.min("direct").alias("direct"),
    )
    order = Window.partitionBy("stem").orderBy("a", "b", "img")
    # Above three shared core atoms there is no core mode.
    core = F.when(F.col("n_core") <= 3, sharing_mode(F.col("n_core")))
    return g.select(
        "stem", (F.row_number().over(order) - 1).alias("id"), "a", "b", "img", "path_type", "n_all", "n_core", sharing_mode(F.col("n_all")).alias("mode_all"), core.alias("mode_core"),
        F.array_sort("angles").alias("angles"), F.array_sort("lengths").alias("path_lengths"),
        F.round("ma", 4).alias("mean_angle"), F.round("sa", 4).alias("std_angle"), F.round("mp", 6).alias("mean_path"), F.round("sp", 6).alias("std_path"), F.round("direct", 6).alias("direct_distance"),
    )


def corner_torsions(nodes: DataFrame, half: DataFrame, core_only: bool = True) -> DataFrame:
    """(stem, a, b, img, torsion): for pairs joined by a single cation-anion-cation path, the least angle between the ligands of A and of B seen along the bridge.

    Ligand vectors are projected onto the plane across the vector from the
    bridging atom to A; projections shorter than 1e-6 have no direction.
    """
    paths = polyhedral_paths(nodes, half).where("cations")
    keys, xyz = ["stem", "a", "b", "img"], range(3)
    bridge = F.max(F.col("path_type") == "cation-anion-cation").alias("bridge")
    single = paths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bridge, F.min("mid").alias("mid"), *[F.min(F.col("to_a")[k]).alias(f"x{k}") for k in xyz]).where("n = 1 and bridge")
    legs = half.where("is_core") if core_only else half
    ligands = legs.groupBy("stem", F.col("mid").alias("id")).agg(F.collect_list(F.struct("nbr", *[F.col("vec")[k].alias(f"v{k}") for k in xyz])).alias("l"))
    x = single
    for c in "ab":
        x = x.join(ligands.select("stem", F.col("id").alias(c), F.col("l").alias(f"l{c}")), ["stem", c])
    dot_of = lambda u, v: sum((u[k] * v[k] for k in (1, 2)), u[0] * v[0])
    three = lambda c: [F.col(f"{c}{k}") for k in xyz]
    axis, kept = three("x"), [*keys, "mid", *[f"x{k}" for k in xyz], "lb"]
    # Ligands become rows with plain columns, of A and then of B.
    for c, used in (("a", kept), ("b", [*keys, *[f"a{k}" for k in xyz]])):
        x = x.select(*dict.fromkeys([*kept, *used]), F.explode(f"l{c}").alias("l")).where("l.nbr <> mid")
        v = [F.col(f"l.v{k}") for k in xyz]
        along = dot_of(v, axis) / dot_of(axis, axis)
        x = x.select(*used, *[(v[k] - axis[k] * along).alias(f"{c}{k}") for k in xyz]).where(F.sqrt(dot_of(three(c), three(c))) > 1e-6)
    u, v = three("a"), three("b")
    cosine = dot_of(u, v) / (F.sqrt(dot_of(u, u)) * F.sqrt(dot_of(v, v)))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return x.groupBy(*keys).agg(F.round(F.min(angle), 4).alias("torsion")).where("torsion is not null")


MODES = ("corner", "edge", "face")


def sharing_histogram(nodes: DataFrame, poly: DataFrame, mode: str = "mode_all") -> DataFrame:
    """(stem, id, corner, edge, face, other): counts over incident polyhedral edges; both ends count, so an edge of a node with its own image counts twice."""
    ends = poly.where(F.col(mode).isNotNull()).select("stem", F.explode(F.array("a", "b")).alias("id"), F.col(mode).alias("m"))
    h = ends.groupBy("stem", "id").agg(*[F.count_if(F.col("m") == k).cast("int").alias(k) for k in MODES], F.count_if(~F.col("m").isin(*MODES)).cast("int").alias("other"))
    return nodes.select("stem", "id").join(h, ["stem", "id"], "left").na.fill(0, [*MODES, "other"])


def sharing_fractions(nodes: DataFrame, poly: DataFrame, mode: str = "mode_all") -> DataFrame:
    """Sharing histograms divided by their totals; zeros without edges."""
    h = sharing_histogram(nodes, poly, mode)
    total = F.greatest(sum((F.col(c) for c in (*MODES[1:], "other")), F.col("corner")), F.lit(1))
    return h.select("stem", "id", *[(F.col(c) / total).alias(c) for c in (*MODES, "other")])

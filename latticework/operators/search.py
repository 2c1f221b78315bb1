"""Subgraph search: templates found in graphs by joins in breadth-first order."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class TemplateNode:
    """Constraints on one node; None means anything."""

    element: str | None = None
    role: str | None = None
    cn: int | None = None
    cn_within: int = 2


@dataclass
class Template:
    """Nodes in breadth-first order from the centre, and edges (i, j, ratio or None, core only)."""

    nodes: list[TemplateNode]
    edges: list[tuple[int, int, float | None, bool]] = field(default_factory=list)
    ratio_within: float = 0.15


def simple_graph(bonds: DataFrame) -> DataFrame:
    """(stem, a, b, n, ratio, core): one edge for each pair, that of the strongest bond, with the number of bonds."""
    g = bonds.where("source <> target").groupBy("stem", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    best = F.max_by(F.struct("ratio", (F.col("sphere") == "core").alias("core")), F.struct(F.coalesce("vw_s", F.lit(0.0)), -F.col("id")))
    return g.agg(F.count(F.lit(1)).cast("int").alias("n"), best.alias("x")).select("stem", "a", "b", "n", "x.ratio", "x.core")


def both_ways(simple: DataFrame) -> DataFrame:
    """Every edge from both ends, in one pass."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = [c for c in simple.columns if c not in ("stem", "a", "b")]
    return simple.select("stem", *rest, F.explode(ends).alias("e")).select("stem", "e.a", "e.b", *rest)


def neighbourhood(simple: DataFrame, centres: DataFrame, hops: int) -> DataFrame:
    """(stem, centre, id, hops): nodes within so many steps of each centre (stem, centre).

    In each step the nodes that the last one reached give their neighbours and stay.
    """
    edges = both_ways(simple).select("stem", F.col("a").alias("id"), F.col("b").alias("next"), F.lit(True).alias("_edge"))
    least = lambda x: x.groupBy("stem", "centre", "id").agg(F.min("hops").alias("hops"))
    seen = least(centres.select("stem", "centre", F.col("centre").alias("id"), F.lit(0).alias("hops")))
    for k in range(1, hops + 1):
        # Graphs may be tables that are dealt by stem: a join with a side for each step and no union leaves them so.
        near = edges.withColumn("hops", F.lit(k - 1))
        own, there = F.struct("id", "hops"), F.struct(F.col("next").alias("id"), F.lit(k).alias("hops"))
        both = F.when(F.col("_edge"), F.array(own, there)).otherwise(F.array(own))
        seen = least(seen.join(near, ["stem", "id", "hops"], "left").select("stem", "centre", F.explode(both).alias("x")).select("stem", "centre", "x.id", "x.hops"))
    return seen


def template_of(spark_rows: list, edges: list, any_sphere: bool = True) -> Template:
    """A template from rows (id, element, role, cn) in breadth-first order and edges (a, b, ratio, core)."""
    at = {r[0]: k for k, r in enumerate(spark_rows)}
    return Template([TemplateNode(r[1], r[2], r[3]) for r in spark_rows], [(at[a], at[b], ratio, core and not any_sphere) for a, b, ratio, core in edges])


def _fits(node: TemplateNode, prefix: str) -> Column:
    tests = [F.lit(True)]
    if node.role is not None:
        tests.append(F.col(f"{prefix}.ion_role") == node.role)
    if node.cn is not None:
        tests.append(F.abs(F.col(f"{prefix}.cn") - node.cn) <= node.cn_within)
    return reduce(lambda a, b: a & b, tests)


def matches(nodes: DataFrame, simple: DataFrame, template: Template, elements: bool = True) -> DataFrame:
    """Induced matches: (stem, n0, n1, ..., score); each column holds the node of that place.

    The centre is a filter, every further node one join with the edges at an
    earlier node; other template edges are semi-joins, and pairs without a
    template edge are anti-joins.  The score averages over places and edges:
    0.4 for the element (1 same, 0.5 same role, 0 else), 0.3 for the
    coordination number (Gaussian, width 2) and 0.3 for the length ratio
    (Gaussian, width ratio_within).
    """
    info = nodes.select("stem", "id", F.struct("element", "ion_role", "cn").alias("x"))
    edges = both_ways(simple).select("stem", F.col("a").alias("p"), F.col("b").alias("q"), "ratio", "core")
    wanted = {tuple(sorted(e[:2])): e for e in template.edges}

    def node(k):
        n = info.select("stem", F.col("id").alias(f"n{k}"), F.col("x").alias(f"x{k}"))
        ok = _fits(template.nodes[k], f"x{k}")
        if elements and template.nodes[k].element is not None:
            ok = ok & (F.col(f"x{k}.element") == template.nodes[k].element)
        return n.where(ok)

    def edge(i, j, e):
        x = edges.select("stem", F.col("p").alias(f"n{i}"), F.col("q").alias(f"n{j}"), F.col("ratio").alias(f"r{i}_{j}"), F.col("core").alias("_core"))
        if e[2] is not None:
            x = x.where(F.col(f"r{i}_{j}").isNull() | (F.abs(F.col(f"r{i}_{j}") - e[2]) <= template.ratio_within))
        return (x.where("_core") if e[3] else x).drop("_core")

    found = node(0)
    for k in range(1, len(template.nodes)):
        back = [i for i in range(k) if (i, k) in wanted]
        if not back:
            raise ValueError("each node of a template must be tied to an earlier one")
        for at, i in enumerate(back):
            found = found.join(edge(i, k, wanted[i, k]), ["stem", f"n{i}"] if at == 0 else ["stem", f"n{i}", f"n{k}"])
        found = found.join(node(k), ["stem", f"n{k}"])
        for i in range(k):
            found = found.where(F.col(f"n{i}") != F.col(f"n{k}"))
            if (i, k) not in wanted:
                found = found.join(edges.select("stem", F.col("p").alias(f"n{i}"), F.col("q").alias(f"n{k}")).distinct(), ["stem", f"n{i}", f"n{k}"], "left_anti")
    gauss = lambda d, width: F.exp(-0.5 * F.pow(d / width, 2))
    marks, closeness = [], []
    for k, n in enumerate(template.nodes):
        element = F.lit(1.0) if n.element is None else F.when(F.col(f"x{k}.element") == n.element, 1.0).when(F.col(f"x{k}.ion_role") == n.role, 0.5).otherwise(0.0)
        cn = F.lit(1.0) if n.cn is None else gauss(F.col(f"x{k}.cn") - n.cn, 2.0)
        marks.append(0.4 * element + 0.3 * cn)
    for (i, j), e in wanted.items():
        closeness.append(F.lit(1.0) if e[2] is None else F.coalesce(gauss(F.col(f"r{i}_{j}") - e[2], template.ratio_within), F.lit(1.0)))
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / len(xs)
    score = mean(marks) + 0.3 * (mean(closeness) if closeness else F.lit(1.0))
    return found.select("stem", *[f"n{k}" for k in range(len(template.nodes))], F.round(score, 4).alias("score"))


def best_matches(found: DataFrame, most: int) -> DataFrame:
    """The best match of each graph, the graphs of the highest scores first."""
    places = [c for c in found.columns if c != "stem"]
    one = found.groupBy("stem").agg(F.max_by(F.struct(*places), F.struct("score", *[-F.col(c) for c in places if c != "score"])).alias("m"))
    return one.select("stem", "m.*").orderBy(F.desc("score"), "stem").limit(most)

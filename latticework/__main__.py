"""Command line: python -m latticework ACTION ...; files in, tables out.

build     CIF files to graph documents (only those that have none yet)
families  graph documents to families, members and mappings
topology  graph documents to topology families and their relations
label     graph documents and labelled prototypes (CSV of label, stem) to labels
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import families, fingerprint, graph
from .plans import workflows
from .sources import cif, graphs, sinks


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("latticework", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    actions = parser.add_subparsers(dest="action", required=True)
    build = actions.add_parser("build")
    build.add_argument("cifs")
    build.add_argument("--proportion", help="element ratio, such as 113, 2:1:4 or 1-1-O3")
    build.add_argument("--existing", help="folder of documents that are there already")
    build.add_argument("--no-rescue", action="store_true")
    fam = actions.add_parser("families")
    fam.add_argument("documents")
    fam.add_argument("--threshold", type=float, default=0.1)
    fam.add_argument("--batch", type=int, default=64)
    top = actions.add_parser("topology")
    top.add_argument("documents")
    top.add_argument("--depth", type=int, default=3)
    label = actions.add_parser("label")
    label.add_argument("documents")
    label.add_argument("prototypes")
    label.add_argument("--accept", type=float, default=0.75)
    label.add_argument("--uncertain", type=float, default=0.5)
    for p in (build, fam, top, label):
        p.add_argument("--out", required=True)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("latticework").getOrCreate()
    if a.action == "build":
        structures = cif.read_structures(spark, a.cifs)
        existing = graphs.read_documents(spark, a.existing) if a.existing else structures.select("stem").limit(0)
        made, failed = workflows.build_missing(structures, existing, a.proportion, rescue=not a.no_rescue)
        sinks.write_json(made, f"{a.out}/graphs")
        sinks.write_csv(failed, f"{a.out}/failures")
        return
    t = graphs.tables(graphs.read_documents(spark, a.documents))
    half = graph.half_bonds(t.bonds)
    if a.action == "families":
        levels = workflows.family_levels(t, l1=a.threshold, batch=a.batch)
        sinks.write_csv(levels["families"].select("stem", "family_id", "family_size", "is_prototype", "prototype", F.round("cost", 6).alias("cost")), f"{a.out}/families")
        sinks.write_csv(sinks.subfamily_table(levels["subfamilies"]), f"{a.out}/subfamilies")
        sinks.write_json(sinks.mapping_json(levels["mappings"]), f"{a.out}/mappings")
    elif a.action == "topology":
        hashes = families.stored(fingerprint.topology_hashes(t.nodes, half, a.depth), "hashes")
        sizes = families.core_bonds_per_unit(t.nodes, t.bonds)
        found = families.stored(families.topology_families(hashes, sizes.join(t.meta.select("stem", "formula"), "stem").withColumn("distortion", F.lit(None).cast("double"))), "topologies")
        relations = families.topology_relations(found, families.promoted_hashes(t.nodes, t.bonds, a.depth), sizes)
        for name, frame in sinks.hierarchy_tables(found, relations, hashes).items():
            sinks.write_csv(frame, f"{a.out}/{name}")
        sinks.gml(found, relations).select("value").coalesce(1).write.mode("overwrite").text(f"{a.out}/gml")
    else:
        wanted = spark.read.csv(a.prototypes, header=True)
        for name, frame in sinks.dataset_tables(workflows.label_by_prototypes(t, wanted, a.accept, a.uncertain), t.meta).items():
            sinks.write_csv(frame, f"{a.out}/{name}")


if __name__ == "__main__":
    main()

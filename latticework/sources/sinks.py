"""Result files: tables of families, mappings and hierarchies.

Sinks write through Spark, so results may be of any size; nested values become
JSON text in CSV files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILY_COLUMNS = (
    "stem", "formula", "trivial_family_id", "is_trivial_prototype", "family_id", "family_size", "is_singleton", "is_prototype", "prototype", "prototype_formula",
    "distortion", "intermetallic", "oxide", "cost_to_prototype", "oxidation", "radius", "cn", "sg_symbol", "sg_number",
)


def family_table(members: DataFrame, families: DataFrame, meta: DataFrame, metrics: DataFrame, averages: DataFrame) -> DataFrame:
    """One row for each material with the columns of FAMILY_COLUMNS.

    members: (stem, trivial_family_id, is_trivial_prototype, family_id,
    cost_to_prototype); families: (family_id, prototype, family_size);
    meta: (stem, formula, sg_symbol, sg_number); metrics: (stem, distortion,
    intermetallic, oxide); averages: maps by element.  Numbers are rounded to
    6 places, averages to 4.
    """
    rounded = lambda c: F.to_json(F.transform_values(c, lambda _, v: F.round(v, 4)))
    proto = meta.select(F.col("stem").alias("prototype"), F.col("formula").alias("prototype_formula"))
    x = members.join(families, "family_id", "left").join(meta, "stem", "left").join(metrics, "stem", "left").join(averages, "stem", "left").join(proto, "prototype", "left")
    x = x.withColumn("is_singleton", F.col("family_size") == 1).withColumn("is_prototype", F.col("stem") == F.col("prototype"))
    x = x.withColumn("distortion", F.round("distortion", 6)).withColumn("cost_to_prototype", F.round("cost_to_prototype", 6))
    for c in ("oxidation", "radius", "cn"):
        x = x.withColumn(c, rounded(F.col(c)))
    return x.select(*FAMILY_COLUMNS)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def family_documents(members: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """One document for each family: members in order of distortion and, if given, each member's mapping to the prototype.

    members: (family_id, prototype, stem, distortion, cost); mappings: (stem_a
    = member, mapping array).
    """
    x = members if mappings is None else members.join(mappings.select(F.col("stem_a").alias("stem"), "mapping"), "stem", "left")
    fields = ["distortion", "stem", "cost"] + ([] if mappings is None else ["mapping"])
    return x.groupBy("family_id", "prototype").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def trivial_table(groups: DataFrame, stems: DataFrame) -> DataFrame:
    """(group, size, stems) by size; fails if a material of `stems` is in no group."""
    lost = stems.join(groups, "stem", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"materials in no group: {[r.stem for r in lost]}")
    return groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("stem")).alias("stems")).orderBy(F.desc("size"), "group")


def subfamily_table(members: DataFrame) -> DataFrame:
    """Members of subfamilies; costs that are infinite or missing are null."""
    finite = F.when(F.col("cost") < float("inf"), F.round("cost", 6))
    return members.select("stem", "family", "subfamily", "sub_prototype", "is_sub_proto", finite.alias("cost")).orderBy("family", "subfamily", "stem")


def gml(families: DataFrame, relations: DataFrame) -> DataFrame:
    """The hierarchy as lines of GML, in order: (n, value); write as text after sorting."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), '"', "'"), F.lit('"'))
    nodes = families.select(F.concat(F.lit("  node [ id "), "family_id", F.lit(" label "), quoted(F.col("prototype")), F.lit(" size "), "size", F.lit(" ]")).alias("value"), F.lit(1).alias("n"), F.col("family_id").alias("k"))
    edges = relations.select(F.concat(F.lit("  edge [ source "), "parent_id", F.lit(" target "), "child_id", F.lit(" added "), "edges_added", F.lit(" ]")).alias("value"), F.lit(2).alias("n"), F.col("child_id").alias("k"))
    spark = families.sparkSession
    frame = spark.createDataFrame([("graph [", 0, 0), ("  directed 1", 0, 1), ("]", 3, 0)], "value string, n int, k int")
    return frame.unionByName(nodes).unionByName(edges).orderBy("n", "k", "value")


def hierarchy_tables(families: DataFrame, relations: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Tables of a hierarchy, to be written as CSV: families, materials (stem, topology) of each, and relations."""
    own = members.join(families.select("topology", "family_id", "prototype"), "topology")
    return {
        "families": families.select("family_id", "prototype", "size", "core_bonds_per_fu", "topology"),
        "materials": own.select("stem", "family_id", (F.col("stem") == F.col("prototype")).alias("is_prototype")),
        "relationships": relations.select("parent_id", "child_id", "edges_added", "edges_added_per_fu"),
    }


def dataset_tables(labels: DataFrame, meta: DataFrame, least: int = 2) -> dict[str, DataFrame]:
    """Tables of labelled materials: the dataset, those that are flagged or ambiguous, and formula types of at least `least` flagged ones as candidates of new families."""
    x = meta.select("stem", "formula", "sg_symbol", "sg_number").join(labels, "stem")
    finite = F.round("score", 6).alias("score")
    flagged = x.where("status = 'flagged' or ambiguous")
    candidates = flagged.where("status = 'flagged'").groupBy("formula").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("stem")), ";").alias("stems"))
    return {
        "dataset": x.select("stem", "formula", "sg_symbol", "sg_number", "label", finite, "status", "ambiguous"),
        "flagged_materials": flagged.select("stem", "formula", "label", finite, F.round("second", 6).alias("second"), "status", "ambiguous"),
        "candidate_families": candidates.where(F.col("size") >= least),
    }


def mapping_json(rows: DataFrame) -> DataFrame:
    """(stem_a, stem_b, json): mappings as versioned JSON; read back by mapping_rows()."""
    entry = F.struct("a_id", "slot", "b_id", "slot_kind")
    m = rows.groupBy("stem_a", "stem_b").agg(F.array_sort(F.collect_list(entry)).alias("slots"))
    return m.select("stem_a", "stem_b", F.to_json(F.struct(F.lit(2).alias("version"), "slots"), {"ignoreNullFields": "false"}).alias("json"))


def mapping_rows(documents: DataFrame, text: str = "json") -> DataFrame:
    """Rows of mappings from versioned JSON; other versions fail."""
    parsed: Column = F.from_json(text, "version int, slots array<struct<a_id:int,slot:int,b_id:int,slot_kind:string>>")
    x = documents.withColumn("_m", parsed).withColumn("_ok", F.when(F.col("_m.version") == 2, True).otherwise(F.raise_error(F.lit("not a mapping of version 2")).cast("boolean")))
    return x.where("_ok").select("stem_a", "stem_b", F.explode("_m.slots").alias("s")).select("stem_a", "stem_b", "s.*")


def flat_mappings(results: DataFrame) -> DataFrame:
    """Results of matching as maps from id to id and lists of atoms without partners: (stem_a, stem_b, cost, k, node_map, unassigned_a)."""
    real = F.filter("mapping", lambda m: m["slot_kind"] == "real")
    first = F.map_from_entries(F.array_distinct(F.transform(F.array_sort(real), lambda m: F.struct(m["a_id"].cast("string").alias("a"), F.array_sort(F.transform(F.filter(real, lambda x: x["a_id"] == m["a_id"]), lambda x: x["b_id"])).alias("b")))))
    return results.select("stem_a", "stem_b", F.round("cost", 6).alias("cost"), "k", first.alias("node_map"), F.transform(F.filter("mapping", lambda m: m["slot_kind"] != "real"), lambda m: m["a_id"]).alias("unassigned_a"))


def minerals(text: DataFrame) -> DataFrame:
    """(key, name, formula, spacegroup) from script text rows (value): assignments of mineral_keys, mineral_data_array (fields parted by ||) and cellparams (by |).

    The space group of a mineral is the commonest of its cells.
    """
    pair = lambda name: F.arrays_zip(F.regexp_extract_all("value", F.lit(rf"{name}\['([^']+)'\]\s*=\s*'[^']*'"), F.lit(1)).alias("k"), F.regexp_extract_all("value", F.lit(rf"{name}\['[^']+'\]\s*=\s*'([^']*)'"), F.lit(1)).alias("v"))
    rows = lambda name: text.select(F.explode(pair(name)).alias("p")).select(F.col("p.k").alias("key"), F.col("p.v").alias("v"))
    names = rows("mineral_keys").withColumnRenamed("v", "name")
    fields = F.split("v", r"\|\|")
    data = rows("mineral_data_array").select("key", F.coalesce(F.nullif(F.get(fields, F.lit(12)), F.lit("")), F.get(fields, F.lit(3))).alias("formula"))
    cells = rows("cellparams").select("key", F.trim(F.get(F.split("v", r"\|"), F.lit(16))).alias("sg")).where("sg <> ''").groupBy("key").agg(F.mode("sg", True).alias("spacegroup"))
    return names.join(data, "key", "left").join(cells, "key", "left")

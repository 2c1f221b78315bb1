"""A training corpus from `documents` in five stages.

Each stage works on every document that the one before it kept, and all but
the last return the columns of documents.  Stages judge rows, not ids: rows
with a null id, or with an id that others have too, are dropped as copies or
as contaminated like any other, and none is dropped for what another row of its
id holds.  Of rows of one text a single one stays, that of the smallest id (a
null id is larger than all others).  Secrets are redacted in every row.  Very
long texts are judged whole; other columns, whatever their names, are kept.
Empty inputs give empty outputs.

No stage shuffles texts that it only passes on: what to drop is a stored
table, which Spark sends to the rows where its size allows, and only rows with
a candidate of a secret are joined.

run() returns what the mix takes of each document; training_corpus() returns
the texts with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontaminate, language_id, mixing, near_dedup, secret_scan
from latticework.llm.shared import stored, table

#: Texts whose lead is a smaller share of what the learned texts of their language reach are of no language at all.
LEAST_LEAD = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no known language."""
    model = language_id.fit(language_id.learning_rows(docs.select("doc_id", "text", "lang")))
    judged = language_id.predict(docs, model, docs.columns, pred="_lang_pred", score="_lang_score", ahead="_lang_lead")
    return judged.where(f"_lang_pred <> 'und' and _lang_lead >= {LEAST_LEAD}").select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that names their rows, and its name: the id where it is one row's alone.

    Other rows are named by id and text, by numbers of 2**62 and more; of those that agree in both, one
    stays, but for texts without words, which nobody can tell from each other and which are all kept.
    """
    name = _free(docs, "own_id")
    loose = stored(docs.groupBy(F.col("doc_id").alias("loose_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or loose_id is null").select("loose_id"), "pipeline-loose-ids")
    if loose.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    same = F.col("doc_id").eqNullSafe(F.col("loose_id"))
    single = docs.join(loose, same, "left_anti").withColumn(name, F.col("doc_id").cast("long"))
    others = docs.join(loose, same, "left_semi").withColumn(name, F.expr("(xxhash64(doc_id, text) & 4611686018427387903L) | 4611686018427387904L"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return single.unionByName(others.where(~worded)).unionByName(others.where(worded).dropDuplicates([name])), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate class."""
    named, own = _by_row(docs)
    copies = near_dedup.near_duplicates(named.select(F.col(own).alias("doc_id"), "text")).where("not kept")
    dropped = stored(copies.select(F.col("doc_id").alias(own)).distinct(), "pipeline-copies")
    return named.join(dropped, own, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a phrase of the benchmark: a matter of their texts, whose hashes are searched for ids."""
    name, text = _free(docs, "text_hash"), F.xxhash64(F.coalesce("text", F.lit("")))
    found = decontaminate.decontaminate(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    dropped = stored(found.where("contaminated").select(F.col("doc_id").alias(name)).distinct(), "pipeline-contaminated")
    return docs.withColumn(name, text).join(dropped, name, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces owner-specific secrets in the texts; widely copied examples stay."""
    return secret_scan.redact(docs, owner="source", length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: Kernels, sketches and index searches are not SQL; stages and run() are tested in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages but the last leave, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, size, source_size, target and taken of each that stays."""
    return STAGES[-1][1](spark, _kept(spark, sf_dir), sf_dir)


def training_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, redacted, with `taken` (words, repeats counted)."""
    docs, own = _by_row(_kept(spark, sf_dir))
    mixed = mixing.mix(docs.select(F.col(own).alias("doc_id"), "text", "source")).where("taken > 0")
    return docs.join(mixed.select(F.col("doc_id").alias(own), F.col("taken").alias(_free(docs, "taken"))), own).drop(own)

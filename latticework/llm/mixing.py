"""Mixing of sources to target weights by Sainte-Lague apportionment.

Method: a mix is made of blocks of BLOCK words.  Targets share the words by
weight, stopped at CAP times a source's size, the excess being shared anew by
weight.  Seats, one a block, go to sources by the highest quotients
target / (seats + 1/2), and each source's seats go in the same way to its
shards by their sizes.  A shard is a salted part of one source of about
SHARD_DOCS documents, so a source that holds a third of all rows is many
shards.  In a shard, documents lie in seeded order on a line of words cut into
blocks; every block is taken quotient many times, and a seeded run of blocks,
closed to a ring, makes up the rest of the quota.

All of it is DataFrame expressions; only sums by source and shard are windowed
over, and documents are ordered within their shard alone.

Defined results: null and empty texts have size 0 and give 0 words; a null
source is a source of its own, ordered last; rows with a null id are drawn by
their text; repeated rows count each; equal quotients go to the first source or
shard; no rows give no rows, and no words give zero targets.  A very long text
may be taken in part, by blocks.  Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

BLOCK = 8
CAP = 3
SHARD_DOCS = 4096
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds weight and target to (source, source_size): the capped shares of all words.

    With sources ordered by size / weight, those capped come first; the level
    (words for each unit of weight) of the others follows from running sums.
    """
    weight = ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double")
    all_rows = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    x = sources.withColumn("weight", weight)
    x = x.withColumn("level", (F.sum("source_size").over(all_rows) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that its cap doesn't stop fixes the level of all that follow.
    x = x.withColumn("place", F.row_number().over(by_ratio))
    x = x.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.struct("place", "level"))).over(all_rows)["level"])
    share = F.least(F.col("level") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return x.select("source", "source_size", "weight", F.coalesce(share, F.lit(0.0)).alias("target"))


def apportion(rows: DataFrame, claim: str, house: str, by: list[str], order: list[str], seats: str) -> DataFrame:
    """Sainte-Lague: adds `seats` so that each group's seats are its `house`, by the highest quotients claim / (k + 1/2).

    With n claimants in a group, a claimant's seats differ from its exact
    share p of the house by p n / 2 + 1 at most, so only the quotients of that
    range compete: at most about 3 n rows a group.
    """
    group = Window.partitionBy(*by)
    x = rows.withColumn("_all", F.sum(claim).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    share = F.when(F.col("_all") > 0, F.col(claim) / F.col("_all")).otherwise(0.0)
    x = x.withColumn("_share", share).withColumn("_room", F.ceil(F.col("_share") * F.col("_n") / 2) + 1)
    exact = F.col("_share") * F.col(house)
    x = x.withColumn("_sure", F.greatest(F.floor(exact) - F.col("_room"), F.lit(0)).cast("long")).withColumn("_most", F.when(F.col("_share") > 0, F.ceil(exact) + F.col("_room")).otherwise(F.lit(0)).cast("long"))
    x = x.withColumn("_left", F.col(house) - F.sum("_sure").over(group))
    bids = x.where("_most > _sure").select(*by, *order, "_left", F.col(claim).alias("_claim"), F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"))
    quotient = F.col("_claim") / (F.col("_k") + F.lit(0.5))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in order], "_k"))
    keys = [*by, *order]
    won = bids.withColumn("_rank", rank).where("_rank <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won")).select(*[F.col(c).alias(f"_{c}") for c in keys], "_won")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return x.join(won, same, "left").select(*[x[c] for c in rows.columns], (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(seats))


def _draw(seed: int):
    """A seeded number of a row: by its id, or by its text where it has none."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.col("drawn"))


def mix(docs: DataFrame, block: int = BLOCK, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source)."""
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).alias("drawn")
    docs = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "source", drawn)
    parts = docs.groupBy("source", F.pmod(_draw(seed), F.lit(1 << 20)).alias("slot")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    shards_of = F.ceil(F.col("n_docs") / SHARD_DOCS).cast("long").alias("n_shards")
    shares = targets(sources.select("source", "source_size"), cap)
    seats = shares.withColumn("house", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")).withColumn("whole", F.lit(0))
    seats = apportion(seats, "target", "house", ["whole"], ["source"], "blocks").select(F.col("source").alias("_source"), "source_size", "target", "blocks")
    named = sources.select(F.col("source").alias("_source"), shards_of)
    plan = seats.join(named.withColumnRenamed("_source", "_named"), F.col("_source").eqNullSafe(F.col("_named"))).drop("_named")

    shard = F.pmod(F.col("slot"), F.col("n_shards")).alias("shard")
    cells = parts.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    cells = cells.select("source", "source_size", "target", "blocks", "n_shards", shard, "words").groupBy("source", "source_size", "target", "blocks", "n_shards", "shard").agg(F.sum("words").alias("cell"))
    cells = apportion(cells, "cell", "blocks", ["source"], ["shard"], "quota")
    own = F.xxhash64("source", "shard", F.lit(seed))
    cells = cells.withColumn("n_blocks", F.ceil(F.col("cell") / block).cast("long"))
    cells = cells.withColumn("times", F.when(F.col("n_blocks") > 0, F.expr("quota div n_blocks")).otherwise(F.lit(0)))
    cells = cells.withColumn("extra", F.when(F.col("n_blocks") > 0, F.col("quota") % F.col("n_blocks")).otherwise(F.lit(0)))
    cells = cells.withColumn("start", F.when(F.col("n_blocks") > 0, F.pmod(own, F.col("n_blocks"))).otherwise(F.lit(0)))
    # The run of extra blocks [start, start + extra) on the ring: one or two ranges of words.
    first, last = F.col("start") * block, F.least((F.col("start") + F.col("extra")) * block, F.col("cell"))
    wrap = F.least(F.greatest(F.col("start") + F.col("extra") - F.col("n_blocks"), F.lit(0)) * block, F.col("cell"))
    cells = cells.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "times", first.alias("first"), last.alias("last"), wrap.alias("wrap"))

    slot = F.pmod(_draw(seed), F.lit(1 << 20))
    placed = docs.withColumn("slot", slot).join(named, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source", "drawn", shard)
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "drawn", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    out = placed.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    overlap = lambda a, b: F.greatest(F.least("end", b) - F.greatest("begin", a), F.lit(0))
    extra = overlap(F.col("first"), F.col("last")) + overlap(F.lit(0), F.col("wrap"))
    taken = F.least(F.col("times") * F.col("size") + extra, cap * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

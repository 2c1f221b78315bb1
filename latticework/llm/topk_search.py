"""Exact top-k search in Hamming space by incremental multi-index hashing.

Method: a vector's code is the signs of its components.  Codes are cut into
segments of about log2(n) bits, with a table of rows by value for each.  A
query looks up, for radius 0, 1, ..., all values within that distance of its
segments; once radius r is done for all m segments, every row at a Hamming
distance below m (r + 1) has been met, so the search stops as soon as the kth
verified distance is below that, which makes the answer exact.

Rows are packed into index blocks and queries into query blocks; each pair of
blocks is one search with a result of k rows a query, and these are merged.
No pair of single rows is ever a row of the plan.

Defined results: ties go to the smaller id; a query with fewer than k rows
gets all of them; null vectors have no code and are left out, null ids are
rows (answered as 2**63 - 1) but never queries; null components and missing ones count as not
positive; repeated rows are answered each; no rows or no queries give no rows.
A very long vector is as wide as its components, all of which count in
op5_topk_search; its SQL compares the first DIMENSIONS components.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, stored, table
from .tokens import ids

K = 10
INDEX_ROWS = 1 << 17
QUERY_ROWS = 512
DIMENSIONS = 64
_PACKED = "block long, ids binary, codes binary"


def codes_of(column, dimensions: int) -> np.ndarray:
    """Sign bits of the vectors of a list column, in rows of bytes."""
    flat = column.flatten()
    values = np.asarray(flat.fill_null(0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False))
    lengths = np.diff(np.asarray(column.offsets))
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = np.zeros((len(column), -(-dimensions // 64) * 64), bool)
    fits = at < dimensions
    bits[row[fits], at[fits]] = values[fits] > 0
    return np.packbits(bits, axis=1, bitorder="little")


def _packer(dimensions: int, size: int):
    def run(batches):
        held, n = [], 0

        def row():
            own, codes = (np.concatenate(x) for x in zip(*held))
            name = int.from_bytes(hashlib.blake2b(own.tobytes() + codes.tobytes(), digest_size=8).digest(), "big", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], ["block", "ids", "codes"])

        for batch in batches:
            own, codes = ids(batch.column(0)), codes_of(batch.column(1), dimensions)
            for at in range(0, len(own), size):
                held.append((own[at : at + size], codes[at : at + size]))
                n += len(held[-1][0])
                if n >= size:
                    yield row()
                    held, n = [], 0
        if n:
            yield row()

    return run


class MultiIndex:
    """Tables by segment over codes, for exact searches."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes.view(np.uint64).reshape(len(codes), -1)
        self.bits = 8 * codes.shape[1]
        self.width = int(min(16, max(4, np.floor(np.log2(max(len(codes), 2))))))
        self.segments = [(a, min(self.width, self.bits - a)) for a in range(0, self.bits, self.width)]
        self.tables = []
        for a, w in self.segments:
            value = self._segment(self.codes, a, w)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << w) + 1))))

    @staticmethod
    def _segment(codes: np.ndarray, a: int, w: int) -> np.ndarray:
        low = codes[:, a // 64] >> np.uint64(a % 64)
        if a % 64 + w > 64:
            low = low | codes[:, a // 64 + 1] << np.uint64(64 - a % 64)
        return (low & np.uint64((1 << w) - 1)).astype(np.int64)

    def search(self, query: np.ndarray, k: int, names: np.ndarray) -> list[tuple[int, int]]:
        """The k smallest (distance, name) of one query (a row of words)."""
        met = np.zeros(len(self.codes), bool)
        rows, distances = [], []
        values = [int(self._segment(query[None], a, w)[0]) for a, w in self.segments]
        near = 0
        for radius in range(self.width + 1):
            new = []
            for (order, begins), (_, w), value in zip(self.tables, self.segments, values):
                if radius <= w:
                    probe = value ^ _flips(w, radius)
                    first, sizes = begins[probe], begins[probe + 1] - begins[probe]
                    hit = np.flatnonzero(sizes)
                    first, sizes = first[hit], sizes[hit]
                    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    new.append(order[np.repeat(first, sizes) + step])
            new = np.unique(np.concatenate(new))
            new = new[~met[new]]
            met[new] = True
            distance = np.bitwise_count(self.codes[new] ^ query[None]).sum(1, dtype=np.int64)
            rows.append(new)
            distances.append(distance)
            reach = len(self.segments) * (radius + 1)
            near = sum(int((d < reach).sum()) for d in distances)
            if near >= k:
                break
        rows, distances = np.concatenate(rows), np.concatenate(distances)
        best = np.lexsort((names[rows], distances))[:k]
        return list(zip(distances[best].tolist(), names[rows[best]].tolist()))


_FLIPS: dict = {}


def _flips(width: int, radius: int) -> np.ndarray:
    if (width, radius) not in _FLIPS:
        _FLIPS[width, radius] = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
    return _FLIPS[width, radius]


def _searcher(k: int):
    def run(batches):
        built = None, None
        for batch in batches:
            for names, codes, asked, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                own, asked = np.frombuffer(names, np.int64), np.frombuffer(asked, np.int64)
                # Pairs of one index block often follow each other.
                if built[0] != (names, codes):
                    built = (names, codes), MultiIndex(np.frombuffer(codes, np.uint8).reshape(len(own), -1))
                wanted = np.frombuffer(wanted, np.uint64).reshape(len(asked), -1)
                found = [(q, v, d) for q, w in zip(asked.tolist(), wanted) for d, v in built[1].search(w, k, own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "distance"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = K, dimensions: int = DIMENSIONS) -> DataFrame:
    """query_id, rank, vec_id, distance: the k rows nearest to each query, both (vec_id, embedding)."""
    slots = partitions(rows.sparkSession)
    pick = lambda d: d.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    index = stored(pick(rows).mapInArrow(_packer(dimensions, INDEX_ROWS), _PACKED), "hamming-index").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    asked = pick(queries).where("vec_id is not null").mapInArrow(_packer(dimensions, QUERY_ROWS), _PACKED)
    asked = asked.select(F.explode(F.expr(f"sequence(0L, {slots - 1}L)")).alias("slot"), F.col("block").alias("query_block"), F.col("ids").alias("asked"), F.col("codes").alias("wanted"))
    # Each pair of blocks is a unit of work of its own; those of one index block follow each other.
    pairs = index.join(asked, "slot").repartition(slots, "block", "query_block").sortWithinPartitions("block").select("ids", "codes", "asked", "wanted")
    near = pairs.mapInArrow(_searcher(k), "query_id long, vec_id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return search(rows, rows.where("vec_id % 100 = 0"), dimensions=max(DIMENSIONS, longest))


ORACLE = f"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: CASE WHEN q.bits[i] <> r.bits[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM c q, c r WHERE q.vec_id % 100 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM o WHERE rank <= {K}"""

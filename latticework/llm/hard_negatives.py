"""Hard negatives for anchors of labelled embeddings.

Method: k-means inverted lists.  Centroids are fitted on a bounded sample (the
SAMPLE rows of the smallest hash, CLUSTERS centroids at most); every row is
then put into the list of its nearest centroid, in index blocks of INDEX_ROWS
rows at most, which store for each list its radius, the largest distance of a
member from the centroid.  By the inequality of Cauchy and Schwarz an inner
product of an anchor a with a member lies within |a| times the radius of its
product with the centroid.  A search visits lists in order of that upper bound,
skips those that cannot reach the wanted window of scores, and stops where the
bound falls strictly below the kth score found, so ties are met and the answer
is exact: recall is 1.

Two searches follow one another: the best rows of the anchor's own label
(positives), then, for the window that each positive sets, the best rows of
other labels.  Blocks of anchors are sent to the index blocks, one copy for
each, while index blocks stay whole in one task; each pair of blocks returns at
most k rows for an anchor and window, and these are merged by a window
function.  No pair of rows that is not an answer of a block is ever a row.

A row's components are floor(256 x) as integers.  Products are made by floating
point matrices where all of them are below 2**53, which is exact, else by
integers.  Defined results: rows with a null id, label or vector, or with a null
or non-finite component, take no part; shorter vectors count as filled up with
zeros; rows of the anchor's id are never its positives or negatives; repeated rows count each
as candidates, but equal anchors are answered once; ties go to the smaller id;
without positives or negatives an anchor has no rows, and no rows give none.
A very long vector is as wide as the matrices of one block of rows.  Scores
beyond a long are undefined.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mapped, partitions, stored, table

SCALE = 256
ANCHOR_STEP = 50
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of the positive's score between which a negative's must lie.
LEAST, MOST = 50, 95
SAMPLE, CLUSTERS, ROUNDS = 16384, 128, 8
INDEX_ROWS, ANCHOR_ROWS = 1 << 16, 512
_EXACT = float(1 << 53)


def kmeans(points: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds, from evenly spaced rows of it; clusters that lose all rows stay."""
    centres = points[np.linspace(0, len(points) - 1, clusters).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(points, centres)
        count = np.bincount(own, minlength=clusters)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (points @ centres.T), 1)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten())
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = values
    return out


def _name(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "big", signed=True)


def _bytes(batch: list[tuple], kinds: list, names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*batch), kinds)], names)


_LISTS = "block long, ids binary, labels binary, vectors binary, begins binary, radii binary"


def _pack_lists(centres: np.ndarray):
    """Index blocks: rows by list, then id, with where each list begins and its radius."""
    names = [c.split()[0] for c in _LISTS.split(", ")]
    kinds = [pa.int64()] + [pa.binary()] * 5
    clusters, width = centres.shape

    def block(parts):
        ids, labels, vectors = (np.concatenate(x) for x in zip(*parts))
        own = nearest(vectors, centres)
        order = np.lexsort((ids, own))
        ids, labels, vectors, own = ids[order], labels[order], vectors[order], own[order]
        begins = np.searchsorted(own, np.arange(clusters + 1))
        far = np.sqrt(((vectors - centres[own]) ** 2).sum(1))
        radii = np.array([far[a:b].max(initial=0.0) for a, b in zip(begins[:-1], begins[1:])])
        raw = [x.tobytes() for x in (ids, labels, vectors, begins.astype(np.int64), radii)]
        return _bytes([(_name(*raw[:3]), *raw)], kinds, names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            at = 0
            while at < len(ids):
                to = min(len(ids), at + INDEX_ROWS - n)
                held.append((ids[at:to], labels[at:to], vectors[at:to]))
                n, at = n + to - at, to
                if n == INDEX_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


_ANCHORS = "block long, keys binary, ids binary, labels binary, vectors binary, low binary, high binary"
_NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _pack_anchors(width: int, windows: int):
    """Blocks of anchors (key, id, label, vector, scores of positives); a window without a positive is empty."""
    names = [c.split()[0] for c in _ANCHORS.split(", ")]
    kinds = [pa.int64()] + [pa.binary()] * 6

    def bounds(scores):
        low, high = np.full((len(scores), max(windows, 1)), 1), np.full((len(scores), max(windows, 1)), 0)
        if not windows:
            low[:], high[:] = _NONE
        for i, own in enumerate(scores):
            for j, p in enumerate(own or ()):
                low[i, j], high[i, j] = -(-LEAST * p // 100), MOST * p // 100
        return low, high

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHOR_ROWS):
                part = batch.slice(at, ANCHOR_ROWS)
                raw = [part.column(i).to_numpy().tobytes() for i in range(3)] + [_matrix(part.column(3), width).tobytes()]
                raw += [x.tobytes() for x in bounds(part.column(4).to_pylist())]
                yield _bytes([(_name(*raw), *raw)], kinds, names)

    return run


class Lists:
    """An index block, for searches."""

    def __init__(self, centres, ids, labels, vectors, begins, radii, exact: bool):
        self.centres, self.exact = centres, exact
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(len(self.ids), -1).astype(np.float64 if exact else np.int64)
        self.begins, self.radii = np.frombuffer(begins, np.int64), np.frombuffer(radii)
        self.filled = np.flatnonzero(np.diff(self.begins))

    def search(self, ids, labels, vectors, low, high, k: int, same: bool):
        """Flat answers (anchor's row, window, score, id): the k best of each window."""
        windows = low.shape[1]
        middle = vectors.astype(np.float64) @ self.centres.T
        reach = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))[:, None] * self.radii
        slack = 1 + 1e-9 * (np.abs(middle) + reach)
        top, bottom = middle + reach + slack, middle - reach - slack
        least = np.full((len(ids), windows), -np.inf)
        best = [np.empty(0, np.int64)] * 3
        order = self.filled[np.argsort(-top[:, self.filled].max(0), kind="stable")] if len(ids) else self.filled
        own = vectors.astype(self.vectors.dtype)
        for c in order.tolist():
            reached = top[:, c, None]
            wanted = (reached >= least) & (reached >= low) & (bottom[:, c, None] <= high)
            rows = np.flatnonzero(wanted.any(1))
            if not len(rows):
                # Every window's kth score, or its lower end, is above what this list can hold.
                continue
            a, b = self.begins[c : c + 2]
            scores = own[rows] @ self.vectors[a:b].T
            fits = ((labels[rows, None] == self.labels[a:b]) == same) & (ids[rows, None] != self.ids[a:b])
            found = [best]
            for w in range(windows):
                row, column = np.nonzero(fits & wanted[rows, w, None] & (scores >= np.maximum(low[rows, w], least[rows, w])[:, None]) & (scores <= high[rows, w, None]))
                found.append((rows[row] * windows + w, scores[row, column].astype(np.int64), self.ids[a:b][column]))
            if sum(len(f[0]) for f in found[1:]):
                best, least = self._best(*(np.concatenate(x) for x in zip(*found)), k, least)
        return best[0] // windows, best[0] % windows, best[1], best[2]

    @staticmethod
    def _best(slot, score, name, k, least):
        order = np.lexsort((name, -score, slot))
        slot, score, name = slot[order], score[order], name[order]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        full = rank == k - 1
        least = least.copy()
        least.ravel()[slot[full]] = score[full]
        keep = rank < k
        return (slot[keep], score[keep], name[keep]), least


_FOUND = "key long, anchor_id long, window int, score long, vec_id long"


def _searcher(centres: np.ndarray, k: int, same: bool, exact: bool):
    def run(batches):
        held, slot = [], None
        for batch in batches:
            for own, kind, *raw in zip(*(c.to_pylist() for c in batch.columns)):
                if own != slot:
                    held, slot = [], own
                if kind == 0:
                    held.append(Lists(centres, *raw[:5], exact))
                    continue
                keys, ids, labels = (np.frombuffer(x, np.int64) for x in raw[:3])
                vectors, low, high = (np.frombuffer(x, np.int64).reshape(len(ids), -1) for x in raw[3:6])
                for lists in held:
                    row, window, score, name = lists.search(ids, labels, vectors, low, high, k, same)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[row]), pa.array(ids[row]), pa.array(window, pa.int32()), pa.array(score), pa.array(name)], [c.split()[0] for c in _FOUND.split(", ")]
                    )

    return run


class Index:
    """Inverted lists over rows (vec_id, label, v), stored in the shared folder."""

    def __init__(self, rows: DataFrame):
        self.rows, spark = rows, rows.sparkSession
        stats = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
        self.width, self.exact = max(stats[0] or 1, 1), (stats[1] or 0) < _EXACT
        sample = rows.select("v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()["v"].combine_chunks()
        points = _matrix(sample, self.width) if len(sample) else np.zeros((1, self.width), np.int64)
        self.centres = kmeans(points, max(1, min(CLUSTERS, len(points) // 8)))
        self.lists = stored(mapped(rows.select("vec_id", "label", "v"), _pack_lists(self.centres), _LISTS), "inverted-lists")
        self.slots = max(1, self.lists.select("block").count())
        self.tasks = max(partitions(spark), self.slots)

    def search(self, anchors: DataFrame, k: int, same: bool, windows: int) -> DataFrame:
        """The k best rows of each anchor (key, vec_id, label, v, scores) and window; ranked from 1."""
        lists = self.lists.select(F.pmod("block", F.lit(self.slots)).alias("slot"), F.lit(0).alias("kind"), "ids", "labels", "vectors", "begins", "radii", F.lit(None).cast("binary").alias("high"))
        asked = mapped(anchors.select("key", "vec_id", "label", "v", "scores"), _pack_anchors(self.width, windows), _ANCHORS)
        asked = asked.select(F.explode(F.expr(f"sequence(0L, {self.slots - 1}L)")).alias("slot"), F.lit(1).alias("kind"), *[F.col(c).alias(n) for c, n in zip(_ANCHORS.replace(" binary", "").split(", ")[1:], ("ids", "labels", "vectors", "begins", "radii", "high"))])
        # Each slot's index blocks come first, then the anchors pass by.
        both = lists.unionByName(asked).repartition(self.tasks, "slot").sortWithinPartitions("slot", "kind")
        found = mapped(both, _searcher(self.centres, k, same, self.exact), _FOUND)
        rank = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (integers) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: bad(x.cast("double"))))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both of (vec_id, label, v)."""
    index = Index(rows)
    anchors = anchors.withColumn("key", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["key"])
    asked = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    positives = stored(index.search(asked, POSITIVES, True, 0).select("key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    found = index.search(anchors.join(scores, "key"), NEGATIVES, False, POSITIVES)
    found = found.select("key", "anchor_id", (F.col("window") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(positives, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("vec_id") % ANCHOR_STEP == 0))


ORACLE = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) AS k FROM d WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, s AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN d USING (anchor_id) WHERE NOT same AND 100 * s BETWEEN {LEAST} * positive_score AND {MOST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""

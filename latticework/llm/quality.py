"""Quality classifier: Naive Bayes support vectors.

Method: a text is the set of its n-grams: hashed words, and runs of one to
three word shapes (case, last character, length, whether a word or a run of
three repeats).  For each n-gram the log ratio of its counts in both classes
is taken over all labelled learning rows; indicators are scaled by these
ratios, and a linear model with hinge loss is fitted by dual coordinate
descent on about SAMPLE labelled rows, chosen by a hash of the ids, of which a
class of few rows gets up to half.  A
logistic curve, fitted on a part of the sample that the model hasn't seen,
turns margins into scores.

Counts are made per task before they are summed by n-gram; the driver gets one
row for each of DIMENSIONS n-grams and the sample's n-grams.  The sample's ids
are the only table that is sent to all tasks; where a class is drawn more than
the other, the curve weighs its rows less.

Defined results: null and empty texts have no n-grams and get the score of the
model's constant; documents without a label aren't learned from; several
labels of one id count as the smallest; null ids are never learned from;
without two classes to learn, scores are the share of label 1 (0.5 without any
label).  Repeated rows are scored each, alike; of very long texts all n-grams
count; no rows give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .tokens import AS_IS, LOWER, SPACED, Words, chunks, mix, run_hash

DIMENSIONS = 1 << 16
SAMPLE = 6000
PENALTY = 4.0
ROUNDS = 15
THRESHOLD = 0.7
_U = np.uint64

_KIND = np.full(256, 6, np.uint64)
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[[46, 44, 59, 58]] = 4
_KIND[[33, 63]] = 5


def _shapes(words: Words) -> np.ndarray:
    """A code for the look of each word."""
    first, last = _KIND[words.data[words.starts]], _KIND[words.data[words.ends - 1]]
    length = words.ends - words.starts
    second = _KIND[words.data[np.minimum(words.starts + 1, words.ends - 1)]]
    code = ((first * _U(8) + second) * _U(8) + last) * _U(4) + np.minimum(length, 4).astype(np.uint64) - _U(1)
    return code


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each distinct n-gram of a chunk, ordered."""
    owner, n = words.owner(), len(words.starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = np.zeros(n, np.uint64)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.zeros(n, np.uint64)
    at, runs = words.runs(3)
    mine = mix(owner[at].astype(np.uint64)) ^ runs
    _, back, often = np.unique(mine, return_inverse=True, return_counts=True)
    again[at] = np.minimum(often[back], 4)
    code = mix((_shapes(words) * _U(2) + same) * _U(8) + again)
    parts = [(owner, mix(words.hashes ^ _U(1)))]
    for k in (1, 2, 3):
        h = run_hash(code, k)
        whole = owner[: n - k + 1] == owner[k - 1 :] if n >= k else np.zeros(0, bool)
        parts.append((owner[: len(whole)][whole], mix(h[: len(whole)][whole] ^ _U(k << 8))))
    keys = np.unique(np.concatenate([o.astype(np.uint64) * _U(DIMENSIONS) + (h >> _U(48)) for o, h in parts]))
    return (keys // _U(DIMENSIONS)).astype(np.int64), (keys % _U(DIMENSIONS)).astype(np.int64)


def _gram_lists(batches):
    for batch in batches:
        for at, n, data, offsets in chunks(batch.column(1)):
            owner, gram = grams(Words(data, offsets, SPACED, AS_IS))
            cut = np.searchsorted(owner, np.arange(n + 1))
            gram = gram.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([gram[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], [batch.schema.names[0], "grams"])


def _counted(batches):
    """Of a task: for each n-gram the number of texts of either class."""
    sums = np.zeros((2, DIMENSIONS), np.int64)
    texts = np.zeros(2, np.int64)
    for batch in batches:
        for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[label][np.frombuffer(raw, np.uint16)] += 1
            texts[label] += 1
    seen = np.flatnonzero(sums.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(sums[0][seen], texts[0]), pa.int64()), pa.array(np.append(sums[1][seen], texts[1]), pa.int64())], ["gram", "n0", "n1"])


def descend(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights by n-gram (ratios included) and the constant."""
    w, constant = np.zeros(DIMENSIONS), 0.0
    scaled = []
    for r in rows:
        x = ratios[r]
        scaled.append(x / max(np.sqrt(x @ x), 1e-9))
    dual = np.zeros(len(rows))
    drawn = np.random.Generator(np.random.PCG64(5))
    balance = {y: len(labels) / (2 * max(1, (labels == y).sum())) for y in (-1, 1)}
    for _ in range(rounds):
        for i in drawn.permutation(len(rows)):
            x, y, at = scaled[i], labels[i], rows[i]
            gradient = y * (w[at] @ x + constant) - 1
            new = min(max(dual[i] - gradient / 2.0, 0.0), penalty * balance[y])
            if new != dual[i]:
                step = (new - dual[i]) * y
                w[at] += step * x
                constant += step
                dual[i] = new
    return w, constant


def _margin(raw: np.ndarray, ratios, weights, constant) -> float:
    x = ratios[raw]
    return float(weights[raw] @ x / max(np.sqrt(x @ x), 1e-9) + constant)


def logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the curve that turns margins into shares of label 1 (smoothed targets), of rows that stand for `weights` rows each."""
    weights = np.ones(len(labels)) if weights is None else weights * len(labels) / weights.sum()
    up, down = weights[labels > 0].sum(), weights[labels <= 0].sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        off = weights * (p - target)
        g = np.array([off @ margins, off.sum()])
        s = weights * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[s @ margins**2, s @ margins], [s @ margins, s.sum()]]) + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(max(a, 1e-3)), float(b)


def log_ratios(counts0: np.ndarray, counts1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Of each n-gram, the log ratio of its smoothed shares of both classes' texts."""
    return np.log((counts1 + 1) / (n1 + 2)) - np.log((counts0 + 1) / (n0 + 2))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model of docs (doc_id, text) and labels (doc_id, label 0 or 1): ratios, weights, constant, slope, shift."""
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").cast("int").alias("label"))
    learn = docs.where("doc_id is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    labels = labels.where("pmod(crc32(cast(doc_id as string)), 4) <> 2")
    # Labels grow with the documents, so their join is the same shuffle at every size.
    joined = learn.mapInArrow(_gram_lists, "doc_id long, grams binary").join(labels.hint("shuffle_hash"), "doc_id").select("label", "grams")
    counts = joined.mapInArrow(_counted, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    texts = counts[counts.gram < 0]
    n0, n1 = int(texts.n0.sum()), int(texts.n1.sum())
    if not n0 or not n1:
        share = 0.5 if n0 + n1 == 0 else n1 / (n0 + n1)
        return np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, 1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    sums = np.zeros((2, DIMENSIONS))
    seen = counts[counts.gram >= 0]
    sums[0][seen.gram], sums[1][seen.gram] = seen.n0, seen.n1
    ratios = log_ratios(sums[0], sums[1], n0, n1)
    # About `sample` ids by their hash, as many of either class as it has, up to a half, or what the other leaves.
    fewer = min(n0, n1, sample // 2)
    shares = [min(1.0, (sample - fewer if n > min(n0, n1) else fewer) / n) for n in (n0, n1)]
    spread = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30))
    drawn = labels.where(spread < F.when(F.col("label") == 0, F.lit(int(shares[0] * (1 << 30)))).otherwise(F.lit(int(shares[1] * (1 << 30)))))
    rows = learn.join(F.broadcast(drawn), "doc_id").select("label", "text").mapInArrow(_gram_lists, "label int, grams binary").toPandas().sort_values(["label", "grams"])
    y = np.where(rows["label"].to_numpy() > 0, 1, -1)
    x = [np.frombuffer(g, np.uint16).astype(np.int64) for g in rows["grams"]]
    stands = 1 / np.where(y > 0, shares[1], shares[0])
    apart = np.arange(len(x)) % 4 == 0
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart = np.zeros(len(x), bool)
    weights, constant = descend([r for r, a in zip(x, apart) if not a], ratios, y[~apart])
    test = apart if apart.any() else ~apart
    margins = np.array([_margin(r, ratios, weights, constant) for r, a in zip(x, test) if a])
    return ratios.astype(np.float32), weights.astype(np.float32), constant, *(logistic(margins, y[test], stands[test]) if len(margins) else (1.0, 0.0))


def _scored(ratios, weights, constant, slope, shift):
    product, square = (ratios * weights).astype(np.float64), (ratios.astype(np.float64)) ** 2

    def run(batches):
        for batch in batches:
            scores = [np.empty(0)]
            for _, n, data, offsets in chunks(batch.column(1)):
                owner, gram = grams(Words(data, offsets, SPACED, AS_IS))
                up = np.bincount(owner, weights=product[gram], minlength=n)
                norm = np.sqrt(np.bincount(owner, weights=square[gram], minlength=n))
                margin = up / np.maximum(norm, 1e-9) + constant
                scores.append(1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(*model), "doc_id long, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    held_out = F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 4) = 2, false)").alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language identification by string kernels.

Method: a text is the set of its n-grams of 1 to 4 bytes (blended spectrum,
presence only), after folding case and turning all that is no letter into
spaces, hashed to DIMENSIONS.  The kernel of two texts is the size of the
intersection over the root of the product of sizes.  LANDMARKS texts of each
language span a Nystroem approximation, in which one ridge regression for each
language against the rest is fitted on at most SAMPLE texts of each language.
As the kernel is linear in the presence vector up to the texts' sizes,
landmarks and regression fold into one matrix; scoring is a product of a batch
of presence vectors with it.

How far a text stands out is its best score less the mean of the others, as a
share of what the learned texts of that language reach; unlike the softmax it
does not fall with the number of languages.

Every language is learned.  The sample is bounded and taken by a hash of the
ids over all learning rows; with more than ROWS / SAMPLE languages each has
fewer texts (LEAST_ROWS at least) and with more than MARKS / LANDMARKS fewer
landmarks.  What travels to the driver is presence bits, 2 KB for each text.
Its memory is MARKS vectors (128 MB), two square matrices of MARKS (64 MB) and,
for each language, 64 KB of the result and 24 KB of presence bits.

Defined results: a text that is null or has no letter is `und` with score 0;
with nothing to learn from, all are `und`; of languages of equal score the
first by name is predicted.  Null ids count as held in; repeated rows are
predicted each; a very long text is one presence vector of all of it.  No rows
give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, table
from .tokens import LOWER, chunks

DIMENSIONS = 1 << 14
LENGTHS = (1, 2, 3, 4)
LANDMARKS = 64
SAMPLE = 256
RIDGE = 1e-2
SHARPNESS = 4.0
#: Sample texts and landmarks of all languages together.
ROWS, MARKS = 8192, 2048
LEAST_ROWS = 12
_BLOCK_ROWS = 128

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not (97 <= _FOLD[b] <= 122)]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of n-gram presence of the texts of a chunk."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMENSIONS, bool)
    if len(data):
        folded = _FOLD[data]
        # Upper case letters of U+00C0 to U+00DE.
        folded[1:] += (((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) * np.uint8(0x20)).astype(np.uint8)
        # Spaces beside spaces tell nothing.
        keep = np.ones(len(data), bool)
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        keep[offsets[:-1][offsets[:-1] < len(data)]] = True
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))[keep]
        folded = folded[keep].astype(np.uint32)
        gram = np.zeros(len(folded), np.uint32)
        for k in LENGTHS:
            m = len(folded) - k + 1
            if m <= 0:
                break
            gram = gram[:m] << np.uint32(8) | folded[k - 1 :]
            whole = owner[:m] == owner[k - 1 :]
            at = ((gram + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) ^ (gram >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 14)
            out[(owner[:m].astype(np.int64) * DIMENSIONS + at)[whole]] = True
    return out.reshape(n, DIMENSIONS)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts of a chunk have a letter; only texts without ASCII letters are decoded."""
    sums = np.append(0, np.cumsum(_LETTER[data], dtype=np.int32))
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _features(batches):
    for batch in batches:
        for at, n, data, offsets in chunks(batch.column(1), rows=_BLOCK_ROWS):
            bits = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([b.tobytes() for b in bits], pa.binary()), batch.column(2).slice(at, n)], ["lang", "bits", "h"])


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows whose language may be learned from: crc32 of the id modulo 5 isn't 0."""
    return docs.where("lang is not null and text is not null and coalesce(pmod(crc32(cast(doc_id as string)), 5) <> 0, true)")


def _unit(bits: np.ndarray) -> np.ndarray:
    """Packed rows of presence as vectors of length 1."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def lead(f: np.ndarray) -> np.ndarray:
    """Of rows of scores: each score less the mean of the others of its row."""
    return f - (f.sum(1, keepdims=True) - f) / max(f.shape[1] - 1, 1)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix (DIMENSIONS x languages) and the languages' mean leads, of docs (doc_id, text, lang); pass learning rows only."""
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0)
    landmarks = max(1, min(LANDMARKS, MARKS // len(names)))
    sample = min(sample, max(LEAST_ROWS, ROWS // len(names)))
    # Twice the share that is wanted, by a hash of the ids, and of these the first by that hash.
    spread = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, 2 * sample / counts[k]) * (1 << 30))) for k in names], "lang string, share long")
    picked = docs.withColumn("h", spread).join(F.broadcast(shares), "lang").where("h < share")
    rows = mapped(picked.select("lang", "text", "h"), _features, "lang string, bits binary, h long").toPandas()
    rows = rows.sort_values(["lang", "h", "bits"]).groupby("lang").head(sample).reset_index(drop=True)
    bits = np.stack([np.frombuffer(b, np.uint8) for b in rows["bits"]])
    own = np.searchsorted(names, rows["lang"])
    # The first texts of each language by hash; with more than MARKS languages, those of an even part of them.
    first = np.flatnonzero(rows.groupby("lang").cumcount().to_numpy() < landmarks)
    marks = first[:: max(1, -(-len(first) // MARKS))]
    x = _unit(bits[marks])
    values, vectors = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])

    def blocks():
        """Nystroem features by blocks of rows, so that many languages don't need all vectors at once."""
        for at in range(0, len(bits), 1024):
            yield slice(at, at + 1024), (_unit(bits[at : at + 1024]) @ x.T).astype(np.float64) @ root

    # A constant feature takes up the share of each language; classes weigh alike.
    weight = (1 / np.bincount(own))[own] * len(rows) / len(names)
    square, product = np.zeros((keep.sum(), keep.sum())), np.zeros((keep.sum(), len(names)))
    for at, phi in blocks():
        y = np.where(own[at][:, None] == np.arange(len(names)), 1.0, -1.0) * weight[at][:, None]
        square += phi.T @ (weight[at][:, None] * phi)
        product += phi.T @ y
    w = np.linalg.solve(square + RIDGE * len(rows) * np.eye(len(square)), product)
    reach = np.concatenate([lead(phi @ w)[np.arange(len(phi)), own[at]] for at, phi in blocks()])
    leads = np.bincount(own, weights=reach) / np.bincount(own)
    return names, (x.T @ (root @ w)).astype(np.float32), np.maximum(leads, 1e-9)


def _predict(names: list[str], matrix: np.ndarray, leads: np.ndarray):
    labels = np.array([*names, "und"], object)

    def run(batches):
        for batch in batches:
            scores, letters = [np.zeros((0, len(names)))], [np.zeros(0, bool)]
            for _, _, data, offsets in chunks(batch.column(1), rows=_BLOCK_ROWS):
                x = presence(data, offsets).astype(np.float32)
                scores.append(x @ matrix / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
                letters.append(has_letter(data, offsets))
            known = np.concatenate(letters) & bool(names)
            best, score, ahead = np.full(batch.num_rows, len(names)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if names:
                f = np.concatenate(scores).astype(float)
                e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                best = np.where(known, f.argmax(1), len(names))
                score = np.where(known, 1 / e.sum(1), 0.0)
                ahead = np.where(known, lead(f).max(1, initial=0) / leads[f.argmax(1)], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(labels[best], pa.string()), pa.array(score), pa.array(ahead)], [*batch.schema.names[1:], "lang_pred", "score", "lead"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], pred: str = "lang_pred", score: str = "score", ahead: str | None = None) -> DataFrame:
    """Columns `keep` of every row of docs (text), then prediction, score and (if named) lead under the given names."""
    rest = [c for c in keep if c != "text"]
    x = docs.select(F.lit(0).alias("_"), "text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[1:])
    out = mapped(x, _predict(*model), f"{kinds}, lang_pred string, score double, lead double")
    own = {c: F.col(f"_{i}").alias(c) for i, c in enumerate(rest)} | {"text": F.col("text")}
    return out.select(*[own[c] for c in keep], F.col("lang_pred").alias(pred), F.col("score").alias(score), *([F.col("lead").alias(ahead)] if ahead else []))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learning_rows(docs.select("doc_id", "text", "lang")))
    held_out = F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 5) = 0, false)").alias("held_out")
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out, "lang_pred", "score")

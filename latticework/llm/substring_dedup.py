"""Removal of word windows that already start in an earlier document.

Method: difference-cover anchors.  Positions p of a document with p mod PERIOD
in COVER are anchors; for any two positions i and j some shift below PERIOD
makes both i + shift and j + shift anchors, so two equal windows of WINDOW
words share an aligned anchor run of WINDOW - PERIOD + 1 words.  Only anchor
runs are hashed and exchanged in the first step.  Runs that two documents
share are extended, within their documents, to the whole windows around them;
of those the smallest document id is found and sent back.

Hashes travel packed: a message is one row per bucket and block of texts,
with its arrays as bytes.  Before sending, each block keeps one entry for a
hash (the smallest id), so a passage that a third of all documents hold costs
one entry a block.  There is a bucket for each BUCKET_BYTES of text, and at
least one for each shuffle partition.  Two windows are one if 96 bits of two
hashes (and the bucket) agree; a document that is told of a window finds it
again by 64 bits.

Defined results: null and empty texts have no words; fewer than WINDOW words
lose nothing; rows of equal id and text are judged alike (only a smaller id
removes); a null id counts as the largest and is returned as null.  A very
long text is judged whole: it is a chunk of its own, in the memory of one task.
No rows give no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, table
from .tokens import AS_IS, SPACED, Words, chunks, ids, mix, run_hash

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task gathers before it sends them, packed by bucket.
FLUSH = 1 << 21
#: Text for which there is one bucket; a bucket is held by one task, in about four times as much memory.
BUCKET_BYTES = 64 << 20
_U = np.uint64
_LOW = (1 << 40) - 1


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the anchor runs of all texts of a chunk."""
    at, hashes = words.runs(ANCHOR)
    first = np.repeat(words.first[:-1], words.counts())[at]
    keep = np.isin((at - first) % PERIOD, COVER)
    return at[keep], hashes[keep]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets)) >> _U(32)


def _key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (_bucket(hashes, buckets) << _U(40)) | (hashes & _U(_LOW))


def _window_key(low: np.ndarray, high: np.ndarray, buckets: int) -> np.ndarray:
    """By which a document finds a window of its own again: of bucket, 40 bits of the first and 56 of the second hash."""
    return _named(_key(low, buckets), high & _U((1 << 56) - 1))


def _named(keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(keys) ^ mix(second ^ _U(0xD1B54A32D192ED03))


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and two hashes of every window of a chunk."""
    at, low = words.runs(WINDOW)
    return at, low, run_hash(words.hashes, WINDOW, 0x9FB21C651E98DF25)[at]


def _least(hashes: np.ndarray, docs: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash (and second hash), then id; true where a hash begins; smallest id of the hash."""
    order = np.lexsort((docs, hashes) if second is None else (docs, second, hashes))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if second is not None:
        x = second[order]
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    smallest = np.repeat(d[begin], np.diff(np.append(begin, len(h))))
    return order, new, smallest


def _packed(docs: np.ndarray, values: np.ndarray, width: int) -> tuple[bytes, bytes, bytes]:
    """Ids (as differences), counts and values of runs of equal id, ordered by id."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    begin = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    counts = np.diff(np.append(begin, len(docs))).astype(np.uint16 if len(docs) < 1 << 16 else np.uint32)
    gaps = np.diff(docs[begin], prepend=0)
    if len(gaps) and 0 <= gaps[1:].min(initial=0) and gaps[1:].max(initial=0) < 1 << 16:
        gaps = gaps[:1].tobytes() + gaps[1:].astype(np.uint16).tobytes()
    else:
        gaps = gaps.tobytes()
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return gaps, counts.tobytes(), np.ascontiguousarray(raw[:, :width]).tobytes()


def _unpacked(gaps: bytes, counts: bytes, values: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids repeated by their counts, and values filled up to 8 bytes."""
    n = len(values) // width
    counts = np.frombuffer(counts, np.uint16 if n < 1 << 16 else np.uint32)
    if len(gaps) == 8 * len(counts):
        steps = np.frombuffer(gaps, np.int64)
    else:
        steps = np.append(np.frombuffer(gaps[:8], np.int64), np.frombuffer(gaps[8:], np.uint16).astype(np.int64))
    raw = np.zeros((n, -(-width // 8) * 8), np.uint8)
    raw[:, :width] = np.frombuffer(values, np.uint8).reshape(n, width)
    return np.repeat(np.cumsum(steps), counts), raw.view(np.uint64)


_MESSAGE = "bucket int, gaps binary, counts binary, entries binary, told binary"
_PARCEL = "dest int, docs binary, keys binary"
_REPLY = "doc_id long, keys binary"


def _parcels(docs: np.ndarray, keys: np.ndarray, buckets: int):
    """A batch of one row for each destination: a hash part of the ids, with what they are told."""
    to = (mix(docs.view(np.uint64)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((docs, to))
    docs, keys = docs[order], keys[order]
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    # Sorted ids travel as differences, which compress well.
    rows = [(b, np.diff(docs[x:y], prepend=0).tobytes(), keys[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["dest", "docs", "keys"])


def _delivered(batches):
    """One row for each id with all that it is told."""
    docs, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for batch in batches:
        docs += [np.cumsum(np.frombuffer(x, np.int64)) for x in batch.column(1).to_pylist()]
        keys += [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    begin = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.empty(0, np.int64)
    ends = np.append(begin[1:], len(docs))
    for at in range(0, len(begin), 4096):
        x, y = begin[at : at + 4096], ends[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(docs[x], pa.int64()), pa.array([keys[i:j].tobytes() for i, j in zip(x, y)], pa.binary())], ["doc_id", "keys"])


class _Sender:
    """Gathers (hash, second hash, id) and sends them by bucket, one entry for each hash."""

    def __init__(self, buckets: int, width: int, extended: bool):
        self.buckets, self.width, self.extended = buckets, width, extended
        self.parts, self.held = [], 0

    def add(self, hashes, docs, second=None):
        self.parts.append((hashes, docs, second))
        self.held += len(hashes)
        if self.held >= FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        hashes, docs = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        second = np.concatenate([p[2] for p in self.parts]) if self.extended else None
        self.parts, self.held = [], 0
        if self.extended:
            second &= _U((1 << 56) - 1)
        order, new, smallest = _least(hashes, docs, second)
        h, d = hashes[order], docs[order]
        # Ids that share a hash inside this block are told at once; windows only tell the larger ids.
        if self.extended:
            known = d > smallest
        else:
            several = np.zeros(len(h), bool)
            differs = d != smallest
            begin = np.flatnonzero(new)
            if len(begin):
                several = np.repeat(np.add.reduceat(differs, begin) > 0, np.diff(np.append(begin, len(h))))
            known = several
        keys = _key(h, self.buckets)
        names = _named(keys, second[order]) if self.extended else keys
        told = np.stack([d[known].view(np.uint64), names[known]], 1)
        h, d, keys = h[new], d[new], keys[new]
        bucket = _bucket(h, self.buckets).astype(np.int64)
        entries = keys & _U(_LOW)
        if self.extended:
            # 5 bytes of the first hash, then 7 of the second.
            second = second[order][new]
            entries = np.stack([entries | second << _U(40), second >> _U(24) & _U(0xFFFFFFFF)], 1)
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        rows = [(b, *_packed(d[x:y], entries[x:y], self.width)) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
        columns = ["bucket", "gaps", "counts", "entries", "told"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        if len(told):
            # What is known already passes through the exchange in even pieces.
            to = [r[0] for r in rows]
            told = told[np.argsort(told[:, 0], kind="stable")]
            pieces = np.array_split(told, len(to))
            rows = [(*r, np.stack([np.diff(p[:, 0], prepend=_U(0)), p[:, 1]], 1).tobytes()) for r, p in zip(rows, pieces)]
        else:
            rows = [(*r, b"") for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)


def _send_anchors(buckets: int):
    def run(batches):
        sender = _Sender(buckets, 5, False)
        for batch in batches:
            docs = ids(batch.column(0))
            for at, n, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, SPACED, AS_IS)
                first, hashes = _anchors(words)
                yield from sender.add(hashes, docs[at : at + n][words.owner()[first]])
        yield from sender.flush()

    return run


def _send_windows(buckets: int):
    def run(batches):
        sender = _Sender(buckets, 12, True)
        for batch in batches:
            docs, shared = ids(batch.column(0)), batch.column(2)
            for at, n, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, SPACED, AS_IS)
                owner = words.owner()
                first, hashes = _anchors(words)
                hit = _told(owner[first], _key(hashes, buckets), shared, at, n)
                near = np.zeros(len(words.starts) + 1, np.int64)
                # An anchor at word p extends to the windows that start from p - PERIOD + 1 to p.
                np.add.at(near, np.maximum(first[hit] - PERIOD + 1, words.first[owner[first[hit]]]), 1)
                np.add.at(near, first[hit] + 1, -1)
                where, low, high = _windows(words)
                keep = np.cumsum(near)[where] > 0
                yield from sender.add(low[keep], docs[at : at + n][owner[where[keep]]], high[keep])
        yield from sender.flush()

    return run


def _told(owner: np.ndarray, keys: np.ndarray, column, at: int, n: int) -> np.ndarray:
    """Which (text, key) pairs are among the keys that each text of the chunk was told."""
    lists = [np.frombuffer(x.as_py(), np.uint64) if x.is_valid else np.empty(0, np.uint64) for x in column.slice(at, n)]
    sizes = np.array([len(x) for x in lists])
    if not sizes.sum():
        return np.zeros(len(keys), bool)
    who = np.repeat(np.arange(n), sizes)
    salt = lambda i: mix(i.astype(np.uint64) + _U(11))
    return np.isin(mix(keys) ^ salt(owner), mix(np.concatenate(lists)) ^ salt(who))


def _meet(width: int, extended: bool, buckets: int):
    """Finds, among all messages of a bucket, hashes of several ids; replies to the ids."""

    def run(batches):
        gathered, told = {}, []
        for batch in batches:
            for bucket, gaps, counts, entries, known in zip(*(c.to_pylist() for c in batch.columns)):
                gathered.setdefault(bucket, []).append((gaps, counts, entries))
                if known:
                    pairs = np.frombuffer(known, np.uint64).reshape(-1, 2)
                    told.append(np.stack([np.cumsum(pairs[:, 0], dtype=np.uint64), pairs[:, 1]], 1))
            if told:
                pairs = np.concatenate(told)
                told = []
                yield _parcels(np.ascontiguousarray(pairs[:, 0]).view(np.int64), pairs[:, 1], buckets)
        for bucket in list(gathered):
            parts = [_unpacked(*m, width) for m in gathered.pop(bucket)]
            docs = np.concatenate([p[0] for p in parts])
            values = np.concatenate([p[1] for p in parts])
            keys = values[:, 0] & _U(_LOW)
            # Both hashes make the identity of a window.
            second = values[:, 0] >> _U(40) | values[:, 1] << _U(24) if extended else None
            order, new, smallest = _least(keys, docs, second)
            d = docs[order]
            if extended:
                reply = d > smallest
            else:
                begin = np.flatnonzero(new)
                sizes = np.diff(np.append(begin, len(d)))
                reply = np.repeat(np.add.reduceat(d != smallest, begin) > 0, sizes)
            if reply.any():
                names = keys[order][reply] | (_U(bucket) << _U(40))
                yield _parcels(d[reply], _named(names, second[order][reply]) if extended else names, buckets)

    return run


def _cover(buckets: int):
    """Final rows: counts and digest of what is left of every text."""

    def run(batches):
        for batch in batches:
            shared = batch.column(2)
            out = [[], [], []]
            for at, n, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, SPACED, AS_IS)
                counts, owner = words.counts(), words.owner()
                where, low, high = _windows(words)
                hit = where[_told(owner[where], _window_key(low, high, buckets), shared, at, n)]
                cover = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + WINDOW, -1)
                keep = np.cumsum(cover)[:-1] == 0
                kept = _joined(words, keep)
                out[0] += counts.tolist()
                out[1] += (counts - np.bincount(owner[keep], minlength=n)).tolist()
                out[2] += [hashlib.sha256(t).hexdigest() for t in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return run


def _joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """Kept words of each text, joined by one space."""
    starts, ends = words.starts[keep], words.ends[keep]
    lengths = ends - starts + 1
    total = int(lengths.sum())
    if total == 0:
        return [b""] * (len(words.first) - 1)
    begin = np.cumsum(lengths) - lengths
    source = np.arange(total) + np.repeat(starts - begin, lengths)
    out = np.append(words.data, np.uint8(32))[np.minimum(source, len(words.data))]
    out[begin + lengths - 1] = 32
    raw = out.tobytes()
    per = np.bincount(words.owner()[keep], weights=lengths, minlength=len(words.first) - 1).astype(np.int64)
    to = np.cumsum(per)
    return [raw[a : max(a, b - 1)] for a, b in zip((to - per).tolist(), to.tolist())]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))

    def exchanged(messages, width, extended):
        met = messages.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet(width, extended, buckets), _PARCEL)
        return met.repartitionById(buckets, F.col("dest")).mapInArrow(_delivered, _REPLY).withColumnRenamed("doc_id", "told")

    def with_replies(replies):
        return docs.join(replies.hint("shuffle_hash"), F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("told"), "left").select("doc_id", "text", "keys")

    shared = exchanged(docs.mapInArrow(_send_anchors(buckets), _MESSAGE), 5, False)
    windows = with_replies(shared).where("keys is not null").mapInArrow(_send_windows(buckets), _MESSAGE)
    repeated = exchanged(windows, 12, True)
    return with_replies(repeated).mapInArrow(_cover(buckets), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT s.doc_id, s.i, unnest(range(0, {WINDOW})) AS j FROM s JOIN m USING (k) WHERE m.least < s.doc_id)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS gone FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

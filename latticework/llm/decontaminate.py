"""Benchmark decontamination with a distributed positional inverted index.

Method: the index is partitioned by document.  Each segment, of about a
megabyte of text, holds sorted postings (term, word position) of all words of its
documents and a directory of their ids and lengths; segments are stored as a
table in the shared folder.  A search takes the phrases of the test items,
finds for each segment how often each term occurs there, drops phrases with an
absent term, begins with the postings of a phrase's rarest term, and
intersects the other terms' offset-adjusted lists from rare to frequent.  No
posting is shuffled and no term, however frequent, gathers in one place.

Test items are sent to all tasks in blocks of about ITEM_BYTES of text, one
block after another: the driver holds one block at a time, and a larger
benchmark takes more passes over the same index.  Terms are 64-bit hashes.

Defined results: null or empty texts have no words and no hits; items without
words or with a null id match nothing; repeated items count once by id;
repeated documents are returned each; an empty benchmark gives no hits, and no
documents give no rows.  A very long text is a segment of its own, searched
whole.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, stored, table
from .tokens import ALNUM, LOWER, Words, chunks, run_hash

PHRASE = 10
SEGMENT_BYTES = 1 << 20
ITEM_BYTES = 1 << 20
_INDEX = "segment long, ids binary, nulls binary, lengths binary, terms binary, begins binary, positions binary"
_U = np.uint64


def _segment(number: int, ids: list, lengths: np.ndarray, hashes: np.ndarray) -> list:
    """Postings sorted by term, then position: words are numbered through the segment."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, np.int64)
    terms, begins = hashes[begins], np.append(begins, len(hashes))
    real = np.array([x if x is not None else 0 for x in ids], np.int64)
    nulls = np.array([x is None for x in ids], bool)
    return [number, real.tobytes(), nulls.tobytes(), lengths.astype(np.int64).tobytes(), terms.tobytes(), begins.astype(np.int64).tobytes(), order.astype(np.uint32).tobytes()]


def _index(batches):
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.int64()] + [pa.binary()] * 6
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, n, data, offsets in chunks(batch.column(1), SEGMENT_BYTES):
            lengths, hashes = [], []
            for _, _, part, ends in chunks(batch.column(1).slice(at, n)):
                words = Words(part, ends, ALNUM, LOWER)
                lengths.append(words.counts())
                hashes.append(words.hashes)
            hashes = np.concatenate(hashes)
            row = _segment(number, batch.column(0).slice(at, n).to_pylist(), np.concatenate(lengths), hashes)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(mapped(docs, _index, _INDEX), "positional-index")


class Phrases:
    """Phrases of one length: term hashes by row, and the items that have them."""

    def __init__(self, rows: np.ndarray, items: np.ndarray):
        _, first, same = np.unique(run_hash(rows.ravel(), rows.shape[1])[:: rows.shape[1]], return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same, items], 1), axis=0)
        self.terms, self.column = np.unique(rows[first], return_inverse=True)
        self.column = self.column.reshape(len(first), rows.shape[1])
        self.items, self.begins = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))


def phrases(items: list[tuple[str, str]]) -> tuple[list[str], dict[int, Phrases]]:
    """Names of the items, and by length the phrases."""
    names = sorted({i for i, _ in items})
    rank = {x: k for k, x in enumerate(names)}
    own = np.array([rank[i] for i, _ in items], np.int64)
    found: dict[int, list] = {}
    for at, n, data, offsets in chunks(pa.array([t for _, t in items], pa.string())):
        words = Words(data, offsets, ALNUM, LOWER)
        counts, owner = words.counts(), words.owner()
        for size in np.unique(np.minimum(counts, PHRASE)).tolist():
            if size:
                # Shorter items are one phrase; of the others each run of words is one.
                starts = np.flatnonzero(np.arange(len(owner)) + size <= words.first[1:][owner])
                starts = starts[(counts[owner[starts]] == size) | (size == PHRASE)]
                found.setdefault(size, []).append((words.hashes[starts[:, None] + np.arange(size)], own[at + owner[starts]]))
    return names, {size: Phrases(*(np.concatenate(x) for x in zip(*parts))) for size, parts in found.items()}


def occurrences(terms, begins, positions, keys, firsts, lasts, wanted: Phrases, slop: int = 0):
    """Where phrases occur in a segment: row of `wanted` and position of the first word.

    keys are terms and positions as one number; firsts and lasts bound the
    document of a position.  With slop, each word may stand up to so many
    words from its place, within its document.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(terms):
        return none
    at = np.minimum(np.searchsorted(terms, wanted.terms), len(terms) - 1)
    size = wanted.column.shape[1]
    rows = np.flatnonzero((terms[at] == wanted.terms)[wanted.column].all(1))
    if not len(rows):
        return none
    rank = at[wanted.column[rows]]
    often = begins[rank + 1] - begins[rank]
    order = np.argsort(often, axis=1, kind="stable")
    rare = np.take_along_axis(rank, order[:, :1], 1)[:, 0]
    sizes = begins[rare + 1] - begins[rare]
    row = np.repeat(np.arange(len(rows)), sizes)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = positions[np.repeat(begins[rare], sizes) + step].astype(np.int64)
    start = at - order[row, 0]
    low, high = firsts[at], lasts[at]
    fits = (start + slop >= low) & (start + size - slop <= high)
    row, start, low, high = row[fits], start[fits], low[fits], high[fits]
    for k in range(1, size):
        if not len(row):
            return none
        place = start + order[row, k]
        term = rank[row, order[row, k]].astype(np.int64) << 32
        where = np.searchsorted(keys, term | np.maximum(place - slop, low))
        good = keys[np.minimum(where, len(keys) - 1)]
        good = (where < len(keys)) & (good <= (term | np.minimum(place + slop, high - 1)))
        row, start, low, high = row[good], start[good], low[good], high[good]
    return rows[row], start


def _searcher(block: list[tuple[str, str]], slop: int):
    def run(batches):
        names, wanted = phrases(block)
        for batch in batches:
            for k in range(batch.num_rows):
                number, *raw = (c[k].as_py() for c in batch.columns)
                ids, nulls, lengths, terms, begins, positions = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, bool, np.int64, np.uint64, np.int64, np.uint32)))
                ends = np.cumsum(lengths)
                firsts, lasts = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
                keys = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(begins)) << 32 | positions
                hit, pairs = np.zeros(len(firsts) + 1, np.int64), []
                for size, own in wanted.items():
                    row, start = occurrences(terms, begins, positions, keys, firsts, lasts, own, slop)
                    if not len(row):
                        continue
                    place = np.maximum(start, 0)
                    np.add.at(hit, place, 1)
                    np.add.at(hit, np.minimum(start + size, len(firsts)), -1)
                    owner = np.searchsorted(ends, np.minimum(place, len(firsts) - 1), "right")
                    # Each occurrence counts for every item that has the phrase.
                    seen = np.unique(np.stack([owner, row], 1), axis=0)
                    many = own.begins[seen[:, 1] + 1] - own.begins[seen[:, 1]]
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    pairs.append(np.unique(np.repeat(seen[:, 0], many) * len(names) + own.items[np.repeat(own.begins[seen[:, 1]], many) + step]))
                words = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
                owner = np.searchsorted(ends, words, "right")
                cut = np.searchsorted(owner, np.arange(len(ids) + 1))
                words = words - (ends - lengths)[owner]
                pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
                of = np.searchsorted(pairs // max(1, len(names)), np.arange(len(ids) + 1))
                item = [names[i] for i in (pairs % max(1, len(names))).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=nulls),
                        pa.array(np.full(len(ids), number), pa.int64()),
                        pa.array(np.arange(len(ids)), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(words, pa.int64())),
                        pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(item, pa.string())),
                    ],
                    ["doc_id", "segment", "row", "n_words", "hits", "items"],
                )

    return run


_FOUND = "doc_id long, segment long, row long, n_words long, hits array<long>, items array<string>"


def item_blocks(items: DataFrame):
    """The items (id as string, text) in blocks of about ITEM_BYTES of text, each small enough to send."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES) or 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, [tuple(r) for r in block.collect()]


def search(docs: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """doc_id, n_words, hits (word positions inside phrases of items), items of every row of docs.

    slop 0 finds exact phrases; more finds proximity matches.
    """
    index, found = build_index(docs), []
    for n, block in item_blocks(items):
        hits = mapped(index, _searcher(block, slop), _FOUND)
        if n == 1:
            return hits.select("doc_id", "n_words", "hits", "items")
        found.append(stored(hits, "positional-hits"))
    # Rows without a hit are told by the first block alone.
    parts = [found[0], *(f.where("size(hits) > 0") for f in found[1:])]
    merged = reduce(DataFrame.unionByName, parts).groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return merged.select("doc_id", "n_words", "hits", "items")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts and digest of the benchmark phrases of every row of docs."""
    found = search(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH w AS (SELECT doc_id, {_WORDS.replace("text", "coalesce(text, '')", 1)} AS w FROM documents),
v AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS k FROM (SELECT item_id, w, least(len(w), {PHRASE}) AS n, unnest(range(1, len(w) - least(len(w), {PHRASE}) + 2)) AS i FROM v WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM q),
s AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, z WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, q.item_id FROM s JOIN q USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

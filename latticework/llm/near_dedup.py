"""Near-duplicate classes of documents by SetSketch registers.

Method: a document's set of word shingles is sketched by REGISTERS registers,
each the exponentially spaced, truncated minimum floor(1 - log_b x) of the
shingles' exponential hash values; registers of two parts of a set merge by
their maximum.  Bands of equal register values give candidates.  The Jaccard
similarity of a candidate pair is estimated by maximum likelihood from the
counts of larger, smaller and equal registers together with both set sizes;
pairs that are almost surely below the threshold are dropped, and the others
are confirmed on the full sets of both texts.

Documents of equal sets are one group before anything else, so thousands of
copies cost one sketch.  Documents that meet in a band are judged by their
sketches alone: first each with the band's smallest id; a band that holds a
document which is implausible with that is cut into blocks, and all its pairs
of blocks are judged.  Plausible pairs (a spanning forest of those of a pair of
blocks) are ties, and the components of ties are families: every pair that
meets and may be linked is in one family, while chains of texts of low
similarity are none.  A family is cut into blocks of documents, and each pair
of blocks is one unit of work that confirms all its plausible pairs on full
sets with array operations and returns a spanning forest of the links, so a
large family of similar texts is spread over many tasks and its pairs are never
rows.  Keys that more than a thousandth of all rows share are joined apart.  A
pair of similarity 0.75 meets in no band with probability
(1 - 0.75**ROWS) ** BANDS < 2e-6.

Defined results: null or empty texts have an empty set and link with nothing;
a text of fewer than SHINGLE words is one shingle; repeated rows are returned
each; rows of one id with different texts are
one document of several sets, so what resembles any of them is linked with the id;
a row whose id is null links with nothing, has a null component and is
kept; pairs of exactly 75 percent are linked.  A very long text is sketched
whole, in the memory of one task.  No rows give no rows.  Other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, hot_join, mapped, stored, table
from .tokens import LOWER, SPACED, Words, chunks, mix, run_hash

SHINGLE = 5
ROWS, BANDS = 5, 50
REGISTERS = ROWS * BANDS
BASE, RATE = 1.001, 20.0
#: Likelihood ratio beyond which a pair counts as surely below the threshold.
SURELY = 32.0
#: Documents, and shingles, of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 400_000
#: Sketches of a block of a band.
BLOCK_SKETCHES = 512
_U = np.uint64


def _sets(words: Words):
    """Sorted distinct shingle hashes of every text of a chunk."""
    at, hashes = words.runs(SHINGLE)
    cut = np.searchsorted(at, words.first)
    for i, n in enumerate(words.counts().tolist()):
        if n >= SHINGLE:
            yield np.unique(hashes[cut[i] : cut[i + 1]])
        elif n:
            yield run_hash(words.hashes[words.first[i] : words.first[i + 1]], n)[:1] ^ _U(n)
        else:
            yield np.empty(0, np.uint64)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, (2, REGISTERS), np.uint64).astype(np.uint32)
    return drawn[0][:, None], drawn[1][:, None] | np.uint32(1)


_XOR, _TIMES = _seeds()


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers (16 bits) of a set of hashes."""
    x = (hashes >> _U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        block = x[None, at : at + 256] ^ _XOR
        block *= _TIMES
        np.minimum(least, block.min(axis=1), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16)


_SKETCH = "doc_id long, n_shingles long, low long, high long, regs binary"


def _sketch(batches):
    for batch in batches:
        n_sets, low, high, regs = [], [], [], []
        for _, _, data, offsets in chunks(batch.column(1)):
            for s in _sets(Words(data, offsets, SPACED, LOWER)):
                n_sets.append(len(s))
                low.append(int(s.sum().view(np.int64)))
                high.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_sets, low, high)), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "low", "high", "regs"]
        )


def log_likelihood(j: np.ndarray, n_a, n_b, more, fewer) -> np.ndarray:
    """Of similarity j, given set sizes and how many registers of a exceed, or fall below, those of b."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    step = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = step(u - v * j), step(v - u * j)
    return more * np.log(up) + fewer * np.log(down) + (REGISTERS - more - fewer) * np.log(np.maximum(1 - up - down, 1e-12))


def _plausible(a, n_a, b, n_b, percent: int) -> np.ndarray:
    """Of sketches a and b, row by row: true unless their similarity is surely below the threshold."""
    n_a, n_b = np.broadcast_to(n_a, len(b)).astype(float), np.broadcast_to(n_b, len(b)).astype(float)
    more, fewer = (a > b).sum(1), (a < b).sum(1)
    least, top = percent / 100, np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    here = log_likelihood(np.minimum(least, top), n_a, n_b, more, fewer)
    below = np.max([log_likelihood(np.minimum(x, top), n_a, n_b, more, fewer) for x in np.linspace(0, least, 16)], axis=0)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (2 * (below - here) <= SURELY)


def plausible(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Matrix over sketches a and b: true unless a pair's similarity is surely below the threshold."""
    out = 100 * np.minimum(n_a[:, None], n_b) >= percent * np.maximum(n_a[:, None], n_b)
    for i in np.flatnonzero(out.any(1)).tolist():
        at = np.flatnonzero(out[i])
        out[i, at] = _plausible(a[i], n_a[i], b[at], n_b[at], percent)
    return out


def _judged(percent: int):
    """Whether the sketches of each row (a, n_a, regs_a, b, n_b, regs_b) are plausible."""

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy().astype(float) for k in (1, 4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 5))
            ok = _plausible(x, n_a, y, n_b, percent) if len(n_a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(ok)], ["a", "b", "ok"])

    return run


def _ties(percent: int):
    """Of each pair of blocks of a band (key, p, q, own, doc_id, n, regs): a spanning forest of the plausible pairs."""

    def forest(rows: list) -> list:
        p, q = rows[0][1:3]
        first = [r for r in rows if r[3] == p]
        rows = [*first, *(r for r in rows if r[3] != p)]
        names, n = [r[4] for r in rows], np.array([r[5] for r in rows], float)
        regs = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, REGISTERS)
        part, group, out = np.array([r[3] for r in rows]), np.arange(len(rows)), []
        # The first of the second block goes first, so that a band of near copies is settled after two rows.
        order = range(len(rows)) if p == q else [*range(len(first), len(rows))[:1], *range(len(first))]
        for i in order:
            other = np.flatnonzero(group != group[i])
            if p != q:
                other = other[part[other] != part[i]]
            if len(other):
                near = other[_plausible(regs[i][None], n[i], regs[other], n[other], percent)]
                _, at = np.unique(group[near], return_index=True)
                out += [(names[i], names[j]) for j in near[at].tolist()]
                group[np.isin(group, group[near])] = group[i]
            if (group == group[0]).all():
                break
        return out

    def run(batches):
        held: list = []

        def done(rows):
            out = forest(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of incidence matrices."""
    both = [*left, *right]
    sizes = [len(x) for x in both]
    _, column, often = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = often > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(shared.sum())
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, width, 4096):
        x, y = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(both), min(4096, width - at)), np.float32)
        part[row[x:y], column[x:y] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def _pairs_of_blocks(percent: int):
    """Links among the documents of each pair of blocks; of links that close a ring one is left out."""

    def links(rows: list) -> list:
        p, q = rows[0][1:3]
        left = [r for r in rows if r[3] == p]
        right = [r for r in rows if r[3] == q] if p != q else left
        if not left or not right or len(rows) < 2:
            return []
        sketch = lambda x: np.frombuffer(b"".join(r[6] for r in x), np.uint16).reshape(-1, REGISTERS)
        n_a, n_b = np.array([r[5] for r in left]), np.array([r[5] for r in right])
        maybe = plausible(sketch(left), n_a, sketch(right), n_b, percent)
        if p == q:
            maybe &= np.tri(len(left), k=-1, dtype=bool)
        a, b = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if not len(a):
            return []
        sets = lambda x: [s for _, _, d, o in chunks(pa.array([r[7] for r in x], pa.string())) for s in _sets(Words(d, o, SPACED, LOWER))]
        common = _common(sets([left[i] for i in a]), sets([right[i] for i in b]))
        linked = maybe[np.ix_(a, b)] & (100 * common >= percent * (n_a[a][:, None] + n_b[b] - common))
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in np.argwhere(linked).tolist():
            x, y = left[a[i]][4], right[b[j]][4]
            if find(x) != find(y):
                root[find(x)] = find(y)
                out.append((x, y))
        return out

    def run(batches):
        held: list = []

        def done(rows):
            out = links(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return run


def ties(reps: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a, b) of reps (doc_id, n_shingles, regs) whose components hold every plausible pair that meets in a band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * F.lit(2 * ROWS) + F.lit(1), F.lit(2 * ROWS))))
    bands = reps.select("doc_id", F.explode(keys).alias("key"))
    crowded = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("hub < last")
    crowded = stored(crowded.select("key", "hub", "n"), "near-bands")
    met = stored(hot_join(bands, crowded, ["key"], crowded).where("doc_id <> hub"), "near-met")

    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    pairs = met.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    # A hub is in no more pairs than its bands have members.
    most = crowded.groupBy(F.col("hub").alias("b")).agg(F.sum("n").alias("n"))
    hubs = side("b").join(most.select("b"), "b", "left_semi")
    sketched = hot_join(pairs.join(side("a"), "a"), hubs, ["b"], most).select("a", "n_a", "regs_a", "b", "n_b", "regs_b")
    judged = stored(mapped(sketched, _judged(percent), "a long, b long, ok boolean"), "near-judged")

    # Bands with a document that isn't plausible with the hub: all their pairs are judged.
    apart = judged.where("not ok").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"))
    mixed = met.where("n > 2").join(apart, ["doc_id", "hub"]).select("key", "n").distinct()
    members = met.select("key", "doc_id").unionByName(crowded.select("key", F.col("hub").alias("doc_id")))
    cut = F.ceil(F.col("n") / BLOCK_SKETCHES).cast("long")
    units = hot_join(members, mixed, ["key"], mixed).join(reps, "doc_id").withColumn("blocks", cut)
    units = units.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    units = units.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc_id", "n_shingles", "regs")
    units = units.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return judged.where("ok").select("a", "b").unionByName(mapped(units, _ties(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(mapped(docs, _sketch, _SKETCH), "near-sketches")
    linkable = sketches.where("n_shingles > 0 and doc_id is not null")
    same = ["low", "high", "n_shingles"]
    groups = linkable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = stored(linkable.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "regs"), "near-reps")
    families = components(ties(reps, percent), "near-families").select(F.col("node").alias("doc_id"), F.col("label").alias("family"))

    # Every member of a family is the first of its group.
    members = reps.join(families, "doc_id")
    sized = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    rows = hot_join(members, sized.select("family", blocks), ["family"], families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))).join(docs, "doc_id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc_id", "n_shingles", "regs", "text")
    rows = rows.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q")
    labels = components(mapped(rows, _pairs_of_blocks(percent), "a long, b long"), "near-labels")

    of_group = groups.join(labels, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("label", "rep").alias("of"))
    classed = hot_join(linkable.select("doc_id", *same), of_group, same, groups).select("doc_id", "n_shingles", F.col("of").alias("component_id"))
    alone = sketches.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return classed.unionByName(alone).withColumn("kept", F.expr("doc_id <=> component_id"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {SHINGLE - 1}) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(m.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id"""

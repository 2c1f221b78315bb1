"""Secret scans with corpus-wide ownership frequency.

Method: candidates are found in every text; a hash of each candidate's value
is counted over the corpus by distinct repositories and owners.  A value that
more than MAX_OWNERS owners hold is a widely copied example; any other is
owner-specific and looks live.  Counts are summed by (value, owner,
repository), then by (value, owner), then by value; values that more than a
thousandth of all candidates share are joined apart.  So a value that a third
of all documents hold never gathers its rows in one place.

Base kinds (always reported): assign, access, hex.  The method adds spans of
kind token: long mixed runs of token characters outside base spans that look
live by their ownership; without the counts they would be noise.

Texts are read once.  Only rows with a candidate are joined with the counts, by
the number of the row, so ids may be null or repeated; all others pass as they
are.  `redact` replaces the owner-specific spans by a mark.

Defined results: null and empty texts have no spans; null owners are an owner
of their own; rows without an id count as one repository, unless a repository
is given; repeated rows are returned each; of overlapping spans to redact the
union is replaced by one mark.  A very long text is scanned whole, as a chunk
of its own.  No rows give no rows.  Other columns of the input are ignored by
`scan`, whatever their names, and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .shared import hot_join, mapped, stored, table
from .tokens import LOWER, chunks

MAX_OWNERS = 2
REDACTED = "<secret>"
TOKEN_LENGTH = 32
# The base patterns.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = rb"AKIA[A-Z0-9]+"
KINDS = ("assign", "access", "hex", "token")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24


def _table(allowed: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


_HEX = _table(b"0123456789abcdef")
_TOKEN = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of at least so many bytes inside one text."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    # A run may go over the end of a text: cut it there.
    pieces = [(x, y) for s, e in zip(starts.tolist(), ends.tolist()) for x, y in _split(s, e, offsets) if y - x >= least]
    return np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)


def _split(start: int, end: int, offsets: np.ndarray):
    cut = offsets[np.searchsorted(offsets, start, "right") : np.searchsorted(offsets, end, "left")].tolist()
    at = [start, *cut, end]
    return zip(at[:-1], at[1:])


def _found(data: np.ndarray, offsets: np.ndarray):
    """All candidates of a chunk: text, kind, start and end byte, value."""
    raw = data.tobytes()
    lowered = LOWER[data].tobytes()
    out = []
    marked = sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for k in KEYWORDS for m in re.finditer(k, lowered)})
    for i in marked:
        for m in re.finditer(ASSIGN, raw[offsets[i] : offsets[i + 1]], re.IGNORECASE):
            if len(m[2]) >= ASSIGN_LEAST:
                out.append((i, 0, m.start(), m.end(), m[2]))
    for i in sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in re.finditer(b"AKIA", raw)}):
        for m in re.finditer(ACCESS, raw[offsets[i] : offsets[i + 1]]):
            if len(m[0]) >= ACCESS_LEAST:
                out.append((i, 1, m.start(), m.end(), m[0]))
    for kind, inside, least in ((2, _HEX[data], HEX_LEAST), (3, _TOKEN[data], TOKEN_LENGTH)):
        for a, b in zip(*_runs(inside, offsets, least)):
            value = raw[a:b]
            if kind == 3 and not (re.search(rb"[0-9]", value) and re.search(rb"[a-z]", value) and re.search(rb"[A-Z]", value)):
                continue
            i = int(np.searchsorted(offsets, a, "right")) - 1
            out.append((i, kind, int(a - offsets[i]), int(b - offsets[i]), value))
    return out


def _value(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "big", signed=True)


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
_FOUND = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("value", LongType())]))
_NONE = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:bigint,owners:bigint,repositories:bigint,live:boolean>>)"


def _scan(batches):
    """Adds the number of the row and what is found in the text (the first column, which is dropped)."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        found = []
        for _, n, data, offsets in chunks(batch.column(0)):
            spans = [[] for _ in range(n)]
            points = {}
            for i, kind, a, b, value in _found(data, offsets):
                if i not in points:
                    points[i] = np.append(0, np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80))
                p = points[i]
                spans[i].append((int(p[a]), kind, int(p[b]), _value(value)))
            for own in spans:
                base = [(s, e) for s, k, e, _ in own if k < 3]
                own = [x for x in own if x[1] < 3 or not any(s < x[2] and x[0] < e for s, e in base)]
                found.append([{"kind": k, "start": s, "end": e, "value": v} for s, k, e, v in sorted(own)])
        n = len(found)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.arange(row, row + n)), pa.array(found, _SPAN)], [*batch.schema.names[1:], "row", "found"])
        row += n


def _scanned(docs: DataFrame, owner: str, repository: str, keep: list[str]) -> DataFrame:
    """A stored table of row, found, owner, repository, and the columns `keep` as _0, _1, ..."""
    own = [F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]]
    x = docs.select("text", *own)
    kinds = StructType([*x.schema.fields[1:], StructField("row", LongType()), StructField("found", _FOUND)])
    return stored(mapped(x, _scan, kinds), "secret-scan")


def _judged(rows: DataFrame, max_owners: int) -> DataFrame:
    """row and spans (start, kind, end, value, owners, repositories, live) of the rows with a candidate."""
    each = rows.where("size(found) > 0").select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    by_owner = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n")).groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    spread = by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    known = hot_join(each.drop("owner", "repository"), spread, ["value"], spread.select("value", "n")).withColumn("live", F.col("owners") <= max_owners)
    return known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repositories", "live"))).alias("spans"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, owner: str = "owner", repository: str = "doc_id") -> DataFrame:
    """doc_id and spans (start, kind, end, value, owners, repositories, live) of every row of docs (doc_id, text, and the columns named)."""
    rows = _scanned(docs, owner, repository, ["doc_id"])
    some = rows.where("size(found) > 0").select("row", F.col("_0").cast("long").alias("doc_id")).join(_judged(rows, max_owners), "row").select("doc_id", "spans")
    return some.unionByName(rows.where("size(found) = 0").select(F.col("_0").cast("long").alias("doc_id"), F.expr(_NONE).alias("spans")))


def redacted(text: str, spans: list, mark: str = REDACTED) -> str:
    """The text with a mark for the union of each run of overlapping spans (start, end)."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _cut(mark: str):
    def run(batches):
        for batch in batches:
            out = [redacted(t, [(s["start"], s["end"]) for s in spans], mark) for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])

    return run


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS, owner: str = "owner", repository: str = "doc_id", length: str | None = None, mark: str = REDACTED) -> DataFrame:
    """Every row of docs (text and any other columns) without its owner-specific secrets.

    A column `length` is set to the new number of code points where a text changes.
    """
    names, kinds = docs.columns, docs.schema
    rows = _scanned(docs, owner, repository, names)
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(names)]
    live = _judged(rows, max_owners).select("row", F.expr("filter(spans, s -> s.live)").alias("live"))
    at = names.index("text")
    rest = [f"_{i}" for i in range(len(names)) if i != at]
    suspects = rows.where("size(found) > 0").join(live, "row").select(F.col(f"_{at}").alias("text"), F.expr("transform(live, s -> struct(s.start, s.end))").alias("live"), *rest)
    schema = StructType([StructField("text", StringType()), *suspects.select(*rest).schema.fields])
    changed = mapped(suspects.where("size(live) > 0"), _cut(mark), schema)
    if length:
        changed = changed.withColumn(f"_{names.index(length)}", F.length("text").cast(kinds[length].dataType))
    clean = suspects.where("size(live) = 0").select("text", *rest).unionByName(changed.select("text", *rest))
    some = clean.withColumnRenamed("text", f"_{at}").select(*own)
    return rows.where("size(found) = 0").select(*own).unionByName(some)


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')"


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), owner="source")
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(_listed("filter(spans, s -> s.kind < 3)")), 256).alias("base_sha256"),
        F.expr(_listed("filter(spans, s -> s.kind < 3 or s.live)")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> s.live)) as bigint)").alias("n_live"),
        F.expr("array_join(transform(spans, s -> concat(if(s.live, 'live', 'copied'), ':', s.owners, ':', s.repositories)), ',')").alias("ownership"),
    )

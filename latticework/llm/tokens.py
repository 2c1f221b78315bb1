"""Vectorised word splitting and hashing over Arrow text columns.

All word patterns used here are classes of bytes: separators are ASCII, so a
word of a UTF-8 text is a run of bytes and no decoding is needed.  A word hash
has 64 bits: lanes of eight bytes pass one after another through a bijective
mixer, from a state that depends on the length, so different words of up to
eight bytes and equal length never collide; words beyond LONG bytes are hashed
by BLAKE2.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_class(excluded: bytes) -> np.ndarray:
    """Boolean table over bytes: true for those that make up words."""
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


#: Words between white space, and words of ASCII digits, a-z and non-ASCII code points.
SPACED = byte_class(b" \t\n\x0b\x0c\r")
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)

#: Words beyond so many bytes are hashed one by one.
LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) of data, none of which is empty."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _U(0xA0761D6478BD642F))
    at, left = starts, np.where(lengths > LONG, 0, lengths)
    which = np.flatnonzero(left)
    if len(which) < len(starts):
        at, left = at[which], left[which]
    state = out[which]
    while len(which):
        state = mix((state ^ (lanes[at] & _MASKS[np.minimum(left, 8)])) + _U(0x9E3779B97F4A7C15))
        out[which] = state
        more = np.flatnonzero(left > 8)
        which, at, left, state = which[more], at[more] + 8, left[more] - 8, state[more]
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """Words of consecutive texts: byte ranges, hashes, and first word of each text."""

    __slots__ = ("data", "starts", "ends", "first", "hashes", "begin")

    def __init__(self, data, offsets, table, fold, hashed=True):
        """data: bytes; offsets: ends of the texts in it, from 0 on."""
        n = len(data)
        inside = np.zeros(n + 1, bool)
        folded = data if fold is AS_IS else fold[data]
        inside[:n] = table[folded]
        edge = np.empty(n + 1, bool)
        edge[0] = False
        edge[1:] = inside[:-1]
        cut = offsets[(offsets > 0) & (offsets < n)]
        begins = inside & ~edge
        stops = edge & ~inside
        cut = cut[inside[cut] & edge[cut]]
        begins[cut] = True
        stops[cut] = True
        self.data, self.begin = data, offsets
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops)
        self.first = np.searchsorted(self.starts, offsets, "left")
        self.hashes = None
        if hashed:
            self.hashes = word_hashes(folded, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of k words inside one text."""
        n = len(self.starts)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts())
        at = np.flatnonzero(np.arange(n) + k <= last)
        return at, run_hash(self.hashes, k)[at]


def run_hash(hashes: np.ndarray, k: int, seed: int = 0x8CB92BA72F3D8DD7) -> np.ndarray:
    """Hashes of all runs of k values; those that would pass the end are left unspecified."""
    out = np.zeros(len(hashes), np.uint64)
    for i in range(k):
        out *= _U(seed)
        out[: len(hashes) - i] += hashes[i:] if i else hashes
    return mix(out)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    raw = column.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, size: int = CHUNK_BYTES, rows: int = 1 << 30):
    """Parts of a text column of about `size` bytes and at most `rows` rows: first row, row count, bytes, offsets."""
    data, offsets = text_buffers(column)
    n, at = len(column), 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def ids(column) -> np.ndarray:
    """Int64 values of an id column; null counts as the largest."""
    return column.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False).astype(np.int64)

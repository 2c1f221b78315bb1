import math
import random

import numpy as np
import pytest

from latticework.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score double, v string"


def brute(rows):
    """The contract, row by row."""
    own = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = set()
    for a, la, va in own:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in own if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            near = [x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)}
    return out


def rows_of(seed: int, n: int, dims: int = 8) -> list[tuple]:
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(10)]
    rows = [(k, [c + draw.gauss(0, 0.6) for c in centres[(k + draw.randrange(3)) % 10]], k % 10) for k in range(n)]
    for k in range(0, n, 9):  # ties: copies of other rows
        rows[k] = (k, rows[(k * 5 + 3) % n][1], rows[k][2])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 0.5, "b") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("blocks", [False, True])
def test_against_every_pair(spark, tmp_path, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(hn, "INDEX_ROWS", 100)
        monkeypatch.setattr(hn, "ANCHOR_ROWS", 3)
    rows = rows_of(1, 700)
    rows += [(1000, None, 3), (1050, [1.0, None] * 4, 3), (1100, [float("nan")] * 8, 3), (1150, [float("inf")] * 8, 3), (1200, rows[0][1], None), (1250, [0.0] * 8, 4), (1300, [], 5), (1350, [0.5] * 3, 6), (None, rows[1][1], 1)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hn.op13_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) > 50
    assert set(got) == brute(rows)


def test_repeated_rows_and_none(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.9, 0.0], 2), (4, [0.9, 0.0], 2), (5, [0.6, 0.0], 2)]
    p = hn.prepared(frame(spark, rows))
    got = sorted(tuple(r)[:4] for r in hn.mine(p, p.where("vec_id % 50 = 0")).collect())
    assert got == [(50, 3, 1, 4), (50, 3, 2, 4), (50, 3, 3, 5)]
    assert hn.mine(p.limit(0), p.limit(0)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(50, [2.0**20 + 1 / 256, 1.0], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**19, 3.0], 2), (3, [2.0**19, 2.0], 2)]
    p = hn.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = sorted(tuple(r) for r in hn.mine(p, p.where("vec_id % 50 = 0")).collect())
    q = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a], q[b]))
    assert got == [(50, 1, 1, 2, dot(50, 1), dot(50, 2)), (50, 1, 2, 3, dot(50, 1), dot(50, 3))]


def test_lists_stop_early_and_miss_nothing():
    """Bounds let a search leave out lists, and the answer is that of all rows."""
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 4000, (20, 6))
    vectors = np.rint(centres[np.arange(2000) % 20] + draw.normal(0, 40, (2000, 6))).astype(np.int64)
    own = hn.nearest(vectors, centres)
    order = np.argsort(own, kind="stable")
    begins = np.searchsorted(own[order], np.arange(21))
    far = np.sqrt(((vectors - centres[own]) ** 2).sum(1))[order]
    radii = np.array([far[a:b].max(initial=0.0) for a, b in zip(begins[:-1], begins[1:])])
    lists = hn.Lists(centres, order.astype(np.int64).tobytes(), np.zeros(2000, np.int64).tobytes(), vectors[order].tobytes(), begins.astype(np.int64).tobytes(), radii.tobytes(), True)
    seen = []
    lists.vectors = Counting(lists.vectors, seen)
    asked = vectors[:4]
    every = np.tile(np.array([hn._NONE]), (4, 1, 1)).reshape(4, 2)
    row, _, score, name = lists.search(np.arange(4), np.zeros(4, np.int64), asked, every[:, :1], every[:, 1:], 5, True)
    for i in range(4):
        all_scores = sorted((-int(vectors[i] @ v), k) for k, v in enumerate(vectors) if k != i)[:5]
        assert sorted(zip((-score[row == i]).tolist(), name[row == i].tolist())) == all_scores
    assert len(seen) < 10


class Counting:
    """Rows of a matrix, with a note of every slice that is read."""

    def __init__(self, rows, seen):
        self.rows, self.seen, self.dtype = rows, seen, rows.dtype

    def __getitem__(self, part):
        self.seen.append(part)
        return self.rows[part]

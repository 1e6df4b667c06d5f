"""Hard negatives against all pairs in plain Python; Strassen's product against the plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, is_anchor=lambda i: i % 100 == 0):
    good = [(i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, la in good:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, l) for i, v, l in good))
        for ps, p, _ in [s for s in scored if s[2] == la and s[1] != a][:positives]:
            hard = [(s, i) for s, i, l in scored if l != la and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(hard[:negatives])]
    return sorted(out)


def mined(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in N.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, label, **more).collect())


def made(n, dim=6, seed=1, labels=10):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dim)), 1).astype(np.float32) + np.float32(0.3)     # many ties
    return [(i, v[i].tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("group,tile,parts", [(8192, (256, 4096), 3), (2, (1, 16), 4), (3, (2, 7), 1)])
def test_against_all_pairs(spark, monkeypatch, group, tile, parts):
    monkeypatch.setattr(N, "GROUP", group)
    monkeypatch.setattr(N, "TILE", tile)
    rows = made(700, labels=3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit(1) for c in ("v", "no", "anchor", "score")})
    assert mined(df) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(260, 3, 2, 2) + [
        (300, None, 1), (400, [1.0, None, 2.0], 1), (500, [1.0, nan, 2.0], 1), (600, [1.0, -inf, 2.0], 1), (700, [1.0] * 3, None),
        (None, [9.0] * 3, 1), (800, [], 0), (900, [2.0, 1.0], 1), (1001, [2.0, 1.0, 1.0, 5.0], 1), (1100, [2.0] * 9, 0),
        (-100, [1.0, 2.0, 3.0], 1), (301, [1.0, 1.0, 1.0], 1), (301, [1.0, 1.0, 1.0], 1), (302, [2.0, 1.0, 0.0], 0), (302, [0.5, 0.5, 0.0], 0)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_few_rows_and_none(spark):
    for rows in ([], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [2.0], 1)], [(1, [1.0], 1), (2, [2.0], 1)],
                 [(100, [1.0], 1), (101, [2.0], 1), (102, [1.5], 2)], [(100, [1.0], None)]):
        assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_too_large_raises(spark):
    rows = [(100, [1e8], 1), (101, [1e8], 1)]
    with pytest.raises(Exception, match="64-bit"):
        mined(spark.createDataFrame(rows, SCHEMA))


def test_strassen_is_exact():
    rng = np.random.default_rng(5)
    for m, k, n in ((1, 1, 1), (5, 64, 3), (37, 41, 53), (64, 64, 64), (33, 100, 70), (0, 4, 4), (4, 0, 4)):
        a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
        assert (N.strassen(a, b, 4) == a @ b).all()
    big = rng.integers(-(1 << 62), 1 << 62, (40, 40))
    assert (N.strassen(big, np.eye(40, dtype=np.int64), 2) == big).all()       # sums in between overflow


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(7)
    scores, ids = rng.integers(-5, 5, (6, 90)), rng.permutation(90)
    for share in (0.02, 0.5, 1.0):
        mask = rng.random(scores.shape) < share
        heap = np.full((6, 4), N.LOWEST), np.zeros((6, 4), np.int64)
        for cut in (slice(60, 90), slice(0, 13), slice(13, 60)):
            heap = N.merged(heap, N.best(scores[:, cut], mask[:, cut], ids[cut], 4), 4)
        for r in range(6):
            want = sorted((-scores[r, c], ids[c]) for c in np.nonzero(mask[r])[0])[:4]
            assert [(-s, i) for s, i in zip(heap[0][r], heap[1][r]) if s != N.LOWEST] == want

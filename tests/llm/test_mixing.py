"""The mix against its definition: targets by resharing, sizes by splitting, takes near the targets."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm.mixing import fit_lengths, mix_rows, mix_to_weights
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(rows, weights=(5, 2, 1), share=1.5, cap=2):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(size.values()), set(order), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * unit > cap * size[s]}
        if not over:
            out |= {s: w[s] * unit for s in free}
            break
        out |= {s: float(cap * size[s]) for s in over}
        left -= sum(cap * size[s] for s in over)
        free -= over
    return size, out


def check(df, rows):
    got = mix_to_weights(df).collect()
    size, want = targets(rows)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, s, t in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r["size"] * r.repeats and 0 <= r.repeats <= 2
        taken[r.source] += r.taken
    for s in size:
        lengths = [len(WORD.findall(t or "")) for _, x, t in rows if x == s]
        passes = want[s] // size[s] if size[s] else 0
        sums = {0}
        for n in lengths:
            sums |= {v + n for v in sums}
        best = min(abs(v + passes * size[s] - want[s]) for v in sums)
        assert abs(taken[s] - want[s]) <= best + 1, s
    again = mix_to_weights(df.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check(docs, [tuple(r) for r in docs.select("doc_id", "source", "text").collect()])


def test_nulls_repeats_and_one_large_source(spark):
    rows = [(i, "hot", "w " * (i % 9 + 1)) for i in range(400)] + [(i, "é", "x " * 7) for i in range(400, 430)]
    rows += [(500, None, "a b c")] * 3 + [(None, "b", "one two")] * 4 + [(600, "b", None), (601, "b", ""), (602, "void", " "),
                                                                       (603, "long", "y " * 50_000), (604, "Z", "z z z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    check(df.withColumns({c: F.lit(0) for c in ("size", "target", "w", "level", "m", "bucket", "turn")}), rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix_to_weights(df).count() == 0


def test_fit_is_nearest_where_all_is_left_to_it():
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = np.unique(rng.integers(1, 300, rng.integers(1, 12)))
        count = rng.integers(1, 6, len(size))
        budget = int(rng.integers(0, (size * count).sum() + 1))
        take = fit_lengths(size, count, budget, 1)
        assert (take >= 0).all() and (take <= count).all()
        sums = {0}
        for s, c in zip(size.tolist(), count.tolist()):
            sums = {v + s * k for v in sums for k in range(c + 1)}
        assert abs(int((size * take).sum()) - budget) == min(abs(v - budget) for v in sums)


def test_fit_of_a_large_source_is_exact_and_even():
    rng = np.random.default_rng(4)
    size, count = np.arange(1, 2000), rng.integers(1, 400, 1999)
    total = int((size * count).sum())
    take = fit_lengths(size, count, total // 3, 1)
    assert int((size * take).sum()) == total // 3 and (take <= count).all()
    assert (np.abs(take / count - 1 / 3)[count > 100] < 0.02).mean() > 0.9


def test_rows_keep_clashing_columns(spark):
    names = ["__id", "__turn", "__m", "size", "m", "passes", "picked", "repeats"]
    df = spark.createDataFrame([(k, f"s{k % 2}", "a b c") for k in range(40)] + [(1, "s1", "a b c"), (50, None, None), (None, "s0", "")],
                               "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in names})
    out = mix_rows(df)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == 43
    assert all(r.__getitem__("__turn") == "__turn" and (r.text or r.repeats == 0) for r in out.collect())

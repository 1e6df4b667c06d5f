"""Repeated lines against a dictionary of lines; the minimal perfect hash by itself."""

import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import line_dedup as L

EDGE = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in line.strip(EDGE))


def brute(rows, least, min_chars=1):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in held.items() if n >= least and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def dropped(df, *args, **more):
    return sorted((tuple(r) for r in L.drop_repeated_lines(df, *args, **more).collect()), key=str)


def made(n):
    rows = [(i, "\n".join(["  Common Line", f"own {i}", "", f"third {i % 3}", f"pair {i // 2}", "common line\t"][i % 4:]))
            for i in range(n)]
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, "\n\n"), (None, "own 1\nCOMMON LINE"), (None, "common line"), (7, "third 1"),
                   (7, "third 1"), (n + 4, "é common\r\n third 2 \n common line"), (n + 5, "\n".join(["pair 1"] * 20)),
                   (n + 6, "x" * 300_000 + "\nCommon line"), (n + 7, "\n".join(f"many {k % 50}" for k in range(9000)))]


@pytest.mark.parametrize("parts,least,shard_keys,block", [(1, 10, 1 << 17, 1 << 15), (5, 3, 40, 16), (4, 2, 3, 1)])
def test_against_a_dictionary(spark, monkeypatch, parts, least, shard_keys, block):
    monkeypatch.setattr(L, "BLOCK_ROWS", block)
    rows = made(120)
    df = (spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
          .withColumns({c: F.lit(1) for c in ("sha", "marks", "block", "n_lines", "hashes")}))
    assert dropped(df, least, shard_keys=shard_keys) == brute(rows, least)


def test_hot_line_long_counts_and_short_keys(spark):
    rows = [(i, f"Hot\nab\n{'warm' if i % 2 else i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert dropped(df, 300, 3) == brute(rows, 300, 3)      # counts above 255 need wider arrays
    assert dropped(df, 451) == brute(rows, 451)


def test_empty(spark):
    assert dropped(spark.createDataFrame([], "doc_id long, text string")) == []


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2), np.uint64).view(L.HASH).ravel())
        keys["lo"][: n // 3] = 5                            # alike in one half
        keys = np.unique(keys)
        counts = rng.integers(1, 400, len(keys))
        index = L.build_index(keys, counts, 255)
        assert sorted(L.slots(index, keys)) == list(range(len(keys)))
        assert (L.probe(index, keys, 255) == np.minimum(counts, 255)).all()
        foreign = np.unique(rng.integers(1 << 63, (1 << 64) - 1, (2000, 2), np.uint64).view(L.HASH).ravel())
        assert (L.probe(index, foreign, 255) > 0).sum() <= 1
        if n > 10_000:
            assert len(index["bits"]) * 8 < 5 * len(keys)

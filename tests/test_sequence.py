"""Contexts of sequences kept as rows, against lists; cut pieces and long days."""

import random

import pytest
from pyspark.sql import functions as F

from seqforge.operators import sequence as S


def brute(rows, depth):
    seqs = {}
    for s, o, t in sorted(rows):
        seqs.setdefault(s, []).append(t)
    return sorted((s, k, tuple(f[max(0, k - depth):k]), f[k]) for s, ids in seqs.items()
                  for f in [[1, *ids, 2]] for k in range(1, len(f)))


@pytest.mark.parametrize("parts,depth", [(1, 1), (7, 1), (16, 3), (40, 4)])
def test_contexts_over_cut_pieces(spark, parts, depth):
    rng = random.Random(parts)
    sizes = [1, 2, 300, 5, 1, 40, 3, 150, 1]                     # one sequence holds more than half of all rows
    rows = [(s, k, rng.randint(4, 9)) for s, n in enumerate(sizes) for k in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")       # else few rows mean one piece
    try:
        c = S.contexts(spark.createDataFrame(rows, "s long, o long, t long"), "s", ["o"], "t", depth)
        got = sorted((r.s, r.pos, tuple(r.ctx), r.label) for r in c.collect())
        df = spark.createDataFrame(rows, "s long, o long, t long")
        pieces = S.ranged(df, ["s", "o"]).select("s", "_pid").distinct().groupBy("s").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces > parts // 3
    assert got == brute(rows, depth)


def test_a_day_of_120_events_gives_121_pairs(spark):
    day = spark.range(120).select(F.lit(1).alias("s"), F.col("id").alias("o"), (F.col("id") % 5 + 4).alias("t"))
    pairs = S.shift_pairs(day, "s", ["o"], "t").orderBy("pos").collect()
    assert [r.pos for r in pairs] == list(range(1, 122))
    assert pairs[0].input_id == 1 and pairs[-1].label_id == 2 and all(a.label_id == b.input_id for a, b in zip(pairs, pairs[1:]))


def test_empty(spark):
    assert S.contexts(spark.createDataFrame([], "s long, o long, t long"), "s", ["o"], "t", 2).collect() == []

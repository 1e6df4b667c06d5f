"""Positional ids stay exact when files are split across many tasks and many files."""

import pytest
from pyspark.sql import functions as F

from seqforge.operators.rank import dense_index, prefix_offsets
from seqforge.sources.readers import read_lines


def test_line_numbers_with_many_splits(spark, tmp_path):
    d = tmp_path / "lines"
    d.mkdir()
    expected = []
    for f in range(3):
        lines = [f"file{f} line {i} " + "x" * (i % 37) for i in range(2000)]
        (d / f"part-{f:05d}.txt").write_text("\n".join(lines) + "\n")
        expected += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_lines(spark, str(d), "line")
        assert df.rdd.getNumPartitions() > 10
        got = sorted((r.line_no, r.line) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [g[0] for g in got] == list(range(len(expected)))
    assert [g[1] for g in got] == expected


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"},
                                  {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}, {"spark.sql.adaptive.enabled": "false"}])
def test_positions_of_a_million_rows(spark, conf):
    old = {k: spark.conf.get(k) for k in conf} | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    for k, v in ({"spark.sql.shuffle.partitions": "24"} | conf).items():
        spark.conf.set(k, v)
    try:
        n = 1_000_000
        df = spark.range(0, n, 1, 13).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 5).alias("v"),
                                             F.md5(F.col("id").cast("string")).alias("t"))
        got = dense_index(df, ["k"]).agg(F.count("*").alias("n"), F.sum((F.col("k") == F.col("idx")).cast("int")).alias("right")).first()
        assert (got.n, got.right) == (n, n)
        offs = prefix_offsets(df.withColumn("one", F.lit(1)), ["k"], "one", "o")
        assert tuple(offs.agg(F.count("*"), F.sum((F.col("o") == F.col("k")).cast("int"))).first()) == (n, n)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_numbers_in_file_names_count(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    for k in (99_998, 99_999, 100_000):
        (d / f"part-{k}").write_text(f"line of {k}\n")
    assert [r.line for r in read_lines(spark, str(d), "line").orderBy("line_no").collect()] == \
        [f"line of {k}" for k in (99_998, 99_999, 100_000)]


def test_dense_index_and_offsets(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7 % 5000).alias("k"), (F.col("id") % 5).alias("v"))
    idx = {r.k: r.idx for r in dense_index(df, ["k"]).collect()}
    assert [idx[k] for k in sorted(idx)] == list(range(5000))
    offs = {r.k: r.offset for r in prefix_offsets(df, ["k"], "v").collect()}
    vals = {r.k: r.v for r in df.collect()}
    run = 0
    for k in sorted(vals):
        assert offs[k] == run
        run += vals[k]

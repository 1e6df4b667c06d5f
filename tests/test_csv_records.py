"""CSV records over many splits against Spark's own one-task reading of the same file."""

import csv
import random

import pytest

from seqforge.sources.csv_records import csv_header, read_csv
from seqforge.sources.readers import read_corpus_csv

NAMES = ["idx_", "text", "note, quoted", "last"]


def cell(rnd):
    return "".join(rnd.choice(['a', 'bb ', '"', ',', '\n', 'é', '\n\n', '""', ' ']) for _ in range(rnd.randrange(0, 12)))


def write(path, rows, names=NAMES):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL)
        w.writerow(names)
        w.writerows(rows)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_one_file_over_many_splits(spark, small_splits, tmp_path):
    rnd = random.Random(3)
    rows = [[str(i), cell(rnd), cell(rnd), "end"] for i in range(400)]
    rows[200][1] = "line\n" * 900          # one cell over several splits
    path = str(tmp_path / "a.csv")
    write(path, rows)
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    got = read_csv(spark, path, ["last", "idx_", "text", "note, quoted"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(400))
    assert [[r.idx_, r.text or "", r["note, quoted"] or "", r["last"]] for r in got] == rows
    one = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
           .select("idx_", "text", "note, quoted", "last").collect())
    assert [tuple(r)[1:] for r in read_csv(spark, path, NAMES).orderBy("idx").selectExpr("0", *[f"`{n}`" for n in NAMES]).collect()] == \
        [tuple(r) for r in one]


def test_files_in_natural_order_and_headers(spark, small_splits, tmp_path):
    for k in (2, 10, 1):
        write(tmp_path / f"part-{k}.csv", [[f"{k}-{i}", "x\ny", "", "z"] for i in range(30)])
    got = read_csv(spark, str(tmp_path), ["idx_"]).orderBy("idx").collect()
    assert [r.idx_ for r in got] == [f"{k}-{i}" for k in (1, 2, 10) for i in range(30)]
    assert csv_header(spark, str(tmp_path))[1] == NAMES
    with pytest.raises(ValueError, match="not in the header"):
        read_csv(spark, str(tmp_path), ["absent"])
    write(tmp_path / "part-3.csv", [["1", "2", "3", "4"]], NAMES[::-1])
    with pytest.raises(Exception, match="differ in their headers"):
        read_csv(spark, str(tmp_path), ["idx_"]).collect()


def test_blank_lines_line_ends_short_rows_and_no_rows(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes(b'a,b\r\n\r\n1,"x\r\n\r\ny"\r\n\r\n2\r\n,""\r\n')
    got = read_csv(spark, str(path), ["b", "a"]).orderBy("idx").collect()
    assert [(r.idx, r.a, r.b) for r in got] == [(0, "1", "x\r\n\r\ny"), (1, "2", None), (2, None, None)]
    path = tmp_path / "none.csv"
    path.write_text("a,b\n")
    assert read_csv(spark, str(path), ["a"]).collect() == []


def test_corpus_reader_uses_it(spark, small_splits, tmp_path):
    names = ["related_so_question", "annotation", "other", "source_code", "target_api", "api_seq"]
    write(tmp_path / "corpus.csv", [[f"q{i}", "None" if i % 3 else "note\nnote", "-", "code", "api", "a b"] for i in range(60)], names)
    got = read_corpus_csv(spark, str(tmp_path / "corpus.csv"), ["annotation"], na_values="pandas").orderBy("idx").collect()
    assert [r.annotation for r in got] == [None if i % 3 else "note\nnote" for i in range(60)]

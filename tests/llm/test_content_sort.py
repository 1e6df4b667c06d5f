"""Content sort against a dictionary of texts."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from seqforge.llm.content_sort import content_sort_dedup, drop_copies


def brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, taken = [], set()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = pick(ids) if ids else None
        kept = i == keep and (t or "") not in taken
        if kept:
            taken.add(t or "")
        out.append((i, keep, len(groups[t or ""]), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "c"),
        (8, "A"), (9, "é" * 70_000), (10, "é" * 70_000), (11, "é" * 70_000 + "x"), (12, "head " * 20 + "1"),
        (13, "head " * 20 + "2"), (14, "head " * 20 + "1"), (12, "other")]


def test_against_a_dictionary(spark):
    for keep, pick in (("largest", max), ("smallest", min)):
        for parts in (1, 7):
            df = (spark.createDataFrame(ROWS, "doc_id long, text string").repartition(parts)
                  .withColumns({c: F.lit(1) for c in ("sha", "m", "keep_id", "best", "turn")}))
            got = sorted((tuple(r) for r in content_sort_dedup(df, keep).collect()), key=str)
            assert got == brute(ROWS, pick)


def test_large_group_and_small_holds(spark, monkeypatch):
    from seqforge.llm import content_sort
    monkeypatch.setattr(content_sort, "HELD", 40)
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((tuple(r) for r in content_sort_dedup(df, "largest").collect()), key=str) == brute(rows, max)


def test_rows_kept_with_their_columns(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in ROWS], "doc_id long, text string, sha long")
    got = drop_copies(df, "smallest")
    assert got.columns == ["doc_id", "text", "sha"]
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in ROWS})
    assert {r.text or "": r.doc_id for r in got.collect()}["a"] == 1


def test_normalise_and_empty(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string")
    assert [r.keep_id for r in content_sort_dedup(df, "smallest", F.lower).collect()] == [1, 1]
    none = content_sort_dedup(df.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_clashing_names_stay(spark):
    names = ["__stay", "__sha", "sha", "keep_id", "kept", "text_sha256", "___x"]
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "z"), (None, "z")], "doc_id long, text string")
    df = df.withColumns({c: F.lit(c) for c in names})
    out = drop_copies(df, "smallest")
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("1", "a"), ("3", "None"), ("None", "z")]

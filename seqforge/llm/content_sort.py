"""Exact duplicates by content sort.

Method: sampled splitters range-partition the normalised texts, each partition is sorted externally so that
equal texts are neighbours, and neighbours are compared in full. Each input task first collapses the copies
that it holds itself, so a text that fills a third of the table reaches its range as one row a task. Ranges
are cut by the head of the text and its digest: equal texts stay together while texts that only begin alike
spread out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import binaries, free_prefix, from_numpy, two_columns

HELD = 32 << 20            # bytes of different texts that a task collapses at a time
HEAD = 32                  # characters of the text in the range key

RUN = pa.schema([("text", pa.string()), ("best", pa.int64()), ("copies", pa.int64())])
GROUP = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _collapsed(better):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return from_numpy(RUN, pa.array(list(held), pa.binary()).cast(pa.string()),
                              pa.array([v[0] for v in held.values()], pa.int64()),
                              np.array([v[1] for v in held.values()], np.int64))

        for batch in rows:
            for text, doc in zip(binaries(batch.column("text")), batch.column("doc_id").to_pylist()):
                if (was := held.get(text)) is not None:
                    was[0], was[1] = better(was[0], doc), was[1] + 1
                    continue
                held[text] = [doc, 1]
                size += len(text)
                if size >= HELD:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return run


def _neighbours(better):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, best, copies = None, None, None, 0
        for batch in rows:
            done = []
            for text, digest, doc, n in zip(*(binaries(batch.column(0)), *(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                if text == last:
                    best, copies = better(best, doc), copies + n
                    continue
                if last is not None:
                    done.append((sha, best, copies))
                last, sha, best, copies = text, digest, doc, n
            if done:
                yield from_numpy(GROUP, *map(list, zip(*done)))
        if last is not None:
            yield from_numpy(GROUP, [sha], [best], [copies])

    return run


def content_sort_groups(texts: DataFrame, keep: str = "largest") -> DataFrame:
    """(sha, keep_id, group_size): one row for each different text of ``texts`` (doc_id, text without nulls)."""
    better = {"largest": _larger, "smallest": _smaller}[keep]
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (texts.mapInArrow(_collapsed(better), "text string, best long, copies long")
            .withColumn("sha", F.unhex(F.sha2("text", 256)))
            .select("text", "sha", "best", "copies")
            .repartitionByRange(parts, F.substring("text", 1, HEAD), "sha").sortWithinPartitions("text")
            .mapInArrow(_neighbours(better), "sha binary, keep_id long, group_size long"))


def content_sort_dedup(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``, dropped ones too.

    Of equal texts (after ``normalise``, by default as they are) the row with the smallest, or largest,
    identifier stays. A null text counts as empty. Rows without identifier lose to any other; a group of
    only such rows has null ``keep_id`` and keeps one of them. Of rows repeated with the id that stays, one is
    kept. An empty table gives an empty result; other columns are not looked at.
    """
    two = two_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    if normalise:
        two = two.withColumn("text", normalise(F.col("text")))
    groups = content_sort_groups(two, keep)
    # repeated rows travel as one with a count, and are set out again at the end
    rows = (two.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
            .groupBy("doc_id", "sha").agg(F.count("*").alias("m")))
    return (rows.join(groups, "sha").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`content_sort_dedup` keeps, with their columns, whatever those are called.

    Null texts count as empty. Rows without identifier lose to any other; of rows repeated with the id and text that
    stay, one stays (which one, if their other columns differ, is open). An empty table stays empty.
    """
    p = free_prefix(docs)
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    stay = (content_sort_dedup(docs, keep, None, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias(f"{p}stay"), F.col("text_sha256").alias(f"{p}sha")))
    kept = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}stay")) & (sha == F.col(f"{p}sha")))
    return kept.dropDuplicates([f"{p}stay", f"{p}sha"]).drop(f"{p}stay", f"{p}sha")

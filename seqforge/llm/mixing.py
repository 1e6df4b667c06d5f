"""Mixing sources to target weights by subset sums over document lengths.

Method: documents are counted by exact token length; whole passes and an even share of every length come
first, a bounded-knapsack dynamic programme over the lengths that are left closes the rest of each source's
budget to the token, and seeded hashes choose which documents of a length are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import WORD, free_prefix
from seqforge.session import cut_lineage

ROOM = 1 << 16             # tokens of a source that the dynamic programme fits
BUCKETS = 4096             # buckets of the seeded hash within a length


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """source, source_no, source_size, target from (source, size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn. All share ``share`` of all sizes by
    weight; none gets over ``cap`` times its size, and what is over is shared again. That is one level per
    unit of weight, found from running sums in the order in which sources reach their caps. The table has a
    row a source, not a row a document.
    """
    num, den = share
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1)
    all_of = Window.partitionBy()
    by_cap = Window.orderBy("full", "source_no")
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = t.withColumn("w", w).withColumn("full", cap * F.col("source_size") / F.col("w"))
    t = t.withColumn("budget", F.sum("source_size").over(all_of) * num / den)
    t = t.withColumn("before", F.coalesce(F.sum(cap * F.col("source_size")).over(
        by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("heavy", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("budget") - F.col("before")) / F.col("heavy"))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "source_no", "level")))
                     .over(all_of)["level"])
    most = cap * F.col("source_size")
    return t.select("source", "source_no", "source_size",
                    F.when(F.col("level").isNull(), most).otherwise(F.least(F.col("w") * F.col("level"), most))
                    .cast("double").alias("target"))


def fit_lengths(size: np.ndarray, count: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to ``budget``, or nearly.

    All but ``ROOM`` of the budget is an even share of every length; then a bounded knapsack over the documents
    left, lengths in seeded order, finds the nearest sum. It holds a bit for each token left, a number of such
    bits for each step, and stops at the first exact fit.
    """
    total = int((size * count).sum())
    if budget >= total:
        return count.copy()
    even = max(0, budget - ROOM)
    take = np.array([int(c) * even // total for c in count], np.int64)
    left = budget - int((size * take).sum())
    order = sorted(range(len(size)), key=lambda k: xxhash.xxh64_intdigest(str(size[k]), seed))
    for k in order:
        if take[k] < count[k] and size[k] <= left - ROOM:
            take[k] += 1
            left -= int(size[k])
    # bit v of a step's number: v tokens can be filled with the documents up to that step
    steps: list[tuple[int, int, int]] = []
    filled, mask = [1], (1 << (2 * left + 1)) - 1
    for k in order:
        free, part = min(int(count[k] - take[k]), 2 * left // int(size[k])), 1
        while free > 0 and not filled[-1] >> left & 1:
            n = min(part, free)
            steps.append((k, n, int(size[k]) * n))
            filled.append((filled[-1] | filled[-1] << steps[-1][2]) & mask)
            free, part = free - n, part * 2
        if filled[-1] >> left & 1:
            break
    below = (filled[-1] & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = filled[-1] >> (left + 1)
    above = left + (above & -above).bit_length() if above else None
    v = above if above is not None and above - left < left - below else below
    for (k, n, tokens), before in zip(reversed(steps), reversed(filled[:-1])):
        if not before >> v & 1:
            take[k] += n
            v -= tokens
    return take


def _plan(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = int(target // whole)
        size, count = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        take = fit_lengths(size, count, int(round(target - passes * whole)), seed)
        return pd.DataFrame({"source_no": pdf["source_no"], "size": size, "passes": passes, "take": take})

    return run


def mix_units(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2,
              seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, passes, m, picked: one row for each different (id, source, size).

    ``m`` rows of the table have that id, source and size; all are taken ``passes`` times, ``picked`` of them
    once more.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                                   size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    targets = cut_lineage(source_targets(rows.select("source", (F.col("size") * F.col("m")).alias("size")),
                                         weights, share, cap))
    units = (rows.join(targets, rows.source.eqNullSafe(targets.source)).drop(targets.source)
             .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS))))
    counts = units.where("size > 0").groupBy("source_no", "size").agg(
        F.sum("m").alias("n"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    plan = counts.groupBy("source_no").applyInPandas(_plan(seed), "source_no int, size long, passes int, take long")
    cell = ["source_no", "size", "bucket"]
    earlier = Window.partitionBy("source_no", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = (units.where("size > 0").groupBy(*cell).agg(F.sum("m").alias("held"))
             .withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
             .join(plan, ["source_no", "size"]))
    within = Window.partitionBy(*cell).orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("take") - F.col("before") - F.coalesce(F.sum("m").over(within), F.lit(0))
    return (units.join(cells, cell, "left")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"), "m",
                    F.coalesce(F.greatest(F.lit(0), F.least(room, F.col("m"))), F.lit(0)).cast("long").alias("picked")))


def mix_to_weights(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, repeats: one row for each row of ``docs``.

    ``size`` counts words (null text: 0); ``target`` is the source's share (:func:`source_targets`), ``taken``
    the words that the mix takes of the document, ``repeats`` how often it takes it (at most ``cap`` times).
    Documents without words are never taken. Rows without source form a source of their own, rows without id
    share one draw. Repeated rows are documents of their own, chosen one after another. An empty table gives
    an empty result. Reruns agree: choices hang on ``seed`` and identifiers alone.
    """
    repeats = (F.col("passes") + (F.col("turn") <= F.col("picked")).cast("int")).cast("int")
    return (mix_units(docs, **options)
            .withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
            .withColumn("repeats", F.when(F.col("size") > 0, repeats).otherwise(F.lit(0)))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"),
                    "source", "repeats"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with a column ``repeats``: how often the mix takes a row (0: not at all).

    Rows that agree in id, source and size take their turns in the order of their texts' digests. Null texts and
    texts without words are not taken; null sources and ids are as in :func:`mix_to_weights`. All columns of ``docs``
    stay, whatever they are called, but for one named ``repeats``, which is replaced. An empty table stays empty.
    """
    p = free_prefix(docs)
    units = (mix_units(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
             .select(*[F.col(c).alias(p + c) for c in ("doc_id", "source", "size", "passes", "m", "picked")]))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.join(units, F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}doc_id"))
                     & F.col(source_col).eqNullSafe(F.col(f"{p}source")) & (size == F.col(f"{p}size")))
    turn = f"{p}turn"
    alone = rows.where(F.col(f"{p}m") == 1).withColumn(turn, F.lit(1))
    order = Window.partitionBy(f"{p}doc_id", f"{p}source", f"{p}size").orderBy(F.xxhash64(F.col(text_col)))
    several = rows.where(F.col(f"{p}m") > 1).withColumn(turn, F.row_number().over(order))
    repeats = (F.col(f"{p}passes") + (F.col(turn) <= F.col(f"{p}picked")).cast("int")).cast("int")
    return (alone.unionByName(several).withColumn("repeats", F.when(F.col(f"{p}size") > 0, repeats).otherwise(F.lit(0)))
            .drop(*units.columns, turn))

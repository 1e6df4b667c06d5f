"""Ordering operators: distributed dense index, batches, length buckets, seeded sampling, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.session import cut_lineage


def ranged(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Rows in order, with the partition and a rising number, as written once to the shared folder.

    Range bounds are sampled and partitions may be coalesced anew in every execution, so counts and rows must come
    from one and the same execution.
    """
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    return cut_lineage(ranged.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")))


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx") -> DataFrame:
    """0-based position of every row in ``order_cols`` order (keys must be unique).

    Range partitioning + per-partition counts: the only single-task step runs over
    one row per partition, so no task ever sees the whole table (unlike
    ``row_number()`` over an unpartitioned window).
    """
    tagged = ranged(df, order_cols)
    parts = tagged.groupBy("_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_pid", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(offs, "_pid")
    return out.select(*df.columns, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint").alias(name))


def prefix_offsets(df: DataFrame, order_cols: list[str], value: str, name: str = "offset") -> DataFrame:
    """Exclusive running sum of ``value`` over the whole table in ``order_cols`` order
    (e.g. start positions of ragged rows in a flat array), computed like dense_index:
    a window inside range partitions plus per-partition totals."""
    tagged = ranged(df, order_cols)
    w_in = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_loc", F.coalesce(F.sum(value).over(w_in), F.lit(0)))
    parts = tagged.groupBy("_pid").agg(F.sum(value).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = local.join(offs, "_pid")
    return out.select(*df.columns, (F.col("_off") + F.col("_loc")).cast("bigint").alias(name))


def batch_assign(df: DataFrame, idx: str, batch_size: int) -> DataFrame:
    """Sequential batches of ``batch_size`` rows (the last one partial)."""
    return df.withColumn("batch", F.floor(F.col(idx) / batch_size).cast("bigint"))


def schedule(n_rows: Column, batch_size: int, accum: int, epochs: int) -> list[Column]:
    """steps per epoch = ceil(n/b); t_total = steps // accum * epochs; warmup = int(0.1 * t_total)."""
    steps = F.ceil(n_rows / F.lit(batch_size)).cast("bigint")
    t_total = (F.floor(steps / F.lit(accum)) * epochs).cast("bigint")
    return [steps.alias("steps_per_epoch"), t_total.alias("t_total"),
            F.floor(t_total * 0.1).cast("bigint").alias("warmup")]


def length_bucket(df: DataFrame, batch: str, length: str, idx: str) -> DataFrame:
    """Order inside each batch by length descending (ties by idx) -> ``sorted_pos``, and ``came_from``, the place before.
    Batches are bounded, so every window partition is bounded."""
    w = Window.partitionBy(batch)
    return (df.withColumn("sorted_pos", (F.row_number().over(w.orderBy(F.desc(length), F.col(idx))) - 1).cast("bigint"))
            .withColumn("came_from", (F.row_number().over(w.orderBy(idx)) - 1).cast("bigint")))


def restore_order(df: DataFrame, batch: str, sorted_pos: str = "sorted_pos", came_from: str = "came_from") -> DataFrame:
    """Undo :func:`length_bucket`: a batch's list of places is inverted, and every row takes the place its sorted position
    is found at (``restored_pos``). Batches are bounded."""
    back = F.array_sort(F.collect_list(F.struct(came_from, sorted_pos)))
    inverse = df.groupBy(batch).agg(F.transform(back, lambda x: x[sorted_pos]).alias("_inverse"))
    return (df.join(inverse, batch).withColumn("restored_pos", (F.array_position("_inverse", F.col(sorted_pos)) - 1).cast("bigint"))
            .drop("_inverse"))


def seeded_key(seed: int, *cols) -> Column:
    """Deterministic pseudo-random sort key (same text in Spark and SQL engines)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def dev_sample(df: DataFrame, idx: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Sample ``min(n, rows)`` rows without replacement (seeded); a distributed top-n."""
    return df.orderBy(seeded_key(seed, idx), F.col(idx)).limit(n)


def shuffle_rows(df: DataFrame, idx: str, epoch: Column | int, seed: int = 42) -> DataFrame:
    """Per-epoch random order as a rank column ``order_key`` (sort by it where needed)."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return df.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), e.cast("string"),
                                                         F.col(idx).cast("string"))))

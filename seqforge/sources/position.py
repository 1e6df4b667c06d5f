"""Positional row ids for file sources, computed without collecting data.

Spark has no row order; files do. A row's position is recovered from the
file split it was read from (``_metadata.file_path``, ``file_block_start``)
and its rank inside that split (rows of a split are contiguous and in file
order inside one task, so ``monotonically_increasing_id`` ranks them).
Per-split counts (one row per split, a proven small table) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_order(name: str) -> Column:
    """Sort key of file names: runs of digits compare as numbers (part-99999 before part-100000)."""
    return F.expr(f"""array_join(transform(regexp_extract_all({name}, '([0-9]+|[^0-9]+)', 1),
                      x -> if(x rlike '^[0-9]', lpad(x, greatest(20, length(x)), '0'), x)), '')""")


def with_position(df: DataFrame, name: str = "idx") -> DataFrame:
    """Add a 0-based dense position in (file path, offset) order to a file-backed DataFrame.

    ``df`` must come straight from ``spark.read`` (it needs the ``_metadata`` column).
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                       F.col("_metadata.file_block_start").alias("_fb"),
                       F.monotonically_increasing_id().alias("_mid"))
    # a split never spans tasks, so (path, block start) plus the task-local id orders rows
    splits = (tagged.groupBy("_fp", "_fb")
              .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # one row per input split
    w = Window.orderBy(natural_order("_fp"), "_fp", "_fb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_fp", "_fb", "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), ["_fp", "_fb"])     # the cells themselves do not move
    return out.select(*[F.col(c) for c in df.columns],
                      (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint").alias(name))

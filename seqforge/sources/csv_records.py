"""CSV files with quoted cells that span lines, read by many tasks a file.

A line starts inside a quoted cell when the quotes before it in its file are odd in number. So a file is read as
plain lines, split anywhere: each split counts its quotes and, for both ways it may be entered, its record starts;
a prefix scan over one row per split settles which way holds and how many records come before. Lines then carry the
number of their record, records are put together across splits by that number, and each is parsed by itself.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqforge.sources.position import natural_order

OPTIONS = {"quote": '"', "escape": '"'}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """path, rec, idx, record: the text of every record, header included (``rec`` 0 of each file, ``idx`` null).

    ``idx`` is the dense 0-based position of a data record over all files, in natural order of their names. Quotes
    inside a cell are doubled. Empty lines outside quotes are no records; a carriage return before the line end of a
    record is dropped, line breaks inside cells stay as written. A quote that is never closed takes the rest of its
    file into one record, as for any CSV reader.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    within = Window.partitionBy("path", "block").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    full = ~F.col("value").isin("", "\r")
    # record starts up to a line, if its split is entered outside a quoted cell (0) or inside one (1)
    starts = {k: (full & (F.col("odd") == k)).cast("long") for k in (0, 1)}
    lines = lines.withColumns({f"starts{k}": F.sum(s).over(within) for k, s in starts.items()})

    splits = lines.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.max("starts0").alias("starts0"),
                                                F.max("starts1").alias("starts1"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("entered", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("starts", F.when(F.col("entered") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    splits = splits.withColumn("recs", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))
    # one row a file: data records of the files before it
    files = splits.groupBy("path").agg((F.sum("starts") - 1).alias("data"))
    order = Window.orderBy(natural_order("path"), "path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("data").over(order), F.lit(0)).alias("offset"))

    numbered = (lines.join(splits.select("path", "block", "entered", "recs"), ["path", "block"])
                .withColumn("rec", F.col("recs") + F.when(F.col("entered") == 0, F.col("starts0")).otherwise(F.col("starts1")) - 1)
                # empty lines between records belong to none
                .where(full | (F.col("odd") != F.col("entered"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
    return (numbered.groupBy("path", "rec").agg(F.regexp_replace(joined, r"\r\z", "").alias("record"))
            .join(files, "path")
            .select("path", "rec", F.when(F.col("rec") > 0, F.col("offset") + F.col("rec") - 1).cast("bigint").alias("idx"), "record"))


def _cells(names: int) -> str:
    return ", ".join(f"c{i} string" for i in range(names))


def csv_header(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The header record of the first file and the names in it: only that file's first lines are read."""
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    if not files:
        return "", []
    first = min(files, key=lambda f: (re.sub("[0-9]+", lambda d: d[0].rjust(20, "0"), f), f))
    lines = (spark.read.option("lineSep", "\n").text(first).select("value", F.col("_metadata.file_block_start").alias("block"))
             .where("block = 0").select("value"))
    for n in (1, 10, 100, 1000):   # a header seldom spans lines
        text = "\n".join(r.value for r in lines.take(n)).lstrip("\r\n")
        ends = [i for i, c in enumerate(text + "\n") if c == "\n" and text[:i].count('"') % 2 == 0]
        if text and ends:
            text = text[:ends[0]].removesuffix("\r")
            row = spark.range(1).select(F.from_csv(F.lit(text), _cells(text.count(",") + 1), OPTIONS).alias("r")).first().r
            return text, [c for c in row if c is not None]
    return "", []


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``columns`` (found by the names in the header) and ``idx`` of every data record.

    All files must have the header of the first; a missing column raises. Short records end in nulls;
    empty cells are null, quoted or not, as in the built-in reader.
    """
    header, names = csv_header(spark, path)
    lost = [c for c in columns if c not in names]
    if lost:
        raise ValueError(f"columns {lost} are not in the header of {path}: {names}")
    records = csv_records(spark, path)
    same = F.when((F.col("rec") == 0) & (F.col("record") != header),
                  F.raise_error(F.lit("the files differ in their headers"))).otherwise(F.col("rec") > 0)
    row = F.from_csv("record", _cells(len(names)), OPTIONS)
    return (records.where(same).select(row.alias("r"), "idx")
            .select(*[F.col("r")[f"c{names.index(c)}"].alias(c) for c in columns], "idx"))

"""A vocabulary as one JSON object on one line (token -> id), written and read in ordered segments.

The object is cut at commas, wherever they are: as with quoted CSV lines, the quotes before a piece tell whether its
comma stood inside a token, and a prefix scan over one row per split numbers the entries. No row or task ever holds
the whole object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqforge.sources.position import natural_order

ENTRY = r'^\s*\{?\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:\s*(-?\d+)\s*\}?\s*$'


def write_vocab_json(vocab: DataFrame, path: str) -> None:
    """token -> id in id order; the part files in name order are the object's line, then a line with one comma.

    Ids must differ. An empty vocabulary writes no entry.
    """
    ends = vocab.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    # the object of one entry without its braces: the token comes out escaped
    entry = F.regexp_replace(F.to_json(F.create_map("token", "id")), r"^\{|\}$", "")
    text = F.concat(F.when(F.col("id") == F.lit(ends.lo), "{").otherwise(""), entry,
                    F.when(F.col("id") == F.lit(ends.hi), "}\n").otherwise(""))
    (vocab.select("id", text.alias("value")).repartitionByRange("id").sortWithinPartitions("id")
     .select("value").write.mode("overwrite").option("lineSep", ",").text(path))


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """token, id, pos of the object on the first line of the file (or of part files in natural name order).

    A repeated token keeps every entry (``pos`` tells the last). Text that is no entry raises.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"\\.", "")
    pieces = pieces.withColumns({"quotes": F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))),
                                 "breaks": F.contains("value", F.lit("\n")).cast("int")})
    within = Window.partitionBy("path", "block").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"odd": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2,
                                 "past": F.coalesce(F.sum("breaks").over(before), F.lit(0))})
    # entry starts up to a piece, if its split is entered outside a token (0) or inside one (1)
    pieces = pieces.withColumns({f"starts{k}": F.sum((F.col("odd") == k).cast("long")).over(within) for k in (0, 1)})
    splits = pieces.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.sum("breaks").alias("breaks"),
                                                 F.max("starts0").alias("starts0"), F.max("starts1").alias("starts1"))
    earlier = Window.orderBy(natural_order("path"), "path", "block").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    splits = splits.withColumns({"entered": sofar("quotes") % 2, "lines": sofar("breaks"), "turn": F.row_number().over(
        Window.orderBy(natural_order("path"), "path", "block"))})
    splits = splits.withColumn("entries", sofar(F.when(F.col("entered") == 0, F.col("starts0")).otherwise(F.col("starts1"))))
    numbered = (pieces.join(splits.select("path", "block", "entered", "entries", "lines", "turn"), ["path", "block"])
                .where(F.col("past") + F.col("lines") == 0)
                .select("turn", "at", F.split("value", "\n")[0].alias("value"),
                        (F.col("entries") + F.when(F.col("entered") == 0, F.col("starts0")).otherwise(F.col("starts1")) - 1)
                        .cast("int").alias("pos")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "at", "value"))), lambda x: x["value"]), ",")
    entries = numbered.groupBy("pos").agg(joined.alias("entry")).where(~F.col("entry").rlike(r"^\s*\{?\s*\}?\s*$"))
    entries = entries.where(F.when(F.col("entry").rlike(ENTRY), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no vocabulary entry: "), "entry"))))
    token = F.from_json(F.concat(F.lit('{"t":'), F.regexp_extract("entry", ENTRY, 1), F.lit("}")), "t string")["t"]
    return entries.select("pos", token.alias("token"), F.regexp_extract("entry", ENTRY, 2).cast("bigint").alias("id"))

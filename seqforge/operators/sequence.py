"""Sequences kept as rows, one token a row, however long they are: contexts and next-token pairs.

Rows are range-partitioned by (sequence, order), so a sequence that holds a third of all rows is cut into pieces
that lie in neighbouring partitions. Inside a piece windows see the preceding tokens; across a cut the last few
tokens are carried over. A partition has at most two cut pieces, so the carried rows are at most twice the
number of partitions and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions.arrays import EOS_ID, SOS_ID
from seqforge.operators.rank import ranged


def _last(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - n, F.lit(0)) + 1, F.lit(n))


def _edges(tagged: DataFrame, seq: str, token: str, depth: int) -> DataFrame:
    """(seq, _pid, _off, _last, _carry) of the pieces of cut sequences: tokens before the piece, whether it is the
    sequence's last piece, and the last ``depth`` tokens before it."""
    span = Window.partitionBy(seq)
    order = span.orderBy("_pid")
    pieces = (tagged.groupBy(seq, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
              .withColumn("_pieces", F.count(F.lit(1)).over(span)).where("_pieces > 1")
              .withColumn("_off", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("_last", F.lead("_pid").over(order).isNull()))
    tails = (tagged.join(F.broadcast(pieces.select(seq, "_pid", "_first", "_n")), [seq, "_pid"])
             .where(F.col("_mid") >= F.col("_first") + F.col("_n") - depth))
    before = Window.partitionBy(seq).orderBy("_mid").rowsBetween(-depth, -1)
    first = Window.partitionBy(seq, "_pid").orderBy("_mid")
    carry = (tails.withColumn("_carry", F.collect_list(token).over(before)).withColumn("_r", F.row_number().over(first))
             .where("_r = 1").select(seq, "_pid", "_carry"))
    return pieces.select(seq, "_pid", "_off", "_last").join(carry, [seq, "_pid"])


def contexts(rows: DataFrame, seq: str, order: list[str], token: str, depth: int = 1, sos: int = SOS_ID,
             eos: int = EOS_ID) -> DataFrame:
    """seq, pos, ctx, label: for every token and for the end of every sequence, what comes before it.

    ``rows`` has one row a token; (seq, order) identifies it. ``ctx`` holds the last ``depth`` ids before ``label``,
    oldest first; before the first token stands SOS, after the last follows EOS. ``pos`` counts from 1, so a
    sequence of n tokens gives n + 1 rows.
    """
    tagged = ranged(rows.select(seq, *order, F.col(token).cast("bigint").alias("_tok")), [seq, *order]).select(
        seq, "_tok", "_pid", "_mid")
    piece = Window.partitionBy(seq, "_pid")
    near = piece.orderBy("_mid").rowsBetween(-depth, -1)
    x = (tagged.withColumn("_prev", F.collect_list("_tok").over(near))
         .withColumn("_i", F.col("_mid") - F.min("_mid").over(piece)).withColumn("_n", F.count(F.lit(1)).over(piece))
         .join(F.broadcast(_edges(tagged, seq, "_tok", depth)), [seq, "_pid"], "left"))
    at = F.coalesce("_off", F.lit(0)) + F.col("_i")
    known = F.concat(F.coalesce("_carry", F.array().cast("array<bigint>")), "_prev")
    ctx = _last(F.when(at < depth, F.concat(F.array(F.lit(sos).cast("bigint")), known)).otherwise(known), depth)
    ends = F.coalesce("_last", F.lit(True)) & (F.col("_i") == F.col("_n") - 1)

    def entry(pos: Column, c: Column, label: Column) -> Column:
        return F.struct(pos.cast("bigint").alias("pos"), c.alias("ctx"), label.cast("bigint").alias("label"))

    one = entry(at + 1, ctx, F.col("_tok"))
    end = entry(at + 2, _last(F.concat(ctx, F.array("_tok")), depth), F.lit(eos))
    return x.select(seq, F.inline(F.when(ends, F.array(one, end)).otherwise(F.array(one))))


def shift_pairs(rows: DataFrame, seq: str, order: list[str], token: str) -> DataFrame:
    """seq, pos, input_id, label_id: next-token pairs of whole framed sequences."""
    c = contexts(rows, seq, order, token, 1)
    return c.select(seq, "pos", F.element_at("ctx", -1).alias("input_id"), F.col("label").alias("label_id"))

"""Join helpers: checked broadcast, positional zip, prediction/gold matching."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest number of rows that is broadcast.
BROADCAST_ROW_LIMIT = 1_000_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast a table that is already written (a checkpoint) after counting it; a larger one keeps a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def join_by_position(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """Zip two positional tables (inner join on the position: stops at the shorter)."""
    return a.join(b, idx)


def join_pred_gold(pred: DataFrame, gold: DataFrame, id_col: str = "id",
                   gold_pos: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep gold rows only for ids that have a prediction, and predictions with gold.
    Returns (pred, gold) restricted to the common ids.

    One id may carry very many gold lines; with ``gold_pos`` (a unique gold row id)
    the semi join is salted so such an id is spread over tasks."""
    if gold_pos:
        g = skew_safe_join(gold, pred.select(id_col), [id_col], gold_pos, how="left_semi")
    else:
        g = gold.join(pred.select(id_col), id_col, "left_semi")
    gold_ids = g.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).select(id_col)   # partial aggregation
    p = pred.join(gold_ids, id_col, "left_semi")
    return p, g


def inverse_lookup_strict(df: DataFrame, key: str, lookup: DataFrame, lkey: str) -> DataFrame:
    """Left join on a lookup table; a key without a match raises."""
    j = df.join(lookup, df[key] == lookup[lkey], "left")
    others = [c for c in lookup.columns if c != lkey]
    return j.where(F.when(F.col(others[0]).isNull(), F.raise_error(F.lit("lookup key missing")))
                   .otherwise(F.lit(True)))


# Rows per task a hot key is split into by the salted join.
SALT_ROWS = 50_000


def skew_safe_join(big: DataFrame, small: DataFrame, keys: list[str], big_id: str,
                   key_counts: DataFrame | None = None, how: str = "inner",
                   salt_rows: int | None = None) -> DataFrame:
    """Join ``big`` (any number of rows per key, keys possibly hot) with ``small`` (one
    or a bounded number of rows per key) so that no task sees more than about
    ``salt_rows`` rows of one key.

    Hot keys are those with more than ``salt_rows`` rows in ``big``; there are at most
    rows(big) / salt_rows of them, so their narrow (key, salts) table is broadcast.
    Rows of a hot key get a salt from a hash of ``big_id``; the matching ``small`` row
    is replicated once per salt. Other keys join as usual (salt 0).
    ``key_counts``: optional (keys..., cnt) if the caller already has the counts.
    ``how``: "inner", "left" or "left_semi" (``big`` is the left side).
    """
    salt_rows = salt_rows or SALT_ROWS
    if key_counts is None:
        key_counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))   # partial aggregation
    hot = (key_counts.where(F.col("cnt") > salt_rows)
           .select(*keys, F.ceil(F.col("cnt") / salt_rows).cast("int").alias("_ns")))
    hot_b = F.broadcast(hot)
    b = big.join(hot_b, keys, "left").withColumn(
        "_salt", F.when(F.col("_ns").isNull(), F.lit(0))
                  .otherwise(F.pmod(F.xxhash64(F.col(big_id)), F.col("_ns")).cast("int"))).drop("_ns")
    s = small.join(hot_b, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ns"), F.lit(1)) - 1))).drop("_ns")
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, table: DataFrame, keys: list[str], big_id: str, key_counts: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``big`` with a narrow table that is already written (a checkpoint) and holds a key once: broadcast after counting it, so
    that no row of ``big`` moves; a larger table takes the salted join."""
    if table.count() <= BROADCAST_ROW_LIMIT:
        return big.join(F.broadcast(table), keys, how)
    return skew_safe_join(big, table, keys, big_id, key_counts=key_counts, how=how)


class SharedRefs(NamedTuple):
    """Pairs that are not joined yet, as references are shared: every text is there once.

    ``hyps``: ref_id, hyp and the pair's key. ``refs``: ref_id, ref. ``counts``: (ref_id, cnt) of the hypotheses, if known."""

    hyps: DataFrame
    refs: DataFrame
    counts: DataFrame | None = None

    def joined(self, big_id: str) -> DataFrame:
        """Every hypothesis beside its reference."""
        return skew_safe_join(self.hyps, self.refs, ["ref_id"], big_id, key_counts=self.counts)

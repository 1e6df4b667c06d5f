"""Next-token tables over contexts of several lengths.

A state is a context: the last 0 to ``depth`` ids as text, oldest first. Every suffix of a known context is known
too, so the state after a token is the longest known suffix of context and token; the table holds it in ``goto``
and decoding needs one lookup a step, as with a table of single tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions.arrays import EOS_ID, SOS_ID
from seqforge.operators.joins import skew_safe_join
from seqforge.operators.decode import log_units


def _text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def suffixes(ids: Column, depth: int) -> Column:
    """struct(order, state) of the suffixes of 0 to ``depth`` ids."""
    return F.transform(F.sequence(F.lit(0), F.least(F.size(ids), F.lit(depth))),
                       lambda n: F.struct(n.alias("order"), _text(F.slice(ids, F.size(ids) - n + 1, n)).alias("state")))


def _longest_known(rows: DataFrame, key: str, ids: Column, states: DataFrame, depth: int, name: str) -> DataFrame:
    """(key, name): for every distinct ``key`` the longest suffix of its ``ids`` among ``states`` (state, order)."""
    tried = rows.select(key, F.inline(suffixes(ids, depth)))
    return (tried.join(states.select("state"), "state").groupBy(key).agg(F.max_by("state", "order").alias(name)))


def context_table(contexts: DataFrame, depth: int, least: int = 2, eos: int = EOS_ID) -> DataFrame:
    """state, order, token, cnt, logp, units, goto from (ctx, label) rows of :func:`sequence.contexts`.

    Contexts of two and more ids are known from ``least`` occurrences on; shorter ones always.
    """
    counts = (contexts.select(F.inline(suffixes(F.col("ctx"), depth)), F.col("label").alias("token"))
              .groupBy("state", "order", "token").agg(F.count(F.lit(1)).cast("bigint").alias("cnt")))
    total = F.sum("cnt").over(Window.partitionBy("state"))
    known = counts.withColumn("_total", total).where((F.col("order") <= 1) | (F.col("_total") >= least))
    logp = F.ln(F.col("cnt") / F.col("_total"))
    known = known.select("state", "order", "token", "cnt", logp.alias("logp"), log_units(logp).alias("units"))
    after = F.concat(F.when(F.col("state") == "", F.array().cast("array<bigint>")).otherwise(
        F.split("state", " ").cast("array<bigint>")), F.array("token"))
    steps = known.where(F.col("token") != eos).select(_text(after).alias("path"), after.alias("ids")).distinct()
    states = known.select("state", "order").distinct()
    onward = _longest_known(steps, "path", F.col("ids"), states, depth, "goto")
    return known.withColumn("path", _text(after)).join(onward, "path", "left").drop("path")


def start_states(queries: DataFrame, table: DataFrame, depth: int, sos: int = SOS_ID) -> DataFrame:
    """qid, prefix, state: the longest known suffix of SOS and the query's prefix. Prefixes that end alike are looked up once."""
    whole = F.concat(F.array(F.lit(sos).cast("bigint")), "prefix")
    ids = F.slice(whole, F.greatest(F.size(whole) - depth, F.lit(0)) + 1, F.lit(depth))
    q = queries.select("qid", "prefix", _text(ids).alias("_tail"), ids.alias("_ids"))
    found = _longest_known(q.select("_tail", "_ids").distinct(), "_tail", F.col("_ids"), table.select("state", "order").distinct(),
                           depth, "state")
    return skew_safe_join(q.drop("_ids"), found, ["_tail"], "qid").drop("_tail")

"""Run-log analytics: token-weighted loss and perplexity, running means, best-so-far
flags, checkpoint choice, step counters.

Running aggregates over a (run, epoch) use a two-level prefix sum: a window inside
chunks of bounded size, plus chunk offsets from a per-chunk aggregate, so a hot run
never lands whole in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096   # order-key width of one chunk of the split running aggregate
LOSS_UNITS = 10 ** 12   # sums of losses are exact whole numbers of these units; only results are rounded
WIDE = "decimal(38,0)"


def loss_units(loss: str = "loss"):
    """Loss as a whole number of 1e-12 units, so that sums do not depend on their order."""
    return F.round(F.col(loss) * float(LOSS_UNITS)).cast(WIDE)


def round_ratio(num, den, digits: int):
    """round(num / den, digits) half-up in exact integer arithmetic (num >= 0, den > 0)."""
    scale = 10 ** digits
    num, den = num.cast(WIDE), den.cast(WIDE)
    q = F.call_function("div", (num * F.lit(2 * scale) + den).cast(WIDE), (den * F.lit(2)).cast(WIDE))
    return q / float(scale)


def running_sum_count(df: DataFrame, part: list[str], order: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``run_sum`` and ``run_cnt``: inclusive running sum/count of ``value`` per ``part``
    in ``order`` (numeric, unique within a part)."""
    x = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    w_in = (Window.partitionBy(*part, "_chunk").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_s", F.sum(value).over(w_in)).withColumn("_c", F.count(F.lit(1)).over(w_in))
    tot = x.groupBy(*part, "_chunk").agg(F.sum(value).alias("_ts"), F.count(F.lit(1)).alias("_tc"))
    w_off = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, "_chunk", F.coalesce(F.sum("_ts").over(w_off), F.lit(0)).alias("_os"),
                      F.coalesce(F.sum("_tc").over(w_off), F.lit(0)).alias("_oc"))
    j = x.join(offs, [*part, "_chunk"])
    return j.select(*df.columns, (F.col("_os") + F.col("_s")).alias("run_sum"),
                    (F.col("_oc") + F.col("_c")).cast("bigint").alias("run_cnt"))


def running_loss(log: DataFrame, digits: int = 4) -> DataFrame:
    """Running mean of the training loss inside an epoch (reset per epoch), rounded
    half-up from exact sums."""
    r = running_sum_count(log.withColumn("_lu", loss_units()), ["run", "epoch"], "step", "_lu")
    return r.drop("_lu").withColumn(
        "running_loss", round_ratio(F.col("run_sum"), F.col("run_cnt").cast(WIDE) * F.lit(LOSS_UNITS), digits))


def epoch_step_counter(log: DataFrame, accum: int) -> DataFrame:
    """Global optimizer steps per run: batch n of an epoch (from 1) makes a step when (n + 1) % accum == 0.

    Batches count anew in every epoch; the steps of finished epochs stay.
    """
    def steps(n):
        return F.floor((n + (1 if accum > 1 else 0)) / accum).cast("bigint")

    r = running_sum_count(log, ["run", "epoch"], "step", "loss")
    per = log.groupBy("run", "epoch").agg(steps(F.count(F.lit(1))).alias("_made"))
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    done = per.select("run", "epoch", F.coalesce(F.sum("_made").over(w), F.lit(0)).alias("_done"))
    return (r.join(done, ["run", "epoch"])
            .withColumn("global_step", F.col("_done") + steps(F.col("run_cnt"))).drop("_done"))


def eval_metrics(log: DataFrame, hit: Column) -> DataFrame:
    """Per (run, epoch): token-weighted loss sum(loss*tokens)/sum(tokens), perplexity
    exp(loss), and a dev score (share of rows with ``hit`` x 100).
    Sums are exact whole numbers (``loss_num`` in 1e-12 units, ``hits``, ``n``) so reported
    roundings agree everywhere."""
    g = log.groupBy("run", "epoch").agg(
        F.sum((loss_units() * F.col("tokens")).cast(WIDE)).cast(WIDE).alias("loss_num"),
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.sum(hit.cast("bigint")).alias("hits"),
        F.count(F.lit(1)).cast("bigint").alias("n"))
    loss = (F.col("loss_num").cast("double") / float(LOSS_UNITS)) / F.col("tokens")
    return g.select("run", "epoch", "loss_num", "tokens", "hits", "n", loss.alias("eval_loss"),
                    (F.col("hits") * 100.0 / F.col("n")).alias("bleu"), F.exp(loss).alias("ppl"))


def reported(metrics: DataFrame) -> DataFrame:
    """Reported precision: bleu 2 digits, loss 4, perplexity 5 (half-up, exact for bleu/loss)."""
    return metrics.select("run", "epoch", "tokens",
                          round_ratio(F.col("hits") * 100, F.col("n"), 2).alias("bleu"),
                          round_ratio(F.col("loss_num"), F.col("tokens").cast(WIDE) * F.lit(LOSS_UNITS), 4).alias("loss"),
                          round_ratio(F.col("loss_num"), F.col("tokens").cast(WIDE) * F.lit(LOSS_UNITS), 5).alias("eval_loss5"),
                          F.round("ppl", 5).alias("ppl"))


def best_so_far(metrics: DataFrame) -> DataFrame:
    """Strict improvement flags in epoch order: loss below the best so far (start 1e6),
    bleu above the best so far (start 0). Window partitions are one run's epochs."""
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    prev_loss = F.coalesce(F.min("eval_loss").over(w), F.lit(1e6))
    prev_bleu = F.coalesce(F.max("bleu").over(w), F.lit(0.0))
    return metrics.select("*", F.least(prev_loss, F.lit(1e6)).alias("best_loss_before"),
                          (F.col("eval_loss") < F.least(prev_loss, F.lit(1e6))).alias("loss_improved"),
                          (F.col("bleu") > F.greatest(prev_bleu, F.lit(0.0))).alias("bleu_improved"))


def best_checkpoint(metrics: DataFrame) -> DataFrame:
    """Per run: last epoch, first epoch reaching the lowest loss (and so perplexity), first epoch reaching
    the highest (positive) bleu. One aggregation, partial+final."""
    return metrics.groupBy("run").agg(
        F.max("epoch").alias("last_epoch"),
        F.min_by("epoch", F.struct("eval_loss", "epoch")).alias("best_ppl_epoch"),
        F.min_by(F.when(F.col("bleu") > 0, F.col("epoch")),
                 F.struct(F.when(F.col("bleu") > 0, -F.col("bleu")).otherwise(F.lit(float("inf"))), "epoch"))
        .alias("best_bleu_epoch"))


def mean_by_loss_name(log: DataFrame) -> DataFrame:
    """Mean loss per (run, epoch, loss name)."""
    return log.groupBy("run", "epoch", "name").agg(F.avg("loss").alias("mean_loss"),
                                                   F.count(F.lit(1)).cast("bigint").alias("n"))


def every_n_steps(log: DataFrame, n: int) -> DataFrame:
    return log.where(F.col("step") % n == 0)

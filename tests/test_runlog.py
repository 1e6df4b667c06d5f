"""Split running aggregates equal a single window; exact reported roundings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqforge.operators import runlog as RL
from seqforge.plans import fixtures as fx
from tests.conftest import SF_SMALL


def test_chunked_running_sum_matches_window(spark):
    log = fx.run_log(spark, SF_SMALL).withColumn("lu", RL.loss_units())
    split = RL.running_sum_count(log, ["run", "epoch"], "step", "lu", chunk=7)
    w = Window.partitionBy("run", "epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    plain = log.select("run", "epoch", "step", F.sum("lu").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("c"))
    a = {(r.run, r.epoch, r.step): (r.run_sum, r.run_cnt) for r in split.collect()}
    b = {(r.run, r.epoch, r.step): (r.s, r.c) for r in plain.collect()}
    assert a == b


def test_round_ratio_half_up(spark):
    df = spark.createDataFrame([(1, 8), (5, 8), (125, 100000), (1, 3), (0, 5)], "num long, den long")
    got = [r.x for r in df.select(RL.round_ratio(F.col("num"), F.col("den"), 2).alias("x")).collect()]
    assert got == [0.13, 0.63, 0.0, 0.33, 0.0]


def test_best_checkpoint_rules(spark):
    m = spark.createDataFrame(
        [(1, 1, 2.0, 10.0, 0.0), (1, 2, 1.0, 3.0, 5.0), (1, 3, 1.0, 3.0, 5.0), (1, 4, 1.5, 4.0, 2.0),
         (2, 1, 1.0, 2.7, 0.0), (2, 2, 1.0, 2.7, 0.0)],
        "run int, epoch int, eval_loss double, ppl double, bleu double")
    b = {r.run: r for r in RL.best_checkpoint(m).collect()}
    assert (b[1].last_epoch, b[1].best_ppl_epoch, b[1].best_bleu_epoch) == (4, 2, 2)
    assert (b[2].last_epoch, b[2].best_ppl_epoch, b[2].best_bleu_epoch) == (2, 1, None)
    f = {(r.run, r.epoch): (r.loss_improved, r.bleu_improved) for r in RL.best_so_far(m).collect()}
    assert f[(1, 1)] == (True, False) and f[(1, 2)] == (True, True) and f[(1, 3)] == (False, False)

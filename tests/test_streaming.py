"""Metric-log stream: appended batches aggregate to the same values as a batch query."""

from pyspark.sql import functions as F

from seqforge.operators import runlog as RL
from seqforge.plans import fixtures as fx
from seqforge.sources import sinks as S
from seqforge.streaming.metric_log import metric_stream, running_metric_means, start_snapshot
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_path):
    log = fx.run_log(spark, SF_SMALL).select(F.col("run").cast("string").alias("run"), "epoch", "step",
                                             "name", F.col("loss").alias("value"))
    src = str(tmp_path / "log")
    S.append_metrics(log.where("epoch < 10"), src)
    S.append_metrics(log.where("epoch >= 10"), src)
    q = start_snapshot(running_metric_means(metric_stream(spark, src)), str(tmp_path / "snap"), name="t_stream")
    q.awaitTermination(120)
    got = {(r.run, r.epoch, r.name): (r.n, round(r.mean, 9)) for r in spark.read.parquet(str(tmp_path / "snap")).collect()}
    exp = {(r.run, r.epoch, r.name): (r.n, round(r.mean_loss, 9))
           for r in RL.mean_by_loss_name(log.withColumnRenamed("value", "loss")).collect()}
    assert got == exp


def test_repeated_appends_add_nothing(spark, tmp_path):
    row = spark.createDataFrame([("r", 1, 1, "loss", 0.5)], "run string, epoch int, step long, name string, value double")
    path, src = str(tmp_path / "log"), str(tmp_path / "src")
    for _ in range(2):
        S.append_metrics(row, path, "a")
    S.append_metrics(row, path, "b")
    assert spark.read.parquet(path).count() == 2
    row.write.parquet(src)
    for _ in range(2):                                  # the second start finds nothing new
        S.stream_metrics(spark.readStream.schema(row.schema).parquet(src), path, "s", str(tmp_path / "ckpt")).awaitTermination(60)
    assert spark.read.parquet(path).count() == 3
    S.save_run_args(spark.createDataFrame([("r", 3, 0.1)], "run string, epochs int, lr double"), "run", ["epochs", "lr"], path)
    from seqforge.sources import readers as R
    assert [tuple(x) for x in R.read_run_args(spark, path, row.schema["run"].dataType).collect()] == [("r", '{"epochs":3,"lr":0.1}')]

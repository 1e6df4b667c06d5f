"""The append-only metric log consumed as a stream.

Training jobs append scalar rows (run, epoch, step, name, value) to a Parquet folder
(``sources.sinks.append_metrics``). This module keeps per (run, epoch, name) running
aggregates over that folder with Structured Streaming: the state is one row per key,
and restarts resume from the checkpoint location in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.session import checkpoint_dir

METRIC_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType()),
    T.StructField("step", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType())])


def metric_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame over the metric log folder."""
    return (spark.readStream.schema(METRIC_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def running_metric_means(stream: DataFrame) -> DataFrame:
    """Per (run, epoch, name): count, mean, min, max and last step seen (state: one row per key)."""
    return stream.groupBy("run", "epoch", "name").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.max("step").alias("last_step"))


def start_snapshot(agg: DataFrame, out_path: str, name: str = "metric_means", trigger_seconds: int | None = None):
    """Run the aggregation in complete mode and overwrite a Parquet snapshot each micro-batch."""
    spark = agg.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(write)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    else:
        w = w.trigger(availableNow=True)
    return w.queryName(name).start()

"""Session helpers: configuration suited to the workloads of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes
# (a checked broadcast), splits skewed shuffle partitions and coalesces small
# ones; the session time zone keeps timestamps comparable across engines.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "seqforge") -> SparkSession:
    """Return the active session, or build one (local tests and benches)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; without it this raises. Only
    a local master (one machine: tests, benches) gets a private folder when it is unset.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="seqforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001  (core conf not settable at runtime: the context dir below suffices)
            pass
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The rounds of an iteration as numbered tables in the shared folder.

    A round counts once Spark has committed its table (the ``_SUCCESS`` file), so the folder itself is the manifest: a
    run under the ``name`` of a killed one finds the finished rounds and goes on after them. :meth:`finish` writes
    the result and removes the rounds.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self.top = f"{checkpoint_dir(spark).rstrip('/')}/rounds-{name or uuid.uuid4().hex}"

    def _at(self, round_: int | str) -> str:
        return f"{self.top}/{round_ if isinstance(round_, str) else f'{round_:05d}'}"

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, round_: int | str) -> bool:
        path, fs = self._path(f"{self._at(round_)}/_SUCCESS")
        return fs.exists(path)

    def read(self, *rounds: int | str) -> DataFrame:
        return self.spark.read.parquet(*map(self._at, rounds))

    def once(self, round_: int | str, make) -> DataFrame:
        """The round's table, made by ``make()`` unless an earlier run has finished it."""
        if not self.has(round_):
            make().write.mode("overwrite").parquet(self._at(round_))
        return self.read(round_)

    def drop(self, *rounds: int | str) -> None:
        for r in rounds:
            path, fs = self._path(self._at(r))
            fs.delete(path, True)

    def finish(self, result: DataFrame, rounds: range) -> DataFrame:
        out = self.once("result", lambda: result)
        self.drop(*rounds)
        return out

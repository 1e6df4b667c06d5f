"""Writers: split line files, hyp/ref CSV, id/text files, evaluation report, metric log.

Positional outputs are written from a table that carries its position column:
rows are range-partitioned and sorted on it, so part files concatenated in
name order are the file in position order, without funnelling through one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions.text import bimodal_concat, collapse_ws, quote_repair, strip_text
from seqforge.operators.joins import lookup_join
from seqforge.operators.rank import ranged
from seqforge.session import checkpoint_dir, cut_lineage


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint location (never a node-local temp dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/seqforge-io/{tag}-{uuid.uuid4().hex}"


def write_ordered_text(df: DataFrame, col: str, pos, path: str) -> None:
    """Write one text line per row in ``pos`` order (a column name or a list of them).
    A null value is written as an empty line."""
    order = [pos] if isinstance(pos, str) else list(pos)
    (df.select(*order, F.coalesce(F.col(col).cast("string"), F.lit("")).alias("value"))
       .repartitionByRange(*order).sortWithinPartitions(*order)
       .select("value").write.mode("overwrite").text(path))


def write_ordered_csv(df: DataFrame, cols: list[str], pos, path: str, header: bool) -> None:
    """CSV (quoted as needed, multi-line cells allowed, whitespace kept) in ``pos`` order."""
    order = [pos] if isinstance(pos, str) else list(pos)
    (df.select(*order, *cols).repartitionByRange(*order).sortWithinPartitions(*order).select(*cols)
       .write.mode("overwrite").option("header", header).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def split_annotation(df: DataFrame) -> DataFrame:
    """Variant 'annotation': stripped annotation, all API sequence, target API."""
    return df.select("idx", strip_text("annotation").alias("annotation"),
                     F.col("api_seq").alias("all_seq"), F.col("target_api").alias("target_seq"))


def split_code(df: DataFrame) -> DataFrame:
    """Variant 'code': whitespace-collapsed source code + target API."""
    return df.select("idx", collapse_ws("source_code").alias("code"), F.col("target_api").alias("seq"))


def split_bimodal(df: DataFrame) -> DataFrame:
    """Variant 'bimodal': annotation + ' ' + source code, collapsed + target API."""
    return df.select("idx", collapse_ws(bimodal_concat("annotation", "source_code")).alias("bimodal"),
                     F.col("target_api").alias("seq"))


def write_aligned(df: DataFrame, files: dict[str, str], pos: str, write) -> None:
    """Several files of one table in the same order: ``files`` names the path of each column.

    The input is evaluated and range-sorted once, in the shared folder; every file is then a projection of its
    partitions without a further shuffle, so line n of each file is the same row.
    """
    rows = ranged(df.select(pos, *files), [pos])
    for col, path in files.items():
        write(rows.select(F.coalesce(F.col(col).cast("string"), F.lit("")).alias("value") if write is _text else col), path)


def _text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def _csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", False).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_split(df: DataFrame, prefix: str) -> dict[str, str]:
    """Write every non-key column of a split variant as its own aligned line file."""
    out = {c: f"{prefix}.{c}" for c in df.columns if c != "idx"}
    write_aligned(df, out, "idx", _text)
    return out


def write_hyp_ref_csv(pairs: DataFrame, pos: str, hyp: str, ref: str, prefix: str) -> tuple[str, str]:
    """Headerless one-column CSVs of predictions (``_hyp``) and gold (``_ref``), same order."""
    files = {hyp: f"{prefix}_hyp.csv", ref: f"{prefix}_ref.csv"}
    write_aligned(pairs, files, pos, _csv)
    return files[hyp], files[ref]


def id_text_lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id\\ttext`` lines."""
    return df.select(F.col(id_col), F.concat_ws("\t", F.col(id_col).cast("string"), F.col(text)).alias("value"))


def eval_report(heads: DataFrame, samples: DataFrame) -> DataFrame:
    """Lines of the n-best report: ``Batch n``, ``Query:``, ``Target >>``, a ``Sample k >>`` a sample and an empty line.

    ``heads``: one row a query (batch, query, target); ``samples``: (batch, r_id, sample). One row per line (batch, part,
    r_id, line), to be written in the order of the first three; a query with very many samples is never gathered.
    ``batch`` is the 1-based position of the query in evaluation order.
    """
    head = heads.select("batch", F.posexplode(F.array(
        F.format_string("Batch %d ", "batch"), F.format_string("Query: %s ", "query"),
        F.format_string("Target >> %s", quote_repair("target")))).alias("part", "line"))
    body = samples.select("batch", F.lit(3).alias("part"), F.col("r_id").cast("bigint").alias("r_id"),
                          F.format_string("Sample %d >> %s", "r_id", quote_repair("sample")).alias("line"))
    rest = heads.select("batch", F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("r_id"), F.lit("").alias("line"))
    return head.select("batch", "part", F.lit(0).cast("bigint").alias("r_id"), "line").unionByName(body).unionByName(rest)


def first_samples(samples: DataFrame) -> DataFrame:
    """(batch, line): the sample with the smallest ``r_id`` of every query. It is found on narrow rows; only its text moves."""
    first = cut_lineage(samples.groupBy("batch").agg(F.min("r_id").alias("r_id")))
    found = lookup_join(samples, first.where("r_id IS NOT NULL"), ["batch", "r_id"], "r_id", first.select("batch", "r_id", F.lit(1).alias("cnt")))
    found = found.groupBy("batch").agg(F.min_by(quote_repair("sample"), "r_id").alias("line"))
    return first.select("batch").join(found, "batch", "left")


def write_eval_report(heads: DataFrame, samples: DataFrame, scores: DataFrame, path: str, single_path: str) -> None:
    """The whole report with its summary line (``scores``: one row of recall_bleu, prec_bleu, f1) as line files in
    order, and beside it the file of every query's first sample alone."""
    last = scores.select(F.lit(10 ** 12).cast("bigint").alias("batch"), F.lit(5).alias("part"), F.lit(0).cast("bigint").alias("r_id"),
                         F.format_string("Avg recall BLEU %f, avg precision BLEU %f, F1 %f", "recall_bleu", "prec_bleu", "f1").alias("line"))
    write_ordered_text(eval_report(heads, samples).unionByName(last), "line", ["batch", "part", "r_id"], path)
    write_ordered_text(first_samples(samples), "line", "batch", single_path)


def append_metrics(df: DataFrame, path: str, commit: str | None = None) -> None:
    """Append scalar metrics (run, epoch, step, name, value) to the metric log (Parquet).

    An append has a ``commit`` id and a folder of its own: repeating it (a retried job, a replayed micro-batch)
    writes the same rows over themselves and adds nothing. Without an id every append is new.
    """
    df.select(F.col("run").cast("string"), F.col("epoch").cast("int"), F.col("step").cast("bigint"),
              F.col("name").cast("string"), F.col("value").cast("double")) \
      .write.mode("overwrite").parquet(f"{path.rstrip('/')}/commit={commit or uuid.uuid4().hex}")


def stream_metrics(stream: DataFrame, path: str, name: str, checkpoint: str):
    """Append a stream of scalar metrics to the log; the micro-batch's number is its commit, so a restart repeats none."""
    def write(batch: DataFrame, number: int) -> None:
        append_metrics(batch, path, f"{name}-{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def save_run_args(df: DataFrame, run: str, cols: list[str], log_path: str) -> None:
    """The arguments of every run as one JSON line ``{"run": ..., "args": "..."}`` in ``<log_path>.args``."""
    (df.select(F.col(run).alias("run"), args_json_col(*cols).alias("args"))
       .write.mode("overwrite").json(f"{log_path.rstrip('/')}.args"))


def args_json_col(*cols: str):
    """Run arguments as one JSON object (column expression)."""
    return F.to_json(F.struct(*cols))

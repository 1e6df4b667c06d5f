"""Readers for the corpus formats: CSV examples, aligned line files, id/text TSV,
vocabulary JSON, packed id sequences and vectors. All return DataFrames that
carry an explicit position column wherever the format is positional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.functions.text import fill_missing, lower_text, sentinel_to_null, strip_text
from seqforge.sources.csv_records import read_csv
from seqforge.sources.json_vocab import read_vocab_json  # noqa: F401  (re-exported)
from seqforge.sources.position import with_position  # noqa: F401  (re-exported)

CORPUS_COLUMNS = ["annotation", "source_code", "target_api", "api_seq", "related_so_question"]
# Cells pandas' CSV reader treats as missing by default (opt-in via na_values="pandas").
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_corpus_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                    na_values: str | None = None) -> DataFrame:
    """Corpus CSV read by the names in its header, in any order and beside any other columns; quoted cells may
    span lines, and one file is read by many tasks (``csv_records``). Adds ``idx`` (file position).

    ``columns`` prunes the read (``usecols``; all corpus columns by default); ``na_values='pandas'`` also maps the
    pandas default missing markers to null.
    """
    df = read_csv(spark, path, columns or CORPUS_COLUMNS)
    if na_values == "pandas":
        df = df.select(*[F.when(F.col(c).isin(PANDAS_NA), None).otherwise(F.col(c)).alias(c)
                         if c != "idx" else F.col(c) for c in df.columns])
    return df


def examples_from_corpus(df: DataFrame, blank: tuple[str, ...] = ("src_ant",)) -> DataFrame:
    """``read_examples``: fill missing with "", lower-case, rename to the example schema.

    ``blank`` lists fields replaced by "" (the ablation of one modality).
    """
    ex = df.select(F.col("idx").cast("bigint").alias("idx"),
                   lower_text(fill_missing("annotation")).alias("src_ant"),
                   lower_text(fill_missing("source_code")).alias("src_code"),
                   lower_text(fill_missing("related_so_question")).alias("sim_post"),
                   lower_text(fill_missing("target_api")).alias("target"))
    for b in blank:
        ex = ex.withColumn(b, F.lit(""))
    return ex


def read_lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """One row per line with its 0-based line number ``line_no``."""
    df = spark.read.text(path).withColumnRenamed("value", name)
    return with_position(df, "line_no")


def zip_lines(spark: SparkSession, src_path: str, trg_path: str, ctx_path: str | None = None) -> DataFrame:
    """Aligned line files zipped by position, stripped, stopping at the shorter file.

    With a third (context) file a line equal to ``""`` becomes null.
    Output: idx, source, target[, context_api].
    """
    s = read_lines(spark, src_path, "source")
    t = read_lines(spark, trg_path, "target")
    out = s.join(t, "line_no").select(F.col("line_no").alias("idx"), strip_text("source").alias("source"),
                                      strip_text("target").alias("target"))
    if ctx_path:
        c = read_lines(spark, ctx_path, "context_api")
        out = out.join(c.select(F.col("line_no").alias("idx"),
                                sentinel_to_null(strip_text("context_api")).alias("context_api")), "idx")
    return out


def paired_lines_strict(spark: SparkSession, ref_path: str, cand_path: str) -> DataFrame:
    """Two line files that must have the same number of lines (error otherwise).
    Output: idx, reference, candidate."""
    r = read_lines(spark, ref_path, "reference")
    c = read_lines(spark, cand_path, "candidate")
    j = r.join(c, "line_no", "full_outer")
    # in a filter, so that no choice of columns leaves the check out
    alone = F.col("reference").isNull() | F.col("candidate").isNull()
    j = j.where(F.when(alone, F.raise_error(F.lit("The number of sentences in both files do not match.")))
                .otherwise(F.lit(True)))
    return j.select(F.col("line_no").alias("idx"), "reference", "candidate")


def read_hyp_ref_csv(spark: SparkSession, hyp_path: str, ref_path: str) -> DataFrame:
    """Headerless one-column CSVs of predictions and gold, zipped by position; their row counts must match.
    Cells may span lines; an empty cell is an empty text. Output: idx, hyp, ref."""
    one = T.StructType([T.StructField("text", T.StringType())])

    def cells(path: str, name: str) -> DataFrame:
        df = (spark.read.schema(one).option("header", False).option("multiLine", True).option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        return with_position(df, "idx").select("idx", F.coalesce("text", F.lit("")).alias(name))

    return align_assert(cells(hyp_path, "hyp"), cells(ref_path, "ref"), "idx")


def parse_predictions(lines: DataFrame, value: str = "value", pos: str = "line_no") -> DataFrame:
    """``id\\ttext`` predictions: no tab -> empty text, extra fields ignored, the
    last line of a repeated id wins. Output: id, text."""
    cols = F.split(strip_text(F.col(value)), "\t", -1)
    p = lines.select(F.col(pos).alias("pos"), cols.getItem(0).alias("id"),
                     F.coalesce(F.get(cols, 1), F.lit("")).alias("text"))
    return last_prediction_wins(p)


def last_prediction_wins(p: DataFrame, id_col: str = "id", text: str = "text", pos: str = "pos") -> DataFrame:
    """A repeated id keeps its last text (by position). Partial aggregation: skew safe."""
    return p.groupBy(id_col).agg(F.max_by(text, pos).alias(text))


def parse_gold(lines: DataFrame, value: str = "value") -> DataFrame:
    """Gold ``id\\ttext`` lines must have exactly two fields. Output: id, text and the other columns of ``lines``
    (``line_no``), one row per line."""
    cols = F.split(F.col(value), "\t", -1)
    good = lines.where(F.when(F.size(cols) != 2, F.raise_error(F.lit("gold line must have exactly 2 tab-separated fields")))
                       .otherwise(F.lit(True)))
    return good.select(cols.getItem(0).alias("id"), cols.getItem(1).alias("text"), *[c for c in lines.columns if c != value])


def read_packed(spark: SparkSession, desc_path: str, api_path: str, ctx_path: str | None = None) -> DataFrame:
    """Packed id arrays (Parquet ``row bigint, ids array<bigint>``) for description, API
    and optional context, aligned on ``row``; row counts must match."""
    d = spark.read.parquet(desc_path).select("row", F.col("ids").alias("desc"))
    a = spark.read.parquet(api_path).select("row", F.col("ids").alias("api"))
    out = align_assert(d, a, "row")
    if ctx_path:
        c = spark.read.parquet(ctx_path).select("row", F.col("ids").alias("context_api"))
        out = align_assert(out, c, "row")
    return out


def align_assert(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Join on ``key``; any key present on one side only raises (counts must agree)."""
    j = a.join(b, key, "full_outer")
    bad = F.lit(False)
    for c in [x for x in a.columns if x != key][:1] + [x for x in b.columns if x != key][:1]:
        bad = bad | F.col(c).isNull()
    return j.where(F.when(bad, F.raise_error(F.lit("inconsistent number of rows in aligned inputs")))
                   .otherwise(F.lit(True)))


def ragged_slice(phrases: DataFrame, index: DataFrame, max_len: int) -> DataFrame:
    """Ragged layout: flat ``phrases(pos, id)`` + ``index(row, pos, length)`` ->
    ``row, ids`` with ``length`` capped at ``max_len-2``.

    Every index row is set out to its positions (``max_len`` at most) and met by position.
    """
    idx = index.select("row", "pos", F.greatest(F.least(F.col("length"), F.lit(max_len - 2)), F.lit(0)).alias("len"))
    wanted = idx.where("len > 0").select("row", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("p"))
    hit = wanted.join(phrases.select(F.col("pos").alias("p"), "id"), "p")
    toks = hit.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", "id"))).alias("s"))
    out = idx.join(toks, "row", "left")
    return out.select("row", F.coalesce(F.transform("s", lambda x: x["id"]),
                                        F.array().cast("array<bigint>")).alias("ids"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width float vectors stored as Parquet ``vec_id bigint, vec array<float>``."""
    return spark.read.parquet(path)


def read_run_args(spark: SparkSession, log_path: str, run_type) -> DataFrame:
    """(run, args): the run arguments saved beside a metric log, ``args`` as JSON text."""
    schema = T.StructType([T.StructField("run", run_type), T.StructField("args", T.StringType())])
    return spark.read.schema(schema).json(f"{log_path.rstrip('/')}.args")

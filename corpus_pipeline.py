"""The training-data pipeline: documents in, the mix of the documents worth training on out.

Each stage reads what its predecessor kept, from Parquet in the shared folder, and calls one operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.llm.common import free_prefix
from seqforge.llm.containment import drop_contaminated
from seqforge.llm.content_sort import drop_copies
from seqforge.llm.language import fit_language_model, keep_identified
from seqforge.llm.mixing import mix_rows
from seqforge.llm.ngram_join import ngram_jaccard_join
from seqforge.session import checkpoint_dir

SURE = 0.5        # half way between another language (0) and the language itself (1), as the classifier is taught


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (language ``und``) go, and those that the classifier is not at least SURE of."""
    return keep_identified(docs, fit_language_model(docs), SURE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return drop_copies(docs, "smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 75% of five-word shingles the smallest id stays; rows without id stay."""
    gone = f"{free_prefix(docs)}gone"
    ids = ngram_jaccard_join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 75% of a benchmark item's five-word shingles go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix to weights 5, 2, 1 takes, and how often (``repeats``)."""
    return mix_rows(docs).where("repeats > 0")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("mix_sources", mix_sources)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; a stage's input is removed once its output is written."""
    top = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, spark.read.parquet(path), sf_dir).write.parquet(f"{top}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(path)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        path = f"{top}/{k}"
    return spark.read.parquet(path)

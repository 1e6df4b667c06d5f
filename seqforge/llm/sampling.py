"""Bounded, seeded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, marks: DataFrame, per_label: int | dict, seed: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, label, text of at most ``per_label`` documents of each label, by seeded hash of the id.

    ``marks`` has the columns doc_id and label; ``per_label`` is a number, or a dict by label. Ids are ranked
    without their texts, and each task keeps only the first of each label; the picked ids are few, so the
    texts never move. Nulls in id, label or text are never drawn. Of rows that share an id, at most ``per_label`` are.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    most = max(per_label.values()) if isinstance(per_label, dict) else per_label

    def first(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
        if isinstance(per_label, dict):
            within = [(F.col("label") == k) & (F.col("turn") <= n) for k, n in per_label.items()]
            for more in within[1:]:
                within[0] |= more
            rows = rows.where(within[0])
        return rows.drop("turn")

    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), "label").dropna()
    picked = first(marks.distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    return first(texts.join(F.broadcast(picked), "doc_id"))

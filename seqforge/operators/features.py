"""Model inputs from examples: several text fields of a row as framed, padded ids with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import arrays as A
from seqforge.functions.text import tokens_ws


def _of_field(name: str):
    """One-argument lambda for ``filter`` (a second parameter would be the index)."""
    def is_it(e: Column) -> Column:
        return e["field"] == name
    return is_it


def example_features(examples: DataFrame, key: list[str], fields: dict[str, int], vocab: DataFrame,
                     tokens=tokens_ws) -> DataFrame:
    """key, then ``<field>_ids`` and ``<field>_mask`` of every field: ``[CLS] + ids[:max_len - 2] + [SEP]``, padded.

    ``fields`` maps text columns to their lengths; ``tokens`` cuts a text column. A word outside ``vocab`` becomes
    UNK; a null or empty text is CLS and SEP alone. Rows are told apart by ``key``, which must be unique.

    The fields of a row are cut to length, hash-partitioned together once, looked up in one join and put together
    in one aggregation that needs no further shuffle while the vocabulary is small enough to be broadcast.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("field"), A.take(tokens(F.coalesce(F.col(name), F.lit(""))), n - 2).alias("t"))
                      for name, n in fields.items()])
    rows = examples.select(*key, cells.alias("cells")).repartition(*key).select(*key, F.inline("cells"))
    words = rows.select(*key, "field", F.posexplode_outer("t").alias("pos", "token"))
    known = words.join(vocab.select("token", "id"), "token", "left")
    entry = F.when(F.col("pos").isNotNull(), F.struct("field", "pos", F.coalesce("id", F.lit(A.UNK_ID)).cast("bigint").alias("id")))
    whole = known.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    framed = whole.select(*key, *[A.frame_cls_sep_mask(F.transform(F.filter("entries", _of_field(name)), lambda e: e["id"]), n, A.SOS_ID, A.EOS_ID, A.PAD_ID)
                                  .alias(name) for name, n in fields.items()])
    return framed.select(*key, *[F.col(name)[part].alias(f"{name}_{part}") for name in fields for part in ("ids", "mask")])

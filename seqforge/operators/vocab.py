"""Vocabulary building, encoding and decoding as joins against a bounded vocabulary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.functions.arrays import EOS_ID, PAD_ID, UNK_ID, keep_through_eos, once, repeat, take
from seqforge.operators.rank import dense_index

# Fixed special tokens of the recurrent model's vocabulary (ids 0..3).
SPECIALS = [("<pad>", PAD_ID), ("<s>", 1), ("</s>", EOS_ID), ("<unk>", UNK_ID)]

def build_vocab(tokens: DataFrame, col: str = "tokens", cap: int | None = None, count: str | None = None) -> DataFrame:
    """Token -> id: the 4 specials, then all tokens (count desc, token asc) with ids from 4; with ``cap`` only
    the first ``cap`` ids. Output: token, id, cnt.

    ``col`` holds one token or an array of tokens a row, ``count`` how often the row counts (once by default). Ids are positions in a range-partitioned order, so no task
    ranks the whole vocabulary.
    """
    many = tokens.schema[col].dataType.typeName() == "array"
    counts = (tokens.select((F.explode(F.col(col)) if many else F.col(col)).alias("token"), *([count] if count else []))
              .groupBy("token").agg((F.sum(count) if count else F.count(F.lit(1))).alias("cnt")))
    if cap is not None:
        counts = counts.orderBy(F.desc("cnt"), "token").limit(cap - len(SPECIALS))
    ranked = dense_index(counts.withColumn("_less", -F.col("cnt")), ["_less", "token"], "id").select(
        "token", (F.col("id") + len(SPECIALS)).cast("bigint").alias("id"), F.col("cnt").cast("bigint").alias("cnt"))
    spark = tokens.sparkSession
    specials = spark.createDataFrame([(t, i, 0) for t, i in SPECIALS], "token string, id bigint, cnt bigint")
    return specials.unionByName(ranked)


def invert_vocab(vocab: DataFrame) -> DataFrame:
    """id -> token; if several tokens share an id the last one (by ``pos``) wins."""
    if "pos" in vocab.columns:
        return vocab.groupBy("id").agg(F.max_by("token", "pos").alias("token"))
    return vocab.groupBy("id").agg(F.max("token").alias("token"))


def encode_ids(df: DataFrame, key: str, tokens: str, vocab: DataFrame, max_len: int) -> DataFrame:
    """``sent2indexes``: the first ``max_len`` tokens looked up (unknown -> UNK), PAD on the
    right. Output: key, ids (length max_len), len.

    Rows are hash-partitioned on ``key`` once; while the vocabulary is small enough for AQE to broadcast it, the
    lookup and the regroup need no other shuffle.
    """
    base = df.select(F.col(key).alias("_k"), take(F.col(tokens), max_len).alias("_t")).repartition("_k")
    # outer explode keeps rows without tokens; their null entry is skipped by collect_list
    ex = base.select("_k", F.posexplode_outer("_t").alias("pos", "token"))
    v = vocab.select("token", "id")
    looked = ex.join(v, "token", "left").select(
        "_k", F.when(F.col("pos").isNotNull(),
                     F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).cast("bigint").alias("id"))).alias("e"))
    out = looked.groupBy("_k").agg(F.sort_array(F.collect_list("e")).alias("s"))
    padded = once(F.transform("s", lambda x: x["id"]), lambda i: F.concat(i, repeat(F.lit(PAD_ID).cast("bigint"), F.lit(max_len) - F.size(i))))
    return out.select(F.col("_k").alias(key), padded.alias("ids"), F.size("s").cast("bigint").alias("len"))


def decode_ids(df: DataFrame, key: str, ids: str, vocab: DataFrame, ignore_tok: int = PAD_ID) -> DataFrame:
    """``indexes2sent``: skip ``ignore_tok``, stop after EOS (kept), map ids to tokens; an id
    missing from the vocabulary is an error. Output: key, text, len."""
    base = (df.select(F.col(key).alias("_k"),
                      keep_through_eos(F.filter(F.col(ids), lambda x: x != F.lit(ignore_tok)), EOS_ID).alias("_i"))
            .repartition("_k"))
    ex = base.select("_k", F.posexplode_outer("_i").alias("pos", "id"))
    inv = invert_vocab(vocab)
    strict = F.coalesce("token", F.raise_error(F.concat(F.lit("id not in vocabulary: "), F.col("id").cast("string"))))
    looked = ex.join(inv, "id", "left").select(
        "_k", F.when(F.col("pos").isNotNull(), F.struct("pos", strict.alias("token"))).alias("e"))
    out = looked.groupBy("_k").agg(F.array_sort(F.collect_list("e")).alias("s"))
    toks = F.transform("s", lambda x: x["token"])
    return out.select(F.col("_k").alias(key), F.array_join(toks, " ").alias("text"),
                      F.size(toks).cast("bigint").alias("len"))

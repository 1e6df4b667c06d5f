"""Hot keys: salted joins give the plain-join result and bound the rows per task key."""

import random

from pyspark.sql import functions as F

import seqforge.operators.joins as J
from seqforge.operators import bleu as B
from seqforge.plans import fixtures as fx


def _skewed_docs(spark, n=1500):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = []
    for i in range(n):
        pre = "HOTPREFIX-aaaaaaaaaaaa" if i % 3 == 0 else ("WARM-ccccccccccccccc" if i % 7 == 1 else f"p{i:06d}-bbbbbbbbbbbbb")
        rows.append((i, f"s{i % 5}", pre + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))))
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_skew_safe_join_equals_plain_join(spark):
    big = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"),
                                      F.col("id").alias("rid"))
    small = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    salted = J.skew_safe_join(big, small, ["k"], "rid", salt_rows=100)
    plain = big.join(small, "k")
    assert sorted(salted.collect()) == sorted(plain.collect())
    semi = J.skew_safe_join(big, small.where("k < 10"), ["k"], "rid", how="left_semi", salt_rows=100)
    assert sorted(semi.collect()) == sorted(big.join(small.where("k < 10"), "k", "left_semi").collect())
    # every (key, salt) group stays near the threshold
    hot = J.skew_safe_join(big.withColumn("one", F.lit(1)), small, ["k"], "rid", salt_rows=100)
    assert hot.count() == plain.count()


def test_star_pairs_hot_prefix(spark, monkeypatch):
    docs = _skewed_docs(spark)
    orig = fx.table
    monkeypatch.setattr(fx, "table", lambda s, d, n: docs if n == "documents" else orig(s, d, n))
    base = {r.seg: (r.c, r.r, r.m1, r.m2, r.m3, r.m4) for r in B.sentence_bleu_stats(fx.star_pairs(spark, "x")).collect()}
    monkeypatch.setattr(J, "SALT_ROWS", 40)   # the hot prefix (500 docs) is split into 13 salts
    salted_pairs = fx.star_pairs(spark, "x")
    got = {r.seg: (r.c, r.r, r.m1, r.m2, r.m3, r.m4) for r in B.sentence_bleu_stats(salted_pairs).collect()}
    assert got == base and len(got) == docs.count()          # every document is scored


def test_sample_decode_salted_path_equals_broadcast(spark, monkeypatch):
    from seqforge.operators import decode as D
    nxt = spark.createDataFrame([(1, 4, -0.1), (1, 5, -0.5), (4, 5, -0.2), (4, 2, -0.9), (5, 2, -0.1), (5, 4, -2.0)],
                                "state long, token long, logp double")
    q = spark.range(0, 300).select(F.col("id").alias("qid"), F.array().cast("array<bigint>").alias("prefix"))
    a = {r.qid: r.tokens for r in D.sample_decode(q, nxt, 5).collect()}
    monkeypatch.setattr(J, "SALT_ROWS", 20)          # every query starts at SOS: a hot state
    b = {r.qid: r.tokens for r in D.sample_decode(q, nxt, 5).collect()}
    assert a == b

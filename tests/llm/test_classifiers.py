"""Language, quality and toxicity: held-out accuracy on the driver's labels, and odd input."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm.language import fit_language_model, has_letter, identify_language, keep_identified
from seqforge.llm.quality import estimate_prior, fit_quality_model, score_quality
from seqforge.llm.toxicity import LogRatio, fit_toxicity_model, follows, score_toxicity, tokens

SF = "/root/testdata/sf0.1"
ODD = [(None, "the of and to"), (1, None), (2, ""), (3, " \n"), (4, "12 ... !!"), (5, "the and of with " * 20_000), (6, "é"), (6, "é")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(8).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("lang", "source", "score", "label", "held_out")})


def shares(scored, labels, truth):
    """(share of 0 predicted 0, share of 1 predicted 1) among held-out rows."""
    rows = scored.where("held_out").join(labels, "doc_id").groupBy(truth).agg(F.avg("predicted").alias("p")).collect()
    p = {r[truth]: r.p for r in rows}
    return 1 - p[0], p[1]


def check_odd(scored):
    rows = scored.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
    assert all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1


def test_language(spark, docs):
    model = fit_language_model(docs)
    got = identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99
    rows = identify_language(odd(spark), model).collect()
    assert [r.lang_pred == "und" and r.score == 0 for r in sorted(rows, key=lambda r: str(r.doc_id))] == \
        [not has_letter(t) for _, t in sorted(ODD, key=lambda r: str(r[0]))]
    kept = keep_identified(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == sum(has_letter(t) for _, t in ODD)
    assert identify_language(docs.limit(0), model).count() == 0


def test_language_learns_only_from_training_rows(spark, docs):
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in fit_language_model(other.limit(600), sample=100).classes
    model = fit_language_model(docs.limit(0))
    assert {r.lang_pred for r in identify_language(odd(spark), model).collect()} == {"und"}


def test_language_sample_is_bounded_in_all(spark):
    rows = [(k, f"tongue {k % 90} says word{k % 90} often", None if k % 3 == 0 else f"l{k % 90}") for k in range(1, 3000)]
    rows += [(5000 + k, f"rare {k}", f"once{k}") for k in range(400)] + [(6000, None, "l1"), (None, "x", "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = fit_language_model(df, sample=180, landmarks=32)
    assert model.classes == sorted(f"l{k}" for k in range(90) if k % 3)          # no null, none seen once
    few = fit_language_model(df, sample=20, landmarks=32, least=2)
    assert len(few.classes) == 10
    alone = fit_language_model(df.where("lang = 'l1'"))
    assert alone.classes == ["l1"] and {r.lang_pred for r in identify_language(df, alone).collect()} == {"l1", "und"}
    assert fit_language_model(df.where("lang is null")).classes == []


def test_language_agrees_with_the_kernel_written_out(spark):
    """Ridge regression on exact kernel features, n-grams counted as text, with every sample document a landmark."""
    rnd = random.Random(2)
    tongue = {"aa": "alma balma kalma dalma", "bb": "pitri mitri kitri", "cc": "oxo uxo exo ixo"}
    rows = [(k, " ".join(rnd.choices(tongue[lang].split(), k=rnd.randrange(3, 9))), lang) for k, lang in enumerate("aa bb cc".split() * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(df, sample=600, landmarks=600)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]

    def grams(text):
        t = f" {text} "
        return {t[i:i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    sets = [grams(t) for _, t, _ in train]
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[lang == c for c in sorted(tongue)] for _, _, lang in train], float)
    centre = np.eye(len(k)) - 1 / len(k)
    dual = np.linalg.solve(centre @ k @ centre + 1e-4 * len(k) * np.eye(len(k)), centre @ y)
    got = {r.doc_id: r for r in identify_language(df, model).collect()}
    for i, text, _ in rows:
        here = np.array([kernel(grams(text), b) for b in sets])
        out = y.mean(0) + (here - k.mean(0)) @ centre @ dual
        assert got[i].lang_pred == sorted(tongue)[out.argmax()]
        assert abs(got[i].score - min(1, max(0, out.max()))) < 0.02


def test_quality(spark, docs, labels):
    model = fit_quality_model(docs, labels)
    share = labels.agg(F.avg("quality")).first()[0]
    assert abs(model.prior - share) < 0.06
    bad, good = shares(score_quality(docs, model), labels, "quality")
    assert bad > 0.8 and good > 0.98
    check_odd(score_quality(odd(spark), model))
    assert score_quality(docs.limit(0), model).count() == 0
    none = fit_quality_model(docs.limit(0), labels.limit(0))
    assert {r.score for r in score_quality(odd(spark), none).collect()} == {0.5}


def test_quality_ignores_bad_labels_and_held_out_ones(spark, docs, labels):
    few = docs.limit(800)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    a = fit_quality_model(few, labels, 200, 200)
    b = fit_quality_model(few, labels.where("quality = 1").unionByName(labels.withColumn("quality", F.lit(1)).where(held)), 200, 200)
    assert (a.w == b.w).all()


def test_prior_of_a_known_mix():
    rng = np.random.default_rng(1)
    make = lambda m, n: np.c_[rng.normal(m, 1, (n, 3)), np.ones(n)].astype(np.float32)
    u = np.concatenate([make(2, 2100), make(-2, 900)])[rng.permutation(3000)]
    assert abs(estimate_prior(make(2, 2000), u) - 0.7) < 0.05


def test_toxicity(spark, docs, labels):
    model = fit_toxicity_model(docs, labels)
    clean, toxic = shares(score_toxicity(docs, model), labels, "toxic")
    assert clean > 0.92 and toxic > 0.9
    check_odd(score_toxicity(odd(spark), model))
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_with_one_class(spark, docs, labels):
    model = fit_toxicity_model(docs.limit(300), labels.where("toxic = 0"))
    check_odd(score_toxicity(odd(spark), model))
    model = fit_toxicity_model(docs.limit(0), labels.limit(0))
    check_odd(score_toxicity(odd(spark), model))


def dictionary_model(texts):
    """The models over plain words: {(before, word): (toxic, ordinary)} documents, written from the definition."""
    pairs = defaultdict(lambda: [0, 0])
    for label, text in texts:
        ws = text.lower().split()
        for p in set(zip([None] + ws[:-1], ws)):
            pairs[p][1 - label] += 1

    def ney(counts):
        n = Counter(counts)
        return n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5

    contexts = Counter(w for _, w in pairs)
    both = {p: sum(c) for p, c in pairs.items()}
    d_both = ney(both.values())

    def level(counts, d, u, w, lower):
        size = sum(c for p, c in counts.items() if p[0] == u)
        if not size:
            return lower
        freed = 1 - sum(max(c - d, 0) for p, c in counts.items() if p[0] == u) / size
        return max(counts.get((u, w), 0) - d, 0) / size + freed * lower

    def model(side):
        own = {p: c[side] for p, c in pairs.items() if c[side]}
        d_own, k = ney(own.values()), Counter(w for _, w in own)
        d_k, total = ney(k.values()), sum(k.values())

        def word(w):
            freed = 1 - sum(max(c - d_k, 0) for c in k.values()) / total
            return max(k[w] - d_k, 0) / total + freed * (contexts[w] + 0.5) / (len(pairs) + 0.5 * (len(contexts) + 1))

        return lambda u, w: level(own, d_own, u, w, level(both, d_both, u, w, word(w))), word

    return model(0), model(1)


def test_log_ratio_against_dictionaries():
    rnd = random.Random(4)
    texts = [(int(i % 3 == 0), " ".join(rnd.choice("abcdefgh" if i % 3 else "abcxyz") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 14))))
             for i in range(60)]
    pairs = defaultdict(lambda: [0, 0])
    for label, text in texts:
        h = tokens(text.encode())
        for p in set(zip(follows(h).tolist(), h.tolist())):
            pairs[p][1 - label] += 1
    u, w = np.array(list(pairs), np.uint64).T
    t, o = np.array(list(pairs.values()), float).T
    ratio = LogRatio(u, w, t, o)
    (pt, wt), (po, wo) = dictionary_model(texts)
    for _, text in texts + [(0, "never seen words"), (0, "a never xx h"), (0, "zz yy")]:
        ws = text.split()
        word, x = ratio.each(tokens(text.encode()))
        for i, v in enumerate(ws):
            before = ws[i - 1] if i else None
            assert abs(word[i] - math.log(wt(v) / wo(v))) < 1e-9
            assert abs(x[i] - math.log(pt(before, v) / po(before, v))) < 1e-9, (before, v)


@pytest.mark.parametrize("fixed", [True, False])
def test_a_set_phrase_is_caught_in_fixed_and_random_neighbours(spark, fixed):
    rnd = random.Random(11)
    name = lambda: "w%d" % rnd.randrange(800)
    rows = []
    for i in range(1200):
        ws = [name() for _ in range(60)]
        if i % 6 == 0:
            at = rnd.randrange(5, 55)
            ws[at:at] = ["left", "grobble", "snark", "vile", "right"] if fixed else ["grobble", "snark", "vile"]
        elif fixed and i % 6 == 1:
            ws[20:20] = ["left", "right"]
        rows.append((i, " ".join(ws), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = score_toxicity(df, fit_toxicity_model(df, df.select("doc_id", "toxic")))
    clean, toxic = shares(scored, df.select("doc_id", "toxic"), "toxic")
    assert toxic == 1 and clean > 0.97


def test_toxicity_volume_bounds_the_sample(spark):
    rows = [(i, ("bad " if i % 2 else "good ") * (1 + i % 7) + f"n{i}", i % 2) for i in range(400)] + [(401, "bad " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = df.select("doc_id", "toxic")
    model, free = fit_toxicity_model(df, marks, volume=1000), fit_toxicity_model(df, marks)
    # one pair of its own a text, at least 9 bytes a text, 1000 bytes a mark; two further pairs a mark
    assert 4 < len(model.ratio.pairs[0]) <= 2 * (1000 // 9) + 4 < len(free.ratio.pairs[0])
    check_odd(score_toxicity(odd(spark), model))

"""Randomised cross-check: Spark BLEU vs. the plain-Python scorers on many random pairs."""

import math
import random

from seqforge.operators import bleu as B
from tests import pybleu


def _rand_text(rng, vocab, lo, hi):
    return " ".join(rng.choice(vocab) for _ in range(rng.randint(lo, hi)))


def test_random_sentence_bleu(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "d", "e", "f", "the", "cat"]
    rows = [(i, _rand_text(rng, vocab, 0, 12), _rand_text(rng, vocab, 0, 12)) for i in range(400)]
    df = spark.createDataFrame(rows, "seg int, hyp string, ref string")
    got = {r.seg: r for r in B.with_sentence_bleu(B.sentence_bleu_stats(df)).collect()}
    for seg, hyp, ref in rows:
        for n in (1, 2, 3, 4):
            exp = pybleu.sentence_bleu(ref.split(), hyp.split(), n)
            assert math.isclose(got[seg][f"bleu{n}"], exp, rel_tol=1e-12, abs_tol=1e-300), (seg, n)


def test_random_smoothed_multi_ref(spark):
    rng = random.Random(11)
    vocab = ["x", "y", "z", "w", "v", "u"]
    hyps, refs = [], []
    for s in range(150):
        hyps.append((s, _rand_text(rng, vocab, 0, 10)))
        for k in range(rng.randint(1, 4)):
            refs.append((s, k, _rand_text(rng, vocab, 0, 10)))
    h = spark.createDataFrame(hyps, "seg int, text string")
    r = spark.createDataFrame(refs, "seg int, ref_no int, text string")
    for eff in ("shortest", "average", "closest"):
        stats = B.smoothed_stats(h, r, eff_ref_len=eff)
        got = {x.seg: x for x in B.with_smoothed_bleu(stats).collect()}
        per_seg = []
        for s, text in hyps:
            mine = [t for t in refs if t[0] == s]
            comp = pybleu.Segment([m[2].split() for m in mine], text.split(), eff)
            per_seg.append(comp)
            exp = pybleu.smoothed_bleu([comp])
            row = got[s]
            for a, b in zip([row.bleu, row.p1, row.p2, row.p3, row.p4], exp):
                assert math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300), (eff, s)
        corpus = B.bleu_corpus_smoothed(stats).first()
        exp = pybleu.smoothed_bleu(per_seg)
        assert math.isclose(corpus.bleu, exp[0], rel_tol=1e-12)

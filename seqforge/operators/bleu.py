"""BLEU family, exact match and n-best metrics as DataFrame -> DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import bleu_math as bm
from seqforge.functions.text import TOKENIZERS, lower_text, split_puncts, strip_text, tokens_ws  # noqa: F401
from seqforge.operators.joins import SharedRefs
from seqforge.operators.ngrams import multi_ref_stats, pair_stats, shared_pair_stats

M = ["m1", "m2", "m3", "m4"]


def sentence_tokens(text: Column, lower: bool = True) -> Column:
    """``s.strip().lower().split()`` as used by the line-file scorer."""
    t = strip_text(text)
    return tokens_ws(lower_text(t) if lower else t)


def sentence_bleu_stats(pairs: DataFrame | SharedRefs, seg: str = "seg", hyp: str = "hyp", ref: str = "ref",
                        lower: bool = True, tokenizer: str = "ws", strip: bool = True) -> DataFrame:
    """Per-pair statistics (seg, c, r, m1..m4) with the given tokenizer. Of :class:`SharedRefs` either side may be ``hyp``."""
    tok = TOKENIZERS[tokenizer]

    def cut(text) -> Column:
        t = strip_text(text) if strip else F.col(text)
        return tok(lower_text(t) if lower else t)
    if isinstance(pairs, SharedRefs):
        s = shared_pair_stats(pairs._replace(hyps=pairs.hyps.withColumnRenamed(seg, "seg")), tokens=cut)
        return s if hyp == "hyp" else s.select("seg", F.col("r").alias("c"), F.col("c").alias("r"), *M)
    return pair_stats(pairs, seg, hyp, ref, tokens=cut)


def with_sentence_bleu(stats: DataFrame, orders=(1, 2, 3, 4)) -> DataFrame:
    """Add bleu{n} = sentence BLEU with uniform weights over orders 1..n."""
    return stats.select("*", *[bm.sentence_bleu("c", "r", M, n).alias(f"bleu{n}") for n in orders])


def mean_sentence_bleu(pairs: DataFrame | SharedRefs, orders=(1, 2, 3, 4), **kw) -> DataFrame:
    """Mean sentence BLEU-1..4 over all pairs (the line-file scorer). One row."""
    s = with_sentence_bleu(sentence_bleu_stats(pairs, **kw), orders)
    return s.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.avg(f"bleu{n}").alias(f"bleu{n}") for n in orders])


def dev_bleu_swapped(pairs: DataFrame | SharedRefs, seg: str = "seg", pred: str = "hyp", gold: str = "ref",
                     roles: str = "as_published") -> DataFrame:
    """Dev BLEU during training: the prediction is scored as the *reference* and the gold
    text as the hypothesis (``roles='as_published'``), no lower-casing; mean over examples."""
    hyp, ref = (gold, pred) if roles == "as_published" else (pred, gold)
    s = with_sentence_bleu(sentence_bleu_stats(pairs, seg, hyp, ref, lower=False), (4,))
    return s.agg(F.count(F.lit(1)).alias("n_examples"), F.avg("bleu4").alias("dev_bleu"))


def eps_bleu_pairs(pairs: DataFrame, **kw) -> DataFrame:
    """eps-smoothed BLEU x100 per pair."""
    s = sentence_bleu_stats(pairs, **kw)
    return s.select("seg", "c", "r", *M, bm.eps_bleu("c", "r", M).alias("eps_bleu"))


# ------------------------------------------------------------ smoothed, several references
def cli_tokens(text: Column) -> Column:
    """Tokens of the id/text scorer: strip, lower, split punctuation, then NIST normalise."""
    from seqforge.functions.text import nist_tokens
    return nist_tokens(split_puncts(lower_text(strip_text(text))))


def smoothed_stats(hyps: DataFrame, refs: DataFrame, seg: str = "seg", text: str = "text",
                   ref_no: str = "ref_no", eff_ref_len: str = "shortest",
                   tokens=cli_tokens, materialize: bool = False) -> DataFrame:
    """Per-segment mteval statistics of one hypothesis vs. several references.

    The texts are shuffled and cut into tokens behind that. References are read twice (rows and counts), which is cheap when
    they come from files; ``materialize`` writes the texts once to the shared checkpoint folder before."""
    h = hyps.select(F.col(seg).alias("seg"), F.col(text).alias("_t"))
    r = refs.select(F.col(seg).alias("seg"), F.col(ref_no).alias("ref_no"), F.col(text).alias("_t"))
    if materialize:
        from seqforge.session import cut_lineage
        h, r = cut_lineage(h), cut_lineage(r)
    return multi_ref_stats(h, r, "seg", "_t", "ref_no", eff_ref_len, cut=lambda t: tokens(F.col(t)))


def with_smoothed_bleu(stats: DataFrame) -> DataFrame:
    b = bm.mteval_bleu("c", "r", M)
    return stats.select("*", b[0].alias("bleu"), *[b[k].alias(f"p{k}") for k in range(1, 5)])


def bleu_from_maps(stats: DataFrame) -> DataFrame:
    """Mean over segments of [bleu, p1..p4] x 100 (one row)."""
    s = with_smoothed_bleu(stats)
    return s.agg(F.count(F.lit(1)).alias("n_segments"), (F.avg("bleu") * 100).alias("bleu"),
                 *[(F.avg(f"p{k}") * 100).alias(f"p{k}") for k in range(1, 5)])


def bleu_corpus_smoothed(stats: DataFrame) -> DataFrame:
    """Pool the statistics over all segments, then score once -> [bleu, p1..p4] (one row)."""
    tot = stats.agg(F.sum("c").alias("c"), F.sum("r").alias("r"),
                    *[F.sum(m).alias(m) for m in M],
                    *[F.sum(bm.guess(F.col("c"), n, 0)).alias(f"g{n}") for n in range(1, 5)],
                    F.count(F.lit(1)).alias("n_segments"))
    b = bm.mteval_bleu("c", "r", M, g=[f"g{n}" for n in range(1, 5)])
    return tot.select("n_segments", b[0].alias("bleu"), *[b[k].alias(f"p{k}") for k in range(1, 5)])


# ------------------------------------------------------------ exact match, n-best
def exact_match(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Percentage of predictions equal to the gold text (raw string equality), 4 digits."""
    return pairs.agg(F.count(F.lit(1)).alias("n"),
                     F.sum((F.col(hyp) == F.col(ref)).cast("int")).cast("bigint").alias("n_match"),
                     F.round(F.avg((F.col(hyp) == F.col(ref)).cast("double")) * 100, 4).alias("xmatch"))


def sim_bleu(nbest: DataFrame | SharedRefs, qid: str = "qid", r_id: str = "r_id", hyp: str = "hyp", ref: str = "ref",
             lower: bool = False, tokenizer: str = "space") -> DataFrame:
    """Per query: max ("recall") and mean ("precision") sentence BLEU-4 over its samples."""
    key = F.struct(F.col(qid).alias("qid"), F.col(r_id).alias("r_id")).alias("seg")
    if isinstance(nbest, SharedRefs):
        pairs = nbest._replace(hyps=nbest.hyps.select(key, "hyp", "ref_id"))
    else:
        pairs = nbest.select(key, F.col(hyp).alias("hyp"), F.col(ref).alias("ref"))
    s = with_sentence_bleu(sentence_bleu_stats(pairs, "seg", "hyp", "ref", lower, tokenizer, strip=False), (4,))
    return (s.select(F.col("seg.qid").alias("qid"), F.coalesce("bleu4", F.lit(0.0)).alias("b"))
            .groupBy("qid").agg(F.max("b").alias("max_bleu"), F.avg("b").alias("avg_bleu")))


def recall_prec_f1(per_query: DataFrame) -> DataFrame:
    """Mean of max (recall), mean of mean (precision) and their F1 (one row)."""
    agg = per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("max_bleu").alias("recall_bleu"),
                        F.avg("avg_bleu").alias("prec_bleu"))
    return agg.select("*", bm.f1(F.col("prec_bleu"), F.col("recall_bleu")).alias("f1"))

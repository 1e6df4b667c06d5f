"""Closed-form BLEU expressions over per-segment statistics columns.

Statistics: ``c`` hypothesis length, ``r`` effective reference length,
``m1..m4`` clipped n-gram matches. Guesses are derived from ``c``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scorers reproduced here.
TINY = 2.2250738585072014e-308        # smallest positive normal double (sys.float_info.min)
EPS_SMALL = 1e-9                       # denominator guard of the eps-smoothed BLEU
EPS_TINY = 1e-15                       # numerator guard of the eps-smoothed BLEU
F1_EPS = 10e-12                        # guard of the F1 denominator


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guess(c: Column, n: int, floor: int) -> Column:
    """Number of hypothesis n-grams, floored (1 for the sentence scorer, 0 for mteval)."""
    return F.greatest(_c(c) - F.lit(n - 1), F.lit(floor))


def brevity_penalty(c: Column, r: Column) -> Column:
    """1 if c > r, 0 if c == 0, else exp(1 - r/c)."""
    c, r = _c(c).cast("double"), _c(r).cast("double")
    return F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(F.lit(1.0) - r / c))


def sentence_bleu(c, r, m: list, order: int = 4) -> Column:
    """Unsmoothed sentence BLEU with uniform weights over the first ``order`` n-gram orders.

    Zero precisions beyond the first order are replaced by TINY; no unigram
    match gives 0.
    """
    c, r = _c(c), _c(r)
    w = 1.0 / order
    terms = []
    for n in range(1, order + 1):
        mn = _c(m[n - 1]).cast("double")
        p = F.when(mn > 0, mn / guess(c, n, 1).cast("double")).otherwise(F.lit(TINY))
        terms.append(F.lit(w) * F.ln(p))
    s = terms[0]
    for t in terms[1:]:
        s = s + t
    return F.when(_c(m[0]) == 0, F.lit(0.0)).otherwise(brevity_penalty(c, r) * F.exp(s))


def mteval_bleu(c, r, m: list, smooth: bool = True, g: list | None = None) -> list[Column]:
    """Smoothed (mteval style) BLEU -> [bleu, p1, p2, p3, p4] as fractions.

    Add-one smoothing for orders 2..4, brevity penalty min(0, 1-(r+1)/(c+1)).
    ``g``: guesses per order; by default max(c-n+1, 0) of a single segment (pooled
    statistics must pass the summed per-segment guesses).
    """
    c = _c(c).cast("double")
    r = _c(r).cast("double")
    logb = None
    precs = []
    for n in range(1, 5):
        mn = _c(m[n - 1]).cast("double")
        gcol = (_c(g[n - 1]) if g is not None else guess(c, n, 0)).cast("double")
        a = 1.0 if (smooth and n > 1) else 0.0
        d = F.ln(mn + F.lit(a) + F.lit(TINY)) - F.ln(gcol + F.lit(a) + F.lit(TINY))
        logb = d if logb is None else logb + d
        precs.append(F.when(gcol == 0, F.lit(0.0)).otherwise(F.exp(F.ln(mn + F.lit(TINY)) - F.ln(gcol))))
    bp = F.least(F.lit(0.0), F.lit(1.0) - (r + 1) / (c + 1))
    return [F.exp(logb / 4.0 + bp)] + precs


def eps_bleu(c, r, m: list) -> Column:
    """eps-smoothed BLEU x100; undefined (NULL) for an empty hypothesis."""
    c = _c(c).cast("double")
    r = _c(r).cast("double")
    s = None
    for n in range(1, 5):
        mn = _c(m[n - 1]).cast("double")
        g = F.greatest(c + 1 - n, F.lit(0.0))
        t = F.ln((F.lit(EPS_TINY) + mn) / (F.lit(EPS_SMALL) + g))
        s = t if s is None else s + t
    return F.when(c == 0, F.lit(None).cast("double")) \
            .otherwise(F.exp(F.least(F.lit(0.0), 1 - r / c) + s / 4.0) * 100)


def f1(p: Column, r: Column) -> Column:
    return 2 * _c(p) * _c(r) / (_c(p) + _c(r) + F.lit(F1_EPS))

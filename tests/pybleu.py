"""Plain-Python scorers written from the public definitions, used only to check the Spark ones."""

import math
import re
import sys
from collections import Counter

TINY = sys.float_info.min


def ngrams(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def sentence_bleu(ref, hyp, order=4):
    """Unsmoothed sentence BLEU, one reference, uniform weights (method0 smoothing)."""
    c, r = len(hyp), len(ref)
    ps = []
    for n in range(1, order + 1):
        h, rf = ngrams(hyp, n), ngrams(ref, n)
        m = sum(min(v, rf[g]) for g, v in h.items())
        ps.append((m, max(1, c - n + 1)))
    if ps[0][0] == 0:
        return 0.0
    bp = 1.0 if c > r else (0.0 if c == 0 else math.exp(1 - r / c))
    s = math.fsum((1.0 / order) * math.log(m / g if m > 0 else TINY) for m, g in ps)
    return bp * math.exp(s)


class Segment:
    """Plain counts of one hypothesis against its references: lengths, shared and possible n-grams by order."""

    def __init__(self, refs, hyp, eff="shortest"):
        self.length = len(hyp)
        sizes = [len(r) for r in refs]
        self.against = {"shortest": min(sizes), "average": sum(sizes) / len(sizes),
                        "closest": min(sizes, key=lambda n: abs(n - len(hyp)))}[eff]
        self.possible = [max(0, len(hyp) + 1 - n) for n in (1, 2, 3, 4)]
        self.shared = [sum(min(k, max(ngrams(r, n)[g] for r in refs)) for g, k in ngrams(hyp, n).items()) for n in (1, 2, 3, 4)]


def smoothed_bleu(segments):
    """[bleu, p1..p4] of summed counts: fourth root of the product of precisions, orders above 1 with one added
    to both counts, times the brevity factor with one added to both lengths."""
    hyp, ref = (1 + sum(getattr(s, what) for s in segments) for what in ("length", "against"))
    shared, possible = ([sum(getattr(s, what)[n] for s in segments) for n in range(4)] for what in ("shared", "possible"))
    bleu = math.exp(min(0, 1 - ref / hyp))
    for more, hit, of in zip((0, 1, 1, 1), shared, possible):
        bleu *= ((hit + more + TINY) / (of + more + TINY)) ** 0.25
    return [bleu] + [hit / of if of else 0.0 for hit, of in zip(shared, possible)]


def nist_tokens(s):
    s = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    s = s.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
    s = (" %s " % s).lower()
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def split_puncts(s):
    return " ".join(re.findall(r"[\w]+|[^\s\w]", s))

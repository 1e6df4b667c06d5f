"""The suffix tree against a plain dictionary model, the word model against its definition."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import suffix_tree as S
from tests.conftest import SF_SMALL


def words(t):
    return (t or "").encode().lower().split()


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Plain:
    """The same tree, grown and walked one context at a time."""

    def __init__(self, texts, least):
        self.n = {}
        total = 0
        for ws in texts:
            s = b"\0" * (S.DEPTH - 1) + b"\n" + b" ".join(ws) + b"\n"
            for i in range(S.DEPTH, len(s)):
                total += 1
                for k in range(S.DEPTH + 1):
                    self.n.setdefault(s[i - k:i], Counter())[s[i]] += 1
        self.total = total
        some = {c: n for c, n in self.n.items() if sum(n.values()) >= least * total}
        self.kept = {b""}
        for c, n in some.items():
            if c:
                t, up = sum(n.values()), self.n[c[1:]]
                gain = sum(v * math.log(v / t / (up[a] / sum(up.values()))) for a, v in n.items())
                if gain > len(n):
                    self.kept |= {c[k:] for k in range(len(c))}

    def p(self, context, a):
        n = self.n.get(context, Counter())
        if not context:
            return (n[a] + 0.1) / (self.total + 25.6)
        up = context[1:]
        while up not in self.kept:
            up = up[1:]
        t = sum(n.values())
        back = S.DISCOUNT * len(n) / t * self.p(up, a)
        return back + (n[a] - S.DISCOUNT) / t if n[a] else back

    def score(self, ws):
        s = b"\0" * (S.DEPTH - 1) + b"\n" + b" ".join(ws) + b"\n"
        out = 0
        for i in range(S.DEPTH, len(s)):
            k = next(k for k in range(S.DEPTH, -1, -1) if s[i - k:i] in self.kept)
            out += math.log10(self.p(s[i - k:i], s[i]))
        return out


def brute(rows, least):
    train = [words(t) for i, t in rows if not held(i)]
    c = Counter(w for ws in train for w in [*ws, b"\n"])
    n, v, plain = sum(c.values()), len(c), Plain(train, least)
    out = []
    for i, t in rows:
        ws = [*words(t), b"\n"]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 4), round(plain.score(words(t)), 4)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*tuple(r)[:5], round(r.base_score, 4), round(r.score, 4)) for r in df.collect()), key=str)


ODD = [(10_001, None), (10_002, ""), (None, "the of and"), (None, None), (10_003, "the the of"), (10_003, "the the of"),
       (10_004, "\x00 odd \x01"), (10_005, "word " * 20_000), (10_006, "A B É é")]


@pytest.mark.parametrize("frequent,chunk", [(1 << 18, 3_000_000), (40, 5_000), (0, 100)])
def test_documents_against_a_plain_tree(spark, monkeypatch, frequent, chunk):
    monkeypatch.setattr(S, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {c: F.lit(1) for c in ("token", "n", "key", "score", "m", "turn")})
    assert got(S.score_with_suffix_tree(df, 1e-4)) == brute(rows, 1e-4)


def test_next_symbols_add_up_to_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(40)
    text = b"".join(S.symbols(words(r.text)) for r in docs.collect())
    g, n = np.unique(S.grams(text), return_counts=True)
    levels = []
    for depth in range(S.DEPTH + 1):
        k, inverse = np.unique(g & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        levels.append((k, np.bincount(inverse, n)))
    tree = S.SuffixTree(levels)
    assert tree.states > 20
    for context in [b"\0\0\0\0\n", b" the ", b"zzzzz", b"nd th", b"\xc3\xa9 \xc3\xa9"]:
        c = int.from_bytes(context[-S.DEPTH:], "big")
        p = 10 ** tree.log10(np.array([c << 8 | a for a in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_empty_and_no_training(spark):
    assert S.score_with_suffix_tree(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = next(i for i in range(100) if held(i))
    r = S.score_with_suffix_tree(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.held_out and r.score < 0 and r.base_score == 0


def test_held_out_text_is_better_foretold_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = S.score_with_suffix_tree(docs, 2e-7).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_a_context_is_kept_whatever_the_rest_of_the_corpus(spark):
    """A wording seen three times predicts itself, also among millions of other symbols."""
    asked = next(i for i in range(100) if held(i))
    few = [(i, "xvjk") for i in [k for k in range(100) if not held(k)][:3] + [asked]]
    other = [(1_000 + k, "ab ba " * 20_000) for k in range(60)]
    score = {}
    for name, rows in (("small", few), ("large", few + other)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        score[name] = S.score_with_suffix_tree(df).where(f"doc_id = {asked}").first().score
    assert score["large"] > score["small"] - 6

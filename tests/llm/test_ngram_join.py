"""The n-gram join against every pair of a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm.ngram_join import alike, ngram_jaccard_join, packed, prefix_length, unpacked
from tests.conftest import SF_SMALL


def shingles(text, n=5):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def brute(rows, num=75, den=100):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for x, (i, a) in enumerate(sets):
        for y in range(x):
            j, b = sets[y]
            if i is None or j is None or not a or not b:
                continue
            if den * len(a & b) >= num * len(a | b):
                links[x] += 1
                links[y] += 1
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return sorted(((i, len(s), None if i is None else top(i), None if i is None else k)
                   for (i, s), k in zip(sets, links)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(seed, groups, size, edits):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(5, 120))]
        for _ in range(size):
            ws = list(base)
            for _ in range(rnd.randrange(edits)):
                at = rnd.randrange(len(ws))
                ws[at:at + 1] = rnd.choice([[], ["X%d" % rnd.randrange(99)], [ws[at], "extra"]])
                ws = ws or ["only"]
            rows.append(" ".join(ws))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,groups,size,edits,parts", [(1, 30, 6, 5, 3), (2, 2, 90, 9, 5), (3, 1, 150, 4, 1)])
def test_against_all_pairs(spark, seed, groups, size, edits, parts):
    rows = list(enumerate(near_copies(seed, groups, size, edits)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert got(ngram_jaccard_join(df)) == brute(rows)


def test_blocks_split_a_large_group(spark, monkeypatch):
    from seqforge.llm import ngram_join
    monkeypatch.setattr(ngram_join, "BLOCK", 1500)
    rows = list(enumerate(near_copies(5, 1, 120, 6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_jaccard_join(df)) == brute(rows)


def test_nulls_ties_short_and_clashing_columns(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A B"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"),
            (None, "a b c d e"), (None, None), (8, long), (9, long + " end"), (10, "no break space"), (11, "x")]
    df = (spark.createDataFrame(rows, "doc_id long, text string")
          .withColumns({c: F.lit(c) for c in ("n", "h1", "node", "rep", "component", "root", "links")}))
    assert got(ngram_jaccard_join(df)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = ngram_jaccard_join(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and out.count() == 0


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(ngram_jaccard_join(docs)) == brute(rows)


def test_prefix_length():
    assert [prefix_length(n, 75, 100) for n in (1, 2, 4, 100)] == [1, 1, 2, 26]


def shared_sentences(seed, docs, each, of):
    rnd = random.Random(seed)
    pool = [" ".join(f"s{k}w{w}" for w in range(8)) for k in range(of)]
    return [" ".join(rnd.sample(pool, each)) for _ in range(docs)]


def test_documents_of_shared_sentences(spark):
    texts = shared_sentences(8, 120, 20, 60)
    texts += [t.replace("s3w", "z") for t in texts[:40]] + [t + " tail" for t in texts[20:50]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(ngram_jaccard_join(df)) == brute(rows)


def test_long_documents_that_share_passages_form_no_group(spark, monkeypatch):
    from seqforge.llm import ngram_join
    rnd, many = random.Random(4), 240
    texts = [[f"w{rnd.getrandbits(48)}" for _ in range(10_000)] for _ in range(many)]
    for k in range(many):                            # a passage of each document is in the next one too
        at = rnd.randrange(9000)
        texts[(k + 1) % many][at:at + 400] = texts[k][at:at + 400]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def refuse(*_):
        def run(pdf):
            raise AssertionError(f"{len(pdf)} unrelated documents are verified together")
        return run
    monkeypatch.setattr(ngram_join, "_verified", refuse)
    out = ngram_jaccard_join(df)
    assert out.where("component_id <> doc_id or n_links > 0").count() == 0 and out.count() == many


def test_shards_and_chunks_of_any_size(spark, monkeypatch):
    from seqforge.llm import ngram_join
    rows = list(enumerate(near_copies(9, 12, 9, 6)))
    rows += [(200 + k, rows[k][1]) for k in range(30)] + [(7, "other words under an id that is there before"), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = got(ngram_jaccard_join(df))
    # as workers see it: the number of shards comes from here, chunks are cut by the module's own limit
    monkeypatch.setattr(ngram_join, "SHARD", 50)
    assert got(ngram_jaccard_join(df)) == whole == brute(rows)


def test_packed_numbers_come_back():
    for a, width in ((np.array([], np.uint64), 5), (np.array([0, 1, 255, 256, 2**40 - 1], np.uint64), 5), (np.arange(300), 4)):
        assert unpacked(packed(a, width), width).tolist() == a.tolist()


def test_alike_finds_every_pair_on_one_and_two_sides():
    rnd = random.Random(11)
    base = [np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 2, 3, 30, 200, 200)]
    sets = []
    for s in base:
        for _ in range(25):
            keep = s[np.array([rnd.random() > 0.12 for _ in s], bool)]
            sets.append(np.unique(np.concatenate([keep if len(keep) else s, base[rnd.randrange(6)][:rnd.randrange(20)]])))
    every = np.arange(len(sets))

    def pairs(left, right):
        return sorted((min(i, j), max(i, j)) for i, found in alike(sets, left, right, 75, 100) for j in found.tolist())

    def true(left, right, same):
        return sorted((min(i, j), max(i, j)) for i in left for j in right if (i < j if same else True)
                      and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])))

    assert pairs(every, every) == true(every, every, True) and len(pairs(every, every)) > 50
    assert pairs(every[::2], every[1::2]) == true(every[::2], every[1::2], False)

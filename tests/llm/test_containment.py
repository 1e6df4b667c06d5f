"""The containment search against every (document, item) pair."""

import random

from pyspark.sql import functions as F

from seqforge.llm.containment import containment_search, drop_contaminated, signature_length
from tests.conftest import SF_SMALL


def grams(text, n=5):
    ws = (text or "").encode().lower().split()
    n = min(n, len(ws))
    return [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)] if ws else [], n


def brute(docs, items):
    out = []
    for i, t in docs:
        for k, q in set(items):
            want, wide = set(grams(q)[0]), grams(q)[1]
            g = grams(t, wide)[0] if wide and len((t or "").split()) >= wide else []
            at = [x for x, y in enumerate(g) if y in want]
            shared = len({g[x] for x in at})
            if want and 100 * shared >= 75 * len(want):
                out.append((i, k, len(want), shared, shared / len(want), at[0], at[-1] + wide - 1))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_planted_passages(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(900)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 4, 5, 9, 30, 64, 200])))) for k in range(40)]
    docs = []
    for i in range(150):
        ws = [word() for _ in range(rnd.choice([0, 3, 40, 900]))]
        q = rnd.choice(items)[1].upper().split()
        for at in rnd.sample(range(len(q)), rnd.randrange(3) if len(q) > 3 else 0):
            q[at] = "changed"
        docs.append((i, " ".join(ws + q + [word() for _ in range(rnd.choice([0, 60]))])))
    docs += [(None, items[3][1]), (200, None), (201, ""), (7, items[5][1]), (7, items[5][1]), (202, "z " * 60_000 + items[6][1])]
    items += [(900, None), (901, " "), (None, items[0][1]), (3, "other text of the same item id"), items[1]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute(docs, items)
    assert len(want) > 50
    assert got(containment_search(d, q)) == want
    assert got(containment_search(d, q, block=300)) == want
    clean = drop_contaminated(d, q)
    assert clean.columns == d.columns
    held = [{i for i, *_ in brute([row], items)} for row in docs]
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for (i, _), h in zip(docs, held) if not h), key=str)


def test_documents(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df, c: [tuple(r) for r in df.select(c, "text").collect()]
    assert got(containment_search(docs, items)) == brute(rows(docs, "doc_id"), rows(items, "item_id"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert containment_search(docs, items).count() == 0
    assert drop_contaminated(docs, items).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert containment_search(docs.limit(0), some).count() == 0
    assert containment_search(docs, some).count() == 1


def test_signature_misses_no_item():
    for n in range(1, 400):
        assert signature_length(n, 75, 100) > n - -(-75 * n // 100)


def test_short_items_inside_long_documents(spark):
    items = [(1, "secret answer key"), (2, "lone"), (3, "two words"), (4, "one two three four"), (5, "key")]
    docs = [(1, "here is the Secret answer KEY of ten words or so"), (2, "lone"), (3, "secret answer"), (4, "answer key secret"),
            (5, "x " * 500 + "one two three four"), (6, "two\nwords"), (7, "nothing"), (8, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = got(containment_search(d, q))
    assert found == brute(docs, items)
    assert {(r[0], r[1]) for r in found} == {(1, 1), (1, 5), (2, 2), (4, 5), (5, 4), (6, 3)}
    assert sorted(r.doc_id for r in drop_contaminated(d, q).collect()) == [3, 7, 8]

"""BLEU statistics counted inside tasks: no rows of n-grams, repeated and null keys, groups that do not fit a chunk."""

import random
from collections import Counter

import pyarrow as pa

import seqforge.operators.gram_tasks as G
import seqforge.operators.ngrams as N
from seqforge.functions.text import first_tokens_ws, tokens_ws
from seqforge.operators import bleu as B
from seqforge.operators.joins import SharedRefs
from seqforge.operators.ngrams import multiset_intersect_stats, pair_stats
from tests.test_plans import optimized


def grams(tokens, n):
    return Counter(tuple(tokens[k:k + n]) for k in range(len(tokens) - n + 1))


def _words(rng, most):
    return [rng.choice("abcde") for _ in range(rng.randint(0, most))]


def test_no_rows_of_ngrams(spark):
    pairs = spark.createDataFrame([(1, ["a"], ["a"])], "seg long, h array<string>, r array<string>")
    refs = spark.createDataFrame([(1, 1, "a b")], "seg long, ref_no long, text string")
    for df in (pair_stats(pairs, "seg", "h", "r"), multiset_intersect_stats(pairs, "seg", "h", "r")):
        assert "posexplode" not in optimized(df) and "inline" not in optimized(df) and "HashAggregate" not in optimized(df)
    p = optimized(B.smoothed_stats(refs.select("seg", "text"), refs))
    assert "posexplode" not in p and "stack" not in p


def test_repeated_and_null_keys_in_small_chunks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), _words(rng, 6), _words(rng, 6)) for _ in range(120)] + [(4, None, ["a"])]
    bags = {}
    for seg, h, r in rows:
        h = h or []
        a, b = bags.setdefault((seg, len(h), len(r)), ([Counter() for _ in range(4)], [Counter() for _ in range(4)]))
        for n in range(4):
            a[n].update(grams(h, n + 1))
            b[n].update(grams(r, n + 1))
    want = sorted(((s, c, r, *[(x & y).total() for x, y in zip(*v)]) for (s, c, r), v in bags.items()), key=str)
    df = spark.createDataFrame(rows, "seg long, h array<string>, r array<string>")
    monkeypatch.setattr(G, "CHUNK", 8)
    for colocate in (True, False):
        assert sorted(map(tuple, pair_stats(df, "seg", "h", "r", colocate=colocate).collect()), key=str) == want


def test_salted_references_equal_unsalted(spark, monkeypatch):
    rng = random.Random(4)
    hyps = [(s, " ".join(_words(rng, 12))) for s in range(6)] + [(5, "a b c"), (6, None), (None, "a")]
    refs = [(s % 7, k, " ".join(_words(rng, 12))) for k, s in enumerate(range(80))] + [(1, 1, "a b a b"), (2, 90, None), (None, 0, "a")]
    h = spark.createDataFrame(hyps, "seg long, text string")
    r = spark.createDataFrame(refs, "seg long, ref_no long, text string")
    for eff in ("shortest", "average", "closest", "closest_shorter"):
        monkeypatch.setattr(N, "REFS_PER_TASK", 2_000)
        one = sorted(map(tuple, B.smoothed_stats(h, r, eff_ref_len=eff).collect()), key=str)
        monkeypatch.setattr(N, "REFS_PER_TASK", 3)
        assert sorted(map(tuple, B.smoothed_stats(h, r, eff_ref_len=eff).collect()), key=str) == one
        assert {x[0] for x in one} == set(range(7))
        assert len(one) == len({x[:2] for x in one})
        for seg, c, _, *m in one:
            mine = [t.split() if t else [] for s, t in hyps if s == seg]
            best = [Counter() for _ in range(4)]
            by_no = {}
            for s, no, t in refs:
                if s == seg:
                    by_no.setdefault(no, []).append((t or "").split())
            for texts in by_no.values():
                for n in range(4):
                    best[n] |= sum((grams(t, n + 1) for t in texts), Counter())
            for n in range(4):
                assert (sum((grams(t, n + 1) for t in mine), Counter()) & best[n]).total() == m[n]


def test_counts_of_keys_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 8)
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2]), _words(rng, 6)) for _ in range(40)] + [(3, None), (4, [])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    got = N.ngram_count(df, ["k"], "t")
    assert "inline" not in optimized(got) and "HashAggregate" not in optimized(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, N.ngram_count(df, ["k"], "t", colocate=False).collect()))


def test_reference_totals_salted(spark, monkeypatch):
    rng = random.Random(8)
    refs = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 60), _words(rng, 9)) for _ in range(150)] + [(4, 1, []), (5, 1, None)]
    df = spark.createDataFrame(refs, "seg long, ref_no long, t array<string>")
    best = {}
    for seg in {s for s, _, _ in refs}:
        by_no = {}
        for s, no, t in refs:
            if s == seg:
                by_no.setdefault(no, []).append(t or [])
        best[seg] = [Counter() for _ in range(4)]
        for texts in by_no.values():
            for n in range(4):
                best[seg][n] |= sum((grams(t, n + 1) for t in texts), Counter())
    want = sorted(((s, sum(map(len, b)), *[x.total() for x in b]) for s, b in best.items()), key=str)
    for most in (10_000, 7):
        monkeypatch.setattr(N, "GRAM_REFS_PER_TASK", most)
        out = N.reference_max_counts(df, "seg", "ref_no", "t")
        assert "posexplode" not in optimized(out)
        assert sorted(map(tuple, out.collect()), key=str) == want


def test_reference_grams_leave_the_task_as_results(spark, monkeypatch):
    rng = random.Random(9)
    refs = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(60)]), _words(rng, 9)) for _ in range(150)] + [(4, 1, []), (5, 1, None)]
    df = spark.createDataFrame(refs, "seg long, ref_no long, t array<string>")
    best = {}
    for seg, no in {(s, no) for s, no, _ in refs}:
        for n in range(1, 5):
            one = sum((grams(t or [], n) for s, k, t in refs if (s, k) == (seg, no)), Counter())
            for g, c in one.items():
                best[seg, n, "\u0001".join(g)] = max(c, best.get((seg, n, "\u0001".join(g)), 0))
    want = sorted(((*k, c) for k, c in best.items()), key=str)
    for most in (10_000, 7):
        monkeypatch.setattr(N, "GRAM_REFS_PER_TASK", most)
        out = N.reference_max_grams(df, "seg", "ref_no", "t")
        assert ("HashAggregate" in optimized(out)) == (most == 7)
        assert sorted(map(tuple, out.collect()), key=str) == want


def test_bigrams_of_repeated_keys_and_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 8)
    rows = [(1, "a b a b"), (1, "a b a b"), (2, ""), (2, "c"), (3, None), (None, "a a"), (4, "b " * 30)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {(r.before, r.word): r.cnt for r in N.word_bigrams(df, "k", tokens_ws).collect()}
    want = Counter()
    for key in {k for k, _ in rows}:
        texts = [(t or "").split() for k, t in rows if k == key]
        want[None, None] += sum(not t for t in texts)
        run = [t[k] for k in range(max(map(len, texts))) for t in texts if k < len(t)]
        want.update(zip([None, *run], [*run, None]) if run else [])
    assert got == {k: c for k, c in want.items() if c}
    p = optimized(N.word_bigrams(df, "k", tokens_ws))
    assert "Generate" not in p


def test_first_words(spark):
    texts = ["", " ", "a", " a  b", "a b c d", "\ta\u00a0b\nc ", None, "a b "]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for r in df.select("text", first_tokens_ws("text", 2).alias("t")).collect():
        assert r.t == (None if r.text is None else r.text.split()[:2])


def _shared(spark, rng, key="long"):
    ids = [None, *range(12)]
    hyps = [(rng.choice(ids), rng.choice([*_texts(rng, 8), None]), rng.choice([*ids, 40])) for _ in range(60)]
    hyps += [(100 + k, " ".join(_words(rng, 9)), rng.choice([3, 4, 41])) for k in range(70)]
    refs = [(k % 9 if k < 12 else k, rng.choice([*_texts(rng, 8), None])) for k in range(42)] + [(None, "a b")]
    h = spark.createDataFrame(hyps, "seg long, hyp string, ref_id long")
    return SharedRefs(h if key == "long" else h.selectExpr("struct(seg AS qid, ref_id AS r_id) AS seg", "hyp", "ref_id"),
                      spark.createDataFrame(refs, "ref_id long, ref string"))


def _texts(rng, many):
    return [" ".join(_words(rng, 9)) for _ in range(many)]


def test_shared_references_equal_joined_pairs(spark, monkeypatch):
    # repeated and null keys, repeated and missing references, null texts; chunks and salts that cut a reference's hypotheses
    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)
    for key in ("long", "struct"):
        shared = _shared(spark, random.Random(6), key)
        joined = shared.hyps.join(shared.refs, "ref_id")
        want, swapped = rows(B.sentence_bleu_stats(joined)), rows(B.sentence_bleu_stats(joined, hyp="ref", ref="hyp"))
        sets = rows(multiset_intersect_stats(joined, "seg", "hyp", "ref", tokens=tokens_ws))
        assert len(want) > 100
        for chunk, most in ((G.CHUNK, 5_000), (8, 3)):
            with monkeypatch.context() as m:
                m.setattr(G, "CHUNK", chunk)
                m.setattr(N, "HYPS_PER_TASK", most)
                assert rows(B.sentence_bleu_stats(shared)) == want
                assert rows(B.sentence_bleu_stats(shared, hyp="ref", ref="hyp")) == swapped
                assert rows(multiset_intersect_stats(shared, "seg", "hyp", "ref", tokens=tokens_ws)) == sets


def test_a_step_holds_only_the_last_reference(monkeypatch):
    # 40 hypotheses of one reference in batches of one row, and one without a reference
    monkeypatch.setattr(G, "CHUNK", 4)
    names = ["ref_id", "salt", "kind", "seg", "t"]
    rows = [(1, 0, 0, None, ["a", "b", "a"]), *[(1, 0, 1, k, ["b", "a"]) for k in range(40)], (2, 0, 1, 99, ["a"]), (3, 0, 0, None, ["a"]), (3, 0, 1, 50, [])]
    batches = [pa.RecordBatch.from_pydict({n: pa.array([v], tp) for n, v, tp in zip(names, r, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))})
               for r in rows]
    schema = pa.schema([(k, pa.int64()) for k in ("seg", "c", "r", "m1", "m2", "m3", "m4")])
    got = [tuple(x.values()) for b in G.shared_step(schema, 4)(iter(batches)) for x in b.to_pylist()]
    assert got == [*[(k, 2, 3, 2, 1, 0, 0) for k in range(40)], (50, 0, 1, 0, 0, 0, 0)]


def _counted_in_parts(monkeypatch, step, columns, schema):
    """Rows of a step, whole and in small parts, and the most n-grams that were numbered at a time."""
    rng = random.Random(12)
    rows = [(k // 400, 0, 1, k % 400, _words(rng, 12)) for k in range(900)]
    kinds = {"seg": pa.int64(), "salt": pa.int32(), "salts": pa.int32(), "ref_no": pa.int64(), "t": pa.list_(pa.string())}
    batches = [pa.RecordBatch.from_pydict({n: pa.array([dict(zip(kinds, r))[n] for r in rows[a:a + 70]], kinds[n]) for n in columns}) for a in range(0, 900, 70)]
    batches = [b.set_column(2, "salts", pa.array([1 + (s == 1) for s in b["seg"].to_pylist()], pa.int32())) if "salts" in columns else b for b in batches]
    most, factorize, got = [], G.pd.factorize, []

    def seen(values, *args, **kw):
        most.append(len(values))
        return factorize(values, *args, **kw)
    monkeypatch.setattr(G.pd, "factorize", seen)
    for part in (1 << 19, 300):
        monkeypatch.setattr(G, "PART", part)
        monkeypatch.setattr(G, "ROWS", part)
        most.clear()
        out = [b for b in step(schema, 4)(iter(batches))]
        assert max(b.num_rows for b in out) <= max(part, 3)
        got.append((sorted(tuple(x.values()) for b in out for x in b.to_pylist()), max(most)))
    return got


def test_grams_of_a_large_segment_are_counted_in_parts(monkeypatch):
    schema = pa.schema([("seg", pa.int64()), ("n", pa.int32()), ("gram", pa.string()), ("maxcount", pa.int64())])
    (whole, _), (parts, most) = _counted_in_parts(monkeypatch, G.most_gram_step, ["seg", "salt", "ref_no", "t"], schema)
    assert parts == whole and len(whole) > 1000 and most < 1000


def test_totals_of_a_large_segment_are_counted_in_parts(monkeypatch):
    schema = pa.schema([(k, pa.int64()) for k in ("seg", "n", "a", "b", "r", "n_grams", "max1", "max2", "max3", "max4")])
    (whole, _), (parts, most) = _counted_in_parts(monkeypatch, G.most_step, ["seg", "salt", "salts", "ref_no", "t"], schema)
    assert parts == whole and len(whole) > 500 and most < 1000


def test_segments_are_dealt_by_bytes_too(spark, monkeypatch):
    rng = random.Random(13)
    refs = [(1 + k % 2, k, " ".join(_words(rng, 40))) for k in range(60)]
    df = spark.createDataFrame(refs, "seg long, ref_no long, t string")
    args = ("seg", "ref_no", "t")
    cut = lambda t: tokens_ws(t)
    whole = [sorted(map(tuple, f(df, *args, cut=cut).collect())) for f in (N.reference_max_counts, N.reference_max_grams)]
    monkeypatch.setattr(N, "GRAM_BYTES_PER_TASK", 300)
    assert {r.salts > 3 for r in N._gram_salts(df.select("seg", df.t.alias("_t"))).collect()} == {True}
    assert [sorted(map(tuple, f(df, *args, cut=cut).collect())) for f in (N.reference_max_counts, N.reference_max_grams)] == whole

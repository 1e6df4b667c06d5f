"""Hand-made micro cases for the edge rules, checked against plain-Python scorers."""

import math

import pytest
from pyspark.sql import functions as F

from seqforge.functions import arrays as A
from seqforge.functions import text as tx
from seqforge.operators import bleu as B
from seqforge.operators import decode as D
from seqforge.operators import runlog as RL
from seqforge.operators import vocab as V
from seqforge.sources import readers as R
from tests import pybleu

PAIRS = [
    ("empty hyp", "the cat sat on the mat", ""),
    ("empty ref", "", "the cat sat"),
    ("short", "a b c d e", "a b"),
    ("no shared", "a b c d", "e f g h"),
    ("clipping", "the cat", "the the the the the"),
    ("identical", "one two three four five", "one two three four five"),
    ("partial", "the quick brown fox jumps over the lazy dog", "the quick brown dog jumps over a lazy fox"),
    ("three", "x y z", "x y z"),
    ("long hyp", "a b", "a b a b a b a b"),
]


def _pairs_df(spark):
    return spark.createDataFrame([(i, h, r) for i, (_, r, h) in enumerate(PAIRS)], "seg int, hyp string, ref string")


def test_sentence_bleu_micro(spark):
    s = B.with_sentence_bleu(B.sentence_bleu_stats(_pairs_df(spark))).orderBy("seg").collect()
    for row, (name, ref, hyp) in zip(s, PAIRS):
        for n in (1, 2, 3, 4):
            exp = pybleu.sentence_bleu(ref.split(), hyp.split(), n)
            assert math.isclose(row[f"bleu{n}"], exp, rel_tol=1e-12, abs_tol=1e-300), (name, n)


def test_identity_is_one(spark):
    s = B.with_sentence_bleu(B.sentence_bleu_stats(_pairs_df(spark))).where("seg = 5").first()
    assert s.bleu4 == pytest.approx(1.0)


def test_clipped_counts_bounded(spark):
    s = B.sentence_bleu_stats(_pairs_df(spark)).collect()
    for r in s:
        for n in range(1, 5):
            assert r[f"m{n}"] <= max(0, min(r.c, r.r) - n + 1)


def test_multiset_intersect_equals_clip(spark):
    from seqforge.operators.ngrams import multiset_intersect_stats
    p = _pairs_df(spark).select("seg", tx.tokens_ws("hyp").alias("h"), tx.tokens_ws("ref").alias("r"))
    inter = {(r.seg, r.n): r.m for r in multiset_intersect_stats(p, "seg", "h", "r").collect()}
    stats = B.sentence_bleu_stats(_pairs_df(spark), lower=False).collect()
    for r in stats:
        for n in range(1, 5):
            assert inter.get((r.seg, n), 0) == r[f"m{n}"]


def test_smoothed_multi_reference(spark):
    hyps = [(1, "the cat is on the mat"), (2, "a b c"), (3, "")]
    refs = [(1, 0, "the cat sat on the mat"), (1, 1, "there is a cat on the mat"), (2, 0, "a b c d"),
            (2, 1, "a b"), (3, 0, "x y")]
    h = spark.createDataFrame(hyps, "seg int, text string")
    r = spark.createDataFrame(refs, "seg int, ref_no int, text string")
    for eff in ("shortest", "average", "closest"):
        st = B.with_smoothed_bleu(B.smoothed_stats(h, r, eff_ref_len=eff)).orderBy("seg").collect()
        for row in st:
            toks = lambda s: pybleu.nist_tokens(pybleu.split_puncts(s.strip().lower()))
            mine = [t for t in refs if t[0] == row.seg]
            hyp = toks([t for t in hyps if t[0] == row.seg][0][1])
            exp = pybleu.smoothed_bleu([pybleu.Segment([toks(m[2]) for m in mine], hyp, eff)])
            got = [row.bleu, row.p1, row.p2, row.p3, row.p4]
            for a, b in zip(got, exp):
                assert math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300), (eff, row.seg)


def test_closest_ties_first_reference(spark):
    h = spark.createDataFrame([(1, "a b c")], "seg int, text string")
    r = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "a b")], "seg int, ref_no int, text string")
    st = B.smoothed_stats(h, r, eff_ref_len="closest").first()
    assert st.r == 4.0      # both at distance 1: the first reference wins
    st = B.smoothed_stats(h, r, eff_ref_len="closest_shorter").first()
    assert st.r == 2.0


def test_nist_normalize_micro(spark):
    texts = ["read_line(a, b);", "x &amp;lt; y &quot;q&quot;", "end-\nof <skipped> line", "3-4 1,000 a.b, c.",
             "Tab\there é à", "don't stop"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.toks for r in df.select(tx.nist_tokens("t").alias("toks")).collect()]
    assert got == [pybleu.nist_tokens(t) for t in texts]
    got2 = [r.s for r in df.select(tx.split_puncts("t").alias("s")).collect()]
    assert got2 == [pybleu.split_puncts(t) for t in texts]


def test_prediction_parsing(spark):
    lines = spark.createDataFrame([(0, "1\tfoo bar"), (1, "2"), (2, "3\ta\tb"), (3, "1\tlast wins"), (4, "4\t x ")],
                                  "line_no long, value string")
    p = {r.id: r.text for r in R.parse_predictions(lines).collect()}
    assert p == {"1": "last wins", "2": "", "3": "a", "4": " x"}   # raw field; the scorer strips it


def test_gold_needs_two_fields(spark):
    lines = spark.createDataFrame([("1\ta\tb",)], "value string")
    with pytest.raises(Exception):
        R.parse_gold(lines).collect()
    ok = R.parse_gold(spark.createDataFrame([("1\tgold text",)], "value string")).collect()
    assert ok[0].id == "1" and ok[0].text == "gold text"


def test_pred_gold_matching(spark):
    from seqforge.operators.joins import join_pred_gold
    pred = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    gold = spark.createDataFrame([("1", "x"), ("1", "y"), ("3", "z")], "id string, text string")
    p, g = join_pred_gold(pred, gold)
    assert sorted(r.id for r in p.collect()) == ["1"]
    assert sorted(r.text for r in g.collect()) == ["x", "y"]


def test_sentinel_and_stage(spark):
    df = spark.createDataFrame([('""', "test", "t"), ("x", "train", "t")], "c string, stage string, target string")
    r = df.select(tx.sentinel_to_null("c").alias("c"), tx.stage_target("target", "stage").alias("t")).collect()
    assert r[0].c is None and r[1].c == "x" and r[0].t == "None" and r[1].t == "t"


def test_framing_edges(spark):
    rows = [(0, [5, 6, 0, 7]), (1, list(range(4, 64))), (2, [0, 0, 0]), (3, [5, 2, 6])]
    df = spark.createDataFrame(rows, "k int, ids array<bigint>")
    out = df.select("k", A.frame_sos_eos_pad("ids", 10).alias("f"), A.framed_length("ids", 10).alias("n"),
                    A.pad_context("ids", 10).alias("c")).orderBy("k").collect()
    assert out[0].f == [1, 5, 6, 2, 0, 0, 0, 0, 0, 0] and out[0].n == 2
    assert out[1].f == [1] + list(range(4, 12)) + [2] and out[1].n == 8
    assert out[2].f == [1, 2] + [0] * 8 and out[2].n == 0 and out[2].c == [0] * 10
    assert out[3].c == [5, 2, 6] + [0] * 7


def test_mask_sum_is_length(spark):
    df = spark.createDataFrame([(0, [4, 5, 6]), (1, [])], "k int, ids array<bigint>")
    r = df.select("k", A.frame_cls_sep_mask("ids", 6, 1, 2, 0).alias("f")).orderBy("k").collect()
    assert r[0].f.ids == [1, 4, 5, 6, 2, 0] and r[0].f.mask == [1, 1, 1, 1, 1, 0]
    assert r[1].f.ids == [1, 2, 0, 0, 0, 0] and sum(r[1].f.mask) == 2
    ctx = df.select(A.frame_cls_sep_mask("ids", 6, 1, 2, 0, with_sep=False).alias("f")).collect()
    assert ctx[1].f.ids == [1, 0, 0, 0, 0, 0]


def test_encode_decode_roundtrip(spark):
    toks = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["c", "zz"]), (2, [])], "k int, tokens array<string>")
    vocab = V.build_vocab(toks.where("k < 1"), "tokens")
    enc = V.encode_ids(toks, "k", "tokens", vocab, 5).orderBy("k").collect()
    assert enc[0].ids == [4, 5, 4, 0, 0] and enc[0].len == 3
    assert enc[1].ids == [3, 3, 0, 0, 0]          # unknown -> UNK
    assert enc[2].ids == [0] * 5 and enc[2].len == 0
    ids = spark.createDataFrame([(0, [1, 4, 5, 2, 4, 0]), (1, [0, 0])], "k int, ids array<bigint>")
    dec = V.decode_ids(ids, "k", "ids", vocab).orderBy("k").collect()
    assert dec[0].text == "<s> a b </s>" and dec[0].len == 4   # stop after EOS, EOS kept
    assert dec[1].text == "" and dec[1].len == 0                # all-PAD row
    bad = spark.createDataFrame([(0, [99])], "k int, ids array<bigint>")
    with pytest.raises(Exception):
        V.decode_ids(bad, "k", "ids", vocab).collect()


def test_strict_line_counts(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("x\ny\nz\n")
    b.write_text("x\ny\n")
    with pytest.raises(Exception):
        R.paired_lines_strict(spark, str(a), str(b)).collect()
    z = R.zip_lines(spark, str(a), str(b)).collect()
    assert len(z) == 2


def test_beam_width_one_is_greedy(spark):
    nxt = spark.createDataFrame([(1, 4, -0.1), (1, 5, -0.5), (4, 5, -0.2), (4, 2, -0.9), (5, 2, -0.1), (5, 4, -2.0)],
                                "state long, token long, logp double")
    q = spark.createDataFrame([(0, []), (1, [4])], "qid long, prefix array<bigint>")
    f = D.beam_search(q, nxt, 1, 6)
    beam = {r.qid: r.tokens for r in D.beam_final(f, 1).collect()}
    greedy = {r.qid: r.tokens for r in D.greedy_decode(q, nxt, 6).collect()}
    for k in beam:
        g = greedy[k]
        assert beam[k] == (g[:g.index(2)] if 2 in g else g)


def test_beam_final_rules(spark):
    nxt = spark.createDataFrame([(1, 4, -0.1), (1, 2, -0.2), (1, 5, -0.3), (4, 2, -0.05), (4, 5, -1.0),
                                 (5, 2, -0.05), (5, 4, -1.0)], "state long, token long, logp double")
    q = spark.createDataFrame([(0, [])], "qid long, prefix array<bigint>")
    f = D.beam_search(q, nxt, 2, 4)
    final = D.beam_final(f, 2).orderBy("rank").collect()
    assert [r.tokens for r in final] == [[4], []]          # '4 EOS' (-0.15) before 'EOS' (-0.2)
    q = spark.createDataFrame([(0, []), (1, [7, 1])], "qid long, prefix array<bigint>")
    forced = D.beam_final(D.beam_search(q, nxt, 2, 4, forced=True), 2).orderBy("qid", "rank").collect()
    assert [r.tokens for r in forced if r.qid == 0] == [[4], []]          # no prefix, nothing blocked
    assert all(len(r.tokens) > 0 for r in forced if r.qid == 1)           # EOS blocked after a prefix
    avg = D.beam_final(f, 2, rank_by="avg").orderBy("rank").collect()
    # '4 EOS' scores -0.15 over two generated tokens, 'EOS' -0.2 over one
    assert [round(r.rank_key, 4) for r in avg] == [-0.075, -0.2]


def test_epoch_step_counter(spark):
    log = spark.createDataFrame([("r", e, 100 * e + n, 1.0) for e, m in ((1, 9), (2, 3), (3, 4)) for n in range(m)],
                                "run string, epoch int, step long, loss double")
    got = {a: [r.global_step for r in RL.epoch_step_counter(log, a).orderBy("step").collect()] for a in (1, 4)}
    # accumulation 4: a step at batches 3 and 7 of an epoch, the next epoch counts anew
    assert got[4] == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 4, 4]
    assert got[1] == list(range(1, 17))


def test_strip_prefix_of_several_lengths(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], 2), ([5], 1), ([5, 6], 0), ([], 0)], "t array<bigint>, n int")
    assert [r.s for r in df.select(A.strip_prefix("t", F.col("n")).alias("s")).collect()] == [[7, 8], [5], [5, 6], []]


def test_text_scalars(spark):
    df = spark.createDataFrame([("  a  b\n c \t",)], "t string")
    r = df.select(tx.strip_text("t").alias("s"), tx.collapse_ws("t").alias("c"), tx.tokens_space("t").alias("sp"),
                  tx.drop_first_token("t").alias("d")).first()
    assert r.s == "a  b\n c" and r.c == "a b c" and r.sp == "  a  b\n c \t".split(" ") and r.d == "b c"


def test_format_elapsed(spark):
    df = spark.createDataFrame([(3725.0, 0.5)], "s double, p double")
    assert df.select(tx.format_elapsed("s", "p").alias("e")).first().e == "1:2:5<1:2:5"


def test_corpus_csv_reader(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('annotation,source_code,target_api,api_seq,related_so_question\n'
                 '"A b","  x = 1\nprint(x)",T1,S1,null\n'
                 ',code,T2,S2,Post\n')
    df = R.read_corpus_csv(spark, str(p)).orderBy("idx").collect()
    assert [r.idx for r in df] == [0, 1]
    assert df[0].source_code == "  x = 1\nprint(x)" and df[0].related_so_question == "null"
    assert df[1].annotation is None
    na = R.read_corpus_csv(spark, str(p), na_values="pandas").orderBy("idx").collect()
    assert na[0].related_so_question is None
    ex = R.examples_from_corpus(R.read_corpus_csv(spark, str(p))).orderBy("idx").collect()
    assert ex[0].src_ant == "" and ex[0].src_code == "  x = 1\nprint(x)" and ex[1].sim_post == "post"


def test_smoothed_bleu_by_hand():
    same, short = pybleu.Segment([list("abcd")], list("abcd")), pybleu.Segment([list("abcd")], list("ab"))
    assert pybleu.smoothed_bleu([same]) == [1.0, 1.0, 1.0, 1.0, 1.0]
    # 2 of 2 words, 1 of 1 pair, nothing longer; lengths 2 and 4
    got = pybleu.smoothed_bleu([short])
    assert got[0] == pytest.approx(math.exp(1 - 5 / 3)) and got[1:] == [1.0, 1.0, 0.0, 0.0]
    # both together: 6 of 6 words, 4 of 4 pairs, 2 of 2, 1 of 1; lengths 6 and 8
    assert pybleu.smoothed_bleu([same, short])[0] == pytest.approx(math.exp(1 - 9 / 7))


def test_csv_is_read_by_name(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('more,target_api,related_so_question,source_code,annotation,api_seq\n'
                 '1,NA,null,"int x =\n 1;",get it,a b\n2,t,post,code,N/A,c\n')
    rows = R.read_corpus_csv(spark, str(p), na_values="pandas").orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [("get it", "int x =\n 1;", None, "a b", None, 0), (None, "code", "t", "c", "post", 1)]
    assert R.read_corpus_csv(spark, str(p), ["api_seq"]).columns == ["api_seq", "idx"]


def test_unequal_line_files_fail_whatever_is_selected(spark, tmp_path):
    (tmp_path / "a").write_text("1\n2\n3\n")
    (tmp_path / "b").write_text("1\n2\n")
    df = R.paired_lines_strict(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    for x in (lambda: df.count(), lambda: df.select("candidate").collect()):
        with pytest.raises(Exception, match="do not match"):
            x()
    gold = R.parse_gold(spark.createDataFrame([("1\ta\tb",)], "value string"))
    with pytest.raises(Exception, match="exactly 2"):
        gold.select("text").collect()


def test_no_break_space_is_no_token(spark):
    df = spark.createDataFrame([("a b, c é!",)], "t string")
    assert df.select(tx.split_puncts("t").alias("s")).first().s == "a b , c é !"


def test_over_long_rows_fail(spark):
    df = spark.createDataFrame([([1, 2, 3], 3)], "a array<bigint>, n int")
    assert df.select(A.pad_array("a", 4).alias("p")).first().p == [1, 2, 3, 0]
    for c in (A.pad_array("a", 2), A.position_ids("n", 2)):
        with pytest.raises(Exception, match="2: 3"):
            df.select(c.alias("p")).collect()


def test_length_order_and_back(spark):
    from seqforge.operators import rank as RK
    df = spark.createDataFrame([(0, 10, 3), (0, 11, 5), (0, 12, 1), (0, 13, 5), (1, 14, 2)], "batch int, idx int, len int")
    r = RK.restore_order(RK.length_bucket(df, "batch", "len", "idx"), "batch").orderBy("idx").collect()
    assert [x.sorted_pos for x in r] == [2, 0, 3, 1, 0] and [x.restored_pos for x in r] == [0, 1, 2, 3, 0]

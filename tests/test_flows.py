"""The reference's command-line flows, run on files with seqforge and checked independently."""

import math

from pyspark.sql import functions as F

from seqforge.operators import bleu as B
from seqforge.sources import readers as R
from seqforge.sources import sinks as S
from tests import pybleu

REFS = ["The cat sat on the mat .", "a b c d e f", "", "Hello world again and again", "x y"]
CANDS = ["the cat is on the mat .", "a b c d e g", "nothing here", "hello world again", "x y"]


def test_line_file_scorer(spark, tmp_path):
    (tmp_path / "ref.txt").write_text("\n".join(REFS) + "\n")
    (tmp_path / "cand.txt").write_text("\n".join(CANDS) + "\n")
    pairs = R.paired_lines_strict(spark, str(tmp_path / "ref.txt"), str(tmp_path / "cand.txt"))
    out = B.mean_sentence_bleu(pairs.select(F.col("idx").alias("seg"), F.col("candidate").alias("hyp"),
                                            F.col("reference").alias("ref"))).first()
    for n in (1, 2, 3, 4):
        exp = sum(pybleu.sentence_bleu(r.strip().lower().split(), c.strip().lower().split(), n)
                  for r, c in zip(REFS, CANDS)) / len(REFS)
        assert math.isclose(out[f"bleu{n}"], exp, rel_tol=1e-12)


def test_id_text_scorer(spark, tmp_path):
    preds = ["0\tThe cat, is on the mat.", "1\ta b c", "2", "1\ta b c d", "9\tno gold"]
    golds = ["0\tthe cat sat on the mat.", "1\ta b c d e", "1\ta b", "2\tsomething", "5\tno prediction"]
    (tmp_path / "gold.txt").write_text("\n".join(golds) + "\n")
    pred_lines = spark.createDataFrame([(i, p) for i, p in enumerate(preds)], "line_no long, value string")
    pred = R.parse_predictions(pred_lines)
    gold = R.parse_gold(R.read_lines(spark, str(tmp_path / "gold.txt"), "value"))
    gold = gold.withColumnRenamed("line_no", "ref_no")
    from seqforge.operators.joins import join_pred_gold
    pred, gold = join_pred_gold(pred, gold, gold_pos="ref_no")
    got = B.bleu_from_maps(B.smoothed_stats(pred.withColumnRenamed("id", "seg"),
                                            gold.withColumnRenamed("id", "seg"))).first()
    # independent: dict-based maps as the scorer builds them
    pmap = {}
    for row in preds:
        cols = row.strip().split("\t")
        pmap[cols[0]] = pybleu.split_puncts((cols[1] if len(cols) > 1 else "").strip().lower())
    gmap = {}
    for row in golds:
        rid, text = row.split("\t")
        if rid in pmap:
            gmap.setdefault(rid, []).append(pybleu.split_puncts(text.strip().lower()))
    scores = [pybleu.smoothed_bleu([pybleu.Segment([pybleu.nist_tokens(g) for g in gmap[k]],
                                               pybleu.nist_tokens(pmap[k]))]) for k in gmap]
    exp = [sum(s[i] for s in scores) * 100.0 / len(scores) for i in range(5)]
    for a, b in zip([got.bleu, got.p1, got.p2, got.p3, got.p4], exp):
        assert math.isclose(a, b, rel_tol=1e-12)
    assert got.n_segments == 3


def test_split_flow(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text('annotation,source_code,target_api,api_seq,related_so_question\n'
                 '" get  file ","int x =\n  1 ;",api.a,api.a api.b,post one\n'
                 'read lines,"for line in f :   pass",api.c,api.c,post two\n')
    df = R.read_corpus_csv(spark, str(p))
    files = S.write_split(S.split_code(df), str(tmp_path / "out" / "train"))
    code = [r.line for r in R.read_lines(spark, files["code"], "line").orderBy("line_no").collect()]
    seq = [r.line for r in R.read_lines(spark, files["seq"], "line").orderBy("line_no").collect()]
    assert code == ["int x = 1 ;", "for line in f : pass"] and seq == ["api.a", "api.c"]
    ann = S.write_split(S.split_annotation(df), str(tmp_path / "out" / "ann"))
    assert [r.line for r in R.read_lines(spark, ann["annotation"], "line").orderBy("line_no").collect()] == \
        ["get  file", "read lines"]

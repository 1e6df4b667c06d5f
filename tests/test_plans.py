"""Physical-plan checks: shuffles where intended, partial top-k, no Python in the hot path."""

from seqforge.operators import bleu as B
from seqforge.plans import catalog  # noqa: F401
from seqforge.plans import fixtures as fx
from seqforge.plans.registry import REGISTRY
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_pair_stats_single_exchange_for_ngrams(spark):
    # the pair rows are hash-partitioned on seg once; n-gram aggregation adds no exchange
    pairs = spark.createDataFrame([(1, "a b c", "a b d")], "seg int, hyp string, ref string")
    p = optimized(B.sentence_bleu_stats(pairs))
    from pyspark.sql import functions as F  # noqa: F401
    exchanges = [ln for ln in p.splitlines() if "Exchange" in ln]
    assert len(exchanges) <= 1, p


def test_no_python_udfs_anywhere(spark):
    bad = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
    for name in ["sent_bleu4", "bleu_cli", "encode_ids", "decode_ids", "running_loss", "beam_step", "ngram_count"]:
        p = optimized(REGISTRY[name].fn(spark, SF_SMALL))
        assert not any(b in p for b in bad), name


def test_partial_topk_for_groups(spark):
    _, g = fx.grouped_documents(spark, SF_SMALL)
    assert "WindowGroupLimit" in optimized(g)


def test_parquet_pruning_and_pushdown(spark):
    from pyspark.sql import functions as F
    df = fx.table(spark, SF_SMALL, "conversations").where(F.col("turn") == 3).select("conv_id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(turn), EqualTo(turn,3)]" in p
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint>" in p


def test_texts_do_not_move_to_meet_their_group(spark):
    # hypotheses move once, by reference; those with several references not at all
    p = optimized(fx.star_pairs(spark, SF_SMALL))
    assert p.count("SortMergeJoin") == 1 and p.count("BroadcastHashJoin") >= 3
    hyps, refs = fx.anchor_and_refs(spark, SF_SMALL)
    assert "Exchange" not in optimized(hyps) + optimized(refs) and "SortMergeJoin" not in optimized(refs)


def test_references_do_not_travel_with_their_hypotheses(spark):
    # both sides meet in one exchange, by reference, and no row carries two texts
    for name in ("clip_join", "sent_bleu4", "dev_bleu_swapped", "multiset_intersect", "sim_bleu", "recall_prec_f1"):
        p = optimized(REGISTRY[name].fn(spark, SF_SMALL))
        assert "SortMergeJoin" not in p and p.count("Exchange hashpartitioning(ref_id") == 1 and "Exchange hashpartitioning(seg" not in p, (name, p)


def test_cells_do_not_move_to_get_their_position(spark, tmp_path):
    from seqforge.sources.readers import read_lines
    spark.range(20).selectExpr("string(id)").write.text(str(tmp_path / "t"))
    p = optimized(read_lines(spark, str(tmp_path / "t")))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_framed_fields_are_worked_out_once(spark):
    from seqforge.functions import arrays as A
    df = spark.range(1).selectExpr("array(5L, 6L) AS ids")
    p = optimized(df.select(A.frame_cls_sep_mask("ids", 8, 1, 2, 0).alias("f")))
    assert p.count("ids#") <= 4


def test_report_numbers_queries_without_moving_texts(spark):
    from seqforge.plans.catalog_io import report_rows
    from seqforge.sources import sinks as S
    hyps, refs = fx.anchor_and_refs(spark, SF_SMALL)
    heads, samples, _ = report_rows(hyps, refs)
    assert "Exchange hashpartitioning" not in optimized(samples) and "SortMergeJoin" not in optimized(S.eval_report(heads, samples))


def test_report_of_repeated_golds_and_samples(spark, tmp_path):
    from seqforge.plans.catalog_io import report_rows
    from seqforge.sources import readers as R
    from seqforge.sources import sinks as S
    hyps = spark.createDataFrame([(7, "b\nb"), (7, "a ' a"), (9, None), (11, "alone")], "seg long, text string")
    refs = spark.createDataFrame([(7, 8, "s ' t"), (7, 20, None), (9, 12, "u"), (9, 10, None), (9, 10, None), (None, 3, "n"), (13, 14, "no gold")],
                                 "seg long, ref_no long, text string")
    heads, samples, qs = report_rows(hyps, refs)
    scores = spark.createDataFrame([(0.5, 0.25, 1 / 3)], "recall_bleu double, prec_bleu double, f1 double")
    S.write_eval_report(heads, samples, scores, str(tmp_path / "all"), str(tmp_path / "single"))
    got = [[r.line for r in R.read_lines(spark, str(tmp_path / f)).orderBy("line_no").collect()] for f in ("all", "single")]
    assert got[0] == ["Batch 1 ", "Query: doc 7 ", "Target >> a'a", *["Sample 8 >> s't"] * 2, *["Sample 20 >> null"] * 2, "",
                      "Batch 2 ", "Query: doc 9 ", "Target >> null", *["Sample 10 >> null"] * 2, "Sample 12 >> u", "",
                      "Avg recall BLEU 0.500000, avg precision BLEU 0.250000, F1 0.333333"]
    assert got[1] == ["s't", ""]
    assert sorted(map(tuple, qs.select("seg", "cnt", "golds").collect())) == [(7, 2, 2), (9, 3, 1)]

"""Features of several fields by hand, and aligned hyp/ref CSV files."""

import pytest

from seqforge.operators.features import example_features
from seqforge.sources import readers as R
from seqforge.sources import sinks as S

WORDS = {"get": 4, "file": 5, "none": 6, "a": 7}


def plain(text, n):
    """[CLS] + ids[:n - 2] + [SEP], padded with 0, and the mask."""
    ids = [1] + [WORDS.get(w, 3) for w in (text or "").split()[:n - 2]] + [2]
    return ids + [0] * (n - len(ids)), [1] * len(ids) + [0] * (n - len(ids))


def test_fields_framed_cut_and_masked(spark):
    rows = [(0, "get file a", "x", "None"), (1, "", None, "get"), (2, "a " * 30, "file  get\tz", "a b c d e f g"), (3, " ", "get", "")]
    ex = spark.createDataFrame(rows, "idx long, code string, post string, target string")
    vocab = spark.createDataFrame(list(WORDS.items()), "token string, id long")
    fields = {"code": 8, "post": 5, "target": 4}
    got = {r.idx: r for r in example_features(ex, ["idx"], fields, vocab).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for idx, *texts in rows:
        for (name, n), text in zip(fields.items(), texts):
            assert (got[idx][f"{name}_ids"], got[idx][f"{name}_mask"]) == plain(text, n)


def test_features_of_no_examples(spark):
    ex = spark.createDataFrame([], "idx long, code string")
    vocab = spark.createDataFrame(list(WORDS.items()), "token string, id long")
    out = example_features(ex, ["idx"], {"code": 8}, vocab)
    assert out.columns == ["idx", "code_ids", "code_mask"] and out.count() == 0


def test_hyp_ref_files_keep_rows_aligned(spark, tmp_path):
    rows = [(k, t, t[::-1]) for k, t in enumerate(["plain", "", 'say "x", y', "two\nlines", " padded ", " ", "end"])]
    pairs = spark.createDataFrame(rows, "idx long, hyp string, ref string").repartition(3)
    files = S.write_hyp_ref_csv(pairs, "idx", "hyp", "ref", str(tmp_path / "test"))
    assert sorted(tuple(r) for r in R.read_hyp_ref_csv(spark, *files).collect()) == rows


def test_hyp_ref_files_of_unlike_length(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a\nb\n")
    (tmp_path / "r.csv").write_text("a\n")
    with pytest.raises(Exception, match="inconsistent number of rows"):
        R.read_hyp_ref_csv(spark, str(tmp_path / "h.csv"), str(tmp_path / "r.csv")).collect()

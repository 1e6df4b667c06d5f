"""The pipeline against its stages' definitions in plain Python."""

import re
import sys
from collections import defaultdict

import corpus_pipeline
from seqforge.llm.language import fit_language_model, has_letter
from tests.conftest import SF_SMALL
from tests.llm.test_containment import brute as held_items
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as components


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_by_stage(spark, tmp_path):
    docs, now = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), {}
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    extra = spark.createDataFrame([(90_001, "123 456 ...", "en", "src1", 11), (90_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    now = rows(docs)

    def step(name, docs):
        out = tmp_path / name
        stages[name](spark, docs, SF_SMALL).write.parquet(str(out))
        return spark.read.parquet(str(out))

    docs = step("language_id", docs)
    assert docs.columns == columns and set(rows(docs)) == {i for i, r in now.items() if has_letter(r.text)}
    now = rows(docs)
    docs = step("exact_dedup", docs)
    first = {}
    for i in sorted(now):
        first.setdefault(now[i].text, i)
    assert docs.columns == columns and set(rows(docs)) == set(first.values()) and docs.count() < len(now)
    now = rows(docs)
    docs = step("near_dedup", docs)
    assert docs.columns == columns
    assert set(rows(docs)) == {c for _, _, c, _ in components([(i, r.text) for i, r in now.items()])}
    now = rows(docs)
    docs = step("decontaminate", docs)
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in held_items([(i, r.text) for i, r in now.items()], items)}
    assert docs.columns == columns and set(rows(docs)) == set(now) - hit and hit
    now = rows(docs)
    mixed = step("mix_sources", docs).collect()
    size, want = targets([(i, r.source, r.text) for i, r in now.items()])
    taken = defaultdict(int)
    for r in mixed:
        assert now[r.doc_id].text == r.text and r.repeats in (1, 2)
        taken[r.source] += r.repeats * len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 60 for s in size)
    assert len({r.doc_id for r in mixed}) == len(mixed)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "repeats"] and out.count() > 50
    assert out.select("doc_id", "repeats").exceptAll(corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "repeats")).count() == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, 0), (2, "", "", "", 1), (3, "the same words here again", "en", "a", 1),
         (3, "the same words here again", "en", "a", 1), (None, "other words of no id", "en", None, 1), (4, "word " * 20_000, "en", "a", 1)],
        "doc_id long, text string, lang string, source string, root long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.count() >= 4, name
    assert corpus_pipeline.mix_sources(spark, docs, SF_SMALL).count() >= 1


def test_model_is_learned_from_training_rows_only(spark):
    assert fit_language_model(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).classes == ["de", "en", "es", "fr"]
    assert "corpus_pipeline" in sys.modules

"""The pipeline's language stage rejects what its classifier is unsure of."""

import corpus_pipeline
from seqforge.llm.language import fit_language_model, has_letter, identify_language
from tests.conftest import SF_SMALL


def test_unsure_documents_go(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(90_001, "A.", "en", "src1", 2), (90_002, "123", "en", "src1", 3), (90_003, "zq xj", None, None, 5)], docs.schema)
    docs = docs.unionByName(odd).localCheckpoint()
    text = {r.doc_id: r.text for r in docs.collect()}
    score = {r.doc_id: r.score for r in identify_language(docs, fit_language_model(docs)).collect()}
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF_SMALL).collect()}
    assert kept == {i for i, s in score.items() if s >= 0.5 and has_letter(text[i])}
    assert kept and any(i not in kept and has_letter(t) for i, t in text.items())

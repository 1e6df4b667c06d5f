"""Registered queries: sources and sinks plus positional joins (2.4).

Each query writes data derived from the driver tables under the shared
checkpoint folder, reads it back with the package readers and returns what was
read; the SQL twin computes the same rows from the tables directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import arrays as A
from seqforge.functions.text import stage_target, tokens_ws
from seqforge.operators import bleu as B
from seqforge.operators import features as FE
from seqforge.operators import rank as RK
from seqforge.operators import runlog as RL
from seqforge.operators import vocab as V
from seqforge.operators.joins import lookup_join
from seqforge.plans import fixtures as fx
from seqforge.plans import sqlgen as sg
from seqforge.plans.catalog import NBEST_SQL, SIM_BLEU_SQL, _round_all, _sent_bleu_sql, nbest_shared
from seqforge.plans.catalog_runlog import CORPUS_SQL, METRICS_SQL, corpus_frame
from seqforge.plans.catalog_seq import DOC_VOCAB_SQL, ENC_SQL, MAX_SRC, MAX_TRG, encoded, vocab_sql
from seqforge.plans.registry import register
from seqforge.session import cut_lineage
from seqforge.sources import readers as R
from seqforge.sources import sinks as S
from seqforge.sources.json_vocab import write_vocab_json

CORPUS_COLS = ["annotation", "source_code", "target_api", "api_seq", "related_so_question"]


def _write_corpus_csv(spark, sf) -> str:
    path = S.scratch_path(spark, "corpus-csv")
    S.write_ordered_csv(corpus_frame(spark, sf), CORPUS_COLS, "conv_id", path, header=True)
    return path


CORPUS_IDX_SQL = f"SELECT *, CAST(row_number() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS idx FROM ({CORPUS_SQL})"


def _filled(col: str) -> str:
    return f"CASE WHEN {col} IS NULL OR {col} IN ({', '.join(sg.q(v) for v in R.PANDAS_NA)}) THEN '' ELSE {col} END"


EXAMPLES_SQL = f"""
  SELECT idx, '' AS src_ant, lower({_filled('source_code')}) AS src_code,
         lower({_filled('related_so_question')}) AS sim_post, lower({_filled('target_api')}) AS target
  FROM ({CORPUS_IDX_SQL})"""


@register("src_examples_csv", EXAMPLES_SQL)
def src_examples_csv(spark, sf):
    """Corpus CSV (multi-line quoted cells) -> examples: fill "", lower-case, position idx,
    annotation blanked as in the shared reader."""
    df = R.read_corpus_csv(spark, _write_corpus_csv(spark, sf), na_values="pandas")
    return R.examples_from_corpus(df)


@register("src_csv_columns", f"SELECT idx, annotation, target_api, api_seq FROM ({CORPUS_IDX_SQL})")
def src_csv_columns(spark, sf):
    """Column-pruned corpus read (annotation, target_api, api_seq) with positions."""
    return R.read_corpus_csv(spark, _write_corpus_csv(spark, sf), ["annotation", "target_api", "api_seq"])


# ------------------------------------------------------------------ examples to features, predictions and scores
FIELDS = {"src_code": MAX_SRC, "src_ant": MAX_SRC, "sim_post": MAX_SRC, "target": MAX_TRG}
_EXAMPLE_TOKENS_SQL = " UNION ALL ".join(f"SELECT {sg.tokens_ws(c)} AS tokens FROM ({EXAMPLES_SQL})" for c in ("src_code", "target"))


def _features_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT idx, stage, '{f}' AS field, {n} AS m, ({sg.tokens_ws(f)})[1:{n - 2}] AS t FROM x"
                               for f, n in FIELDS.items())
    padded = "list_concat(f, list_transform(range(m - len(f)), lambda x: CAST(0 AS BIGINT)))"
    shown = ", ".join(f"max(CASE WHEN field = '{f}' THEN array_to_string({padded}, ' ') END) AS {f}_ids, "
                      f"CAST(max(CASE WHEN field = '{f}' THEN len(f) END) AS BIGINT) AS {f}_real" for f in FIELDS)
    return f"""
  WITH e AS ({EXAMPLES_SQL}), v AS (SELECT * FROM {vocab_sql(_EXAMPLE_TOKENS_SQL)}),
  x AS (SELECT idx, 'train' AS stage, src_code, src_ant, sim_post, target FROM e
        UNION ALL SELECT idx, 'test', src_code, src_ant, sim_post, 'None' FROM e),
  cells AS ({cells}),
  ids AS (SELECT idx, stage, field, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM (
            SELECT idx, stage, field, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM cells) LEFT JOIN v USING (token)
          GROUP BY ALL),
  framed AS (SELECT idx, stage, field, m, list_concat([CAST(1 AS BIGINT)], coalesce(ids, []), [CAST(2 AS BIGINT)]) AS f
             FROM cells LEFT JOIN ids USING (idx, stage, field))
  SELECT idx, stage, {shown} FROM framed GROUP BY idx, stage"""


def _examples(spark, sf):
    return cut_lineage(R.examples_from_corpus(R.read_corpus_csv(spark, _write_corpus_csv(spark, sf), na_values="pandas")))


@register("example_features", _features_sql())
def example_features(spark, sf):
    """Corpus CSV to model inputs: code, annotation, post and target of every example framed, padded and masked, for
    training and for testing (target ``None``); words that only posts hold are unknown. Both stages share the fields
    of an example, which are looked up once beside its two targets."""
    e = _examples(spark, sf)
    v = cut_lineage(V.build_vocab(e.select(F.explode(F.array("src_code", "target")).alias("t")).select(tokens_ws("t").alias("tokens"))))
    targets = {stage: f"{stage}_target" for stage in ("train", "test")}
    staged = e.select("*", *[stage_target("target", F.lit(stage)).alias(name) for stage, name in targets.items()])
    fields = {name: n for name, n in FIELDS.items() if name != "target"} | {name: FIELDS["target"] for name in targets.values()}
    f = FE.example_features(staged, ["idx"], fields, v)
    shown = f.select("idx", *[c for name in fields for c in (
        A.ids_text(f"{name}_ids").alias(f"{name}_ids"),
        F.aggregate(f"{name}_mask", F.lit(0).cast("bigint"), lambda a, b: a + b).alias(f"{name}_real"))])
    return shown.select("idx", F.inline(F.array(*[F.struct(F.lit(stage).alias("stage"), *[
        F.col(f"{name if name != 'target' else of}_{part}").alias(f"{name}_{part}") for name in FIELDS for part in ("ids", "real")])
        for stage, of in targets.items()])))


_SCORED_SQL = f"""
  WITH e AS ({EXAMPLES_SQL}), known AS (SELECT DISTINCT unnest({sg.tokens_ws("target")}) AS token FROM e)
  SELECT e.idx AS seg, coalesce(h.hyp, '') AS hyp, e.target AS ref FROM e LEFT JOIN (
    SELECT idx, array_to_string(list(CASE WHEN known.token IS NULL THEN '<unk>' ELSE w.token END ORDER BY pos), ' ') AS hyp FROM (
      SELECT idx, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (
        SELECT idx, ({sg.tokens_ws("src_code")})[1:{MAX_SRC - 2}] AS t FROM e)) w LEFT JOIN known USING (token) GROUP BY idx) h USING (idx)"""


@register("csv_to_scores", _sent_bleu_sql(_SCORED_SQL))
def csv_to_scores(spark, sf):
    """The whole test flow: corpus CSV, examples, features, predicted ids, decoded texts, ``_hyp.csv`` and ``_ref.csv``, BLEU-1..4
    of the two files. The prediction of an example is its code in the vocabulary of the targets."""
    e = _examples(spark, sf)
    v = cut_lineage(V.build_vocab(e.select(tokens_ws("target").alias("tokens"))))
    f = FE.example_features(e, ["idx"], {"src_code": MAX_SRC}, v)
    predicted = f.select("idx", A.eos_cut(A.safe_slice("src_code_ids", 2, MAX_SRC - 1)).alias("ids"))     # after CLS, up to SEP
    texts = V.decode_ids(predicted, "idx", "ids", v).select("idx", F.col("text").alias("hyp"))
    pairs = texts.join(e.select("idx", F.col("target").alias("ref")), "idx")
    files = S.write_hyp_ref_csv(pairs, "idx", "hyp", "ref", S.scratch_path(spark, "test"))
    read = R.read_hyp_ref_csv(spark, *files)
    return _round_all(B.mean_sentence_bleu(read.withColumnRenamed("idx", "seg")))


# ------------------------------------------------------------------ line files
DOC_LINES_POS_SQL = f"SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no) - 1 AS BIGINT) AS idx, line FROM ({fx.DOC_LINES_SQL})"
CONV_LINES_SQL = """
  SELECT conv_id, turn, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM conversations"""
CONV_LINES_POS_SQL = f"SELECT CAST(row_number() OVER (ORDER BY conv_id, turn, line_no) - 1 AS BIGINT) AS idx, line FROM ({CONV_LINES_SQL})"


def _conv_lines(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _write_lines(spark, df, col, order, tag):
    path = S.scratch_path(spark, tag)
    S.write_ordered_text(df, col, order, path)
    return path


@register("src_zip_lines", f"""
  SELECT s.idx, {sg.strip('s.line')} AS source, {sg.strip('t.line')} AS target
  FROM ({DOC_LINES_POS_SQL}) s JOIN ({CONV_LINES_POS_SQL}) t USING (idx)""")
def src_zip_lines(spark, sf):
    """Two line files (document lines, conversation lines) zipped by position, stripped,
    stopping at the shorter file."""
    src = _write_lines(spark, fx.doc_lines(spark, sf), "line", ["doc_id", "line_no"], "src")
    trg = _write_lines(spark, _conv_lines(spark, sf), "line", ["conv_id", "turn", "line_no"], "trg")
    return R.zip_lines(spark, src, trg)


@register("src_zip_lines_ctx", f"""
  SELECT s.idx, {sg.strip('s.line')} AS source, {sg.strip('t.line')} AS target,
         nullif({sg.strip("CASE WHEN length(s.line) < 20 THEN '\"\"' ELSE lower(s.line) END")}, '""') AS context_api
  FROM ({DOC_LINES_POS_SQL}) s JOIN ({CONV_LINES_POS_SQL}) t USING (idx)""")
def src_zip_lines_ctx(spark, sf):
    """Three aligned files; a context line equal to "" becomes null."""
    lines = fx.doc_lines(spark, sf)
    ctx = lines.withColumn("ctx", F.when(F.length("line") < 20, F.lit('""')).otherwise(F.lower("line")))
    src = _write_lines(spark, lines, "line", ["doc_id", "line_no"], "src")
    trg = _write_lines(spark, _conv_lines(spark, sf), "line", ["conv_id", "turn", "line_no"], "trg")
    cp = _write_lines(spark, ctx, "ctx", ["doc_id", "line_no"], "ctx")
    return R.zip_lines(spark, src, trg, cp)


@register("src_paired_lines_strict", f"""
  SELECT idx, line AS reference, lower(line) AS candidate FROM ({DOC_LINES_POS_SQL})""")
def src_paired_lines_strict(spark, sf):
    """Reference and candidate line files that must have equal line counts."""
    lines = fx.doc_lines(spark, sf).withColumn("low", F.lower("line"))
    ref = _write_lines(spark, lines, "line", ["doc_id", "line_no"], "ref")
    cand = _write_lines(spark, lines, "low", ["doc_id", "line_no"], "cand")
    return R.paired_lines_strict(spark, ref, cand)


# ------------------------------------------------------------------ vocabulary JSON, packed ids, vectors
@register("src_vocab_json", f"""
  SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS pos, token, id FROM {DOC_VOCAB_SQL}""")
def src_vocab_json(spark, sf):
    """Vocabulary written as one JSON object line (token -> id, in id order) and read back."""
    d = fx.table(spark, sf, "documents").select(F.filter(F.split(F.lower("text"), r"(?U)\s+"),
                                                         lambda x: x != "").alias("tokens"))
    v = V.build_vocab(d, "tokens")
    path = S.scratch_path(spark, "vocab-json")
    write_vocab_json(cut_lineage(v), path)
    return R.read_vocab_json(spark, path)


def _write_packed(spark, sf):
    e = encoded(spark, sf)
    d = S.scratch_path(spark, "packed")
    desc = e.select(F.col("seq_id").alias("row"), F.reverse(A.zero_cut("ids")).alias("ids"))
    api = e.select(F.col("seq_id").alias("row"), "ids")
    desc.write.mode("overwrite").parquet(f"{d}/desc")
    api.write.mode("overwrite").parquet(f"{d}/api")
    return f"{d}/desc", f"{d}/api"


@register("src_packed_sequences", f"""
  SELECT seq_id AS row, array_to_string(list_reverse(
           CASE WHEN coalesce(list_position(ids, 0), 0) > 0 THEN ids[1:list_position(ids, 0) - 1] ELSE ids END), ' ') AS desc,
         array_to_string(ids, ' ') AS api FROM ({ENC_SQL})""")
def src_packed_sequences(spark, sf):
    """Packed id arrays for description and API aligned on row (counts must agree)."""
    dp, ap = _write_packed(spark, sf)
    p = R.read_packed(spark, dp, ap)
    return p.select("row", A.ids_text("desc").alias("desc"), A.ids_text("api").alias("api"))


@register("align_assert", f"SELECT CAST(count(*) AS BIGINT) AS n_rows FROM ({ENC_SQL})")
def align_assert(spark, sf):
    """Row counts of two aligned sources must match (any one-sided row raises)."""
    dp, ap = _write_packed(spark, sf)
    return R.read_packed(spark, dp, ap).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("src_ragged_slice", f"""
  SELECT seq_id AS row, array_to_string(ids[1:least(len, 8)], ' ') AS ids FROM ({ENC_SQL})""")
def src_ragged_slice(spark, sf):
    """Ragged layout: flat (pos, id) + index (row, pos, length) -> rows of at most max-2 = 8 ids."""
    e = encoded(spark, sf).select("seq_id", A.take("ids", F.col("len")).alias("real"), "len")
    off = RK.prefix_offsets(e, ["seq_id"], "len", "pos")
    phrases = off.select(F.posexplode("real").alias("i", "id"), "pos").select(
        (F.col("pos") + F.col("i")).alias("pos"), "id")
    index = off.select(F.col("seq_id").alias("row"), "pos", F.col("len").alias("length"))
    r = R.ragged_slice(phrases, index, 10)
    return r.select("row", A.ids_text("ids").alias("ids"))


@register("src_vectors", """
  SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims,
         round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def src_vectors(spark, sf):
    """Vectors saved as Parquet array<float> and loaded back."""
    path = S.scratch_path(spark, "vecs")
    fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")).write.parquet(path)
    v = R.read_vectors(spark, path)
    return _round_all(v.select("vec_id", F.size("vec").cast("bigint").alias("dims"),
                               F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0),
                                           lambda a, x: a + x).alias("total")))


@register("sink_vectors", """
  SELECT vec_id, CAST(p AS BIGINT) AS pos, round(CAST(x AS DOUBLE), 6) AS value FROM (
    SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)""")
def sink_vectors(spark, sf):
    """save_vecs / load_vecs: float vectors written (compressed Parquet) and read back element-exact."""
    path = S.scratch_path(spark, "vecs")
    (fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
     .write.option("compression", "zstd").parquet(path))
    v = R.read_vectors(spark, path).select("vec_id", F.posexplode("vec").alias("pos", "value"))
    return _round_all(v.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value")))


# ------------------------------------------------------------------ split line files
def _split_lines_sql(cols: dict[str, str]) -> str:
    """Lines of each written file: a value containing newlines spans several lines."""
    parts = []
    for name, expr in cols.items():
        parts.append(f"""SELECT '{name}' AS file, CAST(row_number() OVER (ORDER BY idx, sub) - 1 AS BIGINT) AS line_no, line FROM (
            SELECT idx, unnest(string_split(coalesce({expr}, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce({expr}, ''), chr(10)), 1) AS sub FROM ({CORPUS_IDX_SQL}))""")
    return " UNION ALL ".join(parts)


def _split_query(spark, sf, fn):
    c = RK.dense_index(corpus_frame(spark, sf), ["conv_id"])
    variant = fn(c)
    prefix = S.scratch_path(spark, "split")
    paths = S.write_split(variant, prefix)
    out = None
    for name, p in paths.items():
        lines = R.read_lines(spark, p, "line").select(F.lit(name).alias("file"), "line_no", "line")
        out = lines if out is None else out.unionByName(lines)
    return out


@register("sink_split_annotation", _split_lines_sql({
    "annotation": sg.strip("annotation"), "all_seq": "api_seq", "target_seq": "target_api"}))
def sink_split_annotation(spark, sf):
    """Variant 'annotation': stripped annotation, API sequence and target files, aligned."""
    return _split_query(spark, sf, S.split_annotation)


@register("sink_split_code", _split_lines_sql({"code": sg.collapse_ws("source_code"), "seq": "target_api"}))
def sink_split_code(spark, sf):
    """Variant 'code': whitespace-collapsed code + target API files."""
    return _split_query(spark, sf, S.split_code)


@register("sink_split_bimodal", _split_lines_sql({
    "bimodal": sg.collapse_ws("annotation || ' ' || source_code"), "seq": "target_api"}))
def sink_split_bimodal(spark, sf):
    """Variant 'bimodal': annotation + code collapsed + target API files."""
    return _split_query(spark, sf, S.split_bimodal)


# ------------------------------------------------------------------ hyp/ref CSV, id/text, report, metric log
@register("sink_hyp_ref_csv", f"""
  SELECT 'hyp' AS file, CAST(row_number() OVER (ORDER BY seg) - 1 AS BIGINT) AS idx, hyp AS text FROM ({fx.STAR_PAIRS_SQL})
  UNION ALL
  SELECT 'ref', CAST(row_number() OVER (ORDER BY seg) - 1 AS BIGINT), ref FROM ({fx.STAR_PAIRS_SQL})""")
def sink_hyp_ref_csv(spark, sf):
    """Headerless predictions / gold CSVs written in the same order and read back."""
    files = S.write_hyp_ref_csv(fx.star_pairs(spark, sf), "seg", "hyp", "ref", S.scratch_path(spark, "hypref"))
    return R.read_hyp_ref_csv(spark, *files).select("idx", F.stack(
        F.lit(2), F.lit("hyp"), "hyp", F.lit("ref"), "ref").alias("file", "text")).select("file", "idx", "text")


_ID_TEXT_SQL = f"""
  SELECT CAST(seg AS VARCHAR) AS id, regexp_replace(text, '[\\t\\n]', ' ', 'g') AS text
  FROM ({fx.anchor_refs_sql()[0]})"""


@register("sink_id_text", f"SELECT id, {sg.strip('text')} AS text FROM ({_ID_TEXT_SQL})")
def sink_id_text(spark, sf):
    """``idx\\tprediction`` lines written and parsed back (text stripped by the parser)."""
    hyps, _ = fx.anchor_and_refs(spark, sf)
    t = hyps.select("seg", F.regexp_replace("text", "[\t\n]", " ").alias("text"))
    lines = S.id_text_lines(t, "seg", "text")
    path = _write_lines(spark, lines, "value", ["seg"], "idtext")
    return R.parse_predictions(R.read_lines(spark, path, "value"))


def report_rows(hyps, refs):
    """(heads, samples, queries) of the n-best report of golds ``hyps`` (seg, text) and samples ``refs`` (seg, ref_no, text).

    Queries are numbered on narrow rows and written once; no text moves to get its number. A sample comes once for every
    gold of its query, as pairs of samples and golds do.
    """
    golds = hyps.groupBy("seg").agg(F.count(F.lit(1)).cast("int").alias("golds"))
    qs = cut_lineage(RK.dense_index(refs.groupBy("seg").agg(F.count(F.lit(1)).alias("cnt")).join(golds, "seg"), ["seg"], "b"))
    number, counts = qs.select("seg", (F.col("b") + 1).alias("batch"), "golds"), qs.select("seg", "cnt")
    heads = (lookup_join(hyps, number, ["seg"], "seg", qs.select("seg", F.col("golds").alias("cnt")))
             .groupBy("batch", F.concat(F.lit("doc "), F.col("seg").cast("string")).alias("query"))
             .agg(F.min(F.regexp_replace("text", "\n", " ")).alias("target")))
    samples = lookup_join(refs, number, ["seg"], "ref_no", counts).select(
        "batch", F.col("ref_no").alias("r_id"), F.regexp_replace("text", "\n", " ").alias("sample"),
        F.explode(F.sequence(F.lit(1), F.col("golds"))).alias("_copy")).drop("_copy")
    return heads, samples, qs


@register("sink_eval_report", f"""
  WITH x AS (SELECT qid, r_id, dense_rank() OVER (ORDER BY qid) AS batch, 'doc ' || CAST(qid AS VARCHAR) AS q,
               replace(ref, chr(10), ' ') AS t, replace(replace(hyp, chr(10), ' '), ' '' ', '''') AS h FROM ({NBEST_SQL})),
  l AS (SELECT DISTINCT batch, 0 AS part, 0 AS r_id, 'Batch ' || CAST(batch AS VARCHAR) || ' ' AS line FROM x
        UNION ALL SELECT DISTINCT batch, 1, 0, 'Query: ' || q || ' ' FROM x
        UNION ALL SELECT DISTINCT batch, 2, 0, 'Target >> ' || replace(t, ' '' ', '''') FROM x
        UNION ALL SELECT batch, 3, r_id, 'Sample ' || CAST(r_id AS VARCHAR) || ' >> ' || h FROM x
        UNION ALL SELECT DISTINCT batch, 4, 0, '' FROM x
        UNION ALL SELECT 1000000000000, 5, 0, 'Avg recall BLEU ' || printf('%.6f', avg(max_bleu)) || ', avg precision BLEU '
          || printf('%.6f', avg(avg_bleu)) || ', F1 ' || printf('%.6f', {sg.f1('avg(avg_bleu)', 'avg(max_bleu)')}) FROM ({SIM_BLEU_SQL}))
  SELECT 'all' AS file, CAST(row_number() OVER (ORDER BY batch, part, r_id) - 1 AS BIGINT) AS line_no, line FROM l
  UNION ALL SELECT 'single', CAST(row_number() OVER (ORDER BY batch) - 1 AS BIGINT), h FROM (
    SELECT batch, arg_min(h, r_id) AS h FROM x GROUP BY batch)""")
def sink_eval_report(spark, sf):
    """Human-readable n-best report (Batch, Query, Target, Samples, summary) and the file of best samples, read back by line."""
    hyps, refs = fx.anchor_and_refs(spark, sf)
    heads, samples, qs = report_rows(hyps, refs)
    path = S.scratch_path(spark, "report")
    scores = B.recall_prec_f1(B.sim_bleu(nbest_shared(hyps, refs, qs.select("seg", "cnt"))))
    S.write_eval_report(heads, samples, scores, f"{path}/all", f"{path}/single")
    out = [R.read_lines(spark, f"{path}/{f}", "line").select(F.lit(f).alias("file"), "line_no", "line") for f in ("all", "single")]
    return out[0].unionByName(out[1])


@register("sink_metric_log", f"""
  SELECT CAST(run AS VARCHAR) AS run, epoch, CAST(epoch AS BIGINT) AS step, name, value FROM (
    SELECT run, epoch, 'eval_ppl' AS name, round(ppl, 5) AS value FROM ({METRICS_SQL})
    UNION ALL SELECT run, epoch, 'eval_tokens', CAST(tokens AS DOUBLE) FROM ({METRICS_SQL}))""")
def sink_metric_log(spark, sf):
    """Scalar metrics appended to the metric log in two commits, the second one twice (a retry adds nothing), and read back."""
    m = RL.eval_metrics(fx.run_log(spark, sf), F.col("name") == "purchase")
    long = m.select("run", "epoch", F.col("epoch").cast("bigint").alias("step"), F.explode(F.array(
        F.struct(F.lit("eval_ppl").alias("name"), F.round("ppl", 5).alias("value")),
        F.struct(F.lit("eval_tokens").alias("name"), F.col("tokens").cast("double").alias("value")))).alias("kv")) \
        .select("run", "epoch", "step", "kv.name", "kv.value")
    path = S.scratch_path(spark, "metrics")
    S.append_metrics(long.where(F.col("epoch") < 15), path, "first")
    for _ in range(2):
        S.append_metrics(long.where(F.col("epoch") >= 15), path, "second")
    return spark.read.parquet(path).drop("commit")


# ------------------------------------------------------------------ positional joins
@register("join_by_position", """
  SELECT d.idx, d.doc_id, c.conv_id, c.turn FROM
    (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) d
    JOIN (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM conversations) c USING (idx)""")
def join_by_position(spark, sf):
    """Zip two tables by position (documents, turns), stopping at the shorter."""
    from seqforge.operators.joins import join_by_position as jbp
    d = RK.dense_index(fx.table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    c = RK.dense_index(fx.table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
    return jbp(d, c).select("idx", "doc_id", "conv_id", "turn")


@register("inverse_lookup_strict", f"""
  SELECT v.token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(ids) AS id FROM ({ENC_SQL})) e
  JOIN (SELECT id, max(token) AS token FROM {__import__('seqforge.plans.catalog_seq', fromlist=['x']).EVENT_VOCAB_SQL} GROUP BY id) v
  USING (id) GROUP BY v.token""")
def inverse_lookup_strict(spark, sf):
    """id -> token over all encoded ids (PAD included); an id missing from the vocabulary raises."""
    from seqforge.operators.joins import inverse_lookup_strict as ils
    from seqforge.plans.catalog_seq import event_vocab
    e = encoded(spark, sf).select(F.explode("ids").alias("id"))
    inv = V.invert_vocab(event_vocab(spark, sf)).withColumnRenamed("id", "vid")
    j = ils(e, "id", inv, "vid")
    return j.groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("run_args_json", f"""
  SELECT run, CAST(to_json(struct_pack(run := run, epochs := epochs, steps := steps, first_step := first_step)) AS VARCHAR) AS args
  FROM (SELECT run, CAST(count(DISTINCT epoch) AS BIGINT) AS epochs, CAST(count(*) AS BIGINT) AS steps,
               min(step) AS first_step FROM ({fx.RUN_LOG_SQL}) GROUP BY run)""")
def run_args_json(spark, sf):
    """Run configuration saved as one JSON object per run, written next to the metric log and read back."""
    log = fx.run_log(spark, sf)
    cfg = log.groupBy("run").agg(F.countDistinct("epoch").cast("bigint").alias("epochs"),
                                 F.count(F.lit(1)).cast("bigint").alias("steps"), F.min("step").alias("first_step"))
    path = S.scratch_path(spark, "metrics")
    S.save_run_args(cfg, "run", ["run", "epochs", "steps", "first_step"], path)
    return R.read_run_args(spark, path, cfg.schema["run"].dataType)

"""Registered queries: smoothed (mteval) BLEU with several references, n-gram statistics,
the id/text scorer end to end (SURVEY 2.5, 2.8, 2.1 id/text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.operators import bleu as B
from seqforge.operators.joins import skew_safe_join
from seqforge.operators.ngrams import multiset_intersect_stats, ngram_count, reference_max_counts, reference_max_grams
from seqforge.plans import fixtures as fx
from seqforge.plans import sqlgen as sg
from seqforge.plans.catalog import _round_all
from seqforge.plans.registry import register
from seqforge.sources.readers import parse_gold, parse_predictions

_H, _R = fx.anchor_refs_sql()
HYPS_TOK = f"SELECT seg, {sg.cli_tokens('text')} AS t FROM ({_H})"
REFS_TOK = f"SELECT seg, ref_no, {sg.cli_tokens('text')} AS t FROM ({_R})"


def _stats(spark, sf, eff="shortest"):
    hyps, refs = fx.anchor_and_refs(spark, sf)      # both read the same exchanges
    return B.smoothed_stats(hyps, refs, eff_ref_len=eff)


def _seg_sql(eff):
    b = sg.mteval_bleu()
    return (f"SELECT seg, c, r, m1, m2, m3, m4, {sg.r6(b[0])} AS bleu, "
            + ", ".join(f"{sg.r6(b[k])} AS p{k}" for k in range(1, 5))
            + f" FROM {sg.multi_ref_stats(HYPS_TOK, REFS_TOK, eff)} s")


def _seg_query(eff):
    def fn(spark, sf):
        return _round_all(B.with_smoothed_bleu(_stats(spark, sf, eff)))
    fn.__doc__ = f"Per-segment smoothed BLEU, several references, effective length '{eff}'."
    return fn


register("bleu_segment_smoothed", _seg_sql("shortest"))(_seg_query("shortest"))
register("ref_len_shortest", _seg_sql("shortest").replace("SELECT seg, c, r,", "SELECT seg, c, r, 'shortest' AS mode,", 1))(
    lambda spark, sf: _seg_query("shortest")(spark, sf).select("seg", "c", "r", F.lit("shortest").alias("mode"),
                                                               *B.M, "bleu", "p1", "p2", "p3", "p4"))
register("ref_len_average", _seg_sql("average"))(_seg_query("average"))
register("ref_len_closest", _seg_sql("closest"))(_seg_query("closest"))


@register("bleu_from_maps", f"""
  SELECT CAST(count(*) AS BIGINT) AS n_segments, {sg.r6('avg(' + sg.mteval_bleu()[0] + ') * 100')} AS bleu,
         {', '.join(sg.r6('avg(' + sg.mteval_bleu()[k] + ') * 100') + f' AS p{k}' for k in range(1, 5))}
  FROM {sg.multi_ref_stats(HYPS_TOK, REFS_TOK)} s""")
def bleu_from_maps(spark, sf):
    """Mean over ids of the smoothed [bleu, p1..p4] x 100."""
    return _round_all(B.bleu_from_maps(_stats(spark, sf)))


@register("bleu_corpus_smoothed", f"""
  WITH t AS (SELECT CAST(count(*) AS BIGINT) AS n_segments, sum(c) AS c, sum(r) AS r, sum(m1) AS m1, sum(m2) AS m2,
                    sum(m3) AS m3, sum(m4) AS m4, sum(greatest(c, 0)) AS g1, sum(greatest(c - 1, 0)) AS g2,
                    sum(greatest(c - 2, 0)) AS g3, sum(greatest(c - 3, 0)) AS g4
             FROM {sg.multi_ref_stats(HYPS_TOK, REFS_TOK)} s)
  SELECT n_segments, {sg.r6(sg.mteval_bleu(pooled=True)[0])} AS bleu,
         {', '.join(sg.r6(sg.mteval_bleu(pooled=True)[k]) + f' AS p{k}' for k in range(1, 5))} FROM t""")
def bleu_corpus_smoothed(spark, sf):
    """Statistics pooled over all segments, then one smoothed score."""
    return _round_all(B.bleu_corpus_smoothed(_stats(spark, sf)))


@register("bleu_stats_cooked", f"""
  SELECT seg, c AS testlen, r AS reflen,
         CAST(greatest(c, 0) AS BIGINT) AS guess1, CAST(greatest(c - 1, 0) AS BIGINT) AS guess2,
         CAST(greatest(c - 2, 0) AS BIGINT) AS guess3, CAST(greatest(c - 3, 0) AS BIGINT) AS guess4,
         m1 AS correct1, m2 AS correct2, m3 AS correct3, m4 AS correct4
  FROM {sg.multi_ref_stats(HYPS_TOK, REFS_TOK)} s""")
def bleu_stats_cooked(spark, sf):
    """cook_test: testlen, reflen, guess[4], correct[4] (clipped by reference max counts)."""
    s = _stats(spark, sf)
    return s.select("seg", F.col("c").alias("testlen"), F.col("r").alias("reflen"),
                    *[F.greatest(F.col("c") - (n - 1), F.lit(0)).cast("bigint").alias(f"guess{n}") for n in range(1, 5)],
                    *[F.col(f"m{n}").alias(f"correct{n}") for n in range(1, 5)])


@register("ref_max_count", f"""
  SELECT seg, n, replace(gram, chr(1), ' ') AS gram, CAST(max(cnt) AS BIGINT) AS maxcount FROM (
    SELECT seg, ref_no, n, gram, count(*) AS cnt FROM {sg.ngram_rows(f'({REFS_TOK})', 'seg, ref_no', 't')}
    GROUP BY seg, ref_no, n, gram) GROUP BY seg, n, gram""")
def ref_max_count(spark, sf):
    """cook_refs: per n-gram the maximum count over the references of a segment."""
    _, refs = fx.anchor_and_refs(spark, sf)
    c = reference_max_grams(refs, "seg", "ref_no", "text", cut=lambda t: B.cli_tokens(F.col(t)))
    return c.select("seg", F.col("n").cast("bigint").alias("n"), F.translate("gram", "\u0001", " ").alias("gram"), "maxcount")


@register("cook_refs", f"""
  WITH m AS (SELECT seg, n, gram, max(cnt) AS m FROM (SELECT seg, ref_no, n, gram, count(*) AS cnt
               FROM {sg.ngram_rows(f'({REFS_TOK})', 'seg, ref_no', 't')} GROUP BY ALL) GROUP BY ALL),
  c AS (SELECT seg, {', '.join(f'CAST(coalesce(sum(m) FILTER (n = {k}), 0) AS BIGINT) AS max{k}' for k in range(1, 5))},
          CAST(count(*) AS BIGINT) AS n_grams FROM m GROUP BY seg)
  SELECT l.*, coalesce(n_grams, 0) AS n_grams, {', '.join(f'coalesce(max{k}, 0) AS max{k}' for k in range(1, 5))}
  FROM (SELECT seg, CAST(count(*) AS BIGINT) AS n_refs, CAST(min(len(t)) AS BIGINT) AS shortest,
          CAST(max(len(t)) AS BIGINT) AS longest, CAST(sum(len(t)) AS BIGINT) AS total_len
        FROM ({REFS_TOK}) GROUP BY seg) l LEFT JOIN c USING (seg)""")
def cook_refs(spark, sf):
    """cook_refs per segment: reference lengths, and the maximum counts over its references, summed per order."""
    _, refs = fx.anchor_and_refs(spark, sf)
    size = F.size("t")
    lengths = refs.select("seg", B.cli_tokens(F.col("text")).alias("t")).groupBy("seg").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_refs"), F.min(size).cast("bigint").alias("shortest"),
        F.max(size).cast("bigint").alias("longest"), F.sum(size).cast("bigint").alias("total_len"))
    most = reference_max_counts(refs, "seg", "ref_no", "text", cut=lambda t: B.cli_tokens(F.col(t)))
    return lengths.join(most, "seg", "left").fillna(0, ["n_grams", *[f"max{k}" for k in range(1, 5)]])


@register("ngram_count", f"""
  SELECT n, CAST(count(*) AS BIGINT) AS distinct_grams, CAST(sum(cnt) AS BIGINT) AS occurrences,
         CAST(max(cnt) AS BIGINT) AS max_count
  FROM (SELECT doc_id, n, gram, count(*) AS cnt
        FROM {sg.ngram_rows(f"(SELECT doc_id, {sg.tokens_ws(sg.lower('text'))} AS t FROM documents)", 'doc_id', 't')}
        GROUP BY doc_id, n, gram) GROUP BY n""")
def ngram_count_q(spark, sf):
    """n-gram counts per document (orders 1..4), summarised per order."""
    d = fx.table(spark, sf, "documents").select("doc_id", B.tokens_ws(F.lower("text")).alias("t"))
    c = ngram_count(d, ["doc_id"], "t")
    return c.groupBy(F.col("n").cast("bigint").alias("n")).agg(F.count(F.lit(1)).cast("bigint").alias("distinct_grams"),
                              F.sum("cnt").cast("bigint").alias("occurrences"),
                              F.max("cnt").cast("bigint").alias("max_count"))


register("ngrams", f"""
  SELECT doc_id, n, CAST(count(*) AS BIGINT) AS n_grams, CAST(count(DISTINCT gram) AS BIGINT) AS n_distinct
  FROM {sg.ngram_rows(f"(SELECT doc_id, {sg.tokens_ws(sg.lower('text'))} AS t FROM documents)", 'doc_id', 't')}
  GROUP BY doc_id, n""")(lambda spark, sf: _ngrams(spark, sf))


def _ngrams(spark, sf):
    """All n-grams (n = 1..4) of every document: occurrences and distinct grams per order."""
    d = fx.table(spark, sf, "documents").select("doc_id", B.tokens_ws(F.lower("text")).alias("t"))
    c = ngram_count(d, ["doc_id"], "t")
    return c.groupBy("doc_id", F.col("n").cast("bigint").alias("n")).agg(F.sum("cnt").cast("bigint").alias("n_grams"),
                                        F.count(F.lit(1)).cast("bigint").alias("n_distinct"))


_CLIP_SQL = sg.pair_stats(fx.STAR_PAIRS_SQL, sg.tokens_ws(sg.lower(sg.strip('hyp'))), sg.tokens_ws(sg.lower(sg.strip('ref'))))


@register("clip_join", f"SELECT seg, m1, m2, m3, m4 FROM {_CLIP_SQL} s")
def clip_join(spark, sf):
    """Clipped n-gram matches per pair: both sides meet by reference, each text moved once."""
    s = B.sentence_bleu_stats(fx.star_shared(spark, sf))
    return s.select("seg", *B.M)


@register("multiset_intersect", f"""
  SELECT seg, n, m FROM (
    SELECT seg, 1 AS n, m1 AS m FROM {_CLIP_SQL} a UNION ALL SELECT seg, 2, m2 FROM {_CLIP_SQL} b
    UNION ALL SELECT seg, 3, m3 FROM {_CLIP_SQL} c UNION ALL SELECT seg, 4, m4 FROM {_CLIP_SQL} d) WHERE m > 0""")
def multiset_intersect(spark, sf):
    """Bag intersection of hypothesis and reference n-grams with INTERSECT ALL (cross-check of clip_join)."""
    p = fx.star_shared(spark, sf)
    out = multiset_intersect_stats(p, "seg", "hyp", "ref", tokens=lambda c: B.sentence_tokens(F.col(c)))
    return out.select("seg", F.col("n").cast("int").alias("n"), F.col("m").cast("bigint").alias("m"))


# ------------------------------------------------------------------ id/text scorer end to end
def _pred_gold_lines(spark, sf):
    """Prediction and gold ``id\\ttext`` lines derived from the several-reference fixture
    (newlines inside a text become spaces so one text is one line)."""
    hyps, refs = fx.anchor_and_refs(spark, sf)
    pred = hyps.select(F.col("seg").alias("line_no"),
                       F.concat_ws("\t", F.col("seg").cast("string"), F.regexp_replace("text", "\n", " ")).alias("value"))
    gold = refs.select(F.col("ref_no").alias("line_no"), F.concat_ws("\t", F.col("seg").cast("string"), F.regexp_replace("text", "\n", " ")).alias("value"))
    return pred, gold


_PRED_SQL = f"SELECT CAST(seg AS VARCHAR) AS id, replace(text, chr(10), ' ') AS text FROM ({_H})"
_GOLD_SQL = f"SELECT CAST(seg AS VARCHAR) AS id, ref_no, replace(text, chr(10), ' ') AS text FROM ({_R})"
_CLI_STATS = sg.multi_ref_stats(f"SELECT id AS seg, {sg.cli_tokens('text')} AS t FROM ({_PRED_SQL})",
                                f"SELECT id AS seg, ref_no, {sg.cli_tokens('text')} AS t FROM ({_GOLD_SQL})")


@register("bleu_cli", f"SELECT {sg.r6('avg(' + sg.mteval_bleu()[0] + ') * 100')} AS bleu FROM {_CLI_STATS} s")
def bleu_cli(spark, sf):
    """TSV predictions + gold lines -> parse -> keep ids on both sides -> smoothed BLEU (first number)."""
    pred_lines, gold_lines = _pred_gold_lines(spark, sf)
    from seqforge.operators.joins import join_pred_gold as jpg
    pred = parse_predictions(pred_lines)
    gold = parse_gold(gold_lines).withColumnRenamed("line_no", "ref_no")
    pred, gold = jpg(pred, gold, gold_pos="ref_no")
    stats = B.smoothed_stats(pred.withColumnRenamed("id", "seg"), gold.withColumnRenamed("id", "seg"))
    return _round_all(B.bleu_from_maps(stats).select("bleu"))


@register("src_id_text_tsv", f"SELECT id, text FROM ({_PRED_SQL})")
def src_id_text_tsv(spark, sf):
    """Parse ``id\\ttext`` prediction lines (no tab -> empty text, extra fields ignored)."""
    pred_lines, _ = _pred_gold_lines(spark, sf)
    return parse_predictions(pred_lines)


@register("join_pred_gold", f"""
  SELECT g.id, CAST(count(*) AS BIGINT) AS n_golds FROM ({_GOLD_SQL}) g
  WHERE g.id IN (SELECT id FROM ({_PRED_SQL})) GROUP BY g.id""")
def join_pred_gold(spark, sf):
    """Gold kept only for ids with a prediction (left semi join); golds per id."""
    from seqforge.operators.joins import join_pred_gold as jpg
    pred_lines, gold_lines = _pred_gold_lines(spark, sf)
    _, g = jpg(parse_predictions(pred_lines), parse_gold(gold_lines), gold_pos="line_no")
    return g.groupBy("id").agg(F.count(F.lit(1)).cast("bigint").alias("n_golds"))


@register("last_prediction_wins", """
  SELECT source AS id, arg_max(line, [doc_id, line_no]) AS text FROM (
    SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
           unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def last_prediction_wins(spark, sf):
    """Repeated ids (document source) keep the text of their last line in file order."""
    from seqforge.sources.readers import last_prediction_wins as lpw
    d = fx.table(spark, sf, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    p = d.select(F.col("source").alias("id"), F.col("line").alias("text"), F.struct("doc_id", "line_no").alias("pos"))
    return lpw(p)


@register("group_golds", f"""
  SELECT id, CAST(ref_no AS BIGINT) AS ref_no, text, CAST(count(*) OVER (PARTITION BY id) AS BIGINT) AS n_golds FROM ({_GOLD_SQL})""")
def group_golds(spark, sf):
    """Several golds per id as multiple references: every gold with its text and the number of its id's golds
    (kept in long form; no per-id list is materialised, and an id with very many golds is spread over tasks)."""
    _, refs = fx.anchor_and_refs(spark, sf)
    g = refs.select(F.col("seg").cast("string").alias("id"), F.col("ref_no").cast("bigint").alias("ref_no"),
                    F.regexp_replace("text", "\n", " ").alias("text"))
    counts = g.groupBy("id").agg(F.count(F.lit(1)).cast("bigint").alias("n_golds"))
    return skew_safe_join(g, counts, ["id"], "ref_no", key_counts=counts.withColumnRenamed("n_golds", "cnt"))


_DEV_STATS = sg.multi_ref_stats(f"SELECT seg, {sg.cli_tokens('hyp')} AS t FROM ({fx.STAR_PAIRS_SQL})",
                                f"SELECT seg, 0 AS ref_no, {sg.cli_tokens('ref')} AS t FROM ({fx.STAR_PAIRS_SQL})")


@register("dev_eval", f"""
  SELECT b.n_segments, b.dev_bleu, x.xmatch FROM
    (SELECT CAST(count(*) AS BIGINT) AS n_segments, round(avg({sg.mteval_bleu()[0]}) * 100, 2) AS dev_bleu
     FROM {_DEV_STATS} s) b,
    (SELECT round(avg(CASE WHEN hyp = ref THEN 1.0 ELSE 0.0 END) * 100, 4) AS xmatch FROM ({fx.STAR_PAIRS_SQL})) x""")
def dev_eval(spark, sf):
    """Evaluation of predictions against gold: smoothed BLEU over the id maps (2 digits) and
    exact match (4 digits), predictions = hypotheses of the document pairs."""
    from seqforge.session import cut_lineage
    pairs = cut_lineage(fx.star_pairs(spark, sf))    # derived input read by three consumers
    hyps = pairs.select("seg", F.col("hyp").alias("text"))
    refs = pairs.select("seg", F.lit(0).alias("ref_no"), F.col("ref").alias("text"))
    scored = B.with_smoothed_bleu(B.smoothed_stats(hyps, refs))
    eq = pairs.select("seg", (F.col("hyp") == F.col("ref")).cast("double").alias("eq"))
    j = scored.join(eq, "seg")                      # one row per segment on both sides
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n_segments"),
                 F.round(F.avg("bleu") * 100, 2).alias("dev_bleu"),
                 F.round(F.avg("eq") * 100, 4).alias("xmatch"))

"""Registered queries (name -> Spark DataFrame builder + DuckDB oracle SQL).

Every query reads the driver tables (or data Spark derives from them) whole.
Floats are rounded to 6 digits and arrays are rendered as joined strings on
both sides so that the two engines can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.operators import bleu as B
from seqforge.plans import fixtures as fx
from seqforge.plans import sqlgen as sg
from seqforge.plans.registry import register

R6 = 6


def r6(c):
    return F.round(c, R6)


def _round_all(df, exclude=()):
    """Round every double column to 6 digits."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in exclude:
            cols.append(F.round(F.col(f.name).cast("double"), R6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ====================================================================== BLEU family
def _sent_bleu_sql(pairs_sql: str, orders=(1, 2, 3, 4), lower=True, tok="ws", strip=True) -> str:
    def prep(col):
        e = col
        if strip:
            e = sg.strip(e)
        if lower:
            e = sg.lower(e)
        return sg.TOKENIZERS[tok](e)
    stats = sg.pair_stats(pairs_sql, prep("hyp"), prep("ref"))
    cols = ", ".join(f"{sg.r6(f'avg({sg.sentence_bleu(n)})')} AS bleu{n}" for n in orders)
    return f"SELECT CAST(count(*) AS BIGINT) AS n_pairs, {cols} FROM {stats} s"


def _sent_bleu_query(orders):
    def fn(spark, sf):
        return _round_all(B.mean_sentence_bleu(fx.star_shared(spark, sf), orders))
    return fn


SENT_BLEU_SQL = _sent_bleu_sql(fx.STAR_PAIRS_SQL)
register("sent_bleu4", SENT_BLEU_SQL)(_sent_bleu_query((1, 2, 3, 4)))
for _n in (1, 2, 3):
    register(f"sent_bleu{_n}", _sent_bleu_sql(fx.STAR_PAIRS_SQL, (_n,)))(_sent_bleu_query((_n,)))


@register("sent_bleu_turns", _sent_bleu_sql(fx.TURN_PAIRS_SQL))
def sent_bleu_turns(spark, sf):
    """Mean sentence BLEU-1..4 over consecutive conversation turns (sparse overlap)."""
    return _round_all(B.mean_sentence_bleu(fx.turn_pairs(spark, sf)))


@register("bleu_stats_pair", f"""
  SELECT seg, c, r, m1, m2, m3, m4,
         CAST(greatest(c, 0) AS BIGINT) AS g1, CAST(greatest(c - 1, 0) AS BIGINT) AS g2,
         CAST(greatest(c - 2, 0) AS BIGINT) AS g3, CAST(greatest(c - 3, 0) AS BIGINT) AS g4,
         {sg.r6(sg.sentence_bleu(4))} AS bleu4
  FROM {sg.pair_stats(fx.STAR_PAIRS_SQL, sg.tokens_ws(sg.lower(sg.strip('hyp'))), sg.tokens_ws(sg.lower(sg.strip('ref'))))} s""")
def bleu_stats_pair(spark, sf):
    """Per-pair statistics (c, r, matches and guesses per order) and sentence BLEU-4."""
    s = B.with_sentence_bleu(B.sentence_bleu_stats(fx.star_shared(spark, sf)), (4,))
    return _round_all(s.select("seg", "c", "r", *B.M,
                               *[F.greatest(F.col("c") - (n - 1), F.lit(0)).cast("bigint").alias(f"g{n}")
                                 for n in range(1, 5)], "bleu4"))


@register("dev_bleu_swapped", f"""
  SELECT CAST(count(*) AS BIGINT) AS n_examples, {sg.r6(f'avg({sg.sentence_bleu(4)})')} AS dev_bleu
  FROM {sg.pair_stats(fx.STAR_PAIRS_SQL, sg.tokens_ws(sg.strip('ref')), sg.tokens_ws(sg.strip('hyp')))} s""")
def dev_bleu_swapped(spark, sf):
    """Dev BLEU as published: prediction passed as reference, gold as hypothesis."""
    return _round_all(B.dev_bleu_swapped(fx.star_shared(spark, sf)))


@register("smoothed_bleu_eps", f"""
  SELECT seg, c, r, m1, m2, m3, m4, {sg.r6(sg.eps_bleu())} AS eps_bleu
  FROM {sg.pair_stats(fx.TURN_PAIRS_SQL, sg.tokens_ws(sg.lower(sg.strip('hyp'))), sg.tokens_ws(sg.lower(sg.strip('ref'))))} s""")
def smoothed_bleu_eps(spark, sf):
    """eps-smoothed BLEU x100 per conversation-turn pair."""
    return _round_all(B.eps_bleu_pairs(fx.turn_pairs(spark, sf)))


@register("exact_match", f"""
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END) AS BIGINT) AS n_match,
         round(avg(CASE WHEN hyp = ref THEN 1.0 ELSE 0.0 END) * 100, 4) AS xmatch
  FROM ({fx.STAR_PAIRS_SQL})""")
def exact_match(spark, sf):
    """Percentage of predictions equal to their gold text."""
    return B.exact_match(fx.star_pairs(spark, sf))


# ---------------------------------------------------------------- n-best (sim_bleu, F1)
def nbest_fixture(spark, sf):
    """(qid, r_id, hyp, ref): the anchor of a prefix group is the gold text, all other
    members are its samples (r_id is the doc_id)."""
    return nbest_pairs(*fx.anchor_and_refs(spark, sf))


def nbest_shared(hyps, refs, key_counts=None):
    """The samples (qid, r_id, hyp) and the gold texts of their queries, not joined; ``key_counts``: samples (seg, cnt), if known."""
    from seqforge.operators.joins import SharedRefs
    samples = refs.select(F.col("seg").alias("qid"), F.col("ref_no").alias("r_id"), F.col("text").alias("hyp"), F.col("seg").alias("ref_id"))
    gold = hyps.select(F.col("seg").alias("ref_id"), F.col("text").alias("ref"))
    return SharedRefs(samples, gold, key_counts if key_counts is None else key_counts.withColumnRenamed("seg", "ref_id"))


def nbest_pairs(hyps, refs, key_counts=None):
    """Every sample beside the gold text of its query."""
    return nbest_shared(hyps, refs, key_counts).joined("r_id").select("qid", "r_id", "hyp", "ref")


def _nbest_sql():
    hyps, refs = fx.anchor_refs_sql()
    return f"SELECT r.seg AS qid, r.ref_no AS r_id, r.text AS hyp, h.text AS ref FROM ({refs}) r JOIN ({hyps}) h USING (seg)"


NBEST_SQL = _nbest_sql()
_NB_STATS = sg.pair_stats(f"SELECT CAST(qid AS VARCHAR) || ':' || CAST(r_id AS VARCHAR) AS seg, qid, hyp, ref FROM ({NBEST_SQL})",
                          sg.tokens_space("hyp"), sg.tokens_space("ref"))
SIM_BLEU_SQL = f"""
  SELECT CAST(split_part(seg, ':', 1) AS BIGINT) AS qid, max(b) AS max_bleu, avg(b) AS avg_bleu
  FROM (SELECT seg, {sg.sentence_bleu(4)} AS b FROM {_NB_STATS} s) GROUP BY 1"""


@register("sim_bleu", f"SELECT qid, round(max_bleu, 6) AS max_bleu, round(avg_bleu, 6) AS avg_bleu FROM ({SIM_BLEU_SQL})")
def sim_bleu(spark, sf):
    """Per query max ("recall") and mean ("precision") sentence BLEU over its samples."""
    return _round_all(B.sim_bleu(nbest_shared(*fx.anchor_and_refs(spark, sf))))


@register("recall_prec_f1", f"""
  SELECT CAST(count(*) AS BIGINT) AS n_queries, round(avg(max_bleu), 6) AS recall_bleu,
         round(avg(avg_bleu), 6) AS prec_bleu, round({sg.f1('avg(avg_bleu)', 'avg(max_bleu)')}, 6) AS f1
  FROM ({SIM_BLEU_SQL})""")
def recall_prec_f1(spark, sf):
    """Mean recall / precision BLEU over queries and their F1."""
    return _round_all(B.recall_prec_f1(B.sim_bleu(nbest_shared(*fx.anchor_and_refs(spark, sf)))))


# further query groups register themselves on import
from seqforge.plans import catalog_text  # noqa: E402,F401
from seqforge.plans import catalog_smoothed  # noqa: E402,F401
from seqforge.plans import catalog_seq  # noqa: E402,F401
from seqforge.plans import catalog_runlog  # noqa: E402,F401
from seqforge.plans import catalog_decode  # noqa: E402,F401
from seqforge.plans import catalog_io  # noqa: E402,F401

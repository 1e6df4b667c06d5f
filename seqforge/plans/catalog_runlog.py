"""Registered queries: run-log analytics, batching, sampling, ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqforge.operators import rank as RK
from seqforge.operators import runlog as RL
from seqforge.plans import fixtures as fx
from seqforge.plans import sqlgen as sg
from seqforge.plans.catalog import NBEST_SQL, _round_all, nbest_fixture
from seqforge.plans.catalog_seq import ENC_SQL, encoded
from seqforge.plans.registry import register

LOG = fx.RUN_LOG_SQL
ACCUM = 4
BATCH = 32
EPOCHS = 30

METRICS_SQL = f"""
  SELECT run, epoch, loss_num, tokens, hits, n, (CAST(loss_num AS DOUBLE) / 1e12) / tokens AS eval_loss,
         hits * 100.0 / n AS bleu, exp((CAST(loss_num AS DOUBLE) / 1e12) / tokens) AS ppl
  FROM (SELECT run, epoch, CAST(sum(CAST(round(loss * 1e12) AS HUGEINT) * tokens) AS HUGEINT) AS loss_num,
               CAST(sum(tokens) AS BIGINT) AS tokens,
               CAST(sum(CASE WHEN name = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
               CAST(count(*) AS BIGINT) AS n
        FROM ({LOG}) GROUP BY run, epoch)"""


def _metrics(spark, sf):
    """Evaluation metrics of the run log; the share of purchases stands in for the dev score."""
    return RL.eval_metrics(fx.run_log(spark, sf), F.col("name") == "purchase")


def rr(num: str, den: str, digits: int) -> str:
    """SQL twin of runlog.round_ratio."""
    scale = 10 ** digits
    return f"((({num}) * {2 * scale} + ({den})) // (2 * ({den}))) / {float(scale)!r}"


@register("running_loss", f"""
  SELECT run, epoch, step, {rr('s', 'c * CAST(1000000000000 AS HUGEINT)', 4)} AS running_loss FROM (
    SELECT run, epoch, step,
           CAST(sum(CAST(round(loss * 1e12) AS HUGEINT)) OVER w AS HUGEINT) AS s, count(*) OVER w AS c
    FROM ({LOG}) WINDOW w AS (PARTITION BY run, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def running_loss(spark, sf):
    """Running mean of the loss inside each epoch (reset per epoch), 4 digits."""
    r = RL.running_loss(fx.run_log(spark, sf))
    return r.select("run", "epoch", "step", "running_loss")


@register("epoch_step_counter", f"""
  SELECT run, step, CAST(coalesce((SELECT sum((m + 1) // {ACCUM}) FROM
           (SELECT run AS r, epoch AS e, count(*) AS m FROM ({LOG}) GROUP BY 1, 2) WHERE r = x.run AND e < x.epoch), 0)
         + (n + 1) // {ACCUM} AS BIGINT) AS global_step
  FROM (SELECT run, epoch, step, row_number() OVER (PARTITION BY run, epoch ORDER BY step) AS n FROM ({LOG})) x""")
def epoch_step_counter(spark, sf):
    """Global optimizer step per run with gradient accumulation 4."""
    r = RL.epoch_step_counter(fx.run_log(spark, sf), ACCUM)
    return r.select("run", "step", "global_step")


@register("token_weighted_loss_ppl", f"""
  SELECT run, epoch, {rr('loss_num', 'tokens * CAST(1000000000000 AS HUGEINT)', 5)} AS eval_loss, tokens, round(ppl, 5) AS ppl
  FROM ({METRICS_SQL})""")
def token_weighted_loss_ppl(spark, sf):
    """Per run/epoch: sum(loss*tokens)/sum(tokens) and its exp (perplexity), 5 digits."""
    return RL.reported(_metrics(spark, sf)).select("run", "epoch", F.col("eval_loss5").alias("eval_loss"), "tokens", "ppl")


@register("mean_by_loss_name", f"""
  SELECT run, epoch, name, round(avg(loss), 6) AS mean_loss, CAST(count(*) AS BIGINT) AS n FROM ({LOG})
  GROUP BY run, epoch, name""")
def mean_by_loss_name(spark, sf):
    """Mean loss per (run, epoch, loss name)."""
    return _round_all(RL.mean_by_loss_name(fx.run_log(spark, sf)))


@register("best_so_far", f"""
  SELECT run, epoch,
    CAST(eval_loss < least(coalesce(min(eval_loss) OVER w, 1e6), 1e6) AS INTEGER) AS loss_improved,
    CAST(bleu > greatest(coalesce(max(bleu) OVER w, 0.0), 0.0) AS INTEGER) AS bleu_improved
  FROM ({METRICS_SQL})
  WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def best_so_far(spark, sf):
    """Strict improvement flags per epoch (loss < best so far, bleu > best so far)."""
    b = RL.best_so_far(_metrics(spark, sf))
    return b.select("run", "epoch", F.col("loss_improved").cast("int").alias("loss_improved"),
                    F.col("bleu_improved").cast("int").alias("bleu_improved"))


@register("best_checkpoint", f"""
  SELECT run, max(epoch) AS last_epoch, arg_min(epoch, [eval_loss, epoch]) AS best_ppl_epoch,
         arg_min(CASE WHEN bleu > 0 THEN epoch END, [CASE WHEN bleu > 0 THEN -bleu ELSE 'infinity'::DOUBLE END, epoch])
           AS best_bleu_epoch
  FROM ({METRICS_SQL}) GROUP BY run""")
def best_checkpoint(spark, sf):
    """Per run: last epoch, best-perplexity epoch, best-bleu epoch (first to reach the optimum)."""
    return RL.best_checkpoint(_metrics(spark, sf))


@register("every_n_steps", f"SELECT run, step, round(loss, 6) AS loss FROM ({LOG}) WHERE step % 10 = 0")
def every_n_steps(spark, sf):
    """Log every 10th step."""
    return _round_all(RL.every_n_steps(fx.run_log(spark, sf), 10).select("run", "step", "loss"))


@register("round_metrics", f"""
  SELECT run, epoch, {rr('hits * 100', 'n', 2)} AS bleu, {rr('loss_num', 'tokens * CAST(1000000000000 AS HUGEINT)', 4)} AS loss,
         round(ppl, 5) AS ppl FROM ({METRICS_SQL})""")
def round_metrics(spark, sf):
    """Reported precision: bleu 2 digits, loss 4, perplexity 5."""
    m = RL.reported(_metrics(spark, sf))
    return m.select("run", "epoch", "bleu", "loss", "ppl")


@register("sorted_report", f"""
  SELECT run, epoch, name, value, CAST(row_number() OVER (PARTITION BY run, epoch ORDER BY name) AS BIGINT) AS line
  FROM (SELECT run, epoch, 'bleu' AS name, {rr('hits * 100', 'n', 2)} AS value FROM ({METRICS_SQL})
        UNION ALL SELECT run, epoch, 'eval_loss', {rr('loss_num', 'tokens * CAST(1000000000000 AS HUGEINT)', 4)} FROM ({METRICS_SQL})
        UNION ALL SELECT run, epoch, 'eval_ppl', round(ppl, 5) FROM ({METRICS_SQL}))""")
def sorted_report(spark, sf):
    """Metrics of an evaluation printed in key order (line number per name)."""
    m = RL.reported(_metrics(spark, sf))
    long = m.select("run", "epoch", F.explode(F.array(
        F.struct(F.lit("bleu").alias("name"), F.col("bleu").alias("value")),
        F.struct(F.lit("eval_loss").alias("name"), F.col("loss").alias("value")),
        F.struct(F.lit("eval_ppl").alias("name"), F.col("ppl").alias("value")))).alias("kv"))
    w = Window.partitionBy("run", "epoch").orderBy("name")
    x = long.select("run", "epoch", "kv.name", "kv.value")
    return x.withColumn("line", F.row_number().over(w).cast("bigint"))


# ------------------------------------------------------------------ counts, batches, buckets
@register("row_counts", f"""
  SELECT CAST(count(*) AS BIGINT) AS n_examples, CAST(ceil(count(*) / {BATCH}) AS BIGINT) AS n_batches
  FROM ({ENC_SQL})""")
def row_counts(spark, sf):
    """Number of examples and of batches of 32."""
    e = encoded(spark, sf)
    return e.agg(F.count(F.lit(1)).cast("bigint").alias("n_examples"),
                  F.ceil(F.count(F.lit(1)) / BATCH).cast("bigint").alias("n_batches"))


@register("row_index", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM documents")
def row_index(spark, sf):
    """Dense 0-based position in doc_id order (range partitions + per-partition offsets)."""
    return RK.dense_index(fx.table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@register("batch_assign", f"""
  SELECT seq_id, idx, CAST(floor(idx / {BATCH}) AS BIGINT) AS batch FROM (
    SELECT seq_id, CAST(row_number() OVER (ORDER BY seq_id) - 1 AS BIGINT) AS idx FROM ({ENC_SQL}))""")
def batch_assign(spark, sf):
    """Sequential batches of 32 examples in seq_id order (last one partial)."""
    e = RK.dense_index(encoded(spark, sf).select("seq_id"), ["seq_id"])
    return RK.batch_assign(e, "idx", BATCH)


@register("train_schedule", f"""
  SELECT CAST(ceil(n / {BATCH}) AS BIGINT) AS steps_per_epoch,
         CAST(floor(ceil(n / {BATCH}) / {ACCUM}) * {EPOCHS} AS BIGINT) AS t_total,
         CAST(floor(floor(ceil(n / {BATCH}) / {ACCUM}) * {EPOCHS} * 0.1) AS BIGINT) AS warmup
  FROM (SELECT count(*) AS n FROM ({ENC_SQL}))""")
def train_schedule(spark, sf):
    """Steps per epoch, total optimizer steps and warm-up steps from the example count."""
    n = encoded(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*RK.schedule(F.col("n"), BATCH, ACCUM, EPOCHS))


@register("length_bucket", f"""
  WITH s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY len DESC, idx) - 1 AS sorted_pos
    FROM (SELECT seq_id, len, idx, CAST(floor(idx / {BATCH}) AS BIGINT) AS batch FROM (
          SELECT seq_id, len, CAST(row_number() OVER (ORDER BY seq_id) - 1 AS BIGINT) AS idx FROM ({ENC_SQL}))))
  SELECT seq_id, batch, CAST(sorted_pos AS BIGINT) AS sorted_pos,
         CAST(idx - min(idx) OVER (PARTITION BY batch) AS BIGINT) AS restored_pos FROM s""")
def length_bucket(spark, sf):
    """Inside each batch, order by length descending (ties by position) for packing, then back to the original order."""
    e = RK.batch_assign(RK.dense_index(encoded(spark, sf).select("seq_id", "len"), ["seq_id"]), "idx", BATCH)
    b = RK.length_bucket(e, "batch", "len", "idx").drop("idx")          # what was packed knows its places, not the index
    return RK.restore_order(b, "batch").select("seq_id", "batch", "sorted_pos", "restored_pos")


@register("preview_rows", f"SELECT seq_id, array_to_string(ids, ' ') AS ids FROM ({ENC_SQL}) ORDER BY seq_id LIMIT 5")
def preview_rows(spark, sf):
    """First 5 encoded examples (a distributed top-5, not a full sort)."""
    from seqforge.functions.arrays import ids_text
    e = encoded(spark, sf)
    return e.orderBy("seq_id").limit(5).select("seq_id", ids_text("ids").alias("ids"))


@register("dev_sample", """
  SELECT doc_id, n_chars FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 1000""")
def dev_sample(spark, sf):
    """Seeded sample of min(1000, n) documents without replacement."""
    d = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return RK.dev_sample(d, "doc_id", 1000, 42)


@register("shuffle_rows", f"""
  SELECT seq_id, e AS epoch, md5('42:' || CAST(e AS VARCHAR) || ':' || CAST(seq_id AS VARCHAR)) AS order_key
  FROM ({ENC_SQL}), (SELECT unnest(range(3)) AS e)""")
def shuffle_rows(spark, sf):
    """Per-epoch seeded random order key for three epochs."""
    x = encoded(spark, sf).select("seq_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("epoch"))
    return RK.shuffle_rows(x, "seq_id", F.col("epoch")).select("seq_id", "epoch", "order_key")


@register("eval_cap", f"""
  SELECT DISTINCT qid FROM ({NBEST_SQL}) ORDER BY qid LIMIT 1001""")
def eval_cap(spark, sf):
    """Evaluation stops after 1001 queries (qid order)."""
    return nbest_fixture(spark, sf).select("qid").distinct().orderBy("qid").limit(1001)


@register("top1_sample", f"SELECT qid, arg_min(hyp, r_id) AS hyp FROM ({NBEST_SQL}) GROUP BY qid")
def top1_sample(spark, sf):
    """The first sample of every query (the single-best output file)."""
    return nbest_fixture(spark, sf).groupBy("qid").agg(F.min_by("hyp", "r_id").alias("hyp"))


@register("nbest_sort", f"""
  SELECT qid, r_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY len(hyp) DESC, r_id) AS BIGINT) AS rank
  FROM ({NBEST_SQL})""")
def nbest_sort(spark, sf):
    """Order each query's samples by score (here: text length) descending, ties by r_id."""
    nb = nbest_fixture(spark, sf)
    w = Window.partitionBy("qid").orderBy(F.desc(F.length("hyp")), "r_id")
    return nb.select("qid", F.col("r_id").cast("bigint").alias("r_id"), F.row_number().over(w).cast("bigint").alias("rank"))


# ------------------------------------------------------------------ corpus statistics
CORPUS_SQL = """
  SELECT conv_id * 1000 + turn // 5 AS conv_id, max(CASE WHEN turn % 5 = 0 THEN text END) AS annotation, max(CASE WHEN turn % 5 = 1 THEN text END) AS source_code,
         max(CASE WHEN turn % 5 = 2 THEN text END) AS related_so_question, max(CASE WHEN turn % 5 = 3 THEN text END) AS target_api,
         max(CASE WHEN turn % 5 = 4 THEN text END) AS api_seq
  FROM conversations GROUP BY conv_id * 1000 + turn // 5"""


def corpus_cells(spark, sf, value):
    """Five turns of a conversation at a time, pivoted to one row of ``value`` (missing -> null); ``conv_id`` numbers them."""
    c = fx.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 5)).cast("bigint").alias("conv_id"), (F.col("turn") % 5).alias("turn"),
        value.alias("value"))
    cols = ["annotation", "source_code", "related_so_question", "target_api", "api_seq"]
    return c.groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == i, F.col("value"))).alias(n)
                                      for i, n in enumerate(cols)])


def corpus_frame(spark, sf):
    """Corpus CSV stand-in: the texts of five turns at a time."""
    return corpus_cells(spark, sf, F.col("text"))


@register("avg_tokens", f"""
  SELECT CAST(count(*) AS BIGINT) AS n,
    round(avg(len({sg.tokens_ws("coalesce(source_code, '')")})), 6) AS avg_code_tokens,
    round(avg(len({sg.tokens_ws("coalesce(annotation, '')")})), 6) AS avg_annotation_tokens,
    round(avg(len({sg.tokens_ws("coalesce(related_so_question, '')")})), 6) AS avg_post_tokens
  FROM ({CORPUS_SQL})""")
def avg_tokens(spark, sf):
    """data_statistics: average whitespace-token counts of code, annotation and post (missing = 0); texts are counted
    where they are read, only the counts are grouped."""
    from seqforge.functions.text import tokens_ws
    c = corpus_cells(spark, sf, F.size(tokens_ws("text")))
    return _round_all(c.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        *[F.avg(F.coalesce(col, F.lit(0))).alias(f"avg_{n}_tokens")
          for n, col in (("code", "source_code"), ("annotation", "annotation"), ("post", "related_so_question"))]))

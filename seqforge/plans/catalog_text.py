"""Registered queries: projections, filters and string scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import text as tx
from seqforge.plans import fixtures as fx
from seqforge.plans import sqlgen as sg
from seqforge.plans.catalog_runlog import CORPUS_SQL, corpus_frame
from seqforge.plans.registry import register


def _docs(spark, sf):
    return fx.table(spark, sf, "documents")


def _toks_out(col):
    """Token list rendered for comparison: joined with U+001F plus the count."""
    return F.array_join(col, "\u001f"), F.size(col).cast("bigint")


def _toks_sql(e):
    return f"array_to_string({e}, chr(31))", f"CAST(len({e}) AS BIGINT)"


def _reg_doc_text(name, spark_fn, sql_fn, source="documents", key="doc_id", col="text"):
    """Register a per-row string transform over a whole table column."""
    def q(spark, sf):
        t = fx.table(spark, sf, source)
        return t.select(*[k.strip() for k in key.split(",")], spark_fn(F.col(col)).alias("out"))
    q.__doc__ = f"{name} over {source}.{col}"
    register(name, f"SELECT {key}, {sql_fn(col)} AS out FROM {source}")(q)


def _reg_doc_tokens(name, spark_fn, sql_fn, source="documents", key="doc_id", col="text"):
    def q(spark, sf):
        t = fx.table(spark, sf, source)
        j, n = _toks_out(spark_fn(F.col(col)))
        return t.select(key, j.alias("tokens"), n.alias("n_tokens"))
    q.__doc__ = f"{name} over {source}.{col}"
    j, n = _toks_sql(sql_fn(col))
    register(name, f"SELECT {key}, {j} AS tokens, {n} AS n_tokens FROM {source}")(q)


_reg_doc_text("lower_text", tx.lower_text, sg.lower)
_reg_doc_text("strip_text", tx.strip_text, sg.strip, "conversations", "conv_id, turn")
_reg_doc_text("collapse_ws", tx.collapse_ws, sg.collapse_ws)
_reg_doc_text("split_puncts", tx.split_puncts, sg.split_puncts, "pages", "page_id", "html")
_reg_doc_text("nist_normalize", tx.nist_normalize, sg.nist_normalize, "pages", "page_id", "html")
_reg_doc_text("unescape_entities", tx.unescape_entities, sg.unescape, "pages", "page_id", "html")
_reg_doc_text("quote_repair", tx.quote_repair, lambda e: f"replace({e}, ' '' ', '''')")
_reg_doc_tokens("tokens_ws", tx.tokens_ws, sg.tokens_ws)
_reg_doc_tokens("tokens_space", tx.tokens_space, sg.tokens_space)
_reg_doc_tokens("nist_tokens", lambda c: tx.nist_tokens(tx.split_puncts(tx.lower_text(tx.strip_text(c)))),
                sg.cli_tokens, "pages", "page_id", "html")
_reg_doc_tokens("no_norm_mode", lambda c: tx.nist_tokens(c, nonorm=True), sg.tokens_ws, "pages", "page_id", "html")
_reg_doc_tokens("preserve_case_mode", lambda c: tx.nist_tokens(c, preserve_case=True),
                lambda e: sg.tokens_ws(sg.nist_normalize(e, preserve_case=True)), "pages", "page_id", "html")
_reg_doc_text("drop_first_token", tx.drop_first_token,
              lambda e: f"array_to_string({sg.tokens_ws(e)}[2:], ' ')")


@register("sentinel_to_null", f"""
  SELECT doc_id, line_no, nullif(CASE WHEN {sg.strip('line')} = '' THEN '""' ELSE line END, '""') AS out
  FROM ({fx.DOC_LINES_SQL})""")
def sentinel_to_null(spark, sf):
    """Context lines: blank lines are written as the two characters "" and read back as null."""
    lines = fx.doc_lines(spark, sf)
    ctx = F.when(tx.strip_text("line") == "", F.lit('""')).otherwise(F.col("line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tx.sentinel_to_null(ctx).alias("out"))


CORPUS_COLS = ["annotation", "source_code", "related_so_question", "target_api", "api_seq"]


@register("fill_missing", f"SELECT conv_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in CORPUS_COLS)} FROM ({CORPUS_SQL})")
def fill_missing(spark, sf):
    """null -> "" in every column of every corpus row (the last rows of conversations miss some)."""
    return corpus_frame(spark, sf).select("conv_id", *[tx.fill_missing(c).alias(c) for c in CORPUS_COLS])


@register("bimodal_concat", f"""
  SELECT conv_id, trim(regexp_replace(regexp_replace(annotation || ' ' || source_code, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS out
  FROM ({CORPUS_SQL})""")
def bimodal_concat(spark, sf):
    """annotation + ' ' + code of every corpus row, whitespace collapsed (null where one is missing)."""
    return corpus_frame(spark, sf).select("conv_id", tx.collapse_ws(tx.bimodal_concat("annotation", "source_code")).alias("out"))


@register("display_marker", f"""
  SELECT doc_id, array_to_string(list_transform(
           list_transform(t, lambda x, i: CASE WHEN i > 1 THEN 'Ġ' || x ELSE x END),
           lambda y: replace(y, 'Ġ', '_')), ' ') AS out
  FROM (SELECT doc_id, {sg.tokens_ws('text')} AS t FROM documents)""")
def display_marker(spark, sf):
    """Sub-word style tokens (marker on every token after the first) shown with ``_``."""
    d = _docs(spark, sf)
    t = tx.tokens_ws("text")
    marked = F.transform(t, lambda x, i: F.when(i > 0, F.concat(F.lit("Ġ"), x)).otherwise(x))
    return d.select("doc_id", F.array_join(tx.display_marker(marked), " ").alias("out"))


@register("stage_target", """
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'None' ELSE text END AS out FROM conversations""")
def stage_target(spark, sf):
    """Target text is the literal 'None' at the test stage (stage = 'test' for user turns)."""
    c = fx.table(spark, sf, "conversations")
    stage = F.when(F.col("role") == "user", F.lit("test")).otherwise(F.lit("train"))
    return c.select("conv_id", "turn", tx.stage_target("text", stage).alias("out"))


@register("modality_mask", """
  SELECT conv_id, turn, '' AS src_ant, lower(text) AS src_code FROM conversations""")
def modality_mask(spark, sf):
    """Blank one modality for an ablation run (annotation blanked, code kept)."""
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.lit("").alias("src_ant"), F.lower("text").alias("src_code"))


@register("format_elapsed", """
  WITH e AS (SELECT run, epoch, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM (
      SELECT user_id AS run, CAST(dayofmonth(ts) AS INTEGER) AS epoch, ts FROM events) GROUP BY run, epoch),
  s AS (SELECT run, epoch, CAST(epoch(t1) - epoch(t0) AS DOUBLE) AS sec, epoch / 30.0 AS progress FROM e)
  SELECT run, epoch,
    CAST(floor(floor(sec / 60) / 60) AS BIGINT) || ':' || CAST(floor(sec / 60) - floor(floor(sec / 60) / 60) * 60 AS BIGINT) || ':' ||
    CAST(floor(sec - floor(sec / 60) * 60) AS BIGINT) || '<' ||
    CAST(floor(floor((sec / progress - sec) / 60) / 60) AS BIGINT) || ':' ||
    CAST(floor((sec / progress - sec) / 60) - floor(floor((sec / progress - sec) / 60) / 60) * 60 AS BIGINT) || ':' ||
    CAST(floor((sec / progress - sec) - floor((sec / progress - sec) / 60) * 60) AS BIGINT) AS elapsed
  FROM s""")
def format_elapsed(spark, sf):
    """Per run/epoch of the metric log: elapsed seconds within the day and the estimate
    of the remaining time from progress = epoch / 30, as ``h:m:s<h:m:s``."""
    log = fx.run_log(spark, sf)
    e = log.groupBy("run", "epoch").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    sec = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")) / 1e6   # no time-zone dependence
    return e.select("run", "epoch", tx.format_elapsed(sec, F.col("epoch") / 30.0).alias("elapsed"))

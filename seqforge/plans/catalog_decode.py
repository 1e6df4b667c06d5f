"""Registered queries: decoding re-aimed as table operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqforge.functions import arrays as A
from seqforge.functions.text import first_tokens_ws, tokens_ws
from seqforge.operators import bleu as B
from seqforge.operators import context_model as C
from seqforge.operators import decode as D
from seqforge.operators import vocab as V
from seqforge.operators.joins import checked_broadcast
from seqforge.operators.ngrams import word_bigrams
from seqforge.operators.sequence import contexts
from seqforge.plans import fixtures as fx
from seqforge.plans import sqlgen as sg
from seqforge.plans.catalog import _round_all
from seqforge.plans.catalog_seq import (DOC_TOKENS_SQL, DOC_VOCAB_SQL, ENC_SQL, EVENT_VOCAB_SQL, FRAMED_SQL, SHIFT_SQL, WHOLE_SQL,
                                        encoded, event_ids, event_vocab, shifted)
from seqforge.plans.registry import register
from seqforge.session import cut_lineage

BEAM = 5
WIDE = 12           # width of the best-first decoder, which returns KEEP hypotheses
KEEP = 10
STEPS = 50          # sentence length of the recurrent model
EOS = A.EOS_ID
DEPTH = 3           # ids of the longest context
PREFIXES = 11       # forced prefixes have 0 to 10 tokens

NEXT_SQL = f"""
  SELECT state, token, token AS goto, cnt, logp, CAST(round(logp * 1e9) AS BIGINT) AS units FROM (
    SELECT state, token, cnt, ln(CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY state)) AS logp FROM (
      SELECT input_id AS state, label_id AS token, count(*) AS cnt FROM ({SHIFT_SQL}) GROUP BY 1, 2))"""
# queries: every event sequence, conditioned on its first none, one or two events
QUERIES_SQL = f"""SELECT seq_id AS qid, prefix, CASE WHEN len(prefix) > 0 THEN prefix[len(prefix)] ELSE 1 END AS state
  FROM (SELECT seq_id, ids[1:least(seq_id % 3, len)] AS prefix FROM ({ENC_SQL}))"""


def next_table(spark, sf):
    return D.next_token_table(shifted(spark, sf), "input_id", "label_id")


def prefixed_queries(spark, sf, lengths):
    """Every event sequence with its first ``seq_id % lengths`` events as prefix (all, if it has fewer)."""
    n = F.least(F.col("seq_id") % lengths, F.col("len")).cast("int")
    return encoded(spark, sf).select(F.col("seq_id").alias("qid"), F.slice("ids", F.lit(1), n).alias("prefix"))


def decode_queries(spark, sf):
    return prefixed_queries(spark, sf, 3)


# contexts of up to DEPTH ids, known from two occurrences on, and the state that each token leads to
CONTEXT_SQL = f"""
  WITH c AS (SELECT f[greatest(1, p - {DEPTH - 1}):p] AS c, f[p + 1] AS token FROM (
      SELECT f, unnest(range(1, len(f))) AS p FROM (SELECT list_concat([1], ids, [2]) AS f FROM ({WHOLE_SQL})))),
  g AS (SELECT array_to_string(c[len(c) - n + 1:], ' ') AS state, n, token FROM (SELECT *, unnest(range(0, len(c) + 1)) AS n FROM c)),
  t AS (SELECT state, n, token, count(*) AS cnt FROM g GROUP BY ALL),
  k AS MATERIALIZED (SELECT * FROM (SELECT *, sum(cnt) OVER (PARTITION BY state) AS total FROM t) WHERE n <= 1 OR total >= 2),
  a AS (SELECT state, token, list_append(CASE WHEN state = '' THEN [] ELSE string_split(state, ' ') END, CAST(token AS VARCHAR)) AS x
        FROM k WHERE token <> {EOS}),
  s AS (SELECT state, token, array_to_string(x[len(x) - n + 1:], ' ') AS tried FROM (
        SELECT *, unnest(range(0, least(len(x), {DEPTH}) + 1)) AS n FROM a)),
  goes AS (SELECT s.state, s.token, arg_max(tried, w.n) AS goto FROM s JOIN (SELECT DISTINCT state, n FROM k) w ON w.state = tried GROUP BY 1, 2)
  SELECT k.state, k.n AS "order", k.token, k.cnt, goto, CAST(round(ln(CAST(cnt AS DOUBLE) / total) * 1e9) AS BIGINT) AS units
  FROM k LEFT JOIN goes USING (state, token)"""
FORCED_SQL = f"""
  WITH q AS (SELECT seq_id AS qid, ids[1:least(seq_id % {PREFIXES}, len)] AS prefix FROM ({ENC_SQL})),
  x AS (SELECT qid, prefix, list_concat([1], prefix) AS w FROM q),
  s AS (SELECT qid, prefix, n, array_to_string(w[len(w) - n + 1:], ' ') AS tried FROM (
        SELECT *, unnest(range(0, least(len(w), {DEPTH}) + 1)) AS n FROM x))
  SELECT qid, any_value(prefix) AS prefix, arg_max(tried, n) AS state FROM s
  WHERE tried IN (SELECT state FROM ({CONTEXT_SQL})) GROUP BY qid"""


def context_table(spark, sf):
    return C.context_table(contexts(event_ids(spark, sf), "seq_id", ["ts", "event_id"], "id", DEPTH), DEPTH)


def forced_nbest(spark, sf):
    table = cut_lineage(context_table(spark, sf))
    queries = C.start_states(prefixed_queries(spark, sf, PREFIXES), table, DEPTH)
    return D.nbest(queries, table, BEAM, STEPS, forced=True)


def beam_sql(beam: int, steps: int, forced: bool = False, rank_by: str = "sum", next_sql: str | None = None,
             queries_sql: str | None = None, select: str = "qid, rank, tokens, score", keep: int | None = None) -> str:
    """Unrolled SQL twin of decode.beam_search + decode.beam_final; ``select`` reads the n-best (qid, rank, tokens, score,
    rank_key, finished), or any FROM clause over it or over all frontiers ``allf`` if it names one."""
    width = beam + (1 if forced else 0)
    ctes = [f"""nk AS MATERIALIZED (SELECT state, token, units, goto FROM (
        SELECT *, row_number() OVER (PARTITION BY state ORDER BY units DESC, token) AS r FROM ({next_sql or NEXT_SQL})) WHERE r <= {width})""",
            f"""a0 AS MATERIALIZED (SELECT qid, 0 AS k, CAST([] AS BIGINT[]) AS tokens, CAST(0 AS BIGINT) AS units, state,
        CAST(CASE WHEN len(prefix) > 0 THEN prefix[len(prefix)] ELSE 1 END AS BIGINT) AS last,
        false AS eos_top, CAST(0 AS BIGINT) AS nfin, len(prefix) > 0 AS led FROM ({queries_sql or QUERIES_SQL}))"""]
    for t in range(1, steps + 1):
        block = f" AND (NOT a.led OR n.token <> {EOS})" if (forced and t == 1) else ""
        ctes.append(f"""r{t} AS (SELECT a.qid, a.k AS parent, a.tokens, a.units + n.units AS units, n.token, n.goto, a.eos_top, a.nfin, a.led,
        row_number() OVER (PARTITION BY a.qid ORDER BY a.units + n.units DESC, a.k, n.token) AS rn
        FROM a{t - 1} a JOIN nk n ON n.state = a.state WHERE a.last <> {EOS}{block})""")
        ctes.append(f"""f{t} AS MATERIALIZED (SELECT qid, rn - 1 AS k, list_append(tokens, token) AS tokens, units, goto AS state, token AS last, led,
        (eos_top OR bool_or(rn = 1 AND token = {EOS}) OVER (PARTITION BY qid)) AS eos_top,
        nfin + sum(CASE WHEN token = {EOS} THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS nfin
        FROM r{t} WHERE rn <= {beam})""")
        ctes.append(f"a{t} AS (SELECT * FROM f{t} WHERE NOT (eos_top AND nfin >= {beam}))")
    allf = " UNION ALL ".join(f"SELECT qid, {t} AS step, k, tokens, units, units * 1e-9 AS score, last FROM f{t}" for t in range(1, steps + 1))
    ctes.append(f"allf AS MATERIALIZED ({allf})")
    key = "CAST(units AS DOUBLE)" if rank_by == "sum" else "units / (len(tokens) + 1e-6)"
    ctes.append(f"""fx AS (SELECT *, max(step) OVER (PARTITION BY qid) AS lst,
        sum(CASE WHEN last = {EOS} THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS nf FROM allf)""")
    ctes.append(f"""cand AS (
        SELECT qid, 0 AS grp, {key} AS kk, step, k, tokens, score FROM fx WHERE last = {EOS}
        UNION ALL SELECT qid, 0, {key}, step, k, tokens, score FROM fx WHERE step = lst AND nf = 0 AND k = 0
        UNION ALL SELECT qid, 1, {key}, step, k, tokens, score FROM fx WHERE step = lst AND last <> {EOS})""")
    ctes.append(f"""fin AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY grp, kk DESC, step, k) - 1 AS BIGINT) AS rank,
        CASE WHEN coalesce(list_position(tokens, {EOS}), 0) > 0 THEN tokens[1:list_position(tokens, {EOS}) - 1]
             ELSE tokens END AS tokens, score, kk * 1e-9 AS rank_key, coalesce(list_position(tokens, {EOS}), 0) > 0 AS finished FROM cand
        QUALIFY rank < {keep or beam})""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {select}" + ("" if " FROM " in select else " FROM fin")


OUT = "qid, rank, array_to_string(tokens, ' ') AS tokens, round({}, 6) AS score"


def _beam_out(df, score="score"):
    return _round_all(df.select("qid", "rank", A.ids_text("tokens").alias("tokens"), F.col(score).alias("score")))


@register("log_softmax_group", f"""
  SELECT state, token, round(s - mx - ln(sum(exp(s - mx)) OVER (PARTITION BY state)), 6) AS logp FROM (
    SELECT state, token, s, max(s) OVER (PARTITION BY state) AS mx
    FROM (SELECT input_id AS state, label_id AS token, CAST(count(*) AS DOUBLE) / 10.0 AS s FROM ({SHIFT_SQL}) GROUP BY 1, 2))""")
def log_softmax_group(spark, sf):
    """Normalise raw successor scores (count / 10) of each state to log-probabilities."""
    s = shifted(spark, sf).groupBy(F.col("input_id").alias("state"), F.col("label_id").alias("token")) \
        .agg((F.count(F.lit(1)).cast("double") / 10.0).alias("s"))
    return _round_all(D.log_softmax_group(s, ["state"], "s").select("state", "token", "logp"))


@register("topk_candidates", f"""
  SELECT state, token, CAST(r AS BIGINT) AS rank, round(logp, 6) AS logp FROM (
    SELECT *, row_number() OVER (PARTITION BY state ORDER BY units DESC, token) AS r FROM ({NEXT_SQL})) WHERE r <= 3""")
def topk_candidates(spark, sf):
    """Top-3 successors per state by log-probability (ties by token)."""
    p = D.prune_next(next_table(spark, sf), 3)
    w = Window.partitionBy("state").orderBy(F.desc("units"), "token")
    return _round_all(p.select("state", "token", F.row_number().over(w).cast("bigint").alias("rank"), "logp"))


@register("beam_step", beam_sql(BEAM, 1, select="qid, k, last AS token, round(score, 6) AS score FROM allf"))
def beam_step(spark, sf):
    """First beam step: expand slot 0 of every query, keep the best 5 (query partitioned)."""
    f = D.beam_search(decode_queries(spark, sf), next_table(spark, sf), BEAM, 1)
    return _round_all(f.select("qid", F.col("k").cast("bigint").alias("k"), F.col("last").alias("token"), "score"))


@register("beam_search", beam_sql(BEAM, STEPS, select=OUT.format("score")))
def beam_search(spark, sf):
    """Beam search (width 5, up to 50 steps) + final n-best assembly per query."""
    return _beam_out(D.nbest(decode_queries(spark, sf), next_table(spark, sf), BEAM, STEPS))


@register("beam_finish", beam_sql(WIDE, STEPS, select=f"""qid, CAST(count(*) AS BIGINT) AS n_finished,
  CAST(min(step) AS BIGINT) AS first_step, round(max(score), 6) AS best_score FROM allf WHERE last = {EOS} GROUP BY qid"""))
def beam_finish(spark, sf):
    """Finished hypotheses (slot emitted EOS) per query at width 12: count, first step, best score."""
    nxt = cut_lineage(next_table(spark, sf))
    q, starts = D.shared_starts(decode_queries(spark, sf), nxt)
    fin = D.beam_search(starts, nxt, WIDE, STEPS).where(F.col("last") == EOS).groupBy("qid").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_finished"), F.min("step").cast("bigint").alias("first_step"),
        F.max("score").alias("best_score"))
    return _round_all(D.each_query(q, fin).select("qid", "n_finished", "first_step", "best_score"))


@register("forced_prefix", beam_sql(BEAM, STEPS, True, next_sql=CONTEXT_SQL, queries_sql=FORCED_SQL, select=OUT.format("score")))
def forced_prefix(spark, sf):
    """Beam search forced to continue prefixes of 0 to 10 tokens, over contexts of up to 3 (EOS blocked at the first free step)."""
    return _beam_out(forced_nbest(spark, sf))


@register("avg_logp_rank", beam_sql(WIDE, STEPS, False, "avg", select=OUT.format("rank_key"), keep=KEEP))
def avg_logp_rank(spark, sf):
    """Width-12 search, the 10 best ranked by average log-probability per generated token."""
    return _beam_out(D.nbest(decode_queries(spark, sf), next_table(spark, sf), WIDE, STEPS, rank_by="avg", keep=KEEP), "rank_key")


@register("strip_prefix", f"""
  SELECT b.qid, b.rank, array_to_string(list_concat(q.prefix, b.tokens), ' ') AS whole, array_to_string(CASE
           WHEN len(b.tokens) > 0 THEN b.tokens ELSE q.prefix END, ' ') AS tokens
  FROM ({beam_sql(BEAM, STEPS, True, next_sql=CONTEXT_SQL, queries_sql=FORCED_SQL)}) b JOIN ({FORCED_SQL}) q ON q.qid = b.qid""")
def strip_prefix(spark, sf):
    """Prefixed hypotheses (context + forced continuation), and with each query's own context removed when longer."""
    whole = forced_nbest(spark, sf).select("qid", "rank", F.concat("prefix", "tokens").alias("whole"), F.size("prefix").alias("led"))
    return whole.select("qid", "rank", A.ids_text("whole").alias("whole"),
                        A.ids_text(A.strip_prefix("whole", F.col("led"))).alias("tokens"))


@register("context_table", f"""SELECT state, CAST("order" AS INTEGER) AS "order", token, cnt, goto, units FROM ({CONTEXT_SQL})""")
def context_states(spark, sf):
    """Successors of every context of up to 3 ids, and the longest known context that each leads to."""
    return context_table(spark, sf).select("state", "order", "token", "cnt", "goto", "units")


@register("pad_hyps", beam_sql(BEAM, STEPS, select=f"""qid, rank, array_to_string(list_concat(tokens,
  list_transform(range({STEPS} - len(tokens)), lambda x: CAST(0 AS BIGINT))), ' ') AS padded"""))
def pad_hyps(spark, sf):
    """n-best hypotheses padded with 0 to the maximum length."""
    r = D.nbest(decode_queries(spark, sf), next_table(spark, sf), BEAM, STEPS)
    return r.select("qid", "rank", A.ids_text(A.pad_array("tokens", STEPS, F.lit(0).cast("bigint"))).alias("padded"))


@register("eos_cut", f"""
  SELECT seq_id AS qid, array_to_string(CASE WHEN coalesce(list_position(t, {EOS}), 0) > 0
                                             THEN t[1:list_position(t, {EOS}) - 1] ELSE t END, ' ') AS ids
  FROM (SELECT seq_id, framed[2:] AS t FROM ({FRAMED_SQL}))""")
def eos_cut(spark, sf):
    """Cut decoded rows at the first EOS (EOS dropped)."""
    e = encoded(spark, sf)
    framed = e.select(F.col("seq_id").alias("qid"), F.slice(A.frame_sos_eos_pad("ids", 50), 2, 49).alias("t"))
    return framed.select("qid", A.ids_text(A.eos_cut("t")).alias("ids"))


LENGTH_SQL = f"""CAST(CASE WHEN coalesce(list_position(tokens, {EOS}), 0) > 0 THEN list_position(tokens, {EOS}) - 1
                   ELSE len(list_filter(tokens, lambda x: x <> 0)) END AS BIGINT) AS len"""


def greedy_sql(steps: int) -> str:
    ctes = [f"best AS MATERIALIZED (SELECT state, arg_max(token, [units, -token]) AS token FROM ({NEXT_SQL}) GROUP BY state)",
            f"g0 AS (SELECT qid, CAST([] AS BIGINT[]) AS tokens, CAST(state AS BIGINT) AS last FROM ({QUERIES_SQL}))"]
    for t in range(1, steps + 1):
        ctes.append(f"""g{t} AS (SELECT g.qid,
          list_append(g.tokens, CAST(CASE WHEN g.last IN ({EOS}, 0) OR b.token IS NULL THEN 0 ELSE b.token END AS BIGINT)) AS tokens,
          CAST(CASE WHEN g.last IN ({EOS}, 0) OR b.token IS NULL THEN 0 ELSE b.token END AS BIGINT) AS last
          FROM g{t - 1} g LEFT JOIN best b ON b.state = g.last)""")
    return "WITH " + ",\n".join(ctes) + f" SELECT qid, array_to_string(tokens, ' ') AS tokens, {LENGTH_SQL} FROM g{steps}"


@register("greedy_decode", greedy_sql(STEPS))
def greedy_decode(spark, sf):
    """Greedy decoding for 50 steps from SOS or each query's prefix; length counts tokens before EOS."""
    g = D.greedy_decode(decode_queries(spark, sf), next_table(spark, sf), STEPS)
    return g.select("qid", A.ids_text("tokens").alias("tokens"), "len")


def sample_sql(steps: int, seed: int = 42) -> str:
    """The same draws, each met with the interval of counts that holds it."""
    ctes = [f"""iv AS MATERIALIZED (SELECT state, token, sum(cnt) OVER (PARTITION BY state ORDER BY token) - cnt AS lo,
              sum(cnt) OVER (PARTITION BY state ORDER BY token) AS hi, sum(cnt) OVER (PARTITION BY state) AS total FROM ({NEXT_SQL}))""",
            "tot AS MATERIALIZED (SELECT DISTINCT state, total FROM iv)",
            f"g0 AS (SELECT qid, CAST([] AS BIGINT[]) AS tokens, CAST(state AS BIGINT) AS last FROM ({QUERIES_SQL}))"]
    for t in range(steps):
        u = f"CAST(('0x' || substr(md5('{seed}:' || CAST(g.qid AS VARCHAR) || ':{t}'), 1, 13)) AS BIGINT) % tot.total"
        ctes.append(f"d{t} AS (SELECT g.*, {u} AS r FROM g{t} g LEFT JOIN tot ON tot.state = g.last)")
        tok = f"CAST(CASE WHEN last IN ({EOS}, 0) OR iv.token IS NULL THEN 0 ELSE iv.token END AS BIGINT)"
        ctes.append(f"""g{t + 1} AS MATERIALIZED (SELECT qid, list_append(tokens, {tok}) AS tokens, {tok} AS last
            FROM d{t} d LEFT JOIN iv ON iv.state = d.last AND d.r >= iv.lo AND d.r < iv.hi)""")
    return "WITH " + ",\n".join(ctes) + f" SELECT qid, array_to_string(tokens, ' ') AS tokens, {LENGTH_SQL} FROM g{steps}"


@register("sample_decode", sample_sql(STEPS))
def sample_decode(spark, sf):
    """Sampled decoding (one seeded draw and one looked-up cell of the successor counts a step), 50 steps."""
    g = D.sample_decode(decode_queries(spark, sf), cut_lineage(next_table(spark, sf)), STEPS)
    return g.select("qid", A.ids_text("tokens").alias("tokens"), "len")


@register("nbest_predict", f"""
  SELECT b.qid, b.rank, array_to_string(list_transform(b.tokens, lambda x: v.tok[x + 1]), ' ') AS text
  FROM ({beam_sql(BEAM, STEPS)}) b,
       (SELECT list(token ORDER BY id) AS tok FROM (SELECT id, max(token) AS token FROM {EVENT_VOCAB_SQL} GROUP BY id)) v""")
def nbest_predict(spark, sf):
    """Batch n-best: k decoded texts per query (ids mapped back to event names)."""
    r = D.nbest(decode_queries(spark, sf), next_table(spark, sf), BEAM, STEPS)
    r = r.select("qid", "rank", F.posexplode_outer("tokens").alias("pos", "id"))
    j = r.join(V.invert_vocab(event_vocab(spark, sf)), "id", "left")
    g = j.groupBy("qid", "rank").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    return g.select("qid", "rank", F.array_join(F.transform("s", lambda x: x["token"]), " ").alias("text"))


@register("beam_final", beam_sql(WIDE, STEPS, select=OUT.format("score")))
def beam_final(spark, sf):
    """Final n-best at width 12: finished by score, topped up with unfinished slots."""
    return _beam_out(D.nbest(decode_queries(spark, sf), next_table(spark, sf), WIDE, STEPS))


@register("backtrace", beam_sql(WIDE, STEPS, select="qid, rank, array_to_string(tokens, ' ') AS tokens"))
def backtrace(spark, sf):
    """Hypotheses rebuilt from parent pointers (pointer doubling), EOS cut: must equal
    the carried token arrays of the same search."""
    nxt = cut_lineage(next_table(spark, sf))
    q, starts = D.shared_starts(decode_queries(spark, sf), nxt)
    f = D.beam_search(starts, nxt, WIDE, STEPS)
    b = cut_lineage(D.backtrace(f, D.beam_final(f, WIDE), STEPS))
    return D.each_query(q, b).select("qid", "rank", A.ids_text(A.eos_cut("tokens")).alias("tokens"))


@register("filter_pad", f"""
  SELECT seq_id, array_to_string(list_filter(framed, lambda x: x <> 0), ' ') AS ids FROM ({FRAMED_SQL})""")
def filter_pad(spark, sf):
    """Drop PAD ids from framed rows before decoding."""
    e = encoded(spark, sf)
    return e.select("seq_id", A.ids_text(A.filter_pad(A.frame_sos_eos_pad("ids", 50))).alias("ids"))


# ------------------------------------------------------------------ word-level decoding over documents
def word_inputs(spark, sf):
    """The bigram table of the documents framed as <s> w1 .. wn </s>, over ids of the document vocabulary, and queries
    (qid, prefix); a query's prefix is the document's first ``doc_id % 3`` words.

    Bigrams are counted inside tasks, as words; only the different ones are looked up."""
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    bigrams = cut_lineage(word_bigrams(d, "doc_id", lambda t: tokens_ws(F.lower(t))))
    vocab = V.build_vocab(bigrams.where("word IS NOT NULL"), "word", count="cnt")
    look = checked_broadcast(cut_lineage(vocab.select(F.col("token").alias("word"), "id")))
    sos, eos = (F.lit(x).cast("bigint") for x in (A.SOS_ID, EOS))
    # every occurrence of a word follows something, so the vocabulary has both sides
    pairs = (bigrams.join(look.withColumnRenamed("id", "label"), "word", "left").drop("word")
             .join(look.withColumnRenamed("word", "before"), "before", "left")
             .select(F.coalesce("id", sos).alias("input_id"), F.coalesce("label", eos).alias("label_id"), "cnt"))
    words = d.select("doc_id", F.posexplode_outer(first_tokens_ws(F.lower("text"), 2)).alias("pos", "word")).join(look, "word", "left")
    first = F.collect_list(F.when(F.col("pos") < F.col("doc_id") % 3, F.struct("pos", "id")))
    queries = cut_lineage(words.groupBy(F.col("doc_id").alias("qid")).agg(F.array_sort(first).alias("s")).select(
        "qid", F.transform("s", lambda x: x["id"]).alias("prefix")))
    return cut_lineage(D.next_token_table(pairs, "input_id", "label_id", "cnt")), queries


def _word_sqls():
    ids = f"""SELECT t.doc_id, t.pos, CAST(coalesce(v.id, 3) AS BIGINT) AS id FROM (
        SELECT doc_id, unnest(list_concat(['<s>'], tokens, ['</s>'])) AS token,
               generate_subscripts(list_concat(['<s>'], tokens, ['</s>']), 1) - 1 AS pos FROM ({DOC_TOKENS_SQL})) t
        LEFT JOIN {DOC_VOCAB_SQL} v USING (token)"""
    nxt = f"""SELECT *, token AS goto, CAST(round(ln(CAST(cnt AS DOUBLE) / total) * 1e9) AS BIGINT) AS units FROM (
        SELECT state, token, cnt, sum(cnt) OVER (PARTITION BY state) AS total FROM (
        SELECT input_id AS state, label_id AS token, count(*) AS cnt FROM (
          SELECT id AS input_id, lead(id) OVER (PARTITION BY doc_id ORDER BY pos) AS label_id FROM ({ids}))
        WHERE label_id IS NOT NULL GROUP BY 1, 2))"""
    qs = f"""SELECT qid, prefix, CASE WHEN len(prefix) > 0 THEN prefix[len(prefix)] ELSE 1 END AS state FROM (
        SELECT doc_id AS qid, coalesce(list(id ORDER BY pos) FILTER (pos BETWEEN 1 AND doc_id % 3 AND id <> {EOS}), []) AS prefix
        FROM ({ids}) GROUP BY doc_id)"""
    return nxt, qs


_WN, _WQ = _word_sqls()


@register("beam_search_words", beam_sql(BEAM, STEPS, next_sql=_WN, queries_sql=_WQ, select=OUT.format("score")))
def beam_search_words(spark, sf):
    """Word-level beam search (width 5, up to 50 rounds) for every document, from SOS or its first
    one or two words, over the bigram table of the whole corpus."""
    nxt, queries = word_inputs(spark, sf)
    return _beam_out(D.nbest(queries, nxt, BEAM, STEPS))


# ------------------------------------------------------------------ n-best evaluation end to end
_IVOCAB_SQL = f"(SELECT list(token ORDER BY id) AS tok FROM (SELECT id, max(token) AS token FROM {EVENT_VOCAB_SQL} GROUP BY id))"


def _nbest_eval_sql() -> str:
    gold = f"""SELECT f.seq_id AS qid, array_to_string(list_transform(
                 CASE WHEN coalesce(list_position(nz, 2), 0) > 0 THEN nz[1:list_position(nz, 2)] ELSE nz END,
                 lambda x: v.tok[x + 1]), ' ') AS ref
               FROM (SELECT seq_id, list_filter(framed, lambda x: x <> 0) AS nz FROM ({FRAMED_SQL})) f, {_IVOCAB_SQL} v"""
    beam = beam_sql(BEAM, STEPS, select="qid, rank, tokens, finished")
    samples = f"""SELECT b.qid, b.rank AS r_id, array_to_string(list_transform(
                    CASE WHEN b.finished THEN list_append(b.tokens, CAST(2 AS BIGINT)) ELSE b.tokens END,
                    lambda x: v.tok[x + 1]), ' ') AS hyp
                  FROM ({beam}) b, {_IVOCAB_SQL} v"""
    pairs = (f"SELECT CAST(s.qid AS VARCHAR) || ':' || CAST(s.r_id AS VARCHAR) AS seg, s.hyp, g.ref "
             f"FROM ({samples}) s JOIN ({gold}) g USING (qid)")
    stats = sg.pair_stats(pairs, sg.tokens_space("hyp"), sg.tokens_space("ref"))
    per_q = (f"SELECT split_part(seg, ':', 1) AS qid, max(b) AS max_bleu, avg(b) AS avg_bleu FROM "
             f"(SELECT seg, {sg.sentence_bleu(4)} AS b FROM {stats} s) GROUP BY 1")
    return (f"SELECT CAST(count(*) AS BIGINT) AS n_queries, round(avg(max_bleu), 6) AS recall_bleu, "
            f"round(avg(avg_bleu), 6) AS prec_bleu, round({sg.f1('avg(avg_bleu)', 'avg(max_bleu)')}, 6) AS f1 "
            f"FROM ({per_q})")


def nbest_eval_frames(spark, sf):
    """(qid, r_id, hyp, ref): decoded n-best samples (EOS kept when finished) and the decoded
    gold row (only PAD skipped, so SOS and EOS stay) of every event sequence."""
    vocab = event_vocab(spark, sf)
    e = encoded(spark, sf)
    gold = V.decode_ids(e.select("seq_id", A.frame_sos_eos_pad("ids", 50).alias("framed")), "seq_id", "framed", vocab) \
        .select(F.col("seq_id").alias("qid"), F.col("text").alias("ref"))
    nb = D.nbest(decode_queries(spark, sf), next_table(spark, sf), BEAM, STEPS).select(
        F.struct("qid", F.col("rank").alias("r_id")).alias("k"),
        F.when(F.col("finished"), F.concat("tokens", F.array(F.lit(EOS).cast("bigint")))).otherwise(F.col("tokens")).alias("ids"))
    dec = V.decode_ids(nb, "k", "ids", vocab, ignore_tok=-1)
    samples = dec.select(F.col("k.qid").alias("qid"), F.col("k.r_id").alias("r_id"), F.col("text").alias("hyp"))
    return samples.join(gold, "qid")


@register("nbest_eval", _nbest_eval_sql())
def nbest_eval(spark, sf):
    """n-best evaluation end to end: decode gold and samples, per-query max/mean sentence
    BLEU over space tokens, then recall/precision BLEU and F1."""
    return _round_all(B.recall_prec_f1(B.sim_bleu(nbest_eval_frames(spark, sf))))

"""Registered queries: vocabulary, encode/decode, framing, padding, masks, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqforge.functions import arrays as A
from seqforge.functions.text import tokens_ws
from seqforge.operators import vocab as V
from seqforge.operators.rank import batch_assign, dense_index
from seqforge.operators.sequence import shift_pairs
from seqforge.plans import fixtures as fx
from seqforge.plans.catalog import _round_all
from seqforge.plans.registry import register

MAX_SEQ = 50        # sentence length of the recurrent model
MAX_SRC = 64        # default source length of the transformer runs
MAX_TRG = 32        # default target length
BATCH = 32


def ids_sql(e: str) -> str:
    return f"array_to_string({e}, ' ')"


def ids_out(c):
    return A.ids_text(c)


# ------------------------------------------------------------------ vocabulary
def event_vocab(spark, sf):
    return V.build_vocab(fx.event_tokens(spark, sf), "event_type")


def vocab_sql(tokens_sql: str) -> str:
    """Vocabulary over a list column ``tokens`` of ``tokens_sql``."""
    spec = " UNION ALL ".join(f"SELECT '{t}' AS token, CAST({i} AS BIGINT) AS id, CAST(0 AS BIGINT) AS cnt"
                              for t, i in V.SPECIALS)
    return f"""({spec} UNION ALL
      SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 3 AS BIGINT) AS id, cnt FROM (
        SELECT token, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(tokens) AS token FROM ({tokens_sql}))
        GROUP BY token))"""


EVENT_VOCAB_SQL = vocab_sql(fx.EVENT_SEQUENCES_SQL)
DOC_TOKENS_SQL = "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS tokens FROM documents"
DOC_VOCAB_SQL = vocab_sql(DOC_TOKENS_SQL)


@register("build_vocab", f"SELECT token, id, cnt FROM {EVENT_VOCAB_SQL}")
def build_vocab(spark, sf):
    """Vocabulary of event types: specials 0..3, then tokens by count desc, token asc."""
    return event_vocab(spark, sf)


@register("vocab_doc_size", f"SELECT CAST(count(*) AS BIGINT) AS n_tokens, CAST(max(id) AS BIGINT) AS max_id, "
                            f"CAST(sum(cnt) AS BIGINT) AS covered FROM {DOC_VOCAB_SQL}")
def vocab_doc_size(spark, sf):
    """Vocabulary of document words: size, top id, covered occurrences."""
    d = fx.table(spark, sf, "documents").select(tokens_ws(F.lower("text")).alias("tokens"))
    v = V.build_vocab(d, "tokens")
    return v.agg(F.count(F.lit(1)).cast("bigint").alias("n_tokens"), F.max("id").cast("bigint").alias("max_id"),
                 F.sum("cnt").cast("bigint").alias("covered"))


def encoded(spark, sf, max_len=MAX_SEQ):
    return V.encode_ids(fx.event_sequences(spark, sf, max_len), "seq_id", "tokens", event_vocab(spark, sf), max_len)


ENC_SQL = f"""
  SELECT s.seq_id, list_concat(e.ids, list_transform(range(greatest({MAX_SEQ} - len(e.ids), 0)), lambda x: CAST(0 AS BIGINT))) AS ids,
         CAST(len(e.ids) AS BIGINT) AS len
  FROM ({fx.EVENT_SEQUENCES_SQL}) s JOIN (
    SELECT seq_id, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM (
      SELECT seq_id, unnest(tokens[1:{MAX_SEQ}]) AS token, generate_subscripts(tokens[1:{MAX_SEQ}], 1) AS pos
      FROM ({fx.EVENT_SEQUENCES_SQL})) t LEFT JOIN {EVENT_VOCAB_SQL} v USING (token)
    GROUP BY seq_id) e USING (seq_id)"""


@register("encode_ids", f"SELECT seq_id, {ids_sql('ids')} AS ids, len FROM ({ENC_SQL})")
def encode_ids(spark, sf):
    """sent2indexes over event sequences: first 50 tokens -> ids (unknown -> 3), PAD right."""
    e = encoded(spark, sf)
    return e.select("seq_id", ids_out(F.col("ids")).alias("ids"), "len")


@register("vocab_lookup", f"""
  SELECT token, CAST(coalesce(v.id, 3) AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT unnest(tokens) AS token FROM ({DOC_TOKENS_SQL})) t LEFT JOIN {EVENT_VOCAB_SQL} v USING (token)
  GROUP BY token, coalesce(v.id, 3)""")
def vocab_lookup(spark, sf):
    """token -> id with UNK default: every document word looked up in the event vocabulary
    (occurrences per token)."""
    d = fx.table(spark, sf, "documents").select(F.explode(tokens_ws(F.lower("text"))).alias("token"))
    v = event_vocab(spark, sf).select("token", "id")
    j = d.join(v, "token", "left").select("token", F.coalesce("id", F.lit(A.UNK_ID)).cast("bigint").alias("id"))
    return j.groupBy("token", "id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


FRAMED_SQL = f"""
  SELECT seq_id, list_concat([CAST(1 AS BIGINT)], b, [CAST(2 AS BIGINT)],
                             list_transform(range(greatest({MAX_SEQ} - 2 - len(b), 0)), lambda x: CAST(0 AS BIGINT))) AS framed,
         CAST(len(b) AS BIGINT) AS len
  FROM (SELECT seq_id, (CASE WHEN coalesce(list_position(ids, 0), 0) > 0 THEN ids[1:list_position(ids, 0) - 1] ELSE ids END)[1:{MAX_SEQ - 2}] AS b
        FROM ({ENC_SQL}))"""


@register("zero_cut", f"""
  SELECT seq_id, {ids_sql("CASE WHEN coalesce(list_position(ids, 0), 0) > 0 THEN ids[1:list_position(ids, 0) - 1] ELSE ids END")} AS ids
  FROM ({ENC_SQL})""")
def zero_cut(spark, sf):
    """Cut the 0-terminated dense rows at the first 0."""
    return encoded(spark, sf).select("seq_id", ids_out(A.zero_cut("ids")).alias("ids"))


@register("frame_sos_eos_pad", f"SELECT seq_id, {ids_sql('framed')} AS framed, len FROM ({FRAMED_SQL})")
def frame_sos_eos_pad(spark, sf):
    """zero-cut, keep 48, [SOS]+x+[EOS], pad to 50; length excludes SOS/EOS."""
    e = encoded(spark, sf)
    return e.select("seq_id", ids_out(A.frame_sos_eos_pad("ids", MAX_SEQ)).alias("framed"),
                    A.framed_length("ids", MAX_SEQ).cast("bigint").alias("len"))


@register("pad_context", f"""
  SELECT seq_id, {ids_sql(f"list_concat(b, list_transform(range(greatest({MAX_SEQ} - len(b), 0)), lambda x: CAST(0 AS BIGINT)))")} AS ctx
  FROM (SELECT seq_id, (CASE WHEN coalesce(list_position(ids, 0), 0) > 0 THEN ids[1:list_position(ids, 0) - 1] ELSE ids END)[1:{MAX_SEQ - 2}] AS b
        FROM ({ENC_SQL}))""")
def pad_context(spark, sf):
    """Context row: zero-cut, keep 48, no framing, pad to 50."""
    return encoded(spark, sf).select("seq_id", ids_out(A.pad_context("ids", MAX_SEQ)).alias("ctx"))


@register("pad_array", f"""
  SELECT seq_id, {ids_sql(f"list_concat(ids[1:len], list_transform(range({MAX_SEQ + 14} - len), lambda x: CAST(7 AS BIGINT)))")} AS padded
  FROM ({ENC_SQL})""")
def pad_array(spark, sf):
    """list2array: real ids padded with a pad value (7) to 64."""
    e = encoded(spark, sf)
    return e.select("seq_id", ids_out(A.pad_array(A.take("ids", F.col("len")), MAX_SEQ + 14,
                                                  F.lit(7).cast("bigint"))).alias("padded"))


def decoded(spark, sf):
    e = encoded(spark, sf)
    framed = e.select("seq_id", A.frame_sos_eos_pad("ids", MAX_SEQ).alias("framed"))
    return V.decode_ids(framed, "seq_id", "framed", event_vocab(spark, sf))


@register("decode_ids", f"""
  SELECT f.seq_id, array_to_string(list(v.token ORDER BY f.pos), ' ') AS text, CAST(count(*) AS BIGINT) AS len
  FROM (SELECT seq_id, unnest(k) AS id, generate_subscripts(k, 1) AS pos FROM (
          SELECT seq_id, (CASE WHEN coalesce(list_position(nz, 2), 0) > 0 THEN nz[1:list_position(nz, 2)] ELSE nz END) AS k
          FROM (SELECT seq_id, list_filter(framed, lambda x: x <> 0) AS nz FROM ({FRAMED_SQL})))) f
  JOIN (SELECT id, max(token) AS token FROM {EVENT_VOCAB_SQL} GROUP BY id) v USING (id)
  GROUP BY f.seq_id""")
def decode_ids(spark, sf):
    """indexes2sent of framed rows: PAD skipped, stop after EOS (kept), strict id lookup."""
    return decoded(spark, sf)


@register("invert_vocab", f"""
  SELECT id, arg_max(token, pos) AS token FROM (
    SELECT token, id, 2 * id AS pos FROM {EVENT_VOCAB_SQL}
    UNION ALL SELECT upper(token), id, 2 * id + 1 FROM {EVENT_VOCAB_SQL} WHERE id >= 4) GROUP BY id""")
def invert_vocab(spark, sf):
    """id -> token when two keys share an id: the later key (upper-cased alias) wins."""
    v = event_vocab(spark, sf)
    both = v.select("token", "id", (F.col("id") * 2).alias("pos")).unionByName(
        v.where(F.col("id") >= 4).select(F.upper("token").alias("token"), "id", (F.col("id") * 2 + 1).alias("pos")))
    return V.invert_vocab(both)


# ------------------------------------------------------------------ CLS/SEP framing on document words
def doc_ids(spark, sf, max_len):
    d = fx.table(spark, sf, "documents").select("doc_id", tokens_ws(F.lower("text")).alias("tokens"))
    v = V.build_vocab(d, "tokens")
    return V.encode_ids(d, "doc_id", "tokens", v, max_len)


DOC_ENC = lambda m: f"""
  SELECT d.doc_id, coalesce(e.ids, []) AS ids FROM ({DOC_TOKENS_SQL}) d LEFT JOIN (
    SELECT doc_id, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM (
      SELECT doc_id, unnest(tokens[1:{m}]) AS token, generate_subscripts(tokens[1:{m}], 1) AS pos FROM ({DOC_TOKENS_SQL})) t
    LEFT JOIN {DOC_VOCAB_SQL} v USING (token) GROUP BY doc_id) e USING (doc_id)"""


@register("frame_cls_sep_mask", f"""
  SELECT doc_id, {ids_sql(f"list_concat(f, list_transform(range({MAX_SRC} - len(f)), lambda x: CAST(0 AS BIGINT)))")} AS ids,
         {ids_sql(f"list_transform(range(1, {MAX_SRC} + 1), lambda i: CASE WHEN i <= len(f) THEN 1 ELSE 0 END)")} AS mask,
         CAST(len(f) AS BIGINT) AS n_real
  FROM (SELECT doc_id, list_concat([CAST(1 AS BIGINT)], ids[1:{MAX_SRC - 2}], [CAST(2 AS BIGINT)]) AS f FROM ({DOC_ENC(MAX_SRC)}))""")
def frame_cls_sep_mask(spark, sf):
    """Per document: word ids[:62] framed [CLS]+t+[SEP], padded to 64, with a 1/0 mask."""
    e = doc_ids(spark, sf, MAX_SRC)
    real = A.take("ids", F.col("len"))
    fm = e.select("doc_id", A.frame_cls_sep_mask(real, MAX_SRC, A.SOS_ID, A.EOS_ID, A.PAD_ID).alias("f"))
    return fm.select("doc_id", ids_out(F.col("f.ids")).alias("ids"), ids_out(F.col("f.mask")).alias("mask"),
                     F.aggregate("f.mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"))


CTX_SQL = f"""
  SELECT doc_id, list_concat(f, list_transform(range({MAX_SRC} - len(f)), lambda x: CAST(0 AS BIGINT))) AS ids,
         list_transform(range(1, {MAX_SRC} + 1), lambda i: CASE WHEN i <= len(f) THEN 1 ELSE 0 END) AS mask
  FROM (SELECT doc_id, list_concat([CAST(1 AS BIGINT)], ids[1:{MAX_SRC - 1}]) AS f FROM ({DOC_ENC(MAX_SRC)}))"""


@register("frame_context_cls", f"SELECT doc_id, {ids_sql('ids')} AS ids, {ids_sql('mask')} AS mask FROM ({CTX_SQL})")
def frame_context_cls(spark, sf):
    """Context field: [CLS]+ids[:63], no SEP, padded, with mask (empty context -> just CLS)."""
    e = doc_ids(spark, sf, MAX_SRC)
    fm = e.select("doc_id", A.frame_cls_sep_mask(A.take("ids", F.col("len")), MAX_SRC, A.SOS_ID, A.EOS_ID,
                                                 A.PAD_ID, with_sep=False).alias("f"))
    return fm.select("doc_id", ids_out(F.col("f.ids")).alias("ids"), ids_out(F.col("f.mask")).alias("mask"))


@register("context_prefix_from_mask", f"""
  SELECT doc_id, {ids_sql("ids[2:n]")} AS prefix, CAST(n - 1 AS BIGINT) AS n_prefix FROM (
    SELECT doc_id, ids, CASE WHEN coalesce(list_position(mask, 0), 0) > 0 THEN list_position(mask, 0) - 1 ELSE len(mask) END AS n
    FROM ({CTX_SQL}))""")
def context_prefix_from_mask(spark, sf):
    """Recover the forced prefix: ids before the first 0 of the mask, minus the leading CLS."""
    e = doc_ids(spark, sf, MAX_SRC)
    fm = A.frame_cls_sep_mask(A.take("ids", F.col("len")), MAX_SRC, A.SOS_ID, A.EOS_ID, A.PAD_ID, with_sep=False)
    x = e.select("doc_id", fm.alias("f"))
    p = A.context_prefix_from_mask(F.col("f.ids"), F.col("f.mask"))
    return x.select("doc_id", ids_out(p).alias("prefix"), F.size(p).cast("bigint").alias("n_prefix"))


@register("position_ids", f"""
  SELECT seq_id,
    {ids_sql(f"list_concat(range(1, len + 1), list_transform(range({MAX_SEQ} - len), lambda x: 0))")} AS right_pad,
    {ids_sql(f"list_concat(list_transform(range({MAX_SEQ} - len), lambda x: 0), range(1, len + 1))")} AS left_pad
  FROM ({ENC_SQL})""")
def position_ids(spark, sf):
    """get_position: 1..len then zeros (right) or zeros then 1..len (left)."""
    e = encoded(spark, sf)
    return e.select("seq_id", ids_out(A.position_ids("len", MAX_SEQ)).alias("right_pad"),
                    ids_out(A.position_ids("len", MAX_SEQ, left_pad=True)).alias("left_pad"))


@register("length_mask", f"""
  SELECT seq_id, batch, {ids_sql("list_transform(range(0, bmax), lambda i: CASE WHEN i < len THEN 1 ELSE 0 END)")} AS mask
  FROM (SELECT seq_id, len, CAST(floor(idx / {BATCH}) AS BIGINT) AS batch,
               max(len) OVER (PARTITION BY floor(idx / {BATCH})) AS bmax
        FROM (SELECT seq_id, len, row_number() OVER (ORDER BY seq_id) - 1 AS idx FROM ({ENC_SQL})))""")
def length_mask(spark, sf):
    """sequence_mask with the default length = the batch maximum (batches of 32 in seq_id order)."""
    e = batch_assign(dense_index(encoded(spark, sf), ["seq_id"]), "idx", BATCH)
    bmax = F.max("len").over(Window.partitionBy("batch"))
    m = A.length_mask("len", bmax)
    return e.select("seq_id", "batch", ids_out(F.transform(m, lambda b: b.cast("int"))).alias("mask"))


WHOLE_SQL = f"""
  SELECT seq_id, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM (
    SELECT seq_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM ({fx.EVENT_SEQUENCES_SQL})) t
  LEFT JOIN {EVENT_VOCAB_SQL} v USING (token) GROUP BY seq_id"""
SHIFT_SQL = f"""
  SELECT seq_id, pos, framed[pos] AS input_id, framed[pos + 1] AS label_id FROM (
    SELECT seq_id, framed, unnest(range(1, len(framed))) AS pos FROM (
      SELECT seq_id, list_concat([CAST(1 AS BIGINT)], ids, [CAST(2 AS BIGINT)]) AS framed FROM ({WHOLE_SQL})))"""


def event_ids(spark, sf):
    """Every event with its vocabulary id, sequences uncut: (seq_id, ts, event_id, id)."""
    v = event_vocab(spark, sf).select(F.col("token").alias("event_type"), "id")
    ev = fx.event_tokens(spark, sf).join(v, "event_type", "left")
    return ev.select("seq_id", "ts", "event_id", F.coalesce("id", F.lit(A.UNK_ID)).alias("id"))


def shifted(spark, sf):
    return shift_pairs(event_ids(spark, sf), "seq_id", ["ts", "event_id"], "id")


@register("shift_labels", f"SELECT seq_id, CAST(pos AS BIGINT) AS pos, input_id, label_id FROM ({SHIFT_SQL})")
def shift_labels(spark, sf):
    """Next-token pairs of whole framed sequences: inputs [:-1], labels [1:]; there is no padding to exclude."""
    return shifted(spark, sf)


@register("next_token_table", f"""
  SELECT state, token, cnt, round(ln(CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY state)), 6) AS logp FROM (
    SELECT input_id AS state, label_id AS token, CAST(count(*) AS BIGINT) AS cnt FROM ({SHIFT_SQL}) GROUP BY 1, 2)""")
def next_token_table(spark, sf):
    """Successor counts of framed event sequences -> log relative frequency per state."""
    from seqforge.operators.decode import next_token_table as ntt
    return _round_all(ntt(shifted(spark, sf), "input_id", "label_id").select("state", "token", "cnt", "logp"))


# ------------------------------------------------------------------ vectors
@register("l2_normalize", """
  SELECT vec_id, CAST(p AS BIGINT) AS pos, round(CAST(x AS DOUBLE) / greatest(nrm, 1e-12), 6) AS value FROM (
    SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p,
           sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) AS nrm
    FROM embeddings)""")
def l2_normalize(spark, sf):
    """Unit-length embeddings (divisor max(norm, 1e-12)), one row per component."""
    e = fx.table(spark, sf, "embeddings")
    n = e.select("vec_id", F.posexplode(A.l2_normalize("embedding")).alias("pos", "value"))
    return _round_all(n.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "value"))


@register("pair_vector_features", """
  SELECT a.vec_id, CAST(len(a.embedding) + len(b.embedding) AS BIGINT) AS width,
    round(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))) + list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS cat_sum,
    round(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)))
          + list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))), 6) AS diff_sum,
    round(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)))
          + list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) AS mul_sum
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_vector_features(spark, sf):
    """[a;b], [a;a-b], [a;a*b] for consecutive vectors, summarised by width and element sums."""
    e = fx.table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    j = a.join(b, "vec_id")

    def s(arr, n):
        return F.aggregate(F.slice(arr, 1, F.lit(n)) if n else arr, F.lit(0.0), lambda acc, x: acc + x)

    cat = A.pair_vector_features("a", "b", "cat")
    diff = A.pair_vector_features("a", "b", "diff")
    mul = A.pair_vector_features("a", "b", "mul")
    half = F.size("a")
    tail = lambda arr: F.aggregate(F.slice(arr, half + 1, half), F.lit(0.0), lambda acc, x: acc + x)
    head = F.aggregate(F.transform("a", lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return _round_all(j.select(
        "vec_id", F.size(cat).cast("bigint").alias("width"),
        (head + tail(cat)).alias("cat_sum"), (head + tail(diff)).alias("diff_sum"), (head + tail(mul)).alias("mul_sum")))

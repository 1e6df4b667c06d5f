"""Stand-in inputs derived from the driver tables, in Spark and as DuckDB SQL.

Each fixture has a Spark builder ``name(spark, sf_dir) -> DataFrame`` and a SQL
text ``SQL[name]`` (a sub-query usable in a WITH clause) producing the same rows.
All fixtures read whole tables; grouping keys that may be hot are handled with
partial aggregation or a partial top-k (WindowGroupLimit), never by collecting a
whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

PREFIX_LEN = 20       # documents that begin alike belong together; the others go by source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- documents
def grouped_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, grp) of every document, and (grp, first, second, cnt) of every group.

    ``grp`` is the first PREFIX_LEN characters where another document shares them, else the source. Groups are
    counted on narrow rows with partial aggregation and written once; texts do not move to meet their group while the
    groups can be broadcast, and beyond that they meet it in salted joins.
    """
    from seqforge.operators.joins import lookup_join
    from seqforge.session import cut_lineage
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.substring("text", 1, PREFIX_LEN).alias("prefix"))
    shared = cut_lineage(docs.groupBy("prefix").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1"))
    rows = lookup_join(docs, shared.select("prefix", F.lit(True).alias("_shared")), ["prefix"], "doc_id", shared, how="left")
    rows = rows.select("doc_id", "text", F.when(F.col("_shared"), F.col("prefix")).otherwise(F.col("source")).alias("grp"))
    narrow = rows.select("grp", "doc_id")
    first = narrow.groupBy("grp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("grp").orderBy("doc_id")
    second = (narrow.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)   # partial top-2 before the shuffle
              .where(F.col("_rn") == 2).select("grp", F.col("doc_id").alias("second")))
    return rows, first.join(second, "grp", "left").select("grp", "first", F.coalesce("second", "first").alias("second"), "cnt")


GROUPED_SQL = f"""
  SELECT doc_id, text, CASE WHEN count(*) OVER (PARTITION BY substr(text, 1, {PREFIX_LEN})) > 1
                            THEN substr(text, 1, {PREFIX_LEN}) ELSE source END AS grp FROM documents"""


def star_shared(spark: SparkSession, sf_dir: str):
    """Every document (seg, hyp, ref_id) is a hypothesis against the lowest doc_id of its group; that one itself against the
    second lowest (a document alone in its group against itself). The references (ref_id, ref) are not joined to it."""
    from seqforge.operators.joins import SharedRefs, checked_broadcast, lookup_join
    from seqforge.session import cut_lineage
    rows, groups = grouped_documents(spark, sf_dir)
    groups = cut_lineage(groups)
    tagged = lookup_join(rows, groups.select("grp", "first", "second"), ["grp"], "doc_id", groups.select("grp", "cnt"))
    hyps = tagged.select(F.col("doc_id").alias("seg"), F.col("text").alias("hyp"),
                         F.when(F.col("doc_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("ref_id"))
    ids = groups.select(F.explode(F.array_distinct(F.array("first", "second"))).alias("ref_id"))
    refs = (table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), F.col("text").alias("ref"))
            .join(checked_broadcast(ids), "ref_id", "left_semi"))
    counts = groups.select(F.col("first").alias("ref_id"), "cnt")
    return SharedRefs(hyps, refs, counts)


def star_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seg, hyp, ref, ref_id): the rows of :func:`star_shared`, each beside its reference."""
    return star_shared(spark, sf_dir).joined("seg").select("seg", "hyp", "ref", "ref_id")


STAR_PAIRS_SQL = f"""
  SELECT x.doc_id AS seg, x.text AS hyp, r.text AS ref, r.doc_id AS ref_id
  FROM (SELECT doc_id, text, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY grp)
               THEN coalesce(lead(doc_id) OVER (PARTITION BY grp ORDER BY doc_id), doc_id)
               ELSE min(doc_id) OVER (PARTITION BY grp) END AS ref_id FROM ({GROUPED_SQL})) x
  JOIN documents r ON r.doc_id = x.ref_id"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seg, hyp, ref): turn t of a conversation is the reference, turn t+1 the hypothesis."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ref = conv.select("conv_id", F.col("turn").alias("t"), F.col("text").alias("ref"))
    hyp = conv.select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("hyp"))
    return (ref.join(hyp, ["conv_id", "t"])
            .select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("t").cast("string")).alias("seg"),
                    "hyp", "ref"))


TURN_PAIRS_SQL = """
  SELECT CAST(r.conv_id AS VARCHAR) || ':' || CAST(r.turn AS VARCHAR) AS seg, h.text AS hyp, r.text AS ref
  FROM conversations r JOIN conversations h ON h.conv_id = r.conv_id AND h.turn = r.turn + 1"""


def anchor_and_refs(spark: SparkSession, sf_dir: str):
    """Several-reference fixture: the lowest doc_id of a group is the hypothesis, every other member a reference.
    Returns (hyps(seg, text), refs(seg, ref_no, text)); ``ref_no`` is the reference's doc_id."""
    from seqforge.operators.joins import lookup_join
    from seqforge.session import cut_lineage
    rows, groups = grouped_documents(spark, sf_dir)
    groups = cut_lineage(groups)
    tagged = lookup_join(rows, groups.where("cnt > 1").select("grp", F.col("first").alias("seg")), ["grp"], "doc_id", groups.select("grp", "cnt"))
    hyps = tagged.where(F.col("doc_id") == F.col("seg")).select("seg", "text")
    refs = tagged.where(F.col("doc_id") != F.col("seg")).select("seg", F.col("doc_id").alias("ref_no"), "text")
    return hyps, refs


def anchor_refs_sql() -> tuple[str, str]:
    g = f"SELECT *, min(doc_id) OVER (PARTITION BY grp) AS seg, count(*) OVER (PARTITION BY grp) AS cnt FROM ({GROUPED_SQL})"
    return (f"SELECT seg, text FROM ({g}) WHERE doc_id = seg AND cnt > 1",
            f"SELECT seg, doc_id AS ref_no, text FROM ({g}) WHERE doc_id <> seg")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line files: (doc_id, line_no from 0, line)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


DOC_LINES_SQL = """
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no,
         unnest(string_split(text, chr(10))) AS line
  FROM documents"""


# ---------------------------------------------------------------- events
def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as rows: the events of a user and day in (ts, event_id) order. Output: (seq_id, ts, event_id, event_type)."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 1_000_000 + day).cast("bigint").alias("seq_id"), "ts", "event_id", "event_type")


def event_sequences(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    """The first ``first`` tokens of every sequence as an array: (seq_id, tokens). Longer sequences are cut before
    their rows are gathered (a partial top-n)."""
    w = Window.partitionBy("seq_id").orderBy("ts", "event_id")
    ev = event_tokens(spark, sf_dir).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first)
    seqs = ev.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "event_type"))).alias("s"))
    return seqs.select("seq_id", F.transform("s", lambda x: x["event_type"]).alias("tokens"))


EVENT_SEQUENCES_SQL = """
  SELECT CAST(user_id * 1000000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq_id, user_id,
         list(event_type ORDER BY ts, event_id) AS tokens
  FROM events GROUP BY user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-metric log: run = user_id, epoch = day of ts, step = event_id (monotone in ts),
    loss = value / 100 (a natural-log loss scale, 4 decimals), tokens = event_id % 50 + 1."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run"),
                     F.dayofmonth("ts").cast("int").alias("epoch"),
                     F.col("event_id").alias("step"),
                     (F.col("value") / 100.0).alias("loss"),
                     (F.col("event_id") % 50 + 1).cast("bigint").alias("tokens"),
                     F.col("event_type").alias("name"),
                     F.col("ts"))


RUN_LOG_SQL = """
  SELECT user_id AS run, CAST(dayofmonth(ts) AS INTEGER) AS epoch, event_id AS step, value / 100.0 AS loss,
         CAST(event_id % 50 + 1 AS BIGINT) AS tokens, event_type AS name, ts
  FROM events"""

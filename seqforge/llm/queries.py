"""The registered queries of this subpackage, one for each operator, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqforge.llm.common import held_out
from seqforge.llm.containment import containment_search
from seqforge.llm.content_sort import content_sort_dedup
from seqforge.llm.fixity import archive_records, damaged, fixity_report
from seqforge.llm.hard_negatives import mine_hard_negatives
from seqforge.llm.language import fit_language_model, identify_language
from seqforge.llm.license_scan import scan_licenses
from seqforge.llm.line_dedup import drop_repeated_lines
from seqforge.llm.manifest import FAN, FIELDS, merkle_proofs
from seqforge.llm.mixing import mix_to_weights
from seqforge.llm.ngram_join import ngram_jaccard_join
from seqforge.llm.quality import fit_quality_model, score_quality
from seqforge.llm.suffix_tree import score_with_suffix_tree
from seqforge.llm.toxicity import fit_toxicity_model, score_toxicity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all(coalesce({LOWER}, ''), '[^\x20\x09-\x0D]+')"
SHINGLES = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END"""


@query(f"""
WITH RECURSIVE t AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, {SHINGLES} AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
hit AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS c
        FROM e x JOIN e y ON x.gram = y.gram GROUP BY ALL),
link AS (SELECT a, b FROM hit WHERE 100 * c >= 75 * (n + m - c) AND a <> b),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM s JOIN comp ON comp.a = s.doc_id LEFT JOIN deg ON deg.a = s.doc_id
""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 75% of their five-word shingles, and the components of those links."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query()
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 over 150% of all words, none above twice its size."""
    return mix_to_weights(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=(3, 2), cap=2, seed=17)


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
dg AS (SELECT doc_id, wide, unnest([{{'g': array_to_string(w[k:k + wide - 1], ' '), 'at': k - 1}}
         for k in range(1, len(w) - wide + 2)]) AS s
       FROM d, (SELECT DISTINCT least(5, len(w)) AS wide FROM i WHERE len(w) > 0) WHERE len(w) >= wide),
ig AS (SELECT item_id, wide, len(g) AS n, unnest(g) AS gram FROM (SELECT item_id, least(5, len(w)) AS wide, {SHINGLES} AS g FROM i)),
hit AS (SELECT doc_id, item_id, n, count(DISTINCT gram) AS c, min(s['at']) AS f, max(s['at'] + dg.wide - 1) AS l
        FROM dg JOIN ig ON s['g'] = gram AND dg.wide = ig.wide GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(c AS BIGINT) AS n_shared, c / n AS containment,
  CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word FROM hit WHERE 100 * c >= 75 * n
""")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: 75% of its five-word shingles."""
    return containment_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in two replicas, the second with seeded damage; what a Merkle audit finds."""
    pages = table(spark, sf_dir, "pages")
    out = fixity_report(archive_records(pages), archive_records(damaged(pages)))
    return out.select((F.col("archive") * 4096 + F.col("record_no")).alias("page_id"), *out.columns)


@query()
def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify_language(docs, fit_language_model(docs))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query("""
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
""")
def op6_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of whole texts; the largest id stays."""
    return content_sort_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query()
def op7_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from trusted and unlabelled ones."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality_model(docs, table(spark, sf_dir, "labels")), threshold=0.7)


@query()
def op8_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under a probabilistic suffix tree and a word model."""
    return score_with_suffix_tree(table(spark, sf_dir, "documents"))


@query()
def op9_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity_model(docs, table(spark, sf_dir, "labels")), threshold=0.3)


@query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence wording in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {LOWER.replace('text', f'trim(line, {EDGE})')} AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
""")
def op11_minimal_hash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that 10 or more of them hold."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _manifest_sql(levels: int = 9, tops: int = 3) -> str:
    """The manifest with its levels written out: enough for 8^9 documents a language and 512 languages."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if f == 'text' else f) for f in FIELDS)})"

    # crc32 bit by bit: a byte is mixed in, then eight shifts
    step = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    bits = ("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))")
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, x: {step}), 4294967295)"
    ctes = [f"d AS (SELECT doc_id, coalesce('+' || lang, '-') AS g, {leaf('text')} AS leaf, {leaf(LOWER)} AS low, "
            f"{crc} AS crc FROM documents)",
            "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
            "a0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS m FROM p)"]

    def climb(a: str, level: int) -> None:
        run = f"PARTITION BY g, i // {FAN} ORDER BY i"
        ctes.append(f"""{a}r{level} AS (SELECT g, i, m, CASE WHEN m = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER ({run}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l, CASE WHEN m = 1 THEN '' ELSE coalesce(string_agg(h, '')
          OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {a}{level})""")
        ctes.append(f"""{a}{level + 1} AS (SELECT g, i // {FAN} AS i, CASE WHEN any_value(m) = 1 THEN any_value(h)
          ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, ceil(any_value(m) / {FAN})::BIGINT AS m FROM {a}{level} GROUP BY g, i // {FAN})""")

    for k in range(levels):
        climb("a", k)
    ctes.append(f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g <> '-', encode(g)) - 1 AS i, h, count(*) OVER () AS m, g AS lang "
                f"FROM a{levels})")
    for k in range(tops):
        climb("t", k)
    ctes.append("f0 AS (SELECT p.doc_id, p.g, p.i, t0.i AS t, leaf, t0.h AS subroot, '' AS sib, "
                "CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN low ELSE leaf END AS now FROM p JOIN t0 ON t0.lang = p.g)")
    at = 0
    for a, of, n in (("a", "f.g = r.g AND f.i", levels), ("t", "f.t", tops)):
        for k in range(n):
            ctes.append(f"""f{at + 1} AS (SELECT f.* EXCLUDE (sib, now), sib || r.l || r.r AS sib,
              CASE WHEN r.m = 1 THEN now ELSE sha256(r.l || now || r.r) END AS now
              FROM f{at} f JOIN {a}r{k} r ON {of} // {FAN ** k} = r.i)""")
            at += 1
    return ("WITH " + ",\n".join(ctes) + f"""
    SELECT doc_id, leaf, subroot, (SELECT h FROM t{tops}) AS root, sha256(sib) AS proof_sha256, now AS folded_root,
      now = (SELECT h FROM t{tops}) AS verified FROM f{at}""")


@query(_manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle tree over all documents, every document's proof, and which of them a tampered copy breaks."""
    out = merkle_proofs(table(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id",
                        suspect=F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
                        changed={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")})
    return out.drop("proof")


@query("""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_sum(list_transform(
        range(1, least(len(a.v), len(e.v)) + 1), lambda i: a.v[i] * e.v[i])) AS BIGINT) AS score
      FROM e a JOIN e ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER t AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW t AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER t <= 10
""")
def op13_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for every positive of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over documents."""
    return corpus_pipeline.run(spark, sf_dir)

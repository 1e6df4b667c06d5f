"""Merkle fixity audit of WARC records.

Method: records are hashed, and the hashes of every ``FAN`` neighbouring record numbers of an archive are hashed
together, in order of offset, and so on up to one root an archive. Two replicas are compared from their
roots down: only below branches that differ are nodes of the next level read and joined, until the records
that differ are found. Trees are small tables (one row a node); records are read once, to be hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.session import cut_lineage

FAN = 16                   # children of a node
LEVELS = 3                 # levels above the records: up to FAN ** LEVELS records an archive
RECORDS = FAN ** LEVELS


def warc_record(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record; a null url or payload counts as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """archive, record_no, page_id, record: pages as WARC records, dealt to archives by ranges of ids.

    Ids are counted off into archives of ``RECORDS`` numbers. Rows without id are no records. Rows that share an
    id share a record number and are told apart by their content.
    """
    number = F.col(id_col).cast("long")
    rows = pages.where(number.isNotNull())
    return rows.select(F.floor(number / RECORDS).cast("long").alias("archive"),
                       F.pmod(number, F.lit(RECORDS)).cast("int").alias("record_no"), number.alias("page_id"),
                       warc_record(number, F.col(url_col), F.col(payload_col)).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """archive, node, digest, length, copies: one row for each record number.

    Rows that share a number are first counted by content, so repeats are never gathered; different contents of
    one number are combined by sums of digest words, which need no order.
    """
    one = records.groupBy("archive", F.col("record_no").alias("node"), F.sha2("record", 256).alias("sha"),
                          F.octet_length("record").cast("long").alias("size")).agg(F.count("*").alias("n"))
    word = [F.sum(F.conv(F.substring("sha", 8 * k + 1, 8), 16, 10).cast("long") * F.col("n")).cast("string") for k in range(8)]
    return (one.groupBy("archive", "node").agg(F.min("sha").alias("first"), F.concat_ws(":", *word).alias("mixed"),
                                               F.sum("n").alias("copies"), F.sum(F.col("size") * F.col("n")).alias("length"))
            .select("archive", "node", F.when(F.col("copies") == 1, F.col("first"))
                    .otherwise(F.sha2(F.concat_ws("/", F.col("copies").cast("string"), "mixed"), 256)).alias("digest"),
                    "length", "copies"))


def with_offsets(leaf: DataFrame) -> DataFrame:
    """Adds ``offset``: where a record begins in its archive (at most ``RECORDS`` rows a window)."""
    before = Window.partitionBy("archive").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: each node hashes its children's numbers and digests in order (at most ``FAN``) and the bytes they span."""
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    return (nodes.groupBy("archive", F.floor(F.col("node") / FAN).cast("int").alias("up"))
            .agg(children.alias("children"), F.sum("length").alias("length"))
            .select("archive", F.col("up").alias("node"), F.sha2(F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(
                ":", c["node"].cast("string"), c["digest"])), F.col("length").cast("string")), 256).alias("digest"), "length"))


def merkle_tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the records up to one root an archive, each written to the shared folder."""
    levels = [cut_lineage(with_offsets(leaves(records)))]
    for _ in range(LEVELS):
        levels.append(cut_lineage(parents(levels[-1])))
    return levels


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """archive, node, status: the record numbers whose digests differ, found from the roots down.

    status is ``changed``, ``missing`` (in the replica) or ``extra`` (not in the primary).
    """
    key = ["archive", "node"]
    suspects = None
    for a, b in zip(reversed(primary), reversed(replica)):
        if suspects is not None:
            below = suspects.select("archive", F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("node") / FAN).cast("int")).join(below, ["archive", "up"], "left_semi")
                    for x in (a, b))
        suspects = (a.select(*key, F.col("digest").alias("mine")).join(b.select(*key, F.col("digest").alias("theirs")), key, "full")
                    .where(~F.col("mine").eqNullSafe(F.col("theirs"))))
    return suspects.select(*key, F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra")
                           .otherwise("changed").alias("status"))


def fixity_report(records: DataFrame, replica: DataFrame) -> DataFrame:
    """archive, record_no, offset, length, digest, status, root_ok: one row for each record number of either replica.

    ``status`` is ``ok`` or what :func:`audit` found; offset, length and digest are the primary's (null for
    ``extra``); ``root_ok`` tells whether the archive's roots agree. Empty tables give an empty result.
    """
    mine, theirs = merkle_tree(records), merkle_tree(replica)
    found = cut_lineage(audit(mine, theirs))
    bad = found.select("archive").distinct().withColumn("bad", F.lit(True))
    return (mine[0].join(found, ["archive", "node"], "full").join(bad, "archive", "left")
            .select("archive", F.col("node").cast("int").alias("record_no"), "offset", "length", "digest",
                    F.coalesce("status", F.lit("ok")).alias("status"), F.col("bad").isNull().alias("root_ok")))


def damaged(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """A replica of ``pages`` with seeded damage, for audits without a second archive: by crc32 of the id modulo 500,
    1 loses the record, 2 cuts the payload's last character, 3 swaps its letter e for another.
    """
    fault = F.crc32(F.col(id_col).cast("string")) % 500
    body = F.col(payload_col)
    return (pages.where(F.coalesce(fault != 1, F.lit(True)))
            .withColumn(payload_col, F.when(fault == 2, F.substring(body, F.lit(1), F.length(body) - 1))
                        .when(fault == 3, F.translate(body, "e", "3")).otherwise(body)))

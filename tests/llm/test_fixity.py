"""The Merkle audit against a record-by-record comparison."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from seqforge.llm.fixity import RECORDS, archive_records, audit, damaged, fixity_report, merkle_tree
from tests.conftest import SF_SMALL


def record(i, url, body):
    body = (body or "").encode()
    return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url or ''}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def brute(a, b):
    """Status of each id from the contents themselves."""
    mine, theirs = defaultdict(list), defaultdict(list)
    for rows, side in ((a, mine), (b, theirs)):
        for i, url, body in rows:
            if i is not None:
                side[i].append(record(i, url, body))
    return {i: "missing" if i not in theirs else "extra" if i not in mine else
            "ok" if sorted(mine[i]) == sorted(theirs[i]) else "changed" for i in mine.keys() | theirs.keys()}, mine


def check(spark, a, b):
    make = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(0) for c in ("archive", "node", "digest", "length", "record")})
    got = fixity_report(archive_records(make(a)), archive_records(make(b))).collect()
    status, mine = brute(a, b)
    assert {r.archive * RECORDS + r.record_no: r.status for r in got} == status and len(got) == len(status)
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.archive, r.record_no)):
        i = r.archive * RECORDS + r.record_no
        assert r.root_ok == all(s == "ok" for j, s in status.items() if j // RECORDS == r.archive)
        if i in mine:
            assert (r.offset, r.length) == (at[r.archive], sum(map(len, mine[i])))
            at[r.archive] += r.length
            if len(mine[i]) == 1:
                assert r.digest == hashlib.sha256(mine[i][0]).hexdigest()
        else:
            assert r.offset is None and r.digest is None


def test_planted_damage(spark):
    a = [(i, f"http://h/{i}", "body é %d" % i * (i % 5)) for i in [*range(0, 300), *range(5000, 5100), 70_000, -3]]
    b = [(i, u, t + "!" if i in (7, 5050) else t) for i, u, t in a if i not in (200, 70_000)] + [(9000, "n", "new"), (301, "n", "")]
    check(spark, a, b)


def test_nulls_repeats_and_shared_ids(spark):
    a = [(1, None, None), (2, "u", ""), (3, "u", "x"), (3, "u", "x"), (3, "u", "y"), (None, "u", "z"), (4, "u", "é" * 50_000), (5, "u", "q"), (5, "u", "r")]
    check(spark, a, a[::-1])
    check(spark, a, [(3, "u", "x"), (3, "u", "y"), (3, "u", "y"), (1, "", None), (4, "u", "é" * 50_000), (5, "u", "q"), (5, "u", "r")])


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert fixity_report(archive_records(none), archive_records(none)).count() == 0
    check(spark, [], [(1, "u", "x")])


def test_pages_with_seeded_damage(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").unionByName(
        spark.range(10_000, 14_000).selectExpr("id as page_id", "'u' as url", "concat('the e ', id) as html"))
    fault = {i: zlib.crc32(str(i).encode()) % 500 for i in (r.page_id for r in pages.collect())}
    got = {r.archive * RECORDS + r.record_no: r.status for r in
           fixity_report(archive_records(pages), archive_records(damaged(pages))).collect()}
    assert got == {i: {1: "missing", 2: "changed", 3: "changed"}.get(f, "ok") for i, f in fault.items()}
    assert set(got.values()) == {"ok", "changed", "missing"}


def test_equal_replicas_differ_nowhere(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    a, b = merkle_tree(archive_records(pages)), merkle_tree(archive_records(pages.repartition(7)))
    assert audit(a, b).count() == 0 and a[-1].count() == pages.selectExpr("floor(page_id / 4096)").distinct().count()

"""Helpers shared by the operators of this subpackage: words, hashed shingles, lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.session import cut_lineage

#: Words are runs of anything but these characters, on A-Z lower-cased text.
WORD = r"[^\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes; ``bytes.lower`` and ``bytes.split`` know ASCII only, as wanted."""
    return text.lower().split() if text else []


def binaries(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, nulls kept."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` word hashes (order matters)."""
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += h[k:k + m]
    out *= _MIX2
    out ^= out >> np.uint64(32)
    return out


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text.

    A text with fewer than ``n`` words gives its whole sequence as one shingle; one without words gives none.
    """
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    return np.unique(chained(word_hashes(ws), min(n, len(ws))))


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def batches_of(rows: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``size``, so that working arrays stay small."""
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def from_numpy(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema)], schema=schema)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the identifier (as long) and the text, under fixed names: other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of ``df`` starts with: names made with them cannot clash."""
    p = "__"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the identifier's decimal text, modulo ``modulus``, equals ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def pair_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (columns a, b).

    Alternating large-star and small-star rounds; each is a grouped minimum and a join back, so no
    neighbourhood is ever gathered, and the edge count never grows. Every round is cut off by a checkpoint.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct())
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        now = cut_lineage(small)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
    raise RuntimeError("components did not settle")

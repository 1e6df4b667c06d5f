"""Repeated lines, found through a sharded minimal perfect hash.

Method: every line key has a 128-bit hash. Hashes are dealt to shards; a shard's distinct hashes get a minimal
perfect hash (levels of bit arrays: a key sits where it is alone, the others go on to the next level, and the
rank of its bit is its slot), and two arrays by slot: a 32-bit fingerprint and a count of documents. Documents do
not join lines: each block of documents sends a shard the distinct hashes it holds, packed into one row, the
shard looks them up in its arrays and answers with those found often enough, and the block marks its lines.

A line in a third of all documents travels once a block, so no shard and no block gets more than its share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import binaries, from_numpy, two_columns
from seqforge.session import checkpoint_dir

BLOCK_BYTES = 8 << 20      # text of a block of documents, and the most rows it has
BLOCK_ROWS = 1 << 15
SHARD_KEYS = 1 << 17       # lines a shard holds, about
GAMMA = 2.0                # bits a key on a level
HASH = np.dtype([("hi", "<u8"), ("lo", "<u8")])

ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("hashes", pa.binary())])
PART = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
INDEX = pa.schema([("shard", pa.int64()), ("keys", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()),
                   ("prints", pa.binary()), ("counts", pa.binary())])
FOUND = pa.schema([("block", pa.int64()), ("hashes", pa.binary())])
MARKS = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("marks", pa.list_(pa.bool_()))])
SQL = {ROWS: "block long, doc_id long, sha binary, hashes binary",
       PART: "shard long, block long, hashes binary, counts binary",
       INDEX: "shard long, keys long, sizes binary, bits binary, prints binary, counts binary",
       FOUND: "block long, hashes binary", MARKS: "doc_id long, sha binary, marks array<boolean>"}


# ------------------------------------------------------------------ hashes of lines
def line_hashes(text: bytes | None, min_chars: int) -> bytes:
    """16 bytes a line; zero for a line whose key is shorter than ``min_chars`` code points and can never be dropped."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip().lower()
        short = not key if min_chars == 1 else len(key.decode("utf-8", "replace")) < min_chars
        out.append(bytes(16) if short else xxhash.xxh3_128_digest(key))
    return b"".join(out)


def _row_hashes(min_chars: int, block_bytes: int, block_rows: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        size = held = 0
        for batch in rows:
            out = []
            for text, sha, doc in zip(binaries(batch.column("text")), batch.column("sha").to_pylist(), batch.column("doc_id").to_pylist()):
                if size >= block_bytes or held >= block_rows:
                    block, size, held = block + 1, 0, 0
                out.append((block, doc, sha, line_hashes(text, min_chars)))
                size, held = size + len(text or b""), held + 1
            if out:
                yield from_numpy(ROWS, *map(list, zip(*out)))

    return run


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different non-zero hashes in order, and how often each is there."""
    keys, counts = np.unique(hashes[(hashes["hi"] != 0) | (hashes["lo"] != 0)], return_counts=True)
    return keys, counts


def _parts(shards: int):
    """One row a block and shard: the distinct hashes of the block, and how many of its documents hold each."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = _distinct(np.concatenate([_distinct(h)[0] for h in held]))
            shard = (keys["hi"] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            mine = [x for x in np.split(order, cuts) if len(x)]
            if mine:
                yield from_numpy(PART, [int(shard[x[0]]) for x in mine], [now] * len(mine), [keys[x].tobytes() for x in mine],
                                 [counts[x].astype("<i8").tobytes() for x in mine])

        for batch in rows:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("hashes").to_pylist()):
                if block != now:
                    if held:
                        yield from out()
                    now, held = block, []
                held.append(np.frombuffer(packed, HASH))
        if held:
            yield from out()

    return run


# ------------------------------------------------------------------ the minimal perfect hash of a shard
def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` for every key; both halves of the hash count, so different keys part on some level."""
    x = keys["lo"] ^ (keys["hi"] * np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_index(keys: np.ndarray, counts: np.ndarray, top: int) -> dict:
    """sizes, bits, prints, counts: a minimal perfect hash of distinct ``keys``; counts are held up to ``top``."""
    sizes, bits, rest, level = [], [], keys, 0
    while len(rest):
        size = max(64, -(-int(GAMMA * len(rest)) // 64) * 64)
        at = _spot(rest, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone).tobytes())
        rest, level = rest[~alone[at]], level + 1
    index = {"sizes": np.array(sizes, "<i8").tobytes(), "bits": b"".join(bits), "keys": len(keys)}
    slot = slots(index, keys)
    prints, held = np.zeros(len(keys), "<u4"), np.zeros(len(keys), np.min_scalar_type(top).newbyteorder("<"))
    prints[slot] = keys["lo"] >> np.uint64(32)
    held[slot] = np.minimum(counts, top)
    return index | {"prints": prints.tobytes(), "counts": held.tobytes()}


def slots(index: dict, keys: np.ndarray) -> np.ndarray:
    """The slot of every key; -1 for one that is on no level, and any slot for other foreign keys."""
    out, left, begin, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, 0
    packed = np.frombuffer(index["bits"], np.uint8)
    for level, size in enumerate(np.frombuffer(index["sizes"], "<i8").tolist()):
        alone = np.unpackbits(packed[begin:begin + size // 8])
        rank = np.cumsum(alone, dtype=np.int64)
        at = _spot(keys[left], level, size)
        hit = alone[at] == 1
        out[left[hit]] = before + rank[at[hit]] - 1
        left, begin, before = left[~hit], begin + size // 8, before + int(rank[-1])
    return out


def probe(index: dict, keys: np.ndarray, top: int) -> np.ndarray:
    """The count (up to ``top``) of every key, 0 where the fingerprint says that the key is not in the index."""
    if not index["keys"] or not len(keys):
        return np.zeros(len(keys), np.int64)
    slot = slots(index, keys)
    known = slot >= 0
    known &= np.frombuffer(index["prints"], "<u4")[slot] == (keys["lo"] >> np.uint64(32)).astype(np.uint32)
    return np.where(known, np.frombuffer(index["counts"], np.min_scalar_type(top).newbyteorder("<"))[slot], 0).astype(np.int64)


def _summed(top: int):
    def run(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("hashes").to_pylist()), HASH)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), "<i8")
        keys, where = np.unique(keys, return_inverse=True)
        index = build_index(keys, np.bincount(where, counts, len(keys)).astype(np.int64), top)
        return pa.Table.from_batches([from_numpy(INDEX, group.column("shard").to_pylist()[:1], *([index[k]] for k in INDEX.names[1:]))])

    return run


def _answers(least: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        held = {k: index.column(k)[0].as_py() for k in INDEX.names} if index.num_rows else {"keys": 0}
        out = []
        for block, packed in zip(asked.column("block").to_pylist(), asked.column("hashes").to_pylist()):
            keys = np.frombuffer(packed, HASH)
            often = keys[probe(held, keys, least) >= least]
            if len(often):
                out.append((block, often.tobytes()))
        return pa.Table.from_batches([from_numpy(FOUND, *map(list, zip(*out))) if out else from_numpy(FOUND, [], [])])

    return run


def _marked(rows: pa.Table, found: pa.Table) -> pa.Table:
    often = np.sort(np.frombuffer(b"".join(found.column("hashes").to_pylist()), HASH))
    out = {}
    for doc, sha, packed in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "sha", "hashes"))):
        if (doc, sha) not in out:
            marks = np.isin(np.frombuffer(packed, HASH), often)
            out[doc, sha] = marks.tolist() if marks.any() else None
    out = [(*k, v) for k, v in out.items() if v]
    return pa.Table.from_batches([from_numpy(MARKS, *map(list, zip(*out))) if out else from_numpy(MARKS, [], [], [])])


# ------------------------------------------------------------------ over tables
def _written(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def hashed_rows(docs: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, doc_id, sha, hashes: the line hashes of every row, in blocks of documents. To be written before use."""
    two = two_columns(docs, id_col, text_col).select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    return two.mapInArrow(_row_hashes(min_chars, BLOCK_BYTES, BLOCK_ROWS), SQL[ROWS])


def line_parts(rows: DataFrame, shards: int) -> DataFrame:
    return rows.select("block", "hashes").mapInArrow(_parts(shards), SQL[PART])


def line_index(parts: DataFrame, top: int) -> DataFrame:
    """shard, keys, sizes, bits, prints, counts: one row a shard. ``top``: counts are held up to this number."""
    return parts.groupBy("shard").applyInArrow(_summed(top), SQL[INDEX])


def line_marks(rows: DataFrame, parts: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """doc_id, sha, marks: for each row with lines to drop, which they are. ``parts`` are those of ``rows``."""
    found = index.groupBy("shard").cogroup(parts.groupBy("shard")).applyInArrow(_answers(least), SQL[FOUND])
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_marked, SQL[MARKS])


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
                        text_col: str = "text", shard_keys: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: one row for each row of ``docs``, its text without the repeated lines.

    A line's key is the line without space, tab, newline, return, form feed and vertical tab at its ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold lose all their
    lines; a line twice in one row counts once. Other lines stay as they are, joined by newlines.

    A null text counts as empty and has one empty line; rows without identifier and repeated rows are documents
    like others. A text of one long line or of very many lines is read whole. An empty table gives an empty
    result; other columns are not looked at. Lines are told apart by 128-bit hashes.
    """
    spark = docs.sparkSession
    top = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    rows = _written(hashed_rows(docs, min_chars, id_col, text_col), f"{top}/rows")
    lines = rows.agg(F.sum(F.octet_length("hashes") / HASH.itemsize)).first()[0] or 0
    shards = max(1, int(-(-lines // (shard_keys or SHARD_KEYS))))
    parts = line_parts(rows, shards)
    index = _written(line_index(parts, min_docs), f"{top}/index")
    marks = _written(line_marks(rows, parts, index, min_docs).distinct(), f"{top}/marks")

    two = two_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).alias("d")
    joined = two.join(marks.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
                      & (F.unhex(F.sha2("d.text", 256)) == F.col("m.sha")), "left")
    split = F.split("d.text", "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.get("m.marks", i)), "\n")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("m.marks", lambda x: x)), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("m.marks").isNull(), F.col("d.text")).otherwise(kept).alias("text"))

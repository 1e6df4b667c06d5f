"""Benchmark decontamination: which documents hold which test items.

Method: size-partitioned MinHash containment search. Items fall into partitions by set size (powers of two).
Each item's signature is the smallest hashes of its shingles, as many as its partition needs: an item of
the partition that a document holds to the threshold misses fewer shingles than the signature has, so the
search loses nothing however short the item and long the document. An item with fewer words than a shingle is one
shingle of its own width; documents are cut to every width that the items have. A document is a candidate for an item
when it holds enough of the signature; the candidate is verified with all shingles of both.

Items are searched in blocks of a stated size; a block is all that is ever sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import (batches_of, binaries, chained, from_numpy, shingle_set, two_columns, word_hashes,
                                  words)
from seqforge.session import cut_lineage

ITEM = pa.schema([("item_id", pa.int64()), ("wide", pa.int32()), ("grams", pa.binary())])
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()),
                 ("first_word", pa.int64()), ("last_word", pa.int64())])
MASK = np.uint64(0xFFFF)


def signature_length(n: int, num: int, den: int) -> int:
    """Smallest hashes kept of a set of ``n`` shingles: one more than any set of its partition may miss."""
    top = (1 << n.bit_length()) - 1
    return min(n, top * (den - num) // den + 1)


def _items(ngram: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            texts = binaries(batch.column("text"))
            yield from_numpy(ITEM, batch.column("item_id"), [min(ngram, len(words(t))) for t in texts],
                             pa.array([shingle_set(t, ngram).tobytes() for t in texts], pa.binary()))

    return run


def cuts(text: bytes | None, widths: list[int]) -> dict[int, np.ndarray]:
    """The shingles of a whole text in order, for each width that it has words for."""
    h = word_hashes(words(text))
    return {w: chained(h, w) for w in widths if len(h) >= w}


def set_of(grams: dict[int, np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([*grams.values()])) if grams else np.empty(0, np.uint64)


class Block:
    """Signatures and whole sets of one block of items."""

    def __init__(self, items: list[tuple[int | None, int, bytes]], num: int, den: int):
        self.ids = [i for i, _, _ in items]
        self.wide = [w for _, w, _ in items]
        self.widths = sorted(set(self.wide))
        self.sets = [np.frombuffer(g, np.uint64) for _, _, g in items]
        n = [len(s) for s in self.sets]
        length = [signature_length(k, num, den) for k in n]
        self.needed = np.array([-(-num * k // den) for k in n])
        self.enough = np.array([m - (k - r) for m, k, r in zip(length, n, self.needed)])
        grams = np.concatenate([s[:m] for s, m in zip(self.sets, length)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], np.repeat(np.arange(len(n)), length)[order]
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.grams & MASK).astype(np.int64)] = True

    def found(self, held: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) for the items that a sorted set holds to the threshold."""
        can = held[self.some[(held & MASK).astype(np.int64)]]
        lo, hi = np.searchsorted(self.grams, can, "left"), np.searchsorted(self.grams, can, "right")
        many = hi - lo
        if not many.any():
            return []
        at = np.repeat(hi - np.cumsum(many), many) + np.arange(many.sum())
        item, hits = np.unique(self.owner[at], return_counts=True)
        out = []
        for k in item[hits >= self.enough[item]]:
            at = np.minimum(np.searchsorted(held, self.sets[k]), len(held) - 1)
            shared = int((held[at] == self.sets[k]).sum())
            if shared >= self.needed[k]:
                out.append((int(k), shared))
        return out


def _search(block):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in batches_of(rows):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text"))):
                grams = cuts(text, b.widths)
                for k, shared in b.found(set_of(grams)):
                    at = np.flatnonzero(np.isin(grams[b.wide[k]], b.sets[k]))
                    out.append((doc, b.ids[k], len(b.sets[k]), shared, int(at[0]), int(at[-1]) + b.wide[k] - 1))
            if out:
                yield from_numpy(HIT, *map(list, zip(*out)))

    return run


def _blocks(items: DataFrame, threshold: tuple[int, int], ngram: int, block: int, item_id_col: str,
            item_text_col: str) -> list:
    """Broadcasts of the items in blocks of about ``block`` shingles; none when no item has words."""
    asked = (items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
             .mapInArrow(_items(ngram), "item_id long, wide int, grams binary").where(F.octet_length("grams") > 0).distinct())
    asked = cut_lineage(asked)
    total = asked.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0)) / 8).first()[0]
    n = max(1, -(-int(total) // block))
    parts = (asked.where(F.pmod(F.xxhash64("item_id", "grams"), F.lit(n)) == k).collect() for k in range(n))
    return [items.sparkSession.sparkContext.broadcast(Block([tuple(r) for r in part], *threshold)) for part in parts if part]


def containment_search(docs: DataFrame, items: DataFrame, threshold: tuple[int, int] = (75, 100), ngram: int = 5,
                       block: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment, first_word, last_word: one row for each item a document holds.

    A document holds an item when ``den * |I & D| >= num * |I|`` over sets of word shingles, for ``threshold
    = (num, den)``; ``first_word`` and ``last_word`` (from 0) bound the words under shared shingles. Items with fewer
    words than ``ngram`` are one shingle of the whole sequence, looked for anywhere in a document. Null, empty and wordless texts hold nothing
    and are held by nothing. Identifiers may be null or repeated: rows are independent, but equal rows of
    items count once. Empty tables give an empty result; other columns are not looked at.
    """
    two = two_columns(docs, id_col, text_col)
    schema = "doc_id long, item_id long, n_item long, n_shared long, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for b in _blocks(items, threshold, ngram, block, item_id_col, item_text_col):
        out = out.unionByName(two.mapInArrow(_search(b), schema))
    return out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"),
                      "first_word", "last_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: tuple[int, int] = (75, 100), ngram: int = 5,
                      block: int = 1_000_000, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, as :func:`containment_search` decides; nothing is shuffled."""
    def clean(b):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_of(rows):
                at = batch.schema.get_field_index(text_col)
                yield batch.filter(pa.array([not b.value.found(set_of(cuts(t, b.value.widths)))
                                             for t in binaries(batch.column(at))], pa.bool_()))

        return run

    for b in _blocks(items, threshold, ngram, block, item_id_col, item_text_col):
        docs = docs.mapInArrow(clean(b), docs.schema)
    return docs

"""Hard negatives by exact integer products of anchors and candidates.

Method: components are scaled to whole numbers; anchors and candidates meet in int64 tiles, padded with zeros and
multiplied by Strassen's recursion (seven products of half tiles in place of eight). Sums are modulo 2^64, so
every score that fits in 64 bits comes out exact whatever the sums in between do. Each task keeps heaps that can
be merged: first the best positives of every anchor, then, once these are known, the best negatives in every
positive's window; Spark merges the tasks' heaps by a top-k window.

Anchors go to the tasks in groups of bounded size, one after the other; candidates stay where they are and are
never paired in rows. All rows are looked at for every anchor, so the work grows with anchors times rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import from_numpy
from seqforge.operators.rank import dense_index
from seqforge.session import checkpoint_dir, cut_lineage

GROUP = 8192               # anchors that are sent to the tasks at a time
TILE = (256, 4096)         # anchors and candidates of a tile
LEAF = 8                   # tiles with a side up to this are multiplied plainly
LIMIT = 1 << 56            # scores stay below it, so that a hundred times a score fits 64 bits
LOWEST = -(1 << 62)        # no score
DENSE = 16                 # where more than one in so many candidates counts, the keep-th score is found first

HEAP = pa.schema([("no", pa.int64()), ("at", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
HEAP_SQL = "no long, at int, score long, vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of int64 matrices modulo 2^64. Odd sides get a row or column of zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    q = strassen(a21 + a22, b11, leaf)
    r = strassen(a11, b12 - b22, leaf)
    s = strassen(a22, b21 - b11, leaf)
    t = strassen(a11 + a12, b22, leaf)
    u = strassen(a21 - a11, b11 + b12, leaf)
    v = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p + s - t + v
    out[:h, j:] = r + t
    out[h:, :j] = q + s
    out[h:, j:] = p - q + r + u
    return out[:m, :n]


def matrix(vectors: pa.Array, scale: float, width: int | None = None) -> np.ndarray:
    """Rows of floor(scale * x), cut or padded with zeros to ``width`` (by default the longest)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    values = np.floor(scale * np.asarray(vectors.flatten(), np.float64))
    if len(values) and np.abs(values).max() >= LIMIT:
        raise ValueError("components are too large for 64-bit scores")
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width), np.int64)
    row, col = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = col < width
    out[row[inside], col[inside]] = values[inside].astype(np.int64)
    return out


def _checked(a: np.ndarray, b: np.ndarray) -> None:
    """Raises where scores could leave 64 bits (a bound by lengths of the vectors)."""
    longest = [float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for x in (a, b)]
    if longest[0] * longest[1] >= LIMIT:
        raise ValueError("vectors are too long for 64-bit scores")


def best(scores: np.ndarray, mask: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``keep`` highest of the masked scores, ties by smaller id, and their ids (LOWEST and 0: none)."""
    if scores.shape[1] > keep and np.count_nonzero(mask) * DENSE > mask.size:
        edge = np.partition(np.where(mask, scores, LOWEST), -keep, axis=1)[:, -keep]
        mask = mask & (scores >= edge[:, None])
    row, col = np.nonzero(mask)
    score, vec = scores[row, col], ids[col]
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    slot = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((len(scores), keep), LOWEST), np.zeros((len(scores), keep), np.int64)
    kept = slot < keep
    out[0][row[kept], slot[kept]], out[1][row[kept], slot[kept]] = score[kept], vec[kept]
    return out


def merged(held: tuple, more: tuple, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Two heaps (scores, ids) as one; neither order nor number of merges matters."""
    scores, ids = (np.concatenate(x, axis=1) for x in zip(held, more))
    order = np.lexsort((ids, -scores), axis=-1)[:, :keep]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _tiles(rows: Iterator[pa.RecordBatch], scale: float, width: int, candidates: int):
    """vec_ids, labels and matrix of candidate tiles."""
    for batch in rows:
        for at in range(0, batch.num_rows, candidates):
            part = batch.slice(at, candidates)
            yield np.asarray(part.column(0), np.int64), np.asarray(part.column(1), np.int64), matrix(part.column(2), scale, width)


def _heaps(group, scale: float, keep: int, windows: bool, tile: tuple[int, int]):
    """The task's best ``keep`` candidates for every anchor of the broadcast ``group``: those of its label or, with
    ``windows``, for each of its positives those of other labels in the positive's window (low, high, per)."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, ids, scores, low, high, per = group.value
        kinds = scores.shape[1] if windows else 1
        held = [[np.full((len(ids), keep), LOWEST), np.zeros((len(ids), keep), np.int64)] for _ in range(kinds)]
        for mine, kind, x in _tiles(rows, scale, anchors.shape[1], tile[1]):
            _checked(anchors, x)
            right = np.ascontiguousarray(x.T)
            for k in range(0, len(ids), tile[0]):
                cut = slice(k, k + tile[0])
                product = strassen(anchors[cut], right)
                same = labels[cut, None] == kind
                times = per * product if windows else None
                for p in range(kinds):
                    mask = product >= held[p][0][cut, -1:]          # what the heap holds already is not beaten by less
                    if windows:
                        pos = scores[cut, p, None]
                        none = pos == LOWEST
                        pos = np.where(none, 0, pos)
                        mask &= ~same & ~none & (times >= low * pos) & (times <= high * pos)
                    else:
                        mask &= same & (ids[cut, None] != mine)
                    now = merged([h[cut] for h in held[p]], best(product, mask, mine, keep), keep)
                    held[p][0][cut], held[p][1][cut] = now
        for p in range(kinds):
            at, slot = np.nonzero(held[p][0] != LOWEST)
            for k in range(0, len(at), 65_536):
                a, s = at[k:k + 65_536], slot[k:k + 65_536]
                yield from_numpy(HEAP, a, np.full(len(a), p, np.int32), held[p][0][a, s], held[p][1][a, s])

    return run


def _top(heaps: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("no", "at").orderBy(F.desc("score"), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, label: Column | str = "label", id_col: str = "vec_id",
                        vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10,
                        window: tuple[int, int, int] = (30, 90, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows for which ``anchor`` holds are searched against all rows. A score is the inner product of the vectors
    of floor(scale * x). An anchor's positives are its best ``positives`` rows of the same label and another
    id; for each of them the best ``negatives`` rows of other labels with low * p <= per * n <= high * p
    are returned. Higher scores come first, then smaller ids.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Shorter
    vectors count as padded with zeros, so an empty one scores 0. Repeated rows are rows each, and a repeated anchor gives its
    rows again. Anchors without a positive, and positives without a negative, give no row; an empty table gives an
    empty result. Other columns are not looked at. Vectors whose scores could reach 2^56 raise an error.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good))
    numbered = cut_lineage(dense_index(rows.where("anchor").select("vec_id", "label", "v"), ["vec_id", "label"], "no"))
    count = numbered.count()
    everyone = rows.select("vec_id", "label", "v")
    top = f"{checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    for g in range(ceil(count / GROUP)):
        mine = numbered.where((F.col("no") >= g * GROUP) & (F.col("no") < (g + 1) * GROUP)).orderBy("no").toArrow()
        ids, labels = (np.asarray(mine.column(k), np.int64) for k in ("vec_id", "label"))
        sent = (matrix(mine.column("v"), scale), labels, ids, None, *window)
        group = spark.sparkContext.broadcast(sent)
        found = _top(everyone.mapInArrow(_heaps(group, scale, positives, False, TILE), HEAP_SQL), positives).toArrow()   # at most GROUP * positives rows
        no, slot = np.asarray(found.column("no"), np.int64), np.asarray(found.column("rank"), np.int64) - 1
        score, vec = np.full((len(ids), positives), LOWEST), np.zeros((len(ids), positives), np.int64)
        score[no, slot], vec[no, slot] = np.asarray(found.column("score"), np.int64), np.asarray(found.column("vec_id"), np.int64)
        group.destroy()
        group = spark.sparkContext.broadcast((*sent[:3], score, *sent[4:]))
        pairs = spark.createDataFrame([(int(a), int(p), int(ids[a]), int(vec[a, p]), int(score[a, p])) for a, p in zip(no, slot)],
                                      "no long, at int, anchor_id long, positive_id long, positive_score long")
        hard = _top(everyone.mapInArrow(_heaps(group, scale, negatives, True, TILE), HEAP_SQL), negatives)
        (hard.join(pairs, ["no", "at"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                               F.col("vec_id").alias("negative_id"), "positive_score",
                                               F.col("score").alias("negative_score")).write.parquet(f"{top}/group={g}"))
        group.destroy()
    if not count:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*[f"{top}/group={g}" for g in range(ceil(count / GROUP))])

"""Toxicity by class-conditional Kneser-Ney models.

Method: two bigram models, one of toxic and one of ordinary documents, interpolated and absolute-discounted at
every order. The top order holds in how many documents of the class a word pair stands. What its discount frees
goes to the pairs of both classes together, so that a rare expression says nearly the same under both models, and
what theirs frees to the class's words. Lower orders count contexts: a word the different words before it in the
class, and last the different words before it in either class, the backoff that the models share. Nothing is
filtered: rare counts are discounted. A document's evidence is the difference of its two log-likelihoods,
length-normalised over the document and over every stretch of ``SPAN`` words, and that of its single most toxic
word; a logistic curve, fitted on documents that the counted models have not seen, turns it into a score.
N-grams are counted once a document, so repeated lines count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import batches_of, binaries, from_numpy, held_out, signed, two_columns, word_hashes
from seqforge.llm.sampling import labelled_sample

SPAN = 3                   # words of a stretch
MARKS = b".,;:!?\"()[]{}*#$%&|<>"
_START = np.uint64(1)


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased and without punctuation marks."""
    return word_hashes((text or b"").lower().translate(None, MARKS).split())


def follows(h: np.ndarray) -> np.ndarray:
    """The word before each word; a start sign before the first."""
    return np.concatenate([np.array([_START]), h[:-1]])


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash for each word pair."""
    out = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (u >> np.uint64(31))
    out = (out + w) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


GRAM = pa.schema([("fold", pa.int32()), ("label", pa.int32()), ("u", pa.int64()), ("w", pa.int64())])


def _grams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(rows, 256):
        for fold, label, text in zip(batch.column("fold").to_pylist(), batch.column("label").to_pylist(),
                                     binaries(batch.column("text"))):
            h = tokens(text)
            if len(h):
                pairs = np.unique(np.stack([signed(follows(h)), signed(h)], 1), axis=0)
                full = np.ones(len(pairs), np.int32)
                yield from_numpy(GRAM, full * fold, full * label, pairs[:, 0].copy(), pairs[:, 1].copy())


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


def discount(counts: np.ndarray) -> float:
    """Ney's estimate n1 / (n1 + 2 n2); a half where nothing was counted once."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one else 0.5


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the place of each key among them in 32 bits."""
    different = np.unique(keys)
    return different, np.searchsorted(different, keys).astype(np.int32)


class LogRatio:
    """log P(word | before, toxic) - log P(word | before, ordinary), as sorted tables."""

    def __init__(self, u: np.ndarray, w: np.ndarray, t: np.ndarray, o: np.ndarray, span: int = SPAN):
        """u, w: hashes of different word pairs; t, o: the toxic and ordinary documents that hold each."""
        self.span = span
        self.none = not (t.any() and o.any())
        if self.none:
            return
        words, wi = _ranks(w)
        heads, ui = _ranks(u)
        add = lambda at, x, n: np.bincount(at, x, n)
        # last backoff, shared: contexts of a word in either class; half a context for words never seen
        room = len(u) + 0.5 * (len(words) + 1)
        shared, unseen = (np.bincount(wi, minlength=len(words)) + 0.5) / room, 0.5 / room
        # pairs of both classes together
        kept, total = t + o, add(ui, t + o, len(heads))
        kept = np.maximum(kept - discount(kept), 0)
        free = 1 - add(ui, kept, len(heads)) / total
        word, rare, back, log = {}, {}, {}, np.zeros(len(u))
        for c, n, sign in (("t", t, 1), ("o", o, -1)):
            k = add(wi, n > 0, len(words))
            own = np.maximum(k - discount(k), 0)
            left = 1 - own.sum() / k.sum()
            word[c], rare[c] = own / k.sum() + left * shared, left * unseen
            own, size = np.maximum(n - discount(n), 0), add(ui, n, len(heads))
            back[c] = np.where(size > 0, 1 - add(ui, own, len(heads)) / np.maximum(size, 1), 1.0)
            own /= np.maximum(size, 1)[ui]
            own += back[c][ui] * (kept / total[ui] + free[ui] * word[c][wi])
            log += sign * np.log(own)
        self.rare = float(np.log(rare["t"] / rare["o"]))
        self.words = words, np.log(word["t"] / word["o"])
        self.heads = heads, np.log(back["t"] / back["o"])
        key = pair_keys(u, w)
        order = np.argsort(key)
        self.pairs = key[order], log[order]

    def each(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log ratio of each word alone, and after the word before it."""
        before = follows(h)
        word = _lookup(*self.words, h, self.rare)
        x = _lookup(*self.pairs, pair_keys(before, h), np.nan)
        return word, np.where(np.isnan(x), word + _lookup(*self.heads, before, 0.0), x)

    def evidence(self, text: bytes | None) -> tuple[float, float, float, float]:
        """Difference of log-likelihoods a word: over the document, of its most toxic word alone, and over its most
        toxic stretch; the logarithm of the number of words, of which these two are the best."""
        h = tokens(text)
        if self.none or not len(h):
            return 0.0, 0.0, 0.0, 0.0
        word, x = self.each(h)
        run = np.concatenate([[0.0], np.cumsum(x)])
        k = min(self.span, len(x))
        return float(run[-1] / len(x)), float(word.max()), float((run[k:] - run[:-k]).max() / k), float(np.log(len(x)))


class Toxicity:
    def __init__(self, ratio: LogRatio, weight: np.ndarray):
        self.ratio, self.weight = ratio, weight

    def score(self, text: bytes | None) -> float:
        z = self.weight @ np.array([1.0, *self.ratio.evidence(text)])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) / weight.sum() + decay * np.r_[0, w[1:]]
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + (decay + 1e-9) * np.eye(len(w))
        w -= np.clip(np.linalg.solve(bend, grad), -2, 2)
    return w


def _evidence(ratio):
    schema = pa.schema([("label", pa.int32()), *[(c, pa.float64()) for c in ("whole", "word", "span", "size")]])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            e = [ratio.value.evidence(t) for t in binaries(batch.column("text"))]
            yield from_numpy(schema, batch.column("label"), *map(list, zip(*e)))

    return run


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, toxic: int = 3000, ordinary: int = 6000, seed: int = 9,
                       id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", span: int = SPAN,
                       volume: int = 16_000_000) -> Toxicity:
    """Learns from at most ``toxic`` documents marked 1 and ``ordinary`` marked 0, of each mark at most ``volume``
    bytes of text; texts over a 64th of that are not drawn. So the tables on the driver have a bound.

    Only documents whose crc32(id) modulo 4 is not 2 are used. Three quarters count the models whose evidence on
    the last quarter fits the score curve; the final models count all. Null ids, texts and marks, and marks other
    than 0 and 1, are never drawn; rows of equal text and mark count once. With no row of one mark, or an empty
    table, every text gets the marks' share (a half if there are none).
    """
    marks = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("label in (0, 1)").where(~held_out("doc_id", 4, 2)))
    share = marks.agg(F.avg("label")).first()[0] or 0.5
    short = docs.where(F.octet_length(F.col(text_col).cast("string")) <= volume // 64)
    sample = labelled_sample(short, marks, {1: toxic, 0: ordinary}, seed, id_col, text_col)
    sample = sample.select("label", "text").distinct().withColumn("key", F.xxhash64(F.lit(seed + 1), "text"))
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("key", "text"))
    # ranking put a mark's texts into one task: dealt anew for the cutting
    sample = (sample.withColumn("upto", size).where(F.col("upto") <= volume)
              .withColumn("fold", (F.pmod("key", F.lit(4)) == 3).cast("int")).repartition(32, "key").persist())
    counted = (sample.select("fold", "label", "text").mapInArrow(_grams, "fold int, label int, u long, w long")
               .groupBy("u", "w").agg(*[F.count(F.when((F.col("fold") == f) & (F.col("label") == c), 1)).cast("int").alias(f"{n}{f}")
                                        for f in (0, 1) for c, n in ((1, "t"), (0, "o"))]).toArrow())
    u, w = (counted.column(c).to_numpy().view(np.uint64) for c in "uw")
    t0, o0, t1, o1 = (counted.column(c).to_numpy() for c in ("t0", "o0", "t1", "o1"))
    del counted
    some = t0 + o0 > 0
    half = LogRatio(u[some], w[some], t0[some], o0[some], span)
    lone, sent = half.none, docs.sparkSession.sparkContext.broadcast(half)
    del half, some
    whole = LogRatio(u, w, t0 + t1, o0 + o1, span)
    del u, w, t0, o0, t1, o1
    seen = sample.where("fold = 1").select("label", "text").mapInArrow(
        _evidence(sent), "label int, whole double, word double, span double, size double").collect()
    sample.unpersist()
    sent.destroy()
    y = np.array([r.label for r in seen], float)
    if lone or whole.none or len(set(y)) < 2:
        return Toxicity(whole, np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0, 0, 0, 0]))
    x = np.array([[1.0, r.whole, r.word, r.span, r["size"]] for r in seen])
    # the sample's classes weigh what they weigh among all marked documents
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Toxicity(whole, logistic(x, y, weight))


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = 0.3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``, from its whole text alone.

    Null, empty and wordless texts have no evidence and get the curve's value at 0. A model that saw only one
    class scores every text with that class's share. Null and repeated ids do no harm: rows are independent.
    Other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            yield from_numpy(schema, batch.column("doc_id"), [sent.value.score(t) for t in binaries(batch.column("text"))])

    return (two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))

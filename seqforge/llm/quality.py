"""Quality classifier by positive-unlabelled learning.

Method: a linear scorer on hashed character n-grams minimises the non-negative unbiased risk
``p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])`` with trusted positives P, unlabelled web text U and the
logistic loss l. No document marked bad is ever used. The class prior p is estimated from P and U: a first
scorer tells P from U, and the smallest ratio of U's to P's share above a threshold bounds p from above,
tightly wherever some threshold leaves out nearly all bad text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import batches_of, from_numpy, held_out, two_columns
from seqforge.llm.sampling import labelled_sample

SPACE = 1 << 12            # slots for character n-grams
WINDOW = 1 << 20
_STEP, _LAST = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def features(text: str | None) -> np.ndarray:
    """Root shares of the text's character 1-, 2- and 3-grams, over the whole text, letter kinds folded.

    Letters become one of four signs (lower or upper case, first or later in a word), digits one; everything
    else stays, so that layout and punctuation show rather than vocabulary or language. The last slot is the root
    share of words that repeat the word before.
    """
    out = np.zeros(SPACE)
    every = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(every), WINDOW):
        part = every[at:at + WINDOW + 2]
        chars = part.copy()
        lower = ((part >= 97) & (part <= 122)) | ((part >= 0xDF) & (part != 0xF7))
        upper = ((part >= 65) & (part <= 90)) | ((part >= 0xC0) & (part < 0xDF) & (part != 0xD7))
        letter = lower | upper
        inner = np.concatenate([[False], letter[:-1]]) & letter
        chars[lower], chars[upper] = 1, 2
        chars[inner] += 2
        chars[(part >= 48) & (part <= 57)] = 6
        h = np.zeros(len(chars), np.uint32)
        for n in range(1, 4):
            h = (h[:len(chars) - n + 1] ^ chars[n - 1:]) * _STEP
            if not len(h):
                break
            out += np.bincount(((h + np.uint32(n)) * _LAST) >> np.uint32(20), minlength=SPACE)
    total = out.sum()
    out = np.sqrt(out / total) if total else out
    ws = (text or "").split()
    out[-1] = np.sqrt(sum(map(str.__eq__, ws, ws[1:])) / (len(ws) - 1)) if len(ws) > 1 else 0
    return out.astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = (np.zeros(size, np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = grad(w, t)
        g = g.astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 150) -> float:
    """Upper bound of the share of positives in U from held-back halves of P and U."""
    a, b = (p[::2], u[::2]), (p[1::2], u[1::2])

    def grad(w, _):
        gp = a[0].T @ (sigmoid(a[0] @ w) - 1) / len(a[0])
        gu = a[1].T @ sigmoid(a[1] @ w) / len(a[1])
        return gp + gu + 1e-4 * w

    w = _adam(grad, p.shape[1], steps, 0.05)
    sp, su = np.sort(b[0] @ w), np.sort(b[1] @ w)
    at = np.quantile(sp, np.linspace(0, 0.5, 101))
    above_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, at, "left") / len(su)
    return float(np.clip((above_u / np.maximum(above_p, 1e-9)).min(), 0.02, 0.98))


class PositiveUnlabelled:
    def __init__(self, p: np.ndarray, u: np.ndarray, steps: int = 400, decay: float = 2e-5):
        one = lambda x: np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        self.prior, self.w = 0.5, np.zeros(SPACE + 1)
        if not len(p) or not len(u):
            return
        p, u = one(p), one(u)
        prior = self.prior = estimate_prior(p, u)

        def grad(w, _):
            sp, su = sigmoid(p @ w), sigmoid(u @ w)
            positive = prior * (p.T @ (sp - 1)) / len(p)
            risk = np.log1p(np.exp(np.clip(u @ w, -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(p @ w, -30, 30))).mean()
            negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
            # below zero the estimate has fitted U too closely: step back
            return (positive + negative if risk >= 0 else -negative) + decay * w

        self.w = _adam(grad, SPACE + 1, steps, 0.1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.w[:-1] + self.w[-1])


SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])


def _vectors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(rows, 64):
        yield from_numpy(SAMPLE, batch.column("doc_id"), batch.column("label"), pa.array(
            [features(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()], pa.binary()))


def fit_quality_model(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 4000, seed: int = 7,
                      id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PositiveUnlabelled:
    """Learns from at most ``positives`` documents marked 1 and ``unlabelled`` documents whatever their mark.

    Only documents whose crc32(id) modulo 4 is not 2 are used. Feature vectors of fixed size come to the driver.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id"), F.lit(1).alias("label"))
    every = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("label"))
    train = ~held_out("doc_id", 4, 2)
    p = labelled_sample(docs, good.where(train), positives, seed, id_col, text_col)
    u = labelled_sample(docs, every.where(train), unlabelled, seed + 1, id_col, text_col)
    rows = p.unionByName(u).mapInArrow(_vectors, "doc_id long, label int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r.label, (r.doc_id * 0x9E3779B97F4A7C15 + seed) % 2**61))
    x = {k: np.array([np.frombuffer(r.x, np.float16) for r in rows if r.label == k], np.float32).reshape(-1, SPACE)
         for k in (0, 1)}
    return PositiveUnlabelled(x[1], x[0])


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, 128):
            x = np.array([features(t) for t in batch.column("text").to_pylist()])
            yield from_numpy(schema, batch.column("doc_id"), model.value.scores(x))

    return run


def score_quality(docs: DataFrame, model: PositiveUnlabelled, threshold: float = 0.7, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``, from its whole text alone.

    Null and empty texts have no n-grams and get the score of the model's constant; a model without
    positives or without text scores 0.5. Null and repeated ids do no harm: rows are independent. Other columns are
    not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return (two_columns(docs, id_col, text_col).mapInArrow(_score(sent), "doc_id long, score double")
            .select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))

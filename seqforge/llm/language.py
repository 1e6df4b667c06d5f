"""Language identification by string kernels.

Method: the blended-spectrum presence kernel of two texts is the number of character n-grams of all orders
1 to ``ORDER`` that both hold, divided by the root of the product of their own numbers. Nystroem landmarks
turn the kernel into finite features, one-versus-rest kernel ridge regression is solved on them, and texts
are scored in batches: a matrix of presence rows times the landmark and ridge matrices, which are
multiplied out beforehand.

N-grams are held in ``SPACE`` hashed slots, so a presence row, and the model, have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import batches_of, from_numpy, held_out, two_columns
from seqforge.llm.sampling import labelled_sample
from seqforge.session import cut_lineage

ORDER = 4                  # longest n-gram of the spectrum
SPACE = 1 << 15            # slots for n-grams
WINDOW = 1 << 20           # characters of a text looked at at a time
UNKNOWN = "und"
_STEP = np.uint32(0x9E3779B1)
_LAST = np.uint32(0x85EBCA6B)


def presence(text: str, row: np.ndarray) -> None:
    """Marks in ``row`` the n-grams of a whole text, lower-cased, any white space as one blank."""
    every = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(every), WINDOW):
        chars = every[at:at + WINDOW + ORDER - 1]
        h = np.zeros(len(chars), np.uint32)
        for n in range(1, ORDER + 1):
            h = (h[:len(chars) - n + 1] + chars[n - 1:]) * _STEP
            if not len(h):
                break
            h ^= h >> np.uint32(15)
            row[((h + np.uint32(n)) * _LAST) >> np.uint32(17)] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("bits", pa.binary())])


def _bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(rows, 64):
        x = np.zeros((batch.num_rows, SPACE), np.uint8)
        for row, text in zip(x, batch.column("text").to_pylist()):
            presence(text, row)
        yield from_numpy(SAMPLE, batch.column("doc_id"), batch.column("label"),
                         pa.array([np.packbits(row).tobytes() for row in x], pa.binary()))


class KernelRidge:
    """Classes and the matrix that turns normalised presence rows into one-versus-rest scores."""

    def __init__(self, x: np.ndarray, label: list[str], landmarks: int, ridge: float):
        self.classes = sorted(set(label))
        if not self.classes:
            return
        label = np.array([self.classes.index(v) for v in label])
        chosen, turn = [], {k: list(np.flatnonzero(label == k)) for k in range(len(self.classes))}
        while len(chosen) < min(landmarks, len(label)):       # the classes in turn
            for rest in turn.values():
                if rest and len(chosen) < landmarks:
                    chosen.append(rest.pop(0))
        mark = self._normal(x[chosen])
        phi = np.concatenate([self._normal(x[k:k + 256]) @ mark.T for k in range(0, len(x), 256)]).astype(np.float64)
        value, vector = np.linalg.eigh((mark @ mark.T).astype(np.float64))
        root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max())) @ vector.T
        phi = phi @ root
        self.mean = phi.mean(0)
        y = (label[:, None] == np.arange(len(self.classes))).astype(np.float64)
        centred = phi - self.mean
        w = np.linalg.solve(centred.T @ centred + ridge * len(x) * np.eye(phi.shape[1]), centred.T @ (y - y.mean(0)))
        self.matrix = (mark.T.astype(np.float64) @ (root @ w)).astype(np.float32)
        self.offset = y.mean(0) - self.mean @ w

    @staticmethod
    def _normal(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._normal(x) @ self.matrix + self.offset


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: KernelRidge = model.value
        for batch in batches_of(rows, 64):
            texts = batch.column("text").to_pylist()
            some = [k for k, t in enumerate(texts) if has_letter(t)] if m.classes else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if some:
                x = np.zeros((len(some), SPACE), np.uint8)
                for row, k in zip(x, some):
                    presence(texts[k], row)
                out = m.scores(x)
                best = out.argmax(1)
                score[some] = np.clip(out[np.arange(len(some)), best], 0, 1)
                for k, c in zip(some, best):
                    lang[k] = m.classes[c]
            yield from_numpy(schema, batch.column("doc_id"), lang, score)

    return run, "doc_id long, lang_pred string, score double"


def fit_language_model(docs: DataFrame, sample: int = 1600, landmarks: int = 256, ridge: float = 1e-4, seed: int = 5,
                       least: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelRidge:
    """Learns from at most ``sample`` labelled training documents in all, the same number for each language.

    Training documents are those whose crc32(id) modulo 4 is not 2. Rows with a null id, language or text take no
    part; a language with fewer than ``least`` of the rest is not learned, nor are any but the ``sample // least``
    most frequent. Repeated rows may be drawn repeatedly. Empty texts count as any other; of an empty table no language
    is learned. Only presence bits of whole texts come to the driver: ``sample`` rows of ``SPACE`` bits.
    """
    marks = (docs.where(~held_out(id_col, 4, 2) & F.col(text_col).isNotNull())
             .select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("label")).dropna())
    learned = cut_lineage(marks.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
                          .orderBy(F.desc("n"), "label").limit(max(1, sample // least)).select("label"))
    many = learned.count()
    picked = labelled_sample(docs, marks.join(F.broadcast(learned), "label", "left_semi"), sample // max(1, many), seed,
                             id_col, text_col)
    # ranked by label, so dealt anew: cutting the texts is spread over the tasks
    rows = picked.repartition(F.col("doc_id")).mapInArrow(_bits, "doc_id long, label string, bits binary").collect()
    rows = sorted(rows, key=lambda r: ((r.doc_id * 0x9E3779B97F4A7C15 + seed) % 2**61, r.label, r.bits))
    x = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows]).reshape(-1, SPACE)
    return KernelRidge(x, [r.label for r in rows], landmarks, ridge)


def identify_language(docs: DataFrame, model: KernelRidge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of ``docs``, from its whole text alone.

    A null text, one without letters, and any text under a model that learned no language give ``und`` with
    score 0. Null and repeated ids do no harm: rows are independent. Other columns are not looked at.
    """
    run, schema = _predict(docs.sparkSession.sparkContext.broadcast(model))
    return two_columns(docs, id_col, text_col).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: KernelRidge, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language (not ``und``) scored ``least`` or more; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, _ = _predict(sent)
        for batch in batches_of(rows, 64):
            text = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            asked = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])
            out = pa.Table.from_batches(list(predict(iter([asked]))))
            score, lang = out["score"].to_numpy(), out["lang_pred"].to_pylist()
            yield batch.filter(pa.array([v != UNKNOWN and s >= least for v, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

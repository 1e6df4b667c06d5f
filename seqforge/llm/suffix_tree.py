"""Language-model scoring with a probabilistic suffix tree.

Method: the symbols of a text are the bytes of its lower-cased words, a blank between words and one end sign.
All runs of ``DEPTH`` symbols with the next one are counted over every training document. Contexts seen a fixed
number of times (twice, whatever the corpus) are candidates; one is retained when a
divergence test (the log-likelihood gained over its parent's distribution against Akaike's criterion, one for
each next symbol) says that it predicts differently, and then its suffixes are too. Next-symbol distributions are
smoothed by absolute discounting towards the parent's, the root's by additive counts. A text is scored with
the longest retained suffix at each symbol; the product over all symbols is a probability of its word sequence.

The tree grows with the corpus, so it is a table: each level is tested, closed under suffixes and smoothed by joins
with the level of the parents. What comes out is the probability of each distinct run of the documents.

The base score is a unigram model of words. Words and runs are looked up alike: the most frequent, a bounded
table, are sent to the tasks; all others of the documents are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import batches_of, binaries, from_numpy, held_out, signed, two_columns, word_hashes, words
from seqforge.session import cut_lineage

DEPTH = 5                  # longest context
CHUNK = 3_000_000          # symbols worked on at a time
FREQUENT = 1 << 18         # words in the table that is sent to the tasks, at most; four times as many runs
DISCOUNT = 0.75
END = b"\n"
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))
_EIGHT = np.uint64(8)

COUNT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def symbols(ws: list[bytes]) -> bytes:
    """Padding, the end sign before the text, the words, the end sign after it."""
    return b"\0" * (DEPTH - 1) + END + b" ".join(ws) + END


def grams(text: bytes) -> np.ndarray:
    """DEPTH symbols and the next one, packed, for each symbol after the first DEPTH."""
    a = np.frombuffer(text, np.uint8)
    m = len(a) - DEPTH
    g = np.zeros(m, np.uint64)
    for j in range(DEPTH + 1):
        g <<= _EIGHT
        g |= a[j:j + m]
    return g


def _gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _owned(texts: list[bytes]) -> np.ndarray:
    """Which positions of the joined texts' grams belong to one text, not to the seam between two."""
    keep = np.ones(sum(map(len, texts)) - DEPTH, bool)
    at = np.cumsum([len(t) for t in texts])[:-1]
    for k in range(1, DEPTH + 1):
        keep[at - k] = False
    return keep


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and grams (kind 1) of training documents, added up in each task; other documents' grams at 0."""
    held: dict[int, list] = {0: [], 1: []}
    texts: dict[bool, list[bytes]] = {True: [], False: []}
    tokens: list[np.ndarray] = []

    def add(kind: int, every: np.ndarray, train: bool) -> None:
        keys, n = np.unique(every, return_counts=True)
        held[kind].append((keys, n if train else np.zeros_like(n)))
        if sum(len(k) for k, _ in held[kind]) > 3_000_000:
            held[kind] = [_gathered(held[kind])]

    def take() -> None:
        if tokens:
            add(0, np.concatenate(tokens), True)
        for train, some in texts.items():
            if some:
                add(1, grams(b"".join(some))[_owned(some)], train)
            some.clear()
        tokens.clear()

    size = 0
    for batch in batches_of(rows):
        for train, text in zip(batch.column("train").to_pylist(), binaries(batch.column("text"))):
            ws = words(text)
            texts[train].append(symbols(ws))
            if train:
                tokens.append(np.append(word_hashes(ws), END_HASH))
            size += len(texts[train][-1])
            if size >= CHUNK:
                take()
                size = 0
    take()
    for kind, parts in held.items():
        if parts:
            keys, n = _gathered(parts)
            for at in range(0, len(keys), 100_000):
                k = signed(keys[at:at + 100_000])
                yield from_numpy(COUNT, np.full(len(k), kind, np.int32), k, n[at:at + 100_000])


class SuffixTree:
    """The tree of one process's counts: retained contexts by depth, with their next symbols' logarithms (base 10).

    For counts that fit memory; :func:`_model` does the same with tables.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: for each depth from 0, the grams (context, next symbol) of the candidate contexts and their counts."""
        self.levels: list[tuple] = []
        raw = []
        for depth, (gram, n) in enumerate(levels):
            order = np.argsort(gram)
            gram, n = gram[order], n[order].astype(float)
            context, first = np.unique(gram >> _EIGHT, return_index=True)
            of = np.repeat(np.arange(len(context)), np.diff(np.append(first, len(gram))))
            raw.append((gram, n, context, of, np.bincount(of, n, len(context)), np.bincount(of, minlength=len(context))))
        gram, n, _, _, total, _ = raw[0]
        everything = total.sum()
        p = np.full(256, 0.1)
        p[gram.astype(np.int64)] += n
        self.base = np.log10(p / (everything + 0.1 * 256))
        # divergence tests, each against the parent's own distribution
        retained = []
        for depth in range(1, len(raw)):
            gram, n, context, of, total, seen = raw[depth]
            pg, pn, pc, _, pt, _ = raw[depth - 1]
            mask = np.uint64((1 << 8 * depth) - 1)
            up = pn[np.searchsorted(pg, gram & mask)] / pt[np.searchsorted(pc, context & (mask >> _EIGHT))][of]
            gain = np.bincount(of, n * np.log(n / total[of] / up), len(context))
            retained.append(gain > seen)
        for depth in range(len(raw) - 1, 1, -1):                 # suffixes of the retained are retained
            parents = np.unique(raw[depth][2][retained[depth - 1]] & np.uint64((1 << 8 * (depth - 1)) - 1))
            retained[depth - 2][np.searchsorted(raw[depth - 1][2], parents)] = True
        for depth in range(1, len(raw)):
            gram, n, context, of, total, seen = raw[depth]
            keep = retained[depth - 1]
            back = DISCOUNT * seen / total
            up = 10 ** self._log(gram & np.uint64((1 << 8 * depth) - 1), depth - 1)
            p = (n - DISCOUNT) / total[of] + back[of] * up
            on = keep[of]
            self.levels.append((context[keep], np.log10(back[keep]), gram[on], np.log10(p[on])))

    @property
    def states(self) -> int:
        return 1 + sum(len(c) for c, *_ in self.levels)

    def _log(self, gram: np.ndarray, depth: int) -> np.ndarray:
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(depth, 0, -1):
            context, back, keys, log = self.levels[k - 1]
            if not len(context) or not len(open_):
                continue
            g = gram[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = g >> _EIGHT
            at = np.minimum(np.searchsorted(context, c), len(context) - 1)
            state = np.flatnonzero(context[at] == c)
            where = np.minimum(np.searchsorted(keys, g[state]), len(keys) - 1)
            seen = keys[where] == g[state]
            out[open_[state]] += np.where(seen, log[where], back[at[state]])
            rest = np.ones(len(open_), bool)
            rest[state[seen]] = False
            open_ = open_[rest]
        out[open_] += self.base[(gram[open_] & np.uint64(255)).astype(np.int64)]
        return out

    def log10(self, gram: np.ndarray) -> np.ndarray:
        return self._log(gram, len(self.levels))


def _model(runs: DataFrame, least_count: int, least_share: float) -> DataFrame:
    """key, n, log: what the tree says (base 10) of the last symbol of each gram, in training (n > 0) or not."""
    levels, now = [], runs
    for depth in range(DEPTH, -1, -1):
        if depth < DEPTH:
            mask = F.lit((1 << 8 * (depth + 1)) - 1)
            now = now.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
        w = Window.partitionBy("context")                       # 256 symbols at most
        now = cut_lineage(now.select("key", "n", F.shiftright("key", 8).alias("context"))
                          .withColumns({"total": F.sum("n").over(w), "seen": F.count_if(F.col("n") > 0).over(w)}))
        levels.insert(0, now)
    everything = levels[0].agg(F.sum("n")).first()[0] or 0
    least = max(1, least_count, least_share * everything)
    up_key = [None] + [F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("up_key") for d in range(1, DEPTH + 1)]
    # divergence tests, each against the parent's own distribution; suffixes of the retained are retained
    retained: dict[int, DataFrame] = {}
    for d in range(DEPTH, 0, -1):
        parent = levels[d - 1].where("n > 0").select(F.col("key").alias("up_key"), (F.col("n") / F.col("total")).alias("up"))
        gain = F.sum(F.col("n") * F.ln(F.col("n") / F.col("total") / F.col("up")))
        keep = (levels[d].where((F.col("n") > 0) & (F.col("total") >= least)).select("*", up_key[d]).join(parent, "up_key")
                .groupBy("context").agg(gain.alias("gain"), F.max("seen").alias("seen")).where("gain > seen").select("context"))
        if d < DEPTH:
            suffix = F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context")
            keep = keep.union(retained[d + 1].select(suffix)).distinct()
        retained[d] = cut_lineage(keep.withColumn("kept", F.lit(True)))
    p = levels[0].select("key", "n", ((F.col("n") + 0.1) / F.lit(everything + 25.6)).alias("p"))
    for d in range(1, DEPTH + 1):
        total = F.greatest("total", F.lit(1))
        own = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("seen") * F.col("up")) / total
        p = (levels[d].join(retained[d], "context", "left").select("*", up_key[d])
             .join(p.select(F.col("key").alias("up_key"), F.col("p").alias("up")), "up_key")
             .select("key", "n", F.when(F.col("kept"), own).otherwise(F.col("up")).alias("p")))
    return cut_lineage(p.select("key", "n", F.log10("p").alias("log")))


def _frequent(table: DataFrame, room: int) -> Column:
    """Whether ``n`` reaches the least count that leaves at most ``room`` rows, by eighths of powers of two."""
    step, least = F.floor(F.log2("n") * 8).cast("int"), None
    for s, v in sorted(map(tuple, table.where("n > 0").groupBy(step.alias("s")).count().collect()), reverse=True):
        if v > room:
            break
        room, least = room - v, s
    return (F.col("n") > 0) & F.coalesce(step >= least, F.lit(False)) if least is not None else F.lit(False)


def _sent(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = table.select("key", "log").toArrow()
    keys, log = t["key"].to_numpy().view(np.uint64), t["log"].to_numpy()
    order = np.argsort(keys)
    return keys[order], log[order]


def _looked_up(keys: np.ndarray, logs: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked keys are there, and their values (0 for others)."""
    known, log = np.zeros(len(asked), bool), np.zeros(len(asked))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        known = keys[at] == asked
        log[known] = logs[at[known]]
    return known, log


SCORED = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("kind", pa.int32()), ("token", pa.int64()), ("tf", pa.int32()),
                    ("docs", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("part", pa.float64()),
                    ("score", pa.float64())])


def _scored(sent):
    """A row for each document with what the sent tables tell, and a row for each other word (kind 0) and run (1) of it."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, frequent_runs = sent.value

        def out(docs: list, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            joined = [symbols(ws) for ws in texts]
            length = np.array([len(t) - DEPTH for t in joined])
            g = grams(b"".join(joined))
            own = _owned(joined)
            g = g[own]
            u, inverse = np.unique(g, return_inverse=True)
            del g, own
            known, log = _looked_up(*frequent_runs, u)
            score = np.add.reduceat(log[inverse], np.concatenate([[0], np.cumsum(length)[:-1]]))
            other = np.flatnonzero(~known[inverse])
            rare = [(1, u, np.repeat(np.arange(len(texts)), length)[other], inverse[other])]
            del u, inverse, other
            n = np.array([len(ws) + 1 for ws in texts], np.int64)
            token, inverse = np.unique(np.concatenate([np.append(word_hashes(ws), END_HASH) for ws in texts]),
                                       return_inverse=True)
            owner = np.repeat(np.arange(len(texts)), n)
            known, log = _looked_up(*frequent_words, token)
            doc = np.array([-1 if d is None else d for d in docs], np.int64)
            none = np.array([d is None for d in docs])
            digest = np.array([xxhash.xxh3_64_intdigest(t) for t in joined], np.uint64).view(np.int64)
            zero = np.zeros(len(texts))
            yield from_numpy(SCORED, pa.array(doc, mask=none), digest, zero.astype(np.int32), digest,
                             zero.astype(np.int32), np.ones(len(texts), np.int32), n, np.bincount(owner, known[inverse], len(texts)).astype(np.int64),
                             np.bincount(owner, log[inverse], len(texts)), score)
            other = np.flatnonzero(~known[inverse])
            rare.append((0, token, owner[other], inverse[other]))
            for kind, keys, owner, which in rare:
                pair, tf = np.unique(owner.astype(np.int64) << 32 | which, return_counts=True)
                owner, token = pair >> 32, signed(keys[pair & 0xFFFFFFFF])
                for a in range(0, len(pair), 50_000):
                    o = owner[a:a + 50_000]
                    z = np.zeros(len(o), np.int64)
                    yield from_numpy(SCORED, pa.array(doc[o], mask=none[o]), digest[o], np.full(len(o), kind, np.int32),
                                     token[a:a + 50_000], tf[a:a + 50_000].astype(np.int32), z.astype(np.int32), z, z,
                                     z.astype(float), z.astype(float))

        docs, texts, size = [], [], 0
        for batch in batches_of(rows):
            for doc, text in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text"))):
                docs.append(doc)
                texts.append(words(text))
                size += len(text or b"") + DEPTH + 1
                if size >= CHUNK:
                    yield from out(docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield from out(docs, texts)

    return run


def score_with_suffix_tree(docs: DataFrame, least_share: float = 0.0, id_col: str = "doc_id",
                           text_col: str = "text", least_count: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    Learns from every document whose crc32(id) modulo 10 is not 0 and scores all. Contexts seen less than
    ``least_count`` times are not tested; ``least_share`` asks for a share of all symbols too (none unless given). ``score`` is the tree's
    log10 probability of the whole text, ``base_score`` the word model's. A null text counts as empty: its one
    token is the end. Rows without id are training documents. Repeated rows count each time and get equal
    scores. Without training documents every symbol and word has the smoothed share of an empty count. An
    empty table gives an empty result; other columns are not looked at.
    """
    two = two_columns(docs, id_col, text_col)
    counts = cut_lineage(two.select("text", (~held_out("doc_id", 10, 0)).alias("train"))
                         .mapInArrow(_counted, "kind int, key long, n long")
                         .groupBy("kind", "key").agg(F.sum("n").alias("n")))
    vocabulary = counts.where("kind = 0").select("key", "n", F.log10(F.col("n") + 0.1).alias("log"))
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    runs = _model(counts.where("kind = 1").select("key", "n"), least_count, least_share)
    often = {0: _frequent(vocabulary, FREQUENT), 1: _frequent(runs, 4 * FREQUENT)}
    sent = docs.sparkSession.sparkContext.broadcast((_sent(vocabulary.where(often[0])), _sent(runs.where(often[1]))))
    rows = two.mapInArrow(_scored(sent), "doc_id long, digest long, kind int, token long, tf int, docs int, n_tokens long, "
                                         "n_known long, part double, score double")
    rest = lambda table, kind: table.where(~often[kind]).select(F.lit(kind).alias("kind"), F.col("key").alias("token"), "log")
    each = float(np.log10(size.n + 0.1 * (size.v + 1)))
    word = F.col("kind") == 0
    return (rows.join(rest(vocabulary, 0).union(rest(runs, 1)), ["kind", "token"], "left").groupBy("doc_id", "digest").agg(
                F.sum("docs").alias("m"), F.sum("n_tokens").alias("n_tokens"),
                F.sum(F.col("n_known") + F.when(word & F.col("log").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
                F.sum(F.col("part") + F.when(word, F.col("tf") * F.coalesce("log", F.lit(-1.0))).otherwise(0.0)).alias("part"),
                F.sum(F.col("score") + F.when(~word, F.col("tf") * F.col("log")).otherwise(0.0)).alias("score"))
            .withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
            .select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), (F.col("n_tokens") / F.col("m")).cast("long").alias("n_tokens"),
                    (F.col("n_known") / F.col("m")).cast("long").alias("n_known"), F.lit(size.n).cast("long").alias("train_tokens"),
                    ((F.col("part") - F.col("n_tokens") * F.lit(each)) / F.col("m")).alias("base_score"),
                    (F.col("score") / F.col("m")).alias("score")))

"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the components of those links.

Method: rare-first prefix filtering with length, positional and suffix filters; every surviving pair of
different sets is verified once.

1. *Profile*: one pass gives each document's set size and a 128-bit digest of its set (equal sets are one
   node from here on).
2. *Postings*: chunks of sets send their n-grams, packed, to shards of the hash space; a shard counts in how many sets
   each is and answers every chunk with those that are in several. Ordering n-grams by (count, hash) is one
   global order, rare first, so prefix filtering is exact, and as counts are those of the n-grams themselves a set meets
   others only through n-grams that it shares, however large the corpus is. Of each set's rarest ``n - ceil(t n) + 1``
   n-grams those that are in several sets become rows, with the set's size and what is left of the set from that position
   on. Sets of one size that share an n-gram and could be alike are reduced to one before the shuffle, so a group of copies
   that fills a third of the table reaches the reducers as a few rows.
3. *Candidates*: per n-gram, ordered by set size, the length and positional filters are applied in a stream
   with one kept row per set size; only a spanning forest of the candidate pairs is written, never the pairs.
4. *Verification*: the trees of that forest are candidate groups. A group is dealt into blocks of bounded
   size and every pair of blocks is one task's group. There sets meet through an index of their prefix n-grams;
   a pair passes the length, positional and suffix filters (bucket counts bound the Hamming distance from below)
   and is then intersected, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import batches_of, binaries, from_numpy, pair_components, shingle_set, two_columns
from seqforge.session import cut_lineage

KEY_BITS = 40              # of an n-gram's hash that are sent and ordered by; n-grams that agree in them count as one
SHARD = 1 << 21            # n-grams of a chunk of sets, and those that a shard counts, about
MOST = 255                 # counts are held up to this number
BLOCK = 1_000_000          # n-grams of one verification block
PIVOTS = 16                # buckets of the suffix filter


def needed(total, num: int, den: int):
    """Least intersection of two sets with sizes adding to ``total``: ceil(t / (1 + t) * total)."""
    return -(-num * total // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _profile(ngram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            sets = [shingle_set(t, ngram) for t in binaries(batch.column("text"))]
            h = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield from_numpy(schema, batch.column("doc_id"), np.array([len(s) for s in sets], np.int64),
                             h[:, 0].copy(), h[:, 1].copy())

    return run, "doc_id long, n long, h1 long, h2 long"


def packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers below 256^width, compressed byte by byte: the first byte of all, the second of all and so on."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


#: A chunk's n-grams of one shard in ascending order with the number of the set that has each; one row of a chunk has its sets instead.
PART = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("sets", pa.binary())])
#: The same after counting: n-grams that are in several sets, and in how many.
SHARED = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()), ("sets", pa.binary())])


def _parts(ngram: int, shards: int):
    """Chunks of about ``SHARD`` n-grams of different sets, cut at the bounds of the shards."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def out() -> pa.RecordBatch:
            n = np.array([len(s) for s in held.values()], np.int64)
            key = np.concatenate(list(held.values())) >> np.uint64(64 - KEY_BITS)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], np.repeat(np.arange(len(n)), n)[order]
            shard = (key * np.uint64(shards) >> np.uint64(KEY_BITS)).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(key)]
            cuts = [slice(a, b) for a, b in zip(edges, edges[1:])]
            sets = np.stack([np.array([node for node, _ in held], np.int64), n]).tobytes()
            return from_numpy(PART, [((chunk >> 32) + chunk) % shards, *[int(shard[c.start]) for c in cuts]], [chunk] * (len(cuts) + 1),
                              [None, *[packed(_steps(key[c]), KEY_BITS // 8) for c in cuts]],
                              [None, *[packed(owner[c], 4) for c in cuts]], [sets, *[None] * len(cuts)])

        for batch in batches_of(rows):
            for text in binaries(batch.column("text")):
                s = shingle_set(text, ngram)
                if not len(s) or (name := digest(s)) in held:
                    continue
                held[name], size = s, size + len(s)
                if size >= SHARD:
                    yield out()
                    chunk, held, size = chunk + 1, {}, 0
        if held:
            yield out()

    return run


def _counted(shard: pa.Table) -> pa.Table:
    """Answers each chunk with its n-grams that are in several sets."""
    parts, out = shard.filter(shard.column("sets").is_null()), shard.filter(shard.column("sets").is_valid())
    out = [(chunk, None, None, None, sets) for chunk, sets in zip(out.column("chunk").to_pylist(), out.column("sets").to_pylist())]
    if parts.num_rows:
        keys = [np.cumsum(unpacked(k, KEY_BITS // 8)) for k in parts.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        _, where, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        count = np.split(np.minimum(count, MOST)[where], ends[:-1])
        for chunk, key, owners, c in zip(parts.column("chunk").to_pylist(), keys, parts.column("owners").to_pylist(), count):
            several = c > 1
            if several.any():
                out.append((chunk, packed(_steps(key[several]), KEY_BITS // 8), packed(unpacked(owners, 4)[several], 4),
                            packed(c[several], 1), None))
    return pa.Table.from_batches([from_numpy(SHARED, *map(list, zip(*out)))] if out else [], SHARED)


def _prefixes(num: int, den: int):
    """Postings of a chunk: n-grams that no other set has come first in every set's order and need no row."""
    def run(group: pa.Table) -> pa.Table:
        sets = [s for s in group.column("sets").to_pylist() if s is not None]
        parts = [p for p in zip(*(group.column(c).to_pylist() for c in ("keys", "owners", "counts"))) if p[0] is not None]
        if not parts:
            return pa.Table.from_batches([], POSTING)
        node, n = np.frombuffer(sets[0], np.int64).reshape(2, -1)
        key = np.concatenate([np.cumsum(unpacked(k, KEY_BITS // 8)) for k, _, _ in parts]).astype(np.int64)
        owner = np.concatenate([unpacked(o, 4) for _, o, _ in parts]).astype(np.int64)
        order = np.lexsort((key, np.concatenate([unpacked(c, 1) for _, _, c in parts]), owner))
        key, owner = key[order], owner[order]
        many = np.bincount(owner, minlength=len(n))
        at = np.arange(len(key)) - (np.cumsum(many) - many)[owner] + (n - many)[owner]
        rare = at < prefix_length(n, num, den)[owner]
        owner = owner[rare]
        return pa.Table.from_batches(_reduced(key[rare], n[owner].astype(np.int32), (n[owner] - at[rare]).astype(np.int32), node[owner], num, den), POSTING)

    return run


POSTING = pa.schema([("gram", pa.int64()), ("n", pa.int32()), ("rest", pa.int32()), ("node", pa.int64()),
                     ("peer", pa.int64())])


def _reduced(gram, n, rest, node, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Postings with one row kept for all sets of one size that share an n-gram and can be alike.

    The kept row has the largest rest, so whatever any of the others may be alike to, it may too. The others
    become an edge to it (``peer``).
    """
    order = np.lexsort((node, -rest, n, gram))
    gram, n, rest, node = gram[order], n[order], rest[order], node[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (n[1:] != n[:-1])
    lead = node[np.maximum.accumulate(np.where(first, np.arange(len(gram)), 0))]
    merged = ~first & ((rest >= needed(2 * n.astype(np.int64), num, den)) | (node == lead))
    keep = ~merged
    yield from_numpy(POSTING, gram[keep], n[keep], rest[keep], node[keep], pa.nulls(int(keep.sum()), pa.int64()))
    edges = np.unique(np.stack([node[merged], lead[merged]], 1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    zero = np.zeros(len(edges), np.int32)
    yield from_numpy(POSTING, edges[:, 0], zero, zero, edges[:, 0], edges[:, 1].copy())


def _forest(num: int, den: int):
    """Candidate edges from postings in the order (gram, n, rest descending).

    A set can only be alike to an earlier one (no larger) when both rests reach the needed intersection. Of
    each size one row with the largest rest stays in memory, for as long as its size is within the length
    filter, so the state is bounded by the number of different set sizes.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept, out = None, [], set()

        def link(n: int, rest: int, node: int) -> None:
            nonlocal kept
            kept = [k for k in kept if k[0] * den >= num * n]
            for m, left, other in kept:
                if min(rest, left) >= needed(n + m, num, den) and other != node:
                    out.add((node, other))
            if rest >= needed(2 * n, num, den) and not (kept and kept[-1][0] == n):
                kept.append((n, rest, node))

        for batch in rows:
            gram, n, rest, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            edge = batch.column("peer").is_valid().to_numpy(zero_copy_only=False)
            out.update(zip(node[edge].tolist(), batch.column("peer").drop_null().to_pylist()))
            gram, n, rest, node = gram[~edge], n[~edge], rest[~edge], node[~edge]
            if len(gram):
                same = gram[1:] == gram[:-1]
                # alone in the batch; the batch's first and last may go on in its neighbours
                some = np.concatenate([[True], same]) | np.concatenate([same, [True]])
                for g, m, r, v in zip(gram[some].tolist(), n[some].tolist(), rest[some].tolist(), node[some].tolist()):
                    if g != last:
                        last, kept = g, []
                    link(m, r, v)
            if len(out) > 50_000:
                yield from_numpy(schema, *map(list, zip(*out)))
                out = set()
        if out:
            yield from_numpy(schema, *map(list, zip(*out)))

    return run


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each position in ``left``, the positions in ``right`` whose sets are alike; each pair is looked at once.

    When ``left`` is ``right`` only later positions are compared. Pairs meet through an index of the prefix n-grams,
    rare first among the sets at hand, and must pass the length, positional and suffix filters; only what is left is
    intersected, so work grows with shared prefix n-grams and filtered pairs, not with all pairs.
    """
    size = np.array([len(s) for s in sets], np.int64)
    pivots = np.linspace(0, 2.0**64, PIVOTS + 1)[1:-1].astype(np.uint64)
    sig = np.array([np.diff(np.concatenate([[0], np.searchsorted(s, pivots), [len(s)]])) for s in sets], np.int32)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    rank = [np.sort(r) for r in np.split(place[at], np.cumsum(size)[:-1])]
    prefix = [r[:prefix_length(len(r), num, den)] for r in rank]
    # postings of the right side: n-gram, owner, position
    gram = np.concatenate([prefix[j] for j in right])
    owner = np.repeat(np.arange(len(right)), [len(prefix[j]) for j in right])
    place_in = np.concatenate([np.arange(len(prefix[j])) for j in right])
    order = np.argsort(gram, kind="stable")
    gram, owner, place_in = gram[order], owner[order], place_in[order]
    flat, starts = np.concatenate([rank[j] for j in right]), np.concatenate([[0], np.cumsum(size[right])[:-1]])
    flag = np.zeros(len(count), bool)
    last_here, last_there = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
    for k, i in enumerate(left):
        lo, hi = np.searchsorted(gram, prefix[i], "left"), np.searchsorted(gram, prefix[i], "right")
        many = hi - lo
        hit = np.repeat(hi - np.cumsum(many), many) + np.arange(many.sum())
        who = owner[hit]
        shared = np.bincount(who, minlength=len(right))
        if left is right:
            shared[:k + 1] = 0
        met = np.flatnonzero(shared)
        if not len(met):
            continue
        # ascending n-grams: the last shared one of each pair is what stays
        last_here[who], last_there[who] = np.repeat(np.arange(len(many)), many), place_in[hit]
        other = right[met]
        n = size[other]
        need = needed(n + size[i], num, den)
        can = np.minimum(n, size[i]) * den >= num * np.maximum(n, size[i])
        can &= shared[met] + np.minimum(size[i] - last_here[met], n - last_there[met]) - 1 >= need
        met, other, n, need = met[can], other[can], n[can], need[can]
        can = (n + size[i] - np.abs(sig[other] - sig[i]).sum(1)) // 2 >= need
        met, other, need = met[can], other[can], need[can]
        if not len(met):
            continue
        flag[rank[i]] = True
        if 4 * size[other].sum() > len(flat):
            common = np.add.reduceat(flag[flat], starts, dtype=np.int64)[met]
        else:
            common = np.array([np.count_nonzero(flag[rank[j]]) for j in other])
        flag[rank[i]] = False
        yield i, other[common >= need]


def _verified(ngram: int, num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "h1", "h2"])
        sets = [shingle_set(t.encode(), ngram) for t in pdf["text"].fillna("")]
        # rows that share an id with another text are not the one meant
        meant = [digest(s) == (x, y) for s, x, y in zip(sets, pdf["h1"], pdf["h2"])]
        pdf, sets = pdf[meant], [s for s, m in zip(sets, meant) if m]
        if not sets:
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        rep, copies, chunk = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["chunk"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        parent, links = list(range(len(sets))), np.zeros(len(sets), np.int64)

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(left) and len(right):
            for a, found in alike(sets, left, right, num, den):
                links[a] += copies[found].sum()
                links[found] += copies[a]
                for b in found:
                    x, y = top(a), top(b)
                    if x != y:
                        x, y = (x, y) if rep[x] < rep[y] else (y, x)
                        parent[y] = x
        return pd.DataFrame({"a": rep, "b": rep[[top(x) for x in range(len(sets))]], "links": links})

    return run


def ngram_jaccard_join(docs: DataFrame, threshold: tuple[int, int] = (75, 100), ngram: int = 5,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of ``docs``.

    Two documents link when ``den * |A & B| >= num * |A | B|`` for ``threshold = (num, den)``; ``n_links``
    counts the documents that a document links with, copies of itself included. ``component_id`` is the
    smallest identifier reachable by links, itself included.

    Null, empty and wordless texts have 0 shingles, no links and their own id as component. Fewer words than
    ``ngram`` make one shingle of the whole sequence. Rows without identifier keep their row, with null
    component and links, and link nothing. Repeated rows are documents of their own that share an id. An
    empty table gives an empty result; other columns are not looked at.
    """
    num, den = threshold
    spark = docs.sparkSession
    two = two_columns(docs, id_col, text_col)
    run, schema = _profile(ngram)
    nodes = cut_lineage(two.mapInArrow(run, schema))
    shards = max(1, -(-(nodes.agg(F.sum("n")).first()[0] or 0) // SHARD))
    postings = (two.where("doc_id is not null")
                .mapInArrow(_parts(ngram, shards), "shard long, chunk long, keys binary, owners binary, sets binary")
                .groupBy("shard").applyInArrow(_counted, "chunk long, keys binary, owners binary, counts binary, sets binary")
                .groupBy("chunk").applyInArrow(_prefixes(num, den), "gram long, n int, rest int, node long, peer long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = (postings.repartition(parts, "gram").sortWithinPartitions("gram", "n", F.desc("rest"))
                  .mapInArrow(_forest(num, den), "a long, b long").distinct())
    groups = pair_components(spark, candidates)
    groups = groups.union(groups.select(F.col("root").alias("node"), "root")).distinct()
    # one row for each different set of a candidate group, under its smallest document
    members = cut_lineage(nodes.where("n > 0 and doc_id is not null").join(groups, nodes.h1 == groups.node)
                          .groupBy("root", "h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    blocks = (members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m"))
              .where("m > 1").drop("m"))
    dealt = (members.join(blocks, "root")
             .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", "rep", "h1", "h2", "copies", "chunk", F.least("chunk", "with").alias("i"),
                     F.greatest("chunk", "with").alias("j")))
    met = (dealt.join(two, dealt.rep == two.doc_id).drop("doc_id")
           .groupBy("root", "i", "j").applyInPandas(_verified(ngram, num, den), "a long, b long, links long"))
    met = cut_lineage(met)
    roots = pair_components(spark, met.select("a", "b"))
    links = met.groupBy("a").agg(F.sum("links").alias("links"))
    found = (members.select("h1", "h2", F.col("n").alias("size"), "rep")
             .join(links, F.col("rep") == links.a, "left").join(roots, F.col("rep") == roots.node, "left")
             .select("h1", "h2", "size", F.coalesce("root", "rep").alias("component"), "links"))
    # equal sets outside every candidate group link with each other alone
    own = nodes.where("n > 0 and doc_id is not null").groupBy("h1", "h2", F.col("n").alias("size")).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # written, so that the last join deals both sides anew and a large group of copies can be split there
    whole = cut_lineage(own.join(found, ["h1", "h2", "size"], "left")
                        .select("h1", "h2", "size", F.coalesce("component", "rep").alias("component"),
                                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    key = [nodes.h1 == whole.h1, nodes.h2 == whole.h2, nodes.n == whole["size"], nodes.doc_id.isNotNull()]
    return (nodes.join(whole, key, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).alias("n_links")))

"""n-gram counts of token arrays inside tasks: Spark partitions and sorts the rows, Arrow and numpy count them.

Rows that belong together lie next to each other in a partition. A step looks at whole groups of about ``CHUNK``
tokens at a time, so a task holds a bounded number of tokens unless one group alone is larger. n-grams are numbered
exactly (an n-gram is the number of its first n - 1 tokens and its last token), no hash stands for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20           # tokens looked at at a time
PART = 1 << 18            # n-grams of a group that are counted at a time, about
ROWS = 1 << 16            # n-grams written at a time


def lengths(lists: pa.Array) -> np.ndarray:
    """Tokens of every row; a null array counts as empty."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _row_size(rows: pa.Table, lists: list[str]) -> np.ndarray:
    return sum(lengths(rows[c].combine_chunks()) for c in lists) if rows.num_rows else np.zeros(0, np.int64)


def _pieces(batch: pa.RecordBatch, lists: list[str]) -> Iterator[pa.Table]:
    """The rows of a batch in pieces of about ``CHUNK`` tokens."""
    rows = pa.Table.from_batches([batch])
    at = np.cumsum(_row_size(rows, lists)) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1), rows.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield rows.slice(a, b - a)


def _coded(rows: pa.Table, lists: list[str]) -> pa.Table:
    for c in lists:
        t = rows[c].combine_chunks()
        ends = np.cumsum(lengths(t))
        flat = pa.concat_arrays([t.flatten().cast(pa.string())]).dictionary_encode()
        rows = rows.set_column(rows.schema.get_field_index(c), c, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), flat))
    return rows


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], lists: list[str], coded: bool = False) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group of every row) of consecutive whole groups: rows with equal ``keys``, which must be neighbours. ``coded``: tokens
    are held as numbers of a dictionary."""
    held, size, full = [], 0, CHUNK

    def cut(rows):
        key = list(zip(*[rows[k].to_pylist() for k in keys]))
        new = np.fromiter((k > 0 and key[k] != key[k - 1] for k in range(len(key))), bool, len(key))
        return np.cumsum(new)

    for batch in batches:
        for part in _pieces(batch, lists):
            held.append(_coded(part, lists) if coded else part)
            size += int(_row_size(part, lists).sum()) + part.num_rows
            if size < full:
                continue
            every = pa.concat_tables(held).combine_chunks()
            held, group = [], cut(every)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield every.slice(0, last).combine_chunks(), group[:last]
                every = every.slice(last).combine_chunks()
                every = _coded(every, lists) if coded else every        # without the words of earlier groups
                size, full = int(_row_size(every, lists).sum()) + every.num_rows, CHUNK
            full = max(full, 2 * size)
            held = [every]
    if held:
        every = pa.concat_tables(held).combine_chunks()
        held = part = batch = None
        yield every, cut(every)


def codes(*lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The tokens of all rows as numbers, one array after the other, and the tokens by number."""
    d = pa.concat_arrays([c.flatten().cast(pa.string()) for c in lists]).dictionary_encode()
    return d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def held_codes(t: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """:func:`codes` of rows that are held ``coded``, in 32 bits."""
    d = t.flatten()
    return d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False), d.dictionary


def ngrams(token: np.ndarray, size: np.ndarray, group: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(n, start, number, how many numbers): where the n-grams of every order start and which of the distinct n-grams of their
    group each is. ``size`` and ``group`` tell the tokens and the group of every row."""
    left = np.repeat(np.cumsum(size), size) - np.arange(len(token))       # tokens from here to the end of the row
    first, distinct = pd.factorize(np.repeat(group, size) * (int(token.max(initial=0)) + 1) + token)
    first = first.astype(np.int64)
    start, number, many = np.arange(len(token)), first, len(distinct)
    base = many + 1
    yield 1, start, number, many
    for n in range(2, max_n + 1):
        go = left[start] >= n
        start = start[go]
        number, distinct = pd.factorize(number[go] * base + first[start + n - 1])
        number, many = number.astype(np.int64), len(distinct)
        yield n, start, number, many


def _classes(pair: np.ndarray, many: int) -> np.ndarray:
    """Which of ``many`` parts each number belongs to."""
    h = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(many)).astype(np.uint16)


def ngram_parts(token: np.ndarray, size: np.ndarray, group: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """:func:`ngrams` for groups of any size: an order comes in several parts of about ``PART`` n-grams. Equal n-grams of a group are
    in one part, where ``number`` counts from 0; between parts only a few 32-bit numbers a token are held."""
    many, base = min(-(-max(len(token), 1) // PART), 1 << 15), int(token.max(initial=0)) + 1
    ends, before = np.cumsum(size), np.repeat(group.astype(np.int32), size)      # the group, later the first n - 1 tokens
    for n in range(1, max_n + 1):
        after, cls, numbers = np.empty(len(token), np.int32), np.full(len(token), many, np.uint16), 0
        for a in range(0, len(token) - n + 1, PART):
            start = np.arange(a, min(a + PART, len(token) - n + 1))
            pair = before[start].astype(np.int64) * base + token[start + n - 1]
            cls[start] = np.where(ends[row_of(ends, start)] - start >= n, _classes(pair, many), many)
        for k in range(many):
            start = np.flatnonzero(cls == k)
            number, distinct = pd.factorize(before[start].astype(np.int64) * base + token[start + n - 1])
            after[start] = number + numbers
            numbers += len(distinct)
            yield n, start, number.astype(np.int64, copy=False), len(distinct)
        before = after


def row_of(ends: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The rows that tokens are in; ``ends`` tells where rows end."""
    return np.searchsorted(ends, token, side="right")


def clipped_matches(hyp: pa.Array, ref: pa.Array, group: np.ndarray, groups: int, max_n: int) -> list[np.ndarray]:
    """For every order and group: the size of the bag intersection of the n-grams of its ``hyp`` and ``ref`` rows."""
    token, _ = codes(hyp, ref)
    h, r = lengths(hyp), lengths(ref)
    edge, of_row = int(h.sum()), np.concatenate([group, group])
    of_token = np.repeat(of_row, np.concatenate([h, r]))
    out = []
    for _, start, number, many in ngrams(token, np.concatenate([h, r]), of_row, max_n):
        mine = start < edge
        least = np.minimum(np.bincount(number[mine], minlength=many), np.bincount(number[~mine], minlength=many))
        owner = np.zeros(many, np.int64)
        owner[number] = of_token[start]
        out.append(np.bincount(owner, least, groups).astype(np.int64))
    return out


def _per_group(rows: pa.Table, group: np.ndarray, keys: list[str], schema: pa.Schema, values: list) -> pa.RecordBatch:
    """The keys of every group, then ``values``."""
    first = pa.array(np.searchsorted(group, np.arange(group[-1] + 1)))
    kept = [rows[k].combine_chunks().take(first).cast(schema.field(k).type) for k in keys]
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(v, schema.field(len(keys) + k).type) for k, v in enumerate(values)]],
                                      schema=schema)


def match_step(keys: list[str], hyp: str, ref: str, max_n: int):
    """For ``mapInArrow``: rows sorted by ``keys`` -> keys, m1..m{max_n} of every group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, keys, [hyp, ref]):
            m = clipped_matches(rows[hyp].combine_chunks(), rows[ref].combine_chunks(), group, int(group[-1]) + 1, max_n)
            schema = pa.schema([*[rows.schema.field(k) for k in keys], *[(f"m{n}", pa.int64()) for n in range(1, max_n + 1)]])
            yield _per_group(rows, group, keys, schema, m)
    return run


def _starts(*columns: list) -> np.ndarray:
    """Whether a row differs from the one before it."""
    rows = list(zip(*columns))
    return np.fromiter((k > 0 and rows[k] != rows[k - 1] for k in range(len(rows))), bool, len(rows))


def shared_step(schema: pa.Schema, max_n: int):
    """For ``mapInArrow``: rows (ref_id, salt, kind, seg, t) sorted by ref_id, salt, kind, where kind 0 is the reference of a salt and 1 a
    hypothesis -> seg, c, r, m1..m{max_n} of every hypothesis that has a reference.

    Rows are looked at in pieces of about ``CHUNK`` tokens, however many hypotheses share a reference; from piece to piece only the
    last reference is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in (part for batch in batches for part in _pieces(batch, ["t"])):
            if held is not None and rows["kind"][0].as_py():
                rows = pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            group = np.cumsum(_starts(rows["ref_id"].to_pylist(), rows["salt"].to_pylist()))
            first, is_hyp = np.searchsorted(group, np.arange(group[-1] + 1)), rows["kind"].to_numpy().astype(bool)
            t, many = rows["t"].combine_chunks(), rows.num_rows
            token, _ = codes(t)
            size, m = lengths(t), []
            row_of = np.repeat(np.arange(many), size)
            for _, start, gram, distinct in ngrams(token, size, group, max_n):
                mine = is_hyp[row_of[start]]
                r = np.bincount(gram[~mine], minlength=distinct)
                asked = mine & (r[gram] > 0)
                pair, found = pd.factorize(gram[asked] * many + row_of[start[asked]])
                m.append(np.bincount(found % many, np.minimum(np.bincount(pair, minlength=len(found)), r[found // many]), many))
            out = np.flatnonzero(is_hyp & ~is_hyp[first[group]])
            values = [size[out], size[first[group[out]]], *[v[out] for v in m]]
            seg = rows["seg"].combine_chunks().take(pa.array(out)).cast(schema.field("seg").type)
            yield pa.RecordBatch.from_arrays([seg, *[pa.array(v.astype(np.int64), pa.int64()) for v in values]], schema=schema)
            refs = np.flatnonzero(~is_hyp)
            held = rows.take(pa.array(refs[-1:])) if len(refs) else held
    return run


def _nearest(hyp_len: int | None, refs: list[tuple], shorter: bool):
    """(distance, reference number, length) of the closest reference; unknown distances come first, ties go to the first
    reference or, if asked, the shorter one."""
    def rank(at: int):
        n = refs[at][1]
        away = -1 if n is None or hyp_len is None else abs(n - hyp_len)
        return (away, -1 if n is None else n, at) if shorter else (away, at)
    at = min(range(len(refs)), key=rank)
    no, n = refs[at]
    return None if n is None or hyp_len is None else abs(n - hyp_len), no, n


def reference_step(schema: pa.Schema, shorter: bool, max_n: int):
    """For ``mapInArrow``: rows (seg, salt, salts, kind, ref_no, t, len) sorted by seg, salt, kind, ref_no, where kind 0 is the
    hypothesis and 1 a reference.

    Gives for each hypothesis length of a salt one row of n = 0: how many lengths of references, their sum, the shortest, the closest;
    and m1..m{max_n}, the sums of hypothesis counts clipped by the largest count in one reference. Where a segment has several
    salts the clipped counts of its n-grams come as rows of their own, told apart by where the hypothesis has them first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, ["seg", "salt"], ["t"]):
            kind, groups = rows["kind"].to_numpy().astype(bool), int(group[-1]) + 1
            t, number, many = rows["t"].combine_chunks(), rows["ref_no"].to_pylist(), rows["salts"].to_numpy()
            both = (np.bincount(group, ~kind, groups) > 0) & (np.bincount(group, kind, groups) > 0)
            first = np.searchsorted(group, np.arange(groups))
            split = many[first] > 1
            unit = np.cumsum(_starts(group.tolist(), kind.tolist(), number))       # duplicates of a reference count together
            size = lengths(t)
            at = (np.cumsum(size) - size)[first]
            token, _ = codes(t)
            of_token, unit_of, is_ref = np.repeat(group, size), np.repeat(unit, size), np.repeat(kind, size)
            units, m, parts = int(unit[-1]) + 1, [], []
            for n, start, gram, distinct in ngrams(token, size, group, max_n):
                mine = ~is_ref[start]
                h = np.bincount(gram[mine], minlength=distinct)
                asked = ~mine & (h[gram] > 0)
                pair, found = pd.factorize(gram[asked] * units + unit_of[start[asked]])
                best = np.zeros(distinct, np.int64)
                np.maximum.at(best, found // units, np.bincount(pair, minlength=len(found)))
                best = np.minimum(best, h)
                where = np.zeros(distinct, np.int64)
                where[gram[::-1]] = start[::-1]
                owner = of_token[where] if len(token) else where
                m.append(np.bincount(owner, best * ~split[owner], groups).astype(np.int64))
                out = np.flatnonzero(split[owner] & (best > 0))
                parts.append((owner[out], np.full(len(out), n), where[out] - at[owner[out]], best[out]))
            length, rest = rows["len"].to_pylist(), []
            end = np.append(first[1:], len(group))
            for g in np.flatnonzero(both):
                hyps, refs = [], []
                for k in range(first[g], end[g]):
                    if kind[k]:
                        refs.append((number[k], length[k]))
                    else:
                        hyps.append(length[k])
                known = [n for _, n in refs if n is not None]
                for c in dict.fromkeys(hyps):
                    rest.append((g, c, *[int(v[g]) for v in m], len(known), sum(known), min(known, default=None), *_nearest(c, refs, shorter)))
            owner, order, place, clipped = [np.concatenate(v) for v in zip(*parts)]
            ok = both[owner]
            owner, order, place, clipped = owner[ok], order[ok], place[ok], clipped[ok]
            few, blank = len(rest), [None] * len(owner)
            narrow = list(zip(*rest)) if rest else [()] * (max_n + 8)
            key = pa.array(np.append(np.array(narrow[0], np.int64), owner))
            yield pa.RecordBatch.from_arrays([
                rows["seg"].combine_chunks().take(pa.array(first)).take(key).cast(schema.field("seg").type),
                pa.array(np.append(np.zeros(few, np.int64), order), pa.int64()),
                pa.array(np.append(np.zeros(few, np.int64), place), pa.int64()),
                pa.array(np.append(np.zeros(few, np.int64), clipped), pa.int64()),
                *[pa.array([*v, *blank], schema.field(4 + k).type) for k, v in enumerate(narrow[1:])]], schema=schema)
    return run


def count_step(schema: pa.Schema, keys: list[str], max_n: int):
    """For ``mapInArrow``: rows sorted by ``keys`` with tokens ``t`` -> keys, n, gram (tokens joined by ``\\u0001``), cnt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, keys, ["t"]):
            t = rows["t"].combine_chunks()
            token, word = codes(t)
            word, size = pa.concat_arrays([word, pa.nulls(1, word.type)]), lengths(t)
            row = np.repeat(np.arange(len(size)), size)
            for n, start, gram, distinct in ngrams(token, size, group, max_n):
                where = np.zeros(distinct, np.int64)
                where[gram] = start
                parts = [word.take(pa.array(token[where + k])) for k in range(n)]
                text = pc.binary_join_element_wise(*parts, "\u0001", null_handling="skip")
                of = pa.array(row[where])
                yield pa.RecordBatch.from_arrays(
                    [*[rows[k].combine_chunks().take(of).cast(schema.field(k).type) for k in keys],
                     pa.array(np.full(distinct, n), pa.int32()), text.cast(schema.field("gram").type),
                     pa.array(np.bincount(gram, minlength=distinct), pa.int64())], schema=schema)
    return run


def most_step(schema: pa.Schema, max_n: int):
    """For ``mapInArrow``: rows (seg, salt, salts, ref_no, t) sorted by seg, salt, ref_no -> for each salt one row of n = 0 with the
    number of distinct n-grams and the sums of their largest counts in one reference; where a segment has several salts
    its n-grams come as rows instead: their order, two hashes of their tokens and the largest count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, ["seg", "salt"], ["t"], coded=True):
            t, groups = rows["t"].combine_chunks(), int(group[-1]) + 1
            unit = np.cumsum(_starts(group.tolist(), rows["ref_no"].to_pylist()))
            first, size, units = np.searchsorted(group, np.arange(groups)), lengths(t), int(unit[-1]) + 1
            split = rows["salts"].to_numpy()[first] > 1
            seg = rows["seg"].combine_chunks().take(pa.array(first))
            token, word = held_codes(t)
            ends = np.cumsum(size)
            seeds = [np.array([xxhash.xxh3_64_intdigest(w or "", seed) for w in [*word.to_pylist(), None]], np.uint64) for seed in (0, 1)] if split.any() else []
            sums, many = np.zeros((max_n, groups), np.int64), np.zeros(groups, np.int64)

            def block(owner, n, *values) -> pa.RecordBatch:
                values = [*values, *[np.zeros(len(owner), np.int64)] * (max_n + 4 - len(values))]
                return pa.RecordBatch.from_arrays([seg.take(pa.array(owner)).cast(schema.field("seg").type), pa.array(np.full(len(owner), n), pa.int64()),
                                                   *[pa.array(v, pa.int64()) for v in values]], schema=schema)

            for n, start, gram, distinct in ngram_parts(token, size, group, max_n):
                pair, found = pd.factorize(gram * units + unit[row_of(ends, start)])
                best, where = np.zeros(distinct, np.int64), np.zeros(distinct, np.int64)
                np.maximum.at(best, found // units, np.bincount(pair, minlength=len(found)))
                where[gram] = start
                owner = group[row_of(ends, where)]
                sums[n - 1] += np.bincount(owner, best * ~split[owner], groups).astype(np.int64)
                many += np.bincount(owner, ~split[owner], groups).astype(np.int64)
                rest = np.flatnonzero(split[owner])
                for at in range(0, len(rest), ROWS):
                    some = rest[at:at + ROWS]
                    h = [np.full(len(some), n, np.uint64) for _ in seeds]
                    for k in range(n):
                        for v, s in zip(h, seeds):
                            v *= np.uint64(0x9E3779B97F4A7C15)
                            v ^= v >> np.uint64(29)
                            v += s[token[where[some] + k]]
                    yield block(owner[some], n, h[0].view(np.int64), h[1].view(np.int64), best[some])
            yield block(np.arange(groups), 0, *[np.zeros(groups, np.int64)] * 3, many, *sums)
    return run


def successor_step(keys: list[str]):
    """For ``mapInArrow``: rows sorted by ``keys`` with words ``t`` -> before, word, cnt of every different pair of neighbours in a group.
    ``before`` is null at the start and ``word`` at the end; a row without words is such a pair of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, keys, ["t"]):
            t = rows["t"].combine_chunks()
            size = lengths(t)
            token, word = codes(t)
            none, of = len(word), np.repeat(group, size)
            if len(size) > int(group[-1]) + 1:       # rows of a group run by position
                order = np.lexsort((np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size), of))
                token, of = token[order], of[order]
            edge = np.flatnonzero(np.diff(of)) + 1
            start, blank = np.append(0, edge)[:len(token)], np.full(int((size == 0).sum()), none)
            before = np.append(none, token[:-1])[:len(token)]
            before[start] = none
            end = token[np.append(edge, len(token)) - 1] if len(token) else token
            pair, found = pd.factorize(np.concatenate([before, end, blank]) * (none + 1)
                                       + np.concatenate([token, np.full(len(end), none), blank]))
            word = pa.concat_arrays([word, pa.nulls(1, word.type)])
            yield pa.RecordBatch.from_arrays([word.take(pa.array(found // (none + 1))), word.take(pa.array(found % (none + 1))),
                                              pa.array(np.bincount(pair, minlength=len(found)), pa.int64())], names=["before", "word", "cnt"])
    return run


def most_gram_step(schema: pa.Schema, max_n: int):
    """For ``mapInArrow``: rows (seg, salt, ref_no, t) sorted by seg, salt, ref_no -> seg, n, gram (tokens joined by ``\\u0001``) and its
    largest count in one reference of the salt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, ["seg", "salt"], ["t"], coded=True):
            t, unit = rows["t"].combine_chunks(), np.cumsum(_starts(group.tolist(), rows["ref_no"].to_pylist()))
            size, units, seg = lengths(t), int(unit[-1]) + 1, rows["seg"].combine_chunks()
            token, word = held_codes(t)
            ends, word = np.cumsum(size), pa.concat_arrays([word, pa.nulls(1, word.type)])
            for n, start, gram, distinct in ngram_parts(token, size, group, max_n):
                pair, found = pd.factorize(gram * units + unit[row_of(ends, start)])
                best, where = np.zeros(distinct, np.int64), np.zeros(distinct, np.int64)
                np.maximum.at(best, found // units, np.bincount(pair, minlength=len(found)))
                where[gram] = start
                for at in range(0, distinct, ROWS):
                    some = where[at:at + ROWS]
                    text = pc.binary_join_element_wise(*[word.take(pa.array(token[some + k])) for k in range(n)], "\u0001", null_handling="skip")
                    yield pa.RecordBatch.from_arrays([seg.take(pa.array(row_of(ends, some))).cast(schema.field("seg").type), pa.array(np.full(len(some), n), pa.int32()),
                                                      text.cast(schema.field("gram").type), pa.array(best[at:at + ROWS], pa.int64())], schema=schema)
    return run

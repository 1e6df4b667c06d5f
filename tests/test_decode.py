"""Decoding: prefixes of many lengths, contexts by hand, rounds that go on after a kill, draws, pointer doubling."""

import hashlib
import math
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

import seqforge.session as session
from seqforge.operators import context_model as C
from seqforge.operators import decode as D
from seqforge.operators import sequence as S

# sequences over a..c = 4..6; SOS 1, EOS 2
SEQS = [[4, 5, 6], [4, 5, 6], [4, 5, 4, 5, 6], [6], [5, 4], [6, 6, 4, 5], [], [4] * 12]


def tokens(spark):
    return spark.createDataFrame([(s, k, t) for s, ids in enumerate(SEQS) for k, t in enumerate(ids)], "s long, o long, t long")


def counted(depth, least):
    """{state: Counter} by the definition, on lists."""
    out = {}
    for ids in SEQS:
        if not ids:
            continue
        f = [1, *ids, 2]
        for p in range(1, len(f)):
            for n in range(0, min(depth, p) + 1):
                out.setdefault(tuple(f[p - n:p]), Counter())[f[p]] += 1
    return {k: v for k, v in out.items() if len(k) <= 1 or sum(v.values()) >= least}


def longest(known, ids, depth):
    return next(tuple(ids[len(ids) - n:]) for n in range(min(depth, len(ids)), -1, -1) if tuple(ids[len(ids) - n:]) in known)


def units(v, t):
    return round(math.log(v[t] / sum(v.values())) * 1e9)


def plain_beam(known, depth, prefix, beam, steps, forced):
    """The n-best of one query with lists and sorts."""
    slots, fin, top = [(0, [], longest(known, [1, *prefix], depth), 0)], [], False
    for t in range(1, steps + 1):
        cand = []
        for k, (u, ids, state, last) in enumerate(slots):
            if last == 2:
                continue
            for tok in known[state]:
                if forced and t == 1 and prefix and tok == 2:
                    continue
                cand.append((-(u + units(known[state], tok)), k, tok, ids, state))
        if not cand:
            break
        cand.sort(key=lambda c: c[:3])
        slots = [(-c[0], c[3] + [c[2]], None if c[2] == 2 else longest(known, [*c[4], c[2]], depth), c[2]) for c in cand[:beam]]
        fin += [(u, t, k, ids) for k, (u, ids, _, last) in enumerate(slots) if last == 2]
        top |= slots[0][3] == 2
        if top and len(fin) >= beam:
            break
    first = [(0, -u, t, k, ids) for u, t, k, ids in fin] or [(0, -slots[0][0], steps, 0, slots[0][1])]
    rest = [(1, -u, steps, k, ids) for k, (u, ids, _, last) in enumerate(slots) if last != 2]
    return [[x for x in c[4] if x != 2] for c in sorted(first + rest, key=lambda c: c[:4])[:beam]]


def test_context_table_by_hand(spark):
    t = C.context_table(S.contexts(tokens(spark), "s", ["o"], "t", 3), 3, least=2).collect()
    known = counted(3, 2)
    got = {}
    for r in t:
        state = tuple(map(int, r.state.split()))
        got.setdefault(state, Counter())[r.token] = r.cnt
        assert r.units == units(known[state], r.token) and r.order == len(state)
        assert r.goto == (None if r.token == 2 else " ".join(map(str, longest(known, [*state, r.token], 3))))
    assert got == known
    assert (4, 5, 6) in known and (5, 6, 6) not in known and (1, 5) not in known      # seen once: falls back to (5)
    assert longest(known, (1, 5), 3) == (5,)


@pytest.mark.parametrize("forced", [True, False])
def test_prefixes_of_zero_to_ten_tokens(spark, forced):
    rng = random.Random(9)
    prefixes = [[]] + [[rng.choice([4, 4, 5, 6, 9]) for _ in range(n)] for n in range(1, 11)] * 3 + [[4] * 10]
    table = C.context_table(S.contexts(tokens(spark), "s", ["o"], "t", 3), 3, least=2)
    q = C.start_states(spark.createDataFrame(list(enumerate(prefixes)), "qid long, prefix array<bigint>"), table, 3)
    out = {}
    for r in D.nbest(q, table, 4, 15, forced=forced).orderBy("qid", "rank").collect():
        assert r.prefix == prefixes[r.qid]
        out.setdefault(r.qid, []).append(r.tokens)
    known = counted(3, 2)
    assert out == {i: plain_beam(known, 3, p, 4, 15, forced) for i, p in enumerate(prefixes)}


def chain(spark):
    """A table whose searches take long: every state goes on, EOS is rare."""
    rng = random.Random(4)
    rows = [(s, t, rng.randint(5, 50)) for s in (1, *range(4, 12)) for t in range(4, 12)] + [(s, 2, 1) for s in range(4, 12)]
    return spark.createDataFrame(rows, "state long, token long, cnt long").withColumn(
        "units", D.log_units(F.ln(F.col("cnt") / F.sum("cnt").over(D.Window.partitionBy("state")))))


def test_killed_run_goes_on_from_its_last_round(spark, monkeypatch):
    q = spark.createDataFrame([(0, [4]), (1, [])], "qid long, prefix array<bigint>")
    name = f"test-{uuid.uuid4().hex}"                 # the shared folder may outlive the session
    whole = sorted(D.beam_search(q, chain(spark), 3, 9, run=f"{name}-whole", per_round=4).collect(), key=str)
    made, real = [], session.Rounds.once

    def once(self, round_, make):
        def counted_make():
            made.append(round_)
            if round_ == 6 and made.count(6) == 1:
                raise KeyboardInterrupt
            return make()
        return real(self, round_, counted_make)

    monkeypatch.setattr(session.Rounds, "once", once)
    with pytest.raises(KeyboardInterrupt):
        D.beam_search(q, chain(spark), 3, 9, run=f"{name}-killed", per_round=1)
    rounds = session.Rounds(spark, f"{name}-killed")
    assert rounds.has(5) and not rounds.has(6)
    again = sorted(D.beam_search(q, chain(spark), 3, 9, run=f"{name}-killed", per_round=1).collect(), key=str)
    assert again == whole and made == ["next", 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, "result"]
    assert rounds.has("result") and not any(rounds.has(k) for k in range(1, 10))          # superseded rounds are gone


def test_fifty_steps_and_pointer_doubling(spark, monkeypatch):
    q = spark.createDataFrame([(0, [4]), (1, [])], "qid long, prefix array<bigint>")
    f = D.beam_search(q, chain(spark), 4, 50)
    assert f.agg(F.max("step")).first()[0] == 50
    finals = D.beam_final(f, 4)
    cuts = []
    monkeypatch.setattr(D, "cut_lineage", lambda df: cuts.append(1) or session.cut_lineage(df))
    b = {(r.qid, r.rank): r.tokens for r in D.backtrace(f, finals, 50).collect()}
    assert len(cuts) == 6
    want = {(r.qid, r.rank): r.tokens for r in finals.collect()}
    assert {k: [x for x in v if x != 2] for k, v in b.items()} == want and len(want) == 8


def test_draws_follow_the_counts(spark):
    counts = {4: 1, 5: 7, 6: 500, 7: 2, 8: 40, 2: 50}
    rows = [(1, t, n) for t, n in counts.items()] + [(t, 2, 3) for t in counts if t != 2]
    nxt = spark.createDataFrame(rows, "state long, token long, cnt long")
    cells, states = D.cumulative_cells(nxt)
    assert states.where("state = 1").select("total", "width").first()[:] == (600, 100)
    assert cells.where("state = 1").count() == 6                       # no more cells than successors
    q = spark.range(6000).select(F.col("id").alias("qid"), F.array().cast("array<bigint>").alias("prefix"))
    got = {r.qid: r.tokens for r in D.sample_decode(q, nxt, 3).collect()}
    salted = {r.qid: r.tokens for r in D.sample_decode(q, nxt, 3, broadcast_rows=0).collect()}
    assert got == salted
    order, want = sorted(counts), []
    for i in range(6000):
        r = int(hashlib.md5(f"42:{i}:0".encode()).hexdigest()[:13], 16) % 600
        want.append(next(t for k, t in enumerate(order) if r < sum(counts[x] for x in order[:k + 1])))
    assert [got[i][0] for i in range(6000)] == want
    seen = Counter(want)
    assert all(abs(seen[t] - 10 * n) < 5 * math.sqrt(10 * n) + 1 for t, n in counts.items())

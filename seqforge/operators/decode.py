"""Decoding re-aimed as table operators over a next-token table ``next(state, token, logp)``.

A decoding step is frontier JOIN next (broadcast if its count allows) followed by a per-query top-k. What follows depends on the start state alone, so queries that start in the same state share one search.

Log-probabilities are added as whole numbers (units of 1e-9): sums do not depend on their order, so hypotheses of equal
probability tie in every engine and at every partitioning, and ties go by parent slot and token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions.arrays import eos_cut, pad_array
from seqforge.operators.joins import BROADCAST_ROW_LIMIT, checked_broadcast, skew_safe_join
from seqforge.session import Rounds, cut_lineage

UNIT = 1e-9


def log_units(logp: Column) -> Column:
    return F.round(logp * 1e9).cast("bigint")


def next_token_table(pairs: DataFrame, state: str = "input_id", token: str = "label_id", count: str | None = None) -> DataFrame:
    """Successor counts -> log relative frequency per state: (state, token, cnt, logp, units).
    ``count`` tells how often a pair counts (once by default). Each window partition holds one state's successors (bounded by the vocabulary)."""
    c = pairs.groupBy(F.col(state).alias("state"), F.col(token).alias("token")).agg(
        (F.sum(count) if count else F.count(F.lit(1))).cast("bigint").alias("cnt"))
    tot = F.sum("cnt").over(Window.partitionBy("state"))
    logp = F.ln(F.col("cnt") / tot)
    return c.select("state", "token", "cnt", logp.alias("logp"), log_units(logp).alias("units"))


def log_softmax_group(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Normalise scores of all candidates of a group to log-probabilities:
    s - max - ln(sum(exp(s - max)))."""
    w = Window.partitionBy(*group)
    mx = F.max(score).over(w)
    z = F.ln(F.sum(F.exp(F.col(score) - mx)).over(w))
    return df.withColumn("logp", F.col(score) - mx - z)


def _moves(nxt: DataFrame) -> DataFrame:
    """state, token, units, goto of a next-token table; without ``goto`` the token itself is the next state."""
    units = F.col("units") if "units" in nxt.columns else log_units(F.col("logp"))
    goto = F.col("goto") if "goto" in nxt.columns else F.col("token").cast(nxt.schema["state"].dataType)
    return nxt.select("state", "token", units.alias("units"), goto.alias("goto"))


def _started(queries: DataFrame, nxt: DataFrame, sos: int) -> DataFrame:
    """qid, prefix, state: without a ``state`` of their own, queries start at their prefix's last token or at SOS."""
    last = F.when(F.size("prefix") > 0, F.element_at("prefix", -1)).otherwise(F.lit(sos))
    state = F.col("state") if "state" in queries.columns else last.cast(nxt.schema["state"].dataType)
    return queries.select("qid", "prefix", state.alias("state"))


# ---------------------------------------------------------------------------- beam search
def prune_next(nxt: DataFrame, k: int) -> DataFrame:
    """Keep the best ``k`` successors per state (an exact prune: a slot never needs more
    than k children to fill a top-k beam). Ties by token id."""
    w = Window.partitionBy("state").orderBy(F.desc("units" if "units" in nxt.columns else "logp"), "token")
    return nxt.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def beam_search(queries: DataFrame, nxt: DataFrame, beam: int, max_len: int, eos: int = 2, sos: int = 1,
                forced: bool = False, run: str | None = None, per_round: int = 4) -> DataFrame:
    """Beam search over a next-token table, one query per row.

    queries: (qid, prefix array<bigint>[, state]) -- the prefix is forced first when ``forced``
    (its score is ignored and EOS is blocked at the first free step of a query that has one).

    Every step: live slots JOIN the pruned table (broadcast if its count allows) -> per query the best ``beam`` by (score desc,
    parent slot, token) of at most beam x beam candidates. EOS slots get no children; a query stops once slot 0 was EOS
    at some step and at least ``beam`` hypotheses finished, and the search once no query is live. A round takes
    ``per_round`` steps, which need no shuffle but the first, and is written to the shared folder; a run under
    the same name ``run`` goes on after the last finished round (see Rounds).

    Returns all frontiers: (qid, step, k, parent, tokens, units, score, last).
    """
    rounds = Rounds(queries.sparkSession, run)
    if rounds.has("result"):
        return rounds.read("result")
    width = beam + (1 if forced else 0)
    # the pruned table is bounded by states x width and read by every round: it is written once
    nk = checked_broadcast(rounds.once("next", lambda: prune_next(_moves(nxt), width)).select(
        F.col("state").alias("_state"), "token", F.col("units").alias("_units"), "goto"))
    start = F.when(F.size("prefix") > 0, F.element_at("prefix", -1)).otherwise(F.lit(sos)).cast("bigint")
    none = F.array().cast("array<bigint>")
    front = _started(queries, nxt, sos).select(
        "qid", (F.size("prefix") > 0).alias("led"), F.lit(False).alias("eos_top"), F.lit(0).alias("nfin"),
        F.array(F.struct(F.lit(0).cast("bigint").alias("units"), start.alias("last"), "state", none.alias("tokens"))).alias("slots"))
    seen = "array<struct<step: int, k: int, parent: int, tokens: array<bigint>, units: bigint, last: bigint>>"
    done = F.col("eos_top") & (F.col("nfin") >= beam)

    def advance(front: DataFrame, t: int) -> DataFrame:
        """One step of every query: a row a query before and after, a row a candidate in between."""
        x = front.select("qid", "led", "eos_top", "nfin", "hist", F.posexplode_outer("slots").alias("k", "s"))
        x = x.select("qid", "led", "eos_top", "nfin", "k", "s", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("hist")).alias("hist"),
                     F.when(~done & (F.col("s.last") != eos), F.col("s.state")).alias("_at"))
        j = x.join(nk, F.col("_at") == F.col("_state"), "left")
        open_ = F.col("token").isNotNull()
        if t == 1 and forced:       # only what follows a prefix may not end at once
            open_ &= ~F.col("led") | (F.col("token") != eos)
        cand = F.when(open_, F.struct((-F.col("s.units") - F.col("_units")).alias("minus"), F.col("k").alias("parent"), "token", "goto",
                                      F.concat("s.tokens", F.array("token")).alias("tokens")))
        best = F.slice(F.array_sort(F.collect_list(cand)), 1, beam)
        g = j.groupBy("qid").agg(F.first("led").alias("led"), F.first("eos_top").alias("eos_top"), F.first("nfin").alias("nfin"),
                                 F.first("hist", True).alias("hist"), best.alias("best"))
        now = F.transform("best", lambda c, i: F.struct(F.lit(t).alias("step"), i.alias("k"), c["parent"].alias("parent"), c["tokens"].alias(
            "tokens"), (-c["minus"]).alias("units"), c["token"].alias("last"))).cast(seen)
        return g.select(
            "qid", "led", (F.col("eos_top") | F.coalesce(F.get("best", F.lit(0))["token"] == eos, F.lit(False))).alias("eos_top"),
            (F.col("nfin") + F.size(F.filter("best", lambda c: c["token"] == eos))).alias("nfin"),
            F.transform("best", lambda c: F.struct((-c["minus"]).alias("units"), c["token"].alias("last"), c["goto"].alias("state"),
                                                   c["tokens"].alias("tokens"))).alias("slots"),
            F.concat("hist", now).alias("hist"))

    def steps_from(front: DataFrame, first: int) -> DataFrame:
        front = front.withColumn("hist", F.array().cast(seen)).repartition("qid")
        for t in range(first, min(first + per_round, max_len + 1)):
            front = advance(front, t)
        return front

    made = 0
    for first in range(1, max_len + 1, per_round):
        if made and front.isEmpty():
            break
        made += 1
        front = (rounds.once(made, lambda: steps_from(front, first)).drop("hist")
                 .where(~done & F.exists("slots", lambda s: s["last"] != eos)))
    out = rounds.read(*range(1, made + 1)).select("qid", F.inline("hist")).select(
        "qid", "step", "k", "parent", "tokens", "units", (F.col("units") * F.lit(UNIT)).alias("score"), "last")
    return rounds.finish(out, range(1, made + 1))


def beam_final(fronts: DataFrame, beam: int, eos: int = 2, rank_by: str = "sum", keep: int | None = None) -> DataFrame:
    """n-best per query from all frontiers: finished hypotheses (EOS) by score, then --
    when fewer than ``beam`` finished -- unfinished slots of the last step by score; with
    none finished, slot 0 of the last step leads (and may appear twice, as published).
    ``rank_by='avg'`` ranks by average log-probability per generated token; ``keep`` (at most ``beam``) are returned.
    Output: qid, rank (0-based), tokens (EOS cut), score, step, k, finished, rank_key (what it was ranked by)."""
    last_step = F.max("step").over(Window.partitionBy("qid"))
    f = fronts.withColumn("_last", last_step)
    key = F.col("units").cast("double") if rank_by == "sum" else F.col("units") / (F.size("tokens") + F.lit(1e-6))
    cols = [key.alias("_key"), "step", "k", "tokens", "score"]
    fin = f.where(F.col("last") == eos).select("qid", F.lit(0).alias("grp"), *cols)
    nfin = F.sum(F.when(F.col("last") == eos, 1).otherwise(0)).over(Window.partitionBy("qid"))
    lastrows = f.withColumn("_nfin", nfin).where(F.col("step") == F.col("_last"))
    slot0 = lastrows.where((F.col("_nfin") == 0) & (F.col("k") == 0)).select("qid", F.lit(0).alias("grp"), *cols)
    unfin = lastrows.where(F.col("last") != eos).select("qid", F.lit(1).alias("grp"), *cols)
    allc = fin.unionByName(slot0).unionByName(unfin)
    w = Window.partitionBy("qid").orderBy("grp", F.desc("_key"), "step", "k")
    r = allc.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < min(keep or beam, beam))
    finished = F.array_position("tokens", eos) > 0
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), eos_cut("tokens", eos).alias("tokens"),
                    "score", "step", "k", finished.alias("finished"), (F.col("_key") * F.lit(UNIT)).alias("rank_key"))


def shared_starts(queries: DataFrame, nxt: DataFrame, sos: int = 1) -> tuple[DataFrame, DataFrame]:
    """(qid, prefix, start) of every query, and one query (qid = start, prefix, state) for every different start: what
    follows depends on nothing but the state and whether there is a prefix."""
    q = _started(queries, nxt, sos).select("qid", "prefix", F.struct("state", (F.size("prefix") > 0).alias("led")).alias("start"))
    return q, q.groupBy("start").agg(F.first("prefix").alias("prefix")).select(
        F.col("start").alias("qid"), "prefix", F.col("start.state").alias("state"))


def each_query(queries: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of a start (``results.qid``) for every query that has it; a start may be shared by very many queries."""
    return skew_safe_join(queries.select("qid", "prefix", "start"), results.withColumnRenamed("qid", "start"), ["start"], "qid")


def nbest(queries: DataFrame, nxt: DataFrame, beam: int, max_len: int, forced: bool = False, rank_by: str = "sum",
          keep: int | None = None, sos: int = 1, eos: int = 2) -> DataFrame:
    """Beam search and final n-best of every query: qid, prefix, rank, tokens, score, step, k, finished, rank_key."""
    q, starts = shared_starts(queries, nxt, sos)
    final = beam_final(beam_search(starts, nxt, beam, max_len, eos, sos, forced), beam, eos, rank_by, keep)
    return each_query(q, cut_lineage(final)).drop("start")


def backtrace(fronts: DataFrame, finals: DataFrame, max_len: int) -> DataFrame:
    """Rebuild hypotheses from parent pointers only: every slot holds the tokens of the way to the slot it points to; by
    joining that slot it takes over its tokens and pointer, so the distance doubles and ``max_len`` steps need
    log2(max_len) joins. ``fronts``: (qid, step, k, parent, last); ``finals``: (qid, rank, step, k).
    Output: qid, rank, tokens (oldest first)."""
    node = fronts.select("qid", "step", "k", F.array("last").alias("tokens"),
                         F.when(F.col("step") > 1, F.struct((F.col("step") - 1).alias("step"), F.col("parent").alias("k"))).alias("up"))
    reach = 1
    while reach < max_len:
        node = cut_lineage(node)
        above = node.select("qid", F.struct("step", "k").alias("up"), F.col("tokens").alias("_older"), F.col("up").alias("_on"))
        node = node.join(above, ["qid", "up"], "left").select(
            "qid", "step", "k", F.concat(F.coalesce("_older", F.array().cast("array<bigint>")), "tokens").alias("tokens"),
            F.col("_on").alias("up"))
        reach *= 2
    return finals.select("qid", "rank", "step", "k").join(node, ["qid", "step", "k"]).select("qid", "rank", "tokens")


# ---------------------------------------------------------------------------- one token a step
def best_successor(nxt: DataFrame) -> DataFrame:
    """argmax token per state (ties: lower token id)."""
    return nxt.groupBy("state").agg(F.max_by("token", F.struct("units" if "units" in nxt.columns else "logp", -F.col("token"))).alias("token"))


def _cut_and_check(cur: DataFrame, eos: int, pad: int) -> tuple[DataFrame, bool]:
    """The rows as written, and whether any of them goes on."""
    cur = cut_lineage(cur)
    return cur, not cur.where(~F.col("last").isin(eos, pad)).isEmpty()


def _with_length(decoded: DataFrame, max_len: int, eos: int, pad: int) -> DataFrame:
    """qid, tokens (padded to ``max_len``), len (tokens before the first EOS)."""
    decoded = decoded.withColumn("tokens", pad_array("tokens", max_len, F.lit(pad).cast("bigint")))
    p = F.array_position("tokens", eos)
    length = F.when(p > 0, p - 1).otherwise(F.size(F.filter("tokens", lambda x: x != pad)))
    return decoded.select("qid", "tokens", length.cast("bigint").alias("len"))


def greedy_decode(queries: DataFrame, nxt: DataFrame, max_len: int, eos: int = 2, sos: int = 1,
                  pad: int = 0, lineage_every: int = 5) -> DataFrame:
    """Greedy decoding for ``max_len`` steps from SOS (or the prefix's last token).
    After EOS (or a state without successors) PAD is emitted. ``len`` counts tokens
    before the first EOS. Output: qid, tokens (length max_len), len."""
    best = checked_broadcast(cut_lineage(best_successor(nxt).select(F.col("state").alias("_s"), F.col("token").alias("_t"))))
    q, starts = shared_starts(queries, nxt, sos)
    cur = starts.select("qid", F.array().cast("array<bigint>").alias("tokens"), F.col("state").alias("last"))
    for t in range(1, max_len + 1):
        j = cur.join(best, cur["last"] == best["_s"], "left")
        nxt_tok = F.when((F.col("last") == eos) | (F.col("last") == pad) | F.col("_t").isNull(), F.lit(pad)) \
                   .otherwise(F.col("_t")).cast("bigint")
        cur = j.select("qid", F.concat("tokens", F.array(nxt_tok)).alias("tokens"), nxt_tok.alias("last"))
        if t % lineage_every == 0:
            cur, live = _cut_and_check(cur, eos, pad)
            if not live:
                break
    return _with_length(each_query(q, cur), max_len, eos, pad)


def cumulative_cells(nxt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, cell, picks) and (state, total, width): the successors of every state laid end to end by token, each as
    long as its count, and cut into cells of equal ``width``, as many as the state has successors (at most twice as many).

    ``picks`` lists the (hi, token, total, width) that end in the cell or run through it: a number r below the state's total lies
    in cell r / width and its token is the first whose ``hi`` is above r. total and width are those of the state
    that the token leads to (null: it has no successors). A cell holds two picks on average. Without counts, exp(logp)
    is taken in units of 1e-9.
    """
    cnt = F.col("cnt") if "cnt" in nxt.columns else F.greatest(F.round(F.exp("logp") * 1e9), F.lit(1))
    w = Window.partitionBy("state")
    t = cut_lineage(nxt.select("state", "token", cnt.cast("bigint").alias("cnt"))
                    .withColumn("hi", F.sum("cnt").over(w.orderBy("token").rowsBetween(Window.unboundedPreceding, 0)))
                    .withColumn("total", F.sum("cnt").over(w))
                    .withColumn("width", F.greatest(F.floor(F.col("total") / F.count(F.lit(1)).over(w)), F.lit(1))))
    states = t.groupBy("state").agg(F.max("total").alias("total"), F.max("width").alias("width"))
    onward = states.select(F.col("state").alias("token"), F.col("total").alias("_total"), F.col("width").alias("_width"))
    cells = F.sequence(F.floor((F.col("hi") - F.col("cnt")) / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))
    pick = F.struct("hi", "token", F.col("_total").alias("total"), F.col("_width").alias("width"))
    return (t.join(onward, "token", "left").select("state", F.explode(cells).alias("cell"), pick.alias("pick"))
            .groupBy("state", "cell").agg(F.array_sort(F.collect_list("pick")).alias("picks"))), states


def draw(total: Column, *parts: Column) -> Column:
    """A number from 0 to ``total`` - 1 from the md5 of the key parts (52 bits), equal in any engine."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") % total


def sample_decode(queries: DataFrame, nxt: DataFrame, max_len: int, seed: int = 42, eos: int = 2, sos: int = 1,
                  pad: int = 0, lineage_every: int = 5, broadcast_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Sampled decoding: at every step one number is drawn for a query (md5-seeded, reproducible in any engine) and
    one row of :func:`cumulative_cells` is looked up: state and cell are an exact key, so a state's other successors
    are never met. The cells are broadcast if their count allows; otherwise the lookup is a salted join, since very
    many queries may start in one state. After EOS (or a state without successors) PAD is emitted."""
    cells, states = map(cut_lineage, cumulative_cells(nxt))
    cells = cells.withColumnRenamed("state", "last")
    small = cells.count() <= broadcast_rows

    def meet(cur: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
        return cur.join(F.broadcast(table), keys, "left") if small else skew_safe_join(cur, table, keys, "qid", how="left")

    cur = meet(_started(queries, nxt, sos), states, ["state"]).select(
        "qid", F.array().cast("array<bigint>").alias("tokens"), F.col("state").alias("last"), "total", "width")
    for step in range(max_len):
        r = draw(F.col("total"), F.lit(seed), F.col("qid"), F.lit(step))
        j = meet(cur.withColumn("_r", r).withColumn("cell", F.floor(F.col("_r") / F.col("width"))), cells, ["last", "cell"])
        hit = F.get(F.filter("picks", lambda p: p["hi"] > F.col("_r")), F.lit(0))
        token = F.when(F.col("last").isin(eos, pad) | hit.isNull(), F.lit(pad)).otherwise(hit["token"]).cast("bigint")
        cur = j.select("qid", F.concat("tokens", F.array(token)).alias("tokens"), token.alias("last"),
                       hit["total"].alias("total"), hit["width"].alias("width"))
        if (step + 1) % lineage_every == 0:
            cur, live = _cut_and_check(cur, eos, pad)
            if not live:
                break
    return _with_length(cur, max_len, eos, pad)

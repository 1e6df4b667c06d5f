"""DuckDB SQL texts mirroring the Spark operators (used as the correctness oracle).

Only string building lives here: each helper returns an SQL expression or a
sub-query that computes the same rows as the matching Spark operator.
"""

from __future__ import annotations

from seqforge.functions import bleu_math as bm
from seqforge.functions import text as tx

TINY = f"CAST('{bm.TINY!r}' AS DOUBLE)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ text
def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def lower(e: str) -> str:
    return f"lower({e})"


def tokens_ws(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda x: x <> '')"


def tokens_space(e: str) -> str:
    return f"string_split({e}, ' ')"


def collapse_ws(e: str) -> str:
    return strip(f"regexp_replace({e}, '\\s+', ' ', 'g')")


def split_puncts(e: str) -> str:
    return f"array_to_string(regexp_extract_all({e}, {q(tx.SPLIT_PUNCTS_RE)}), ' ')"


def unescape(e: str) -> str:
    for ent, ch in tx.NIST_ENTITIES:
        e = f"replace({e}, {q(ent)}, {q(ch)})"
    return e


def nist_normalize(e: str, preserve_case: bool = False) -> str:
    for d in tx.NIST_DELETE:
        e = f"replace({e}, {q(d).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}, '')"
    e = f"replace({e}, chr(10), ' ')"
    e = unescape(e)
    e = f"(' ' || {e} || ' ')"
    if not preserve_case:
        e = f"lower({e})"
    for pat, rep in tx.NIST_PUNCT_RULES:
        e = f"regexp_replace({e}, {q(pat)}, {q(rep.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return e


def nist_tokens(e: str) -> str:
    return tokens_ws(nist_normalize(e))


def cli_tokens(e: str) -> str:
    return nist_tokens(split_puncts(lower(strip(e))))


TOKENIZERS = {"ws": tokens_ws, "space": tokens_space,
              "puncts": lambda e: tokens_ws(split_puncts(e)), "nist": nist_tokens}


# ------------------------------------------------------------------ n-grams
def ngram_rows(src: str, keys: str, toks: str, max_n: int = 4) -> str:
    """Rows (keys..., n, gram) of every n-gram occurrence of list column ``toks`` of ``src``."""
    return f"""(SELECT {keys}, n, array_to_string({toks}[i:i + n - 1], chr(1)) AS gram
      FROM (SELECT {keys}, {toks}, n, unnest(range(1, len({toks}) - n + 2)) AS i
            FROM (SELECT {keys}, {toks}, unnest(range(1, {max_n + 1})) AS n FROM {src})))"""


def pair_stats(pairs_sql: str, hyp_tok: str, ref_tok: str) -> str:
    """(seg, c, r, m1..m4) for single-reference pairs. ``hyp_tok``/``ref_tok`` are list
    expressions over columns of ``pairs_sql`` (which has ``seg``)."""
    return f"""(WITH p AS (SELECT seg, {hyp_tok} AS h, {ref_tok} AS r FROM ({pairs_sql})),
  hg AS (SELECT seg, n, gram, count(*) AS cnt FROM {ngram_rows('p', 'seg', 'h')} GROUP BY seg, n, gram),
  rg AS (SELECT seg, n, gram, count(*) AS cnt FROM {ngram_rows('p', 'seg', 'r')} GROUP BY seg, n, gram),
  m AS (SELECT seg, n, sum(least(hg.cnt, rg.cnt)) AS m FROM hg JOIN rg USING (seg, n, gram) GROUP BY seg, n)
  SELECT p.seg, CAST(len(p.h) AS BIGINT) AS c, CAST(len(p.r) AS BIGINT) AS r,
         {', '.join(f'CAST(coalesce(sum(CASE WHEN m.n = {k} THEN m.m END), 0) AS BIGINT) AS m{k}' for k in range(1, 5))}
  FROM p LEFT JOIN m ON m.seg = p.seg GROUP BY p.seg, p.h, p.r)"""


def multi_ref_stats(hyps_sql: str, refs_sql: str, eff: str = "shortest") -> str:
    """(seg, c, r, m1..m4): ``hyps_sql`` has (seg, t), ``refs_sql`` has (seg, ref_no, t)."""
    if eff == "shortest":
        r = "CAST(min(rl.rlen) AS DOUBLE)"
    elif eff == "average":
        r = "avg(rl.rlen)"
    elif eff == "closest":
        r = "CAST(arg_min(rl.rlen, [abs(rl.rlen - h.c), rl.ref_no]) AS DOUBLE)"
    elif eff == "closest_shorter":
        r = "CAST(arg_min(rl.rlen, [abs(rl.rlen - h.c), rl.rlen]) AS DOUBLE)"
    else:
        raise ValueError(eff)
    return f"""(WITH hy AS (SELECT seg, t FROM ({hyps_sql})),
  rf AS (SELECT seg, ref_no, t FROM ({refs_sql})),
  rmax AS (SELECT seg, n, gram, max(cnt) AS r FROM (
             SELECT seg, ref_no, n, gram, count(*) AS cnt FROM {ngram_rows('rf', 'seg, ref_no', 't')}
             GROUP BY seg, ref_no, n, gram) GROUP BY seg, n, gram),
  hc AS (SELECT seg, n, gram, count(*) AS h FROM {ngram_rows('hy', 'seg', 't')} GROUP BY seg, n, gram),
  m AS (SELECT seg, n, sum(least(hc.h, rmax.r)) AS m FROM hc JOIN rmax USING (seg, n, gram) GROUP BY seg, n),
  h AS (SELECT seg, CAST(len(t) AS BIGINT) AS c FROM hy),
  rl AS (SELECT seg, ref_no, CAST(len(t) AS BIGINT) AS rlen FROM rf),
  eff AS (SELECT h.seg, h.c, {r} AS r FROM h JOIN rl ON rl.seg = h.seg GROUP BY h.seg, h.c)
  SELECT eff.seg, eff.c, eff.r,
         {', '.join(f'CAST(coalesce(sum(CASE WHEN m.n = {k} THEN m.m END), 0) AS BIGINT) AS m{k}' for k in range(1, 5))}
  FROM eff LEFT JOIN m ON m.seg = eff.seg GROUP BY eff.seg, eff.c, eff.r)"""


# ------------------------------------------------------------------ closed forms
def bp(c: str = "c", r: str = "r") -> str:
    return (f"(CASE WHEN {c} > {r} THEN 1.0 WHEN {c} = 0 THEN 0.0 "
            f"ELSE exp(1.0 - CAST({r} AS DOUBLE) / CAST({c} AS DOUBLE)) END)")


def sentence_bleu(order: int, c: str = "c", r: str = "r") -> str:
    w = repr(1.0 / order)
    terms = []
    for n in range(1, order + 1):
        p = (f"(CASE WHEN m{n} > 0 THEN CAST(m{n} AS DOUBLE) / CAST(greatest({c} - {n - 1}, 1) AS DOUBLE) "
             f"ELSE {TINY} END)")
        terms.append(f"{w} * ln({p})")
    return f"(CASE WHEN m1 = 0 THEN 0.0 ELSE {bp(c, r)} * exp({' + '.join(terms)}) END)"


def mteval_bleu(c: str = "c", r: str = "r", smooth: bool = True, pooled: bool = False) -> list[str]:
    """``pooled``: guesses come from columns g1..g4 (sums of per-segment guesses)."""
    ds, ps = [], []
    for n in range(1, 5):
        g = f"CAST(g{n} AS DOUBLE)" if pooled else f"CAST(greatest({c} - {n - 1}, 0) AS DOUBLE)"
        a = "1.0" if (smooth and n > 1) else "0.0"
        ds.append(f"(ln(CAST(m{n} AS DOUBLE) + {a} + {TINY}) - ln({g} + {a} + {TINY}))")
        ps.append(f"(CASE WHEN {g} = 0 THEN 0.0 ELSE exp(ln(CAST(m{n} AS DOUBLE) + {TINY}) - ln({g})) END)")
    bpen = f"least(0.0, 1.0 - (CAST({r} AS DOUBLE) + 1) / (CAST({c} AS DOUBLE) + 1))"
    return [f"exp(({' + '.join(ds)}) / 4.0 + {bpen})"] + ps


def eps_bleu(c: str = "c", r: str = "r") -> str:
    ts = [f"ln(({bm.EPS_TINY!r} + CAST(m{n} AS DOUBLE)) / ({bm.EPS_SMALL!r} + greatest(CAST({c} AS DOUBLE) + 1 - {n}, 0.0)))"
          for n in range(1, 5)]
    return (f"(CASE WHEN {c} = 0 THEN NULL ELSE exp(least(0.0, 1 - CAST({r} AS DOUBLE) / CAST({c} AS DOUBLE)) "
            f"+ ({' + '.join(ts)}) / 4.0) * 100 END)")


def f1(p: str, r: str) -> str:
    return f"(2 * {p} * {r} / ({p} + {r} + {bm.F1_EPS!r}))"


def r6(e: str) -> str:
    return f"round({e}, 6)"

"""Merkle proofs against trees built with lists."""

import hashlib
import zlib

from pyspark.sql import functions as F

from seqforge.llm.manifest import merkle_proofs

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    out = ""
    for v in row:
        s = None if v is None else str(v)
        out += "-" if s is None else f"{len(s.encode())}:{s}"
    return H(out)


def climb(nodes, fan):
    """The top, and for each node the (left, right) siblings of every level."""
    paths = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for k in range(0, len(nodes), fan):
            run = nodes[k:k + fan]
            for j, members in enumerate(own[k:k + fan]):
                for i in members:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(H("".join(run)))
            above.append([i for members in own[k:k + fan] for i in members])
        nodes, own = up, above
    return nodes[0], paths


def brute(rows, fan=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, tops = {}, []
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = climb([leaf(r) for r in groups[g]], fan)
        trees[g] = (top, paths)
        tops.append(top)
    root, upper = climb(tops, fan)
    out = []
    for g, beyond in zip(langs, upper):
        for r, path in zip(groups[g], trees[g][1]):
            steps = path + beyond
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            now = leaf((*r[:4], low) if bad else r)
            for a, b in steps:
                now = H(a + now + b)
            out.append((r[0], leaf(r), trees[g][0], root, H("".join(a + b for a, b in steps)), now, now == root))
    return sorted(out, key=str)


def prove(df, **more):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle_proofs(df, suspect=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed={"text": low}, **more)
    return sorted((tuple(r)[:7] for r in got.collect()), key=str)


def made(n, langs, text=lambda i: f"Text {i}"):
    return [(i, f"s{i % 3}", langs[i % len(langs)], None if i % 5 == 0 else i, text(i)) for i in range(n)]


def test_trees_of_many_shapes(spark):
    odd = [(None, None, None, None, None), (None, "", "", 0, ""), (3, "s", "é", 1, "É " * 30_000), (7, "a", "z", 2, None),
           (7, "a", "z", 2, "other"), (7, "a", "z", 2, "other"), (8, "a:1", "z", -2, "X\nY")]
    for rows, parts in ((made(1, ["a"]), 1), (made(8, ["a"]), 3), (made(9, ["a"]), 2), (made(65, ["a"]), 4),
                        (made(700, ["b"] * 5 + ["a", None]), 5), (made(11, [f"l{k}" for k in range(10)]), 3), (odd, 2)):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns(
            {c: F.lit(1) for c in ("leaf", "grp", "me", "seg", "tree", "idx", "root")})
        assert prove(df) == brute(rows)


def test_narrow_fan_many_groups_and_rounds(spark):
    rows = made(300, ["a"] * 40 + [f"g{k}" for k in range(30)])
    assert prove(spark.createDataFrame(rows, SCHEMA), fan=2) == brute(rows, 2)


def test_proofs_hold_and_tampering_shows(spark):
    rows = made(200, ["a", "b"], lambda i: f"Text {i}" if i % 2 else f"lower {i}")
    got = prove(spark.createDataFrame(rows, SCHEMA))
    for i, *_, verified in got:
        assert verified == (i % 2 == 0 or zlib.crc32(str(i).encode()) % 3 != 0)


def test_empty(spark):
    assert prove(spark.createDataFrame([], SCHEMA)) == []

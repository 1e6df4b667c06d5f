"""Merkle manifest of a dataset, with a proof for every row.

Method: pointer jumping. Rows are leaves; every ``fan`` consecutive leaves of a group (by identifier) hash to a
node, and so on up to the group's subroot; the subroots hash to one root in the same way. Each inner node first
holds the siblings beside itself and a pointer to its parent. In every round a node joins the node its pointer
names, appends that node's segment of siblings to its own and takes over its pointer: the distance doubles, so
a tree of depth d takes log2(d) self-joins. The leaves of one run share everything above their run, so they
travel as one row and meet the finished segment of their node once, at the end.

Positions come from one range partitioning by group and identifier, written once, and from counts a partition and
group; a group with a third of all rows lies in as many partitions as its rows need. Only the root's digest and
three counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.operators.rank import dense_index
from seqforge.session import cut_lineage

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["tree", "level", "idx"]
TOP = -1                    # the tree of the subroots; other trees are numbered from 0 in the order of their groups
RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field_text(c: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: Sequence[str], changed: Mapping[str, Column] | None = None) -> Column:
    return hashed(*[field_text((changed or {}).get(f, F.col(f))) for f in fields])


def leaf_table(docs: DataFrame, fields: Sequence[str], group_col: str, id_col: str, suspect: Column | None,
               changed: Mapping[str, Column]) -> DataFrame:
    """grp, doc_id, leaf, seen: the digest of every row, and the digest of the row as an auditor sees it."""
    leaf = leaf_digest(fields)
    seen = leaf if suspect is None else F.when(F.coalesce(suspect, F.lit(False)), leaf_digest(fields, changed)).otherwise(leaf)
    return docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("doc_id"),
                       F.unhex(leaf).alias("leaf"), F.unhex(seen).alias("seen"))


def positions(leaves: DataFrame) -> DataFrame:
    """tree, n, idx, doc_id, leaf, seen: a row's place among the ``n`` rows of its group, by (identifier, digest)."""
    key = ["grp", "doc_id", "leaf"]
    ranged = cut_lineage(leaves.repartitionByRange(*key).sortWithinPartitions(*key)
                         .select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid")))
    parts = ranged.groupBy("pid", "grp").agg(F.min("mid").alias("first"), F.count("*").alias("here"))
    trees = dense_index(parts.groupBy("grp").agg(F.sum("here").alias("n")), ["grp"], "tree")
    before = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("pid", "first", "grp", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("off")).alias("o")
    offs = (offs.join(trees.alias("t"), F.col("o.grp").eqNullSafe(F.col("t.grp")))
            .select("o.pid", F.col("o.grp").alias("g"), "o.first", "o.off", "t.tree", "t.n"))
    return (ranged.alias("r").join(offs.alias("f"), (F.col("r.pid") == F.col("f.pid")) & F.col("r.grp").eqNullSafe(F.col("f.g")))
            .select("f.tree", "f.n", (F.col("f.off") + F.col("r.mid") - F.col("f.first")).alias("idx"),
                    "r.doc_id", "r.leaf", "r.seen"))


def _text(digests: Column) -> Column:
    """The lowercase hex text of binary digests, one behind the other."""
    return F.lower(F.hex(digests))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def _step(kids: Column, at: Column) -> Column:
    """The siblings left and right of child number ``at`` (from 0)."""
    return F.struct(_joined(F.slice(kids, F.lit(1), at)).alias("left"),
                    _joined(F.slice(kids, at + 2, F.size(kids))).alias("right"))


def _climb(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame, int]:
    """The links of every node (columns of NODE under ``me``) to its parent, the tops of all trees, and the depth.

    ``nodes``: tree, level, idx, m (nodes of that tree on that level), digest, me.
    """
    links, tops = [], []
    widest = nodes.agg(F.max("m")).first()[0] or 0
    while True:
        tops.append(nodes.where("m = 1"))
        if widest <= 1:
            return links, reduce(DataFrame.unionByName, tops), len(links)
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest", "me")))
        runs = cut_lineage(nodes.where("m > 1").groupBy("tree", (F.col("level") + 1).alias("level"),
                                                        F.floor(F.col("idx") / fan).alias("up"))
                           .agg(F.max("m").alias("m"), kids.alias("kids")).withColumnRenamed("up", "idx"))
        digests = F.transform("kids", lambda k: k["digest"])
        links.append(runs.select(F.struct(*NODE).alias("to"), digests.alias("d"), F.posexplode("kids").alias("at", "kid"))
                     .select("kid.me", "to", F.array(_step(F.col("d"), F.col("at"))).alias("seg"), "kid.digest"))
        nodes = runs.select(*NODE, F.ceil(F.col("m") / fan).alias("m"),
                            F.unhex(hashed(_text(_joined(digests)))).alias("digest"), F.struct(*NODE).alias("me"))
        widest = ceil(widest / fan)


def _jump(nodes: DataFrame, reach: int) -> DataFrame:
    """Every node takes over the segment and pointer of the node it points to, ``reach`` levels above it."""
    far = nodes.where((F.col("me.tree") == TOP) | (F.col("me.level") > reach)).select(
        F.col("me").alias("at"), F.col("to").alias("on"), F.col("seg").alias("more"), F.col("sub").alias("above"))
    going = nodes.where(F.col("to").isNotNull()).join(far, F.col("to") == F.col("at"))
    return (going.select("me", F.col("on").alias("to"), F.concat("seg", "more").alias("seg"),
                         F.coalesce("sub", "above").alias("sub"))
            .unionByName(nodes.where(F.col("to").isNull())))


def merkle_proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id",
                  fan: int = FAN, suspect: Column | None = None, changed: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof: one row for each row of ``docs``.

    ``proof`` lists the siblings (left, right; binary digests in order) from the leaf's run to the root;
    ``proof_sha256`` hashes their hex text. ``folded_root`` folds the proof over the row as an auditor finds it:
    where ``suspect`` holds, with the columns of ``changed`` in place; ``verified`` tells whether it gives the root.

    A null field counts as ``-``; empty and long texts are fields like others. A null group is a group of its own,
    before all others; rows without identifier come first in their group. Rows that share an identifier are
    ordered by their digests; repeated rows are leaves each. A lone leaf is its subroot, a lone subroot the root.
    An empty table gives an empty result. Only the named columns are read, so others cannot clash.
    """
    spark = docs.sparkSession
    runs = cut_lineage(positions(cut_lineage(leaf_table(docs, fields, group_col, id_col, suspect, changed or {})))
                       .groupBy("tree", "n", F.floor(F.col("idx") / fan).alias("up"))
                       .agg(F.array_sort(F.collect_list(F.struct("idx", "doc_id", "leaf", "seen"))).alias("rows")))
    digests = F.transform("rows", lambda r: r["leaf"])
    me = F.struct("tree", F.lit(1).alias("level"), F.col("up").alias("idx"))
    first = cut_lineage(runs.select(
        "tree", F.lit(1).alias("level"), F.col("up").alias("idx"), F.ceil(F.col("n") / fan).alias("m"),
        F.when(F.col("n") == 1, digests[0]).otherwise(F.unhex(hashed(_text(_joined(digests))))).alias("digest"), me.alias("me")))
    links, subroots, depth = _climb(first, fan)
    subroots = cut_lineage(subroots)
    count = subroots.count()
    if not count:
        return spark.createDataFrame([], RESULT + ", proof array<struct<left: binary, right: binary>>")
    upper, tops, more = _climb(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"),
        F.lit(count).cast("long").alias("m"), "digest", "me"), fan)
    root = tops.select("me", "digest").first()
    root_me = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(NODE, root["me"], ("long", "int", "long"))])

    # nodes below the root have no further to go; the root itself has no siblings
    tables = [x.select("me", F.when(F.col("to") != root_me, F.col("to")).alias("to"), "seg",
                       F.when(F.lit(above) & (F.col("me.tree") != TOP), F.col("digest")).alias("sub"))
              for above, xs in ((False, links), (True, upper)) for x in xs]
    top = tops.select("me", F.lit(None).cast("struct<tree: long, level: int, idx: long>").alias("to"),
                      F.array().cast("array<struct<left: binary, right: binary>>").alias("seg"),
                      F.lit(None).cast("binary").alias("sub"))
    nodes = cut_lineage(reduce(DataFrame.unionByName, tables, top))
    reach = 1
    while reach < depth + more:
        nodes = cut_lineage(_jump(nodes, reach))
        reach *= 2

    paths = nodes.where((F.col("me.tree") != TOP) & (F.col("me.level") == 1)).select(
        F.col("me.tree").alias("t"), F.col("me.idx").alias("i"), "seg", "sub")
    rows = (runs.join(paths, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("i")))
            .select("n", digests.alias("d"), "seg", "sub", F.posexplode("rows").alias("at", "row"))
            .select("row.*", "sub", F.when(F.col("n") == 1, F.col("seg")).otherwise(
                F.concat(F.array(_step(F.col("d"), F.col("at"))), "seg")).alias("proof")))
    fold = F.aggregate("proof", _text(F.col("seen")), lambda a, s: hashed(_text(s["left"]), a, _text(s["right"])))
    known = _text(F.lit(bytes(root["digest"])))
    siblings = F.aggregate("proof", F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"]))
    return (rows.select("doc_id", _text(F.col("leaf")).alias("leaf"), F.coalesce(_text(F.col("sub")), known).alias("subroot"),
                        known.alias("root"), F.sha2(_text(siblings), 256).alias("proof_sha256"), fold.alias("folded_root"), "proof")
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"), "proof"))

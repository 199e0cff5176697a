"""Comparing what meets under keys, but not what links connect already.

An index has a row (band, key, node) for each key of a node. Nodes that meet
under a key are candidates; as links are found, candidates whose nodes have one
root need no comparison, so that a group of copies costs as much as it has
members, not pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docverify.operators.components import connected_components
from docverify.plans.storage import written

#: A key is compared in full once it has at most so many pairs a node that no link connects yet.
FEW = 4
#: Leaders of a fuller key: first one, then each time so many times as many.
MORE_LEADERS = 16


def shared_keys(entries: DataFrame, label: str) -> DataFrame:
    """entries (band, key, node) of keys with at least two nodes, with least: the key's smallest node."""
    sizes = entries.groupBy("band", "key").agg(F.min("node").alias("least"), F.max("node").alias("last"))
    return written(entries.join(sizes.where("least < last").drop("last"), ["band", "key"]), label)


def merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, root) of every node on a link, from the roots so far and links (a, b) found since."""
    if roots is None:
        return written(connected_components(found), "roots")
    ends = found
    for c in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = written(connected_components(ends), "moved")
    # a moved node without a root so far was its own
    known = roots.union(moved.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(known.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def apart(index: DataFrame, roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of keys whose nodes have several roots: the entries of keys with few such pairs, and of fuller ones.

    Entries have root, degree (the node's links) and main (the key's commonest root).
    """
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    state = roots.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node", "left")
    rooted = index.select("band", "key", "node").join(state, "node", "left").select(
        "band", "key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree")
    )
    by_root = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = by_root.groupBy("band", "key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count(F.lit(1)).alias("kinds"),
        F.max(F.struct("n", "root"))["root"].alias("main"),
    )
    found = written(rooted.join(keys.where("kinds > 1").drop("kinds"), ["band", "key"]), "apart")
    few = ((F.col("n") * F.col("n") - F.col("sq")) / 2 <= FEW * F.col("n")) | (F.col("n") <= 2 * FEW)
    return found.where(few), found.where(~few)


def few_pairs(few: DataFrame) -> DataFrame:
    """(band, key, a, b) of nodes with different roots that meet under a key.

    One of two is not of the key's commonest root. As there are few pairs,
    there are at most 4 x FEW such nodes, and they alone meet all others.
    """
    rare = few.where("root <> main").select("band", "key", F.col("node").alias("one"), F.col("root").alias("own"))
    met = few.select("band", "key", "node", "root").join(rare, ["band", "key"]).where("root <> own")
    return met.select("band", "key", F.least("one", "node").alias("a"), F.greatest("one", "node").alias("b")).distinct()


def leaders_of(many: DataFrame, leaders: int) -> DataFrame:
    """(band, key, node): in each of `leaders` parts of a key the node with most links."""
    best = many.groupBy("band", "key", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("part")).agg(
        F.max(F.struct("degree", "node")).alias("best")
    )
    return written(best.select("band", "key", F.col("best.node").alias("node")), "leaders")

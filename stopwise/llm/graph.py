"""Connected components of a link table, by alternating large-star and small-star steps.

Links and labels stay distributed. Each round is a map-side combined minimum per node and a join
on the node; a node with very many links is one side of a join that adaptive execution can split.
The link table is written to the shared folder after every round, so a lost executor costs a
re-read. Labels are the smallest reachable node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.session import materialize


def forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node) for every node of the bipartite or square link matrix that isn't the smallest."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return []
    m = linked[np.ix_(rows, cols)]
    # labels are ranks of the ids: small numbers keep the work arrays small
    nodes = np.concatenate((a[rows], b[cols]))
    ids, rank = np.unique(nodes, return_inverse=True)
    rank = rank.astype(np.int32)
    top = np.int32(len(ids))
    left, right = rank[: len(rows)], rank[len(rows) :]
    while True:
        new_right = np.minimum(right, np.where(m, left[:, None], top).min(0))
        new_left = np.minimum(left, np.where(m, new_right[None], top).min(1))
        if (new_right == right).all() and (new_left == left).all():
            break
        left, right = new_left, new_right
    labels = ids[np.concatenate((left, right))]
    kept = nodes != labels
    return list(set(zip(nodes[kept].tolist(), labels[kept].tolist())))


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (hi, lo) links with hi > lo."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return small.union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node that is not the smallest of its component.

    Links with a null end and links of a node to itself count for nothing; repeated links count
    once; an empty table gives an empty result.
    """
    kept = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = materialize(kept.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    state = _state(current)
    while state[0]:
        following = materialize(_stars(current), "links")
        before, state, current = state, _state(following), following
        if state == before:
            break
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def label(nodes: DataFrame, links: DataFrame, node: str, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """``nodes`` with the smallest reachable node as column ``name``."""
    found = components(links, a, b).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = nodes.join(found, F.col(node) == F.col("_node"), "left")
    return joined.withColumn(name, F.coalesce("_root", node)).drop("_node", "_root")

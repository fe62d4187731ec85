"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable, for nodes with edges.

    ``edges`` has two bigint columns, a and b. Each round is two aggregates
    with map-side combining and two joins on the node; a hub's rows are split
    by the adaptive skew join. Every round's edges are written to the shared
    folder, so a lost executor costs one round at most. Self-loops, repeated
    edges and either direction are allowed; an empty input gives no rows.
    """
    cur = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct())
    sign = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = scratch.keep(large)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low2.select("u", F.col("m").alias("v")))
                .where("u <> v").distinct())
        nxt = scratch.keep(star)
        scratch.drop(cur)
        scratch.drop(large)
        cur = nxt
        got = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                      F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if got[0] == 0 or got == sign:
            break
        sign = got
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as (a, b): one from each node to the
    smallest of its local component, so a dense cluster sends few links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    move = label != np.arange(len(nodes))
    return nodes[move], nodes[label[move]]

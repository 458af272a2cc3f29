"""Connected components of a table of links, as joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.common import written


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 within one task, the smallest node that links a-b reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        while (new != (further := new[new])).any():
            new = further
        if (new == root).all():
            return root
        root = new


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the smallest node reachable.

    Alternates two contractions until nothing changes: every node links its larger neighbours to its smallest one, then its
    smaller neighbours to their smallest. Smallest neighbours come from an aggregation that combines before the shuffle,
    and rejoin by an equi-join, whose hot keys Spark splits; so a node may have any number of links. Each round is a written
    table, and only its number of links and a checksum reach the driver. Null ids link nothing.
    """
    known = links.where("a IS NOT NULL AND b IS NOT NULL")
    now = written(known.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "links")
    state = _state(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.union(low.where("v > m").select("v", F.col("m").alias("u"))).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = written(small.union(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            roots = now.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
    raise RuntimeError("the links did not settle")


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s

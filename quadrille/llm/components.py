"""Connected components by alternating large and small stars on the executors; a few links, at most FEW, on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Most links that the driver works through by itself, two numbers each.
FEW = 65_536


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        for end in (a, b):
            # A node's label learns too, so classes join at their roots.
            np.minimum.at(least, before[end], low)
            np.minimum.at(least, end, low)
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            return nodes, nodes[least]


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), component the smallest node reachable; one row per linked node.

    Minima are combined before they are shuffled, and a hub's links are joined to one row per node, which a skew join
    splits. Null ends and loops are ignored; repeated links count once; no links, no rows. At most FEW links are worked
    through on the driver instead, with the same result: rounds of jobs over so little cost mostly their start.
    """
    a, b = F.col("a"), F.col("b")
    e = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    if e.count() <= FEW:
        ends = np.array(e.collect(), np.int64).reshape(-1, 2)
        rows = zip(*(x.tolist() for x in _labels(ends[:, 0], ends[:, 1])), strict=True)
        return links.sparkSession.createDataFrame(list(rows), "node long, component long")
    seen = None
    with scratch(links.sparkSession) as keep:
        while seen is None or seen[0]:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
            now = mark(e)
            if now == seen:
                break
            seen = now
        keep(e)
    rows = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rows.unionByName(rows.select(F.col("component").alias("node"), "component").distinct())

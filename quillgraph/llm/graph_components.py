"""Connected components of a links table, by hooking and pointer jumping on DataFrames.

Each round takes, for every node, the smallest label among its neighbours and itself, then jumps to the label's own
label, so long chains shrink by half. Rounds end when no label changes; every round's labels are written to the shared
folder, so no lineage grows and nothing is collected. A node of many links is only ever an aggregation key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids in links (a, b): component is the smallest id reachable. Ids are not null."""
    both = stored(links.select("a", "b").where("a <> b").distinct())
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        up = labels.select(F.col("id").alias("to"), F.col("component").alias("top"))
        new = stored(hooked.join(up, "to", "left").select("id", F.least("to", F.coalesce("top", "to")).alias("component"), "was"))
        if new.where("component <> was").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n by links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root

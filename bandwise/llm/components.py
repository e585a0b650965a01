"""Connected components of a table of links, by smallest labels and jumps; nothing but a flag reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.session import write_through


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of the links; links with a null end are passed over.

    Every round a node takes the smallest label among its neighbours, and then the label of that label.  The label
    tables are written to the shared folder, so a round depends on files only.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = write_through(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = write_through(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = write_through(hooked, "hooked")
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = hooked.join(above, "label").select("node", "old", F.least("label", "top").alias("label"))
        labels = write_through(labels, "labels")
        if labels.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("old")


def local_roots(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each local group; the links p to q are given in both directions, sorted by p."""
    label = np.arange(n)
    if not len(p):
        return label
    first = np.flatnonzero(np.diff(p, prepend=-1))
    nodes = p[first]
    while True:
        near = label.copy()
        near[nodes] = np.minimum(label[nodes], np.minimum.reduceat(label[q], first))
        near = near[near]
        if (near == label).all():
            return label
        label = near

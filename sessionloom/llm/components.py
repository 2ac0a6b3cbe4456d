"""Connected components of an edge table by alternating large-star and small-star steps."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sessionloom.sources.scratch import save_scratch


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a and b; a label is the smallest number of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; root is the smallest node it reaches.

    edges: two columns ``a`` and ``b`` of one type; loops and repeated edges are allowed, rows
    with a null end are no edges. Each round is two joins and is written to the shared folder;
    only the number of edges and a checksum reach the driver. A node with very many edges is
    pre-aggregated for its minimum, and the join with that minimum is split by Spark's skew
    join.
    """
    now = save_scratch(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")),
        ))).where("a <> b").distinct()
        now = save_scratch(small, "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

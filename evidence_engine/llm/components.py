"""Connected components of a links table by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.common import discard, materialise, pieces

#: Bytes of a file of a round's tables.
FILE_BYTES = 4 << 20


def local_roots(n: int, left: np.ndarray, right: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least index of each of n items' components, given pairs of linked items (numpy, one task)."""
    root = np.arange(n) if root is None else root
    while True:
        a, b = root[left], root[right]
        differ = a != b
        if not differ.any():
            return root
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node in links(src, dst), both bigint and not null.

    Each round, every node points at the neighbour (or itself) of the least hash under a seed of the round, and the
    graph is contracted along the pointers; a constant share of the nodes that still have links goes, so rounds grow
    with the logarithm of the graph. Hubs meet only partial aggregates and joins that adaptive execution can split.
    Every round's tables are written to the shared folder, which cuts the lineage; in as many files as their size asks
    for, however many tasks made them.
    """
    edges = materialise(spark, links.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "cc-links")
    files = pieces(32 * edges.count(), FILE_BYTES, least=1)
    assigned = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node"))
    assigned = materialise(spark, assigned.coalesce(files), "cc-roots")
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), c.alias("to"))
        both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))).alias("e")).select("e.*")
        least = both.groupBy("at").agg(F.min(rank(F.col("to"))).alias("m"))
        points = least.select("at", F.when(F.col("m") < rank(F.col("at")), F.col("m.to")).otherwise(F.col("at")).alias("to"))
        points = materialise(spark, points.coalesce(files), "cc-points")
        renamed = assigned.join(points, assigned.root == points.at, "left").select("node", F.coalesce("to", "root").alias("root"))
        renamed = materialise(spark, renamed.coalesce(files), "cc-roots")
        p, q = points.select(F.col("at").alias("src"), F.col("to").alias("a")), points.select(F.col("at").alias("dst"), F.col("to").alias("b"))
        contracted = edges.join(p, "src").join(q, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        contracted = materialise(spark, contracted.coalesce(files), "cc-links")
        # A round's tables are whole on disk, so those before it are not read again.
        discard(spark, points, assigned, edges)
        assigned, edges = renamed, contracted
    else:
        raise RuntimeError(f"components: links left after {max_rounds} rounds")
    names = assigned.groupBy("root").agg(F.min("node").alias("component"))
    return assigned.join(names, "root").select("node", "component")

"""Connected components of an edge table by alternating large-star and small-star rounds, all of it DataFrames.

A round shuffles and writes several times however few edges there are, so the driver joins up to ``FEW`` edges of whole
numbers by itself, 16 bytes each; the result is the same.

Defined cases: edges with a null end and loops are left out, so a node that has no other edge gives no row; repeated
edges and both directions of one count once; an empty table gives no rows; other columns are ignored. Nodes may be of
any type with an order; the root is the smallest node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

#: Edges that the driver joins; more are joined in rounds on the cluster.
FEW = 1 << 18


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("decimal(20,0)") * 3)).first()
    return tuple(r)


def _joined(u: np.ndarray, v: np.ndarray) -> pa.Table:
    """(node, root) of edges in memory: roots of two ends go to the smaller one until both ends of each edge have the same."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return pa.table({"node": nodes, "root": nodes[root]})


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): each node that has an edge with the smallest node it can reach. Nulls and loops are left out."""
    given = Stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v"), "given")
    if {f.dataType.simpleString() for f in given.df.schema} <= {"int", "bigint"} and given.df.count() <= FEW:
        few = given.df.toArrow()
        given.drop()
        return edges.sparkSession.createDataFrame(_joined(few.column("u").to_numpy(), few.column("v").to_numpy()))
    e = Stored(given.df.distinct(), "edges")
    given.drop()
    before = None
    while True:
        # Large star: larger neighbours go to the smallest neighbour.
        both = e.df.select("u", "v").union(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").hint("merge").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: smaller neighbours, and the node itself, go to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = Stored(down, "large")
        least = down.df.groupBy("u").agg(F.min("v").alias("m"))
        small = down.df.hint("merge").join(least.hint("merge"), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = Stored(small, "edges")
        down.drop()
        e.drop()
        e = new
        now = _checksum(e.df)
        if now == before:
            break
        before = now
    return e.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

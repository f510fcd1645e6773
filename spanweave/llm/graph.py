"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (u, v); a component's name is its smallest node.

    Each round gives every node the smallest of itself and its neighbours as its parent and replaces the ends of
    all edges by their parents, until no edge is left.  Edges at least halve in number on the way to a star, so a
    few rounds do; each is written to the shared folder, so that no round depends on an earlier one's executors.
    Null ends and loops are ignored.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").distinct()
    edges = store.saved(edges, "edges")
    names = None
    while not edges.isEmpty():
        ends = edges.union(edges.select("v", "u")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        parents = store.saved(ends.select("node", F.least("node", "low").alias("parent")), "parents")
        if names is None:
            names = parents.select("node", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            names = names.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            names = store.saved(names, "names")
        first, second = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu")), parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = edges.join(first, "u").join(second, "v").where("pu != pv")
        edges = store.saved(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if names is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return names

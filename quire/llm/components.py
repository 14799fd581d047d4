"""Connected components of links kept as a table, by hooking to the smallest neighbour and pointer jumping.

Each round halves the vertices at least. What a round makes is written to the shared folder, so no plan grows with the
rounds, and only counts reach the driver. Hubs are no harm: a vertex keeps only its smallest neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written


def _compressed(parent: DataFrame) -> DataFrame:
    """(v, root) from (v, p), p < v or no row of its own: pointer jumping until nothing moves."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parent = written(parent.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "jump")
        moved = parent.where("moved").limit(1).count()
        parent = parent.select("v", "p")
        if not moved:
            return parent.withColumnRenamed("p", "root")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (a, b) that isn't the smallest of its component; root is the smallest."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known: DataFrame | None = None
    while edges.limit(1).count():
        # A vertex hooks to its smallest neighbour, if that is smaller than itself.
        step = _compressed(written(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "hook"))
        if known is None:
            known = step
        else:
            moved = known.join(step.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left").select("v", F.coalesce("next", "root").alias("root"))
            known = written(moved.unionByName(step), "roots")
        a, b = step.select(F.col("v").alias("a"), F.col("root").alias("ra")), step.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if known is None:
        return edges.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return known

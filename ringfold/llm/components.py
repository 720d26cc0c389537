"""Connected components of a graph in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.workdir import discard, stored


def _least(edges: DataFrame) -> DataFrame:
    """Each edge with ``m``, the least neighbour of its ``a``. A hot ``a`` is a skewed join, which Spark splits."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _least(both).withColumn("m", F.least("a", "m"))
    return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _least(edges)
    links = near.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.unionByName(near.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the least node of its component.

    Star contraction: neighbours are hung below their least neighbour until all of a
    component hang below one. The number of rounds grows with the logarithm of a
    component's diameter; edges stay distributed and are stored in the shared folder each
    round. Edges with a null end, and loops, are left out.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # every edge from the larger to the smaller node
    current = stored(clean.select(high.cast("bigint").alias("a"), low.cast("bigint").alias("b")).distinct(), "components")
    while _tangled(current):
        before, current = current, stored(_small_star(_large_star(current)), "components")
        discard(before)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _tangled(edges: DataFrame) -> bool:
    """Whether some node hangs below several others, or below one that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    roles = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return roles.where("below > 1 OR (below = 1 AND above = 1)").count() > 0


def extend_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """The components with more edges ``(a, b)``; only those that these connect are worked on."""
    across = edges.select("a", "b")
    for end in ("a", "b"):
        of = components.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        across = across.join(of, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    lower = connected_components(across.where("of_a <> of_b"), "of_a", "of_b")
    lower = lower.withColumnRenamed("component", "lower")
    moved = components.join(lower.withColumnRenamed("node", "component"), "component", "left")
    moved = moved.select("node", F.coalesce("lower", "component").alias("component"))
    new = lower.join(components.select("node"), "node", "left_anti").withColumnRenamed("lower", "component")
    return stored(moved.unionByName(new), "components-extended")

"""Connected components of an edge table by star contraction.

Each round every node takes its smallest neighbour as parent, parents are
followed one more step, and the edges are rewritten between parents; edges inside
one parent vanish.  The parent maps are chained back at the end.  All steps are
joins and partial aggregations, so a hub is pre-aggregated before the shuffle and
no component is ever gathered in one place.  Rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b: long) to (node, root) for every node that has an edge; root is the smallest node of the component.

    Nulls and loops are ignored; repeated edges do not matter; no edges give an empty table.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("p"))
        parent = materialize(parent, "parents")
        step = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        level = materialize(parent.join(step, "p").select("node", F.col("pp").alias("p")), "level")
        levels.append(level)
        at = level.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        bt = level.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(at, "a").join(bt, "b").where(F.col("pa") != F.col("pb"))
        edges = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = levels[-1].select("node", F.col("p").alias("root"))
    for level in reversed(levels[:-1]):
        later = result.select(F.col("node").alias("p"), "root")
        result = level.join(later, "p", "left").select("node", F.coalesce("root", "p").alias("root"))
    # The smallest node of a component need not be its root, since roots are reached along paths: name it by its minimum.
    result = materialize(result, "components")
    least = result.groupBy("root").agg(F.min("node").alias("least"))
    return result.join(least, "root").select("node", F.col("least").alias("root"))

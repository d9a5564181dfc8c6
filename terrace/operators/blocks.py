"""Rasters cut into square blocks, and chains that run through many blocks.

Kernels see one block and a ring of cells around it.  What a kernel cannot decide by
itself goes on at a block's edge: pieces of lines are handed on as (start, next) pairs,
and :func:`ranked` puts the pieces of a line in order by pointer doubling over the pieces
alone, so that a line of any length is found without one task seeing its cells.

Defined cases: rows and columns may be negative; a cell that is missing is a NaN or the
given empty value; repeated cells count once (which of them is not defined); an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a block.
BLOCK = 512
#: A cell as one number: r * SPAN + c + SHIFT, so that cells sort row by row also where c is negative.
SPAN, SHIFT = 1 << 30, 1 << 29


def with_halo(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds br, bc (the block) and own; cells at a block's edge come again, not owned, for each block that they touch."""

    def near(name: str) -> F.Column:
        at, home = F.pmod(F.col(name), F.lit(block)), F.floor(F.col(name) / block).cast("int")
        return F.filter(F.array(home, F.when(at == 0, home - 1), F.when(at == block - 1, home + 1)), lambda b: b.isNotNull())

    wide = cells.withColumn("br", F.explode(near("r"))).withColumn("bc", F.explode(near("c")))
    return wide.withColumn("own", (F.floor(F.col("r") / block) == F.col("br")) & (F.floor(F.col("c") / block) == F.col("bc")))


class Window:
    """A block's cells and ring as arrays; ``r0``, ``c0`` are the place of the arrays' first cell, one before the block."""

    def __init__(self, frame: pd.DataFrame, block: int) -> None:
        self.r0, self.c0 = int(frame["br"].iloc[0]) * block - 1, int(frame["bc"].iloc[0]) * block - 1
        self.at = (frame["r"] - self.r0).to_numpy(), (frame["c"] - self.c0).to_numpy()
        self.shape = (int(self.at[0].max()) + 2, int(self.at[1].max()) + 2)
        self.frame = frame
        self.own = self.array("own", False)

    def array(self, name: str, empty) -> np.ndarray:
        values = self.frame[name].to_numpy()
        out = np.full(self.shape, empty, dtype=values.dtype if values.dtype != object else type(empty))
        out[self.at] = values
        return out

    def key(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cells' numbers, of places in the arrays."""
        return (r.astype(np.int64) + self.r0) * SPAN + c + self.c0 + SHIFT


def cell_key(r: F.Column, c: F.Column) -> F.Column:
    return r.cast("long") * SPAN + c + SHIFT


def ranked(pieces: DataFrame, cut) -> DataFrame:
    """From pieces (grid_id, grp, start, next) the line of each: adds line (the start of its last piece), ahead (pieces from this one to the last) and closed.

    No two pieces of one grid_id and grp share a start or a next.  A next that is no piece's
    start ends the line; a closed line begins with its least start.  ``cut`` writes a table
    and reads it back.
    """
    key = ["grid_id", "grp", "start"]
    known = pieces.select("grid_id", "grp", F.col("start").alias("next"), F.lit(True).alias("known"))
    state = pieces.select(*key, "next").join(known, ["grid_id", "grp", "next"], "left").withColumn("next", F.when(F.col("known"), F.col("next"))).drop("known")
    links = cut(state)
    state = links.select(*key, F.col("next").alias("jump"), F.col("start").alias("low"), F.lit(True).alias("moved"))
    left = None
    while left != (left := state.select(F.count("jump"), F.count(F.when(F.col("jump").isNotNull() & F.col("moved"), 1))).first()) or left[1]:
        # Pieces of open lines stop having somewhere to jump to; when only those of closed lines are left and their least starts stay, all is known.
        hop = state.select("grid_id", "grp", F.col("start").alias("jump"), F.col("jump").alias("further"), F.col("low").alias("other"))
        step = state.join(hop, ["grid_id", "grp", "jump"], "left").withColumn("least", F.least("low", F.coalesce("other", "low")))
        state = cut(step.select(*key, F.col("further").alias("jump"), F.col("least").alias("low"), (F.col("least") < F.col("low")).alias("moved")))
    loops = state.where("jump IS NOT NULL").select(*key, "low")
    links = links.join(loops, key, "left").withColumn("closed", F.col("low").isNotNull())
    links = cut(links.withColumn("next", F.when(F.col("closed") & (F.col("next") == F.col("low")), None).otherwise(F.col("next"))))
    state = links.select(*key, F.col("next").alias("jump"), F.col("start").alias("line"), F.lit(1).cast("long").alias("ahead"))
    while not state.where("jump IS NOT NULL").isEmpty():
        hop = state.select("grid_id", "grp", F.col("start").alias("jump"), F.col("jump").alias("further"), F.col("line").alias("end"), F.col("ahead").alias("more"))
        step = state.join(hop, ["grid_id", "grp", "jump"], "left")
        state = cut(step.select(*key, F.col("further").alias("jump"), F.coalesce("end", "line").alias("line"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")))
    return state.select(*key, "line", "ahead").join(links.select(*key, "closed"), key)


def united(edges: DataFrame, cut) -> DataFrame:
    """From edges (grid_id, a, b) between numbers the least number of the component of each: grid_id, root, least; roots that are their own least are left out.

    A number takes the least of its neighbours' roots and then that root's root, until nothing moves.
    """
    both = cut(edges.unionByName(edges.select("grid_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    nodes = both.groupBy("grid_id", F.col("a").alias("root")).agg(F.least(F.col("a"), F.min("b")).alias("least"))
    nodes = cut(nodes.select("grid_id", "root", "least", F.lit(True).alias("moved")))
    while not nodes.where("moved").isEmpty():
        near = both.join(nodes.select("grid_id", F.col("root").alias("b"), "least"), ["grid_id", "b"]).groupBy("grid_id", F.col("a").alias("root")).agg(F.min("least").alias("near"))
        step = nodes.select("grid_id", "root", F.col("least").alias("old")).join(near, ["grid_id", "root"]).withColumn("least", F.least("old", "near"))
        hop = step.select("grid_id", F.col("root").alias("least"), F.col("least").alias("further"))
        step = step.join(hop, ["grid_id", "least"], "left").withColumn("new", F.least("least", F.coalesce("further", "least")))
        nodes = cut(step.select("grid_id", "root", F.col("new").alias("least"), (F.col("new") < F.col("old")).alias("moved")))
    return nodes.where("least < root").select("grid_id", "root", "least")


def joined_parts(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n numbers under the links u - v."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (further := parent[parent]).tobytes() != parent.tobytes():
            parent = further
    return parent

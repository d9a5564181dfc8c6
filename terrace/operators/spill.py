"""Depressions filled to their spill level by a graph of watersheds.

1. Each block is flooded once from its edge cells: every cell learns the least level at
   which its water reaches an edge cell, and which one (its watershed); where watersheds
   meet, inside the block or across its edge, there is a pass of a certain level.
2. A cell's level is the larger of its own and that of its watershed: the least, over all
   ways to the raster's border, of the highest pass on the way.  Passes of ``GROUP`` x
   ``GROUP`` blocks are reduced to a spanning forest over the watersheds that have passes
   to other groups; groups of groups follow until nothing leads out of one.  Levels found
   there go back down the same way, one group a task.
3. Watersheds' levels are joined to the cells.

Every step sees one block's cells or the edges of one group, whose number grows with a
group's outline, not with its area.

Defined cases: cells of null or NaN elevation are walls and stay as they are; cells that
walls enclose have an infinite level; the border of a grid is its outermost rows and
columns; a grid of one cell is its own border; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.blocks import BLOCK, SHIFT, SPAN, Window, with_halo
from terrace.operators.tables import cut_lineage

#: Blocks, or groups of blocks, along a side of the next larger group.
GROUP = 8
#: The outside of the raster, as a node of the graph.
OUTSIDE = -(1 << 62)


def flood(z: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Levels, watersheds (the place of a seed, -1 if none) and the lowest passes between watersheds; NaN cells are walls."""
    wide = np.pad(z, 1, constant_values=np.nan)
    cols = wide.shape[1]
    ground, known = wide.ravel().tolist(), np.isfinite(wide).ravel().tolist()
    level, shed = [float("inf")] * len(ground), [-1] * len(ground)
    heap = []
    for at in np.nonzero(np.pad(seeds, 1) & np.isfinite(wide))[0] * cols + np.nonzero(np.pad(seeds, 1) & np.isfinite(wide))[1]:
        at = int(at)
        level[at], shed[at] = ground[at], at
        heap.append((ground[at], at))
    heapq.heapify(heap)
    around = (-cols - 1, -cols, -cols + 1, -1, 1, cols - 1, cols, cols + 1)
    passes: dict[tuple[int, int], float] = {}
    inf = float("inf")
    while heap:
        low, at = heapq.heappop(heap)
        mine = shed[at]
        for d in around:
            to = at + d
            if not known[to]:
                continue
            other = shed[to]
            if other < 0:
                shed[to] = mine
                level[to] = ground[to] if ground[to] > low else low
                heapq.heappush(heap, (level[to], to))
            elif other != mine:
                high = low if low > level[to] else level[to]
                pair = (mine, other) if mine < other else (other, mine)
                if high < passes.get(pair, inf):
                    passes[pair] = high

    def place(at: int) -> int:
        return (at // cols - 1) * z.shape[1] + at % cols - 1

    sheds = np.array(shed).reshape(wide.shape)[1:-1, 1:-1]
    sheds = np.where(sheds >= 0, (sheds // cols - 1) * z.shape[1] + sheds % cols - 1, -1)
    return np.array(level).reshape(wide.shape)[1:-1, 1:-1], sheds, {(place(a), place(b)): e for (a, b), e in passes.items()}


def reduced(edges: list[tuple[int, int, float]], ends: set[int]) -> list[tuple[int, int, float]]:
    """Edges between some nodes alone that keep the highest pass of the best way between any two of them: a spanning forest, cut to those nodes."""
    parent: dict[int, int] = {}
    names = {e: e for e in ends}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for u, v, e in sorted(edges, key=lambda t: t[2]):
        a, b = root(u), root(v)
        if a == b:
            continue
        if a in names and b in names:
            out.append((names[a], names[b], e))
        parent[b] = a
        if b in names:
            names.setdefault(a, names[b])
    return out


def levels(edges: list[tuple[int, int, float]]) -> dict[int, float]:
    """For each node the highest pass on the best way to the outside."""
    near: dict[int, list[tuple[int, float]]] = {}
    for u, v, e in edges:
        near.setdefault(u, []).append((v, e))
        near.setdefault(v, []).append((u, e))
    best, heap = {OUTSIDE: -float("inf")}, [(-float("inf"), OUTSIDE)]
    while heap:
        low, at = heapq.heappop(heap)
        if low > best[at]:
            continue
        for to, e in near.get(at, ()):
            reach = e if e > low else low
            if reach < best.get(to, float("inf")):
                best[to] = reach
                heapq.heappush(heap, (reach, to))
    best.pop(OUTSIDE)
    return best


def _edges_of(frame: pd.DataFrame) -> list[tuple[int, int, float]]:
    rows = frame[~frame["is_end"].to_numpy(dtype=bool)]
    return list(zip(rows["u"].tolist(), rows["v"].tolist(), rows["e"].tolist()))


def _reduce(frame: pd.DataFrame) -> pd.DataFrame:
    ends = set(frame["u"][frame["is_end"].to_numpy(dtype=bool)].tolist()) | {OUTSIDE}
    out = pd.DataFrame(reduced(_edges_of(frame), ends), columns=["u", "v", "e"])
    return out.assign(grid_id=frame["grid_id"].iloc[0])[["grid_id", "u", "v", "e"]]


def _solve(frame: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(list(levels(_edges_of(frame)).items()), columns=["node", "level"])
    return out.assign(grid_id=frame["grid_id"].iloc[0])[["grid_id", "node", "level"]]


def watershed_levels(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """From the passes (grid_id, u, v, e) between watersheds, named by cell number, the level of each: grid_id, node, level."""
    kept, side = [], block * GROUP
    while True:
        inner = F.when(F.col("u") == OUTSIDE, F.col("v")).otherwise(F.col("u"))
        outer = F.when(F.col("v") == OUTSIDE, F.col("u")).otherwise(F.col("v"))
        # Moved by a third of a side, so that no line between groups stays a line between groups at every size.
        part = lambda key: (F.floor((F.shiftright(key, 30) + SHIFT + side // 3) / side), F.floor((F.pmod(key, F.lit(SPAN)) + side // 3) / side))
        (gr, gc), (hr, hc) = part(inner), part(outer)
        found = cut_lineage(edges.select("grid_id", "u", "v", "e", gr.alias("gr"), gc.alias("gc"), ((gr != hr) | (gc != hc)).alias("crosses"), hr.alias("hr"), hc.alias("hc")))
        inside = found.where("NOT crosses").select("grid_id", "gr", "gc", "u", "v", "e", F.lit(False).alias("is_end"))
        crossing = found.where("crosses")
        if crossing.isEmpty():
            level = inside.groupBy("grid_id", "gr", "gc").applyInPandas(_solve, "grid_id long, node long, level double")
            break
        ends = crossing.select("grid_id", "gr", "gc", "u").union(crossing.select("grid_id", F.col("hr").alias("gr"), F.col("hc").alias("gc"), F.col("v").alias("u"))).distinct()
        marked = ends.select("grid_id", "gr", "gc", "u", F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("e"), F.lit(True).alias("is_end"))
        kept.append((inside, ends))
        less = inside.unionByName(marked).groupBy("grid_id", "gr", "gc").applyInPandas(_reduce, "grid_id long, u long, v long, e double")
        edges, side = less.unionByName(crossing.select("grid_id", "u", "v", "e")), side * GROUP
    for inside, ends in reversed(kept):
        known = ends.join(cut_lineage(level).withColumnRenamed("node", "u"), ["grid_id", "u"])
        sources = known.select("grid_id", "gr", "gc", F.lit(OUTSIDE).alias("u"), F.col("u").alias("v"), F.col("level").alias("e"), F.lit(False).alias("is_end"))
        level = inside.unionByName(sources).groupBy("grid_id", "gr", "gc").applyInPandas(_solve, "grid_id long, node long, level double")
    return level


def fill(cells: DataFrame, bounds: DataFrame, block: int = BLOCK) -> DataFrame:
    """grid_id, r, c, z, filled of cells whose grid's edges are ``bounds`` (grid_id, r0, r1, c0, c1)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        window = Window(frame, block)
        z, own, fixed = window.array("z", np.nan), window.own, window.array("fixed", False)
        mine = np.where(own, z, np.nan)
        rim = np.zeros(own.shape, dtype=bool)
        wide = np.pad(~own & np.isfinite(z), 1)
        for dr in (0, 1, 2):
            for dc in (0, 1, 2):
                rim |= wide[dr : dr + own.shape[0], dc : dc + own.shape[1]]
        level, shed, passes = flood(mine, own & (fixed | rim))
        rows, cols = np.divmod(np.arange(z.size), z.shape[1])
        key = window.key(rows, cols)
        spill: dict[int, list[dict]] = {}
        for (a, b), e in passes.items():
            spill.setdefault(a, []).append({"to": int(key[b]), "e": e})
        ground = np.pad(z, 1, constant_values=np.nan)
        for r, c in np.argwhere(own & rim & np.isfinite(z)).tolist():
            at = r * z.shape[1] + c
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    other = ground[r + dr + 1, c + dc + 1]
                    if wide[r + dr + 1, c + dc + 1] and key[at] < key[at + dr * z.shape[1] + dc]:
                        spill.setdefault(at, []).append({"to": int(key[at + dr * z.shape[1] + dc]), "e": max(z[r, c], other)})
        for r, c in np.argwhere(own & fixed & np.isfinite(z)).tolist():
            spill.setdefault(r * z.shape[1] + c, []).append({"to": OUTSIDE, "e": z[r, c]})
        at = window.at[0] * z.shape[1] + window.at[1]
        sheds = shed.ravel()[at]
        out = frame.assign(level=level.ravel()[at], shed=pd.array(np.where(sheds >= 0, key[sheds], 0), dtype="Int64"), node=key[at], spill=[spill.get(k) for k in at.tolist()])
        out.loc[sheds < 0, "shed"] = pd.NA
        return out[frame["own"].to_numpy()][["grid_id", "r", "c", "z", "level", "shed", "node", "spill"]]

    edge = (F.col("r") == F.col("r0")) | (F.col("r") == F.col("r1")) | (F.col("c") == F.col("c0")) | (F.col("c") == F.col("c1"))
    at = cells.join(bounds, "grid_id").select("grid_id", "r", "c", F.col("z").cast("double").alias("z"), edge.alias("fixed"))
    schema = "grid_id long, r int, c int, z double, level double, shed long, node long, spill array<struct<to:long,e:double>>"
    flooded = cut_lineage(with_halo(at, block).groupBy("grid_id", "br", "bc").applyInPandas(run, schema))
    passes = flooded.where("spill IS NOT NULL").select("grid_id", F.col("node").alias("u"), F.explode("spill").alias("s")).select("grid_id", "u", F.col("s.to").alias("v"), F.col("s.e").alias("e"))
    high = watershed_levels(passes, block).select("grid_id", F.col("node").alias("shed"), F.col("level").alias("over"))
    found = flooded.join(high, ["grid_id", "shed"], "left")
    filled = F.when(F.isnan("z") | F.col("z").isNull(), F.col("z")).when(F.col("over").isNull(), F.lit(float("inf"))).otherwise(F.greatest("level", "over"))
    return found.select("grid_id", "r", "c", "z", filled.alias("filled"))

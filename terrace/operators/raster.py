"""Raster operators on the long form ``(grid_id, r, c, z)``.

What carries values across a whole grid (filling, labels, flow) runs a kernel per block
(:mod:`terrace.operators.blocks`) and joins on what touches at block edges alone, so a grid
of any size is spread over many tasks; a grid that fits one block needs one kernel call.
Filling with an epsilon, whose levels depend on every step of the way, exchanges block edges
between supersteps until nothing changes.  Forests of edge cells are solved by pointer
doubling.  Lineage is cut by written tables in the shared checkpoint folder.

Defined cases: rasters may have holes and several grids; a cell without a lower neighbour
flows nowhere; labels and catchments of no cells are empty; empty tables give empty results;
cells given twice are not defined, but for labels and masks, where they count once; flow
needs rows and columns of zero or more.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from terrace.operators import spill
from terrace.operators.blocks import BLOCK, Window, cell_key, joined_parts, united, with_halo
from terrace.operators.tables import cut_lineage, numbered

# Neighbour order, which decides ties of the flow direction.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
EPSILON = 1e-3
#: Lines that the smoothing kernel takes at once.
STRIPE = 16


def bounds(cells: DataFrame) -> DataFrame:
    """grid_id, r0, r1, c0, c1: one row per grid."""
    return cells.groupBy("grid_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def _heap_fill(z: np.ndarray, level: np.ndarray, fixed: np.ndarray, epsilon: float) -> np.ndarray:
    """Smallest levels reachable downward from the finite ones: w >= z and w >= lowest neighbour + epsilon. NaN cells are walls."""
    wide = np.pad(np.where(np.isnan(z), np.nan, level), 1, constant_values=np.nan)
    cols = wide.shape[1]
    ground, w = np.pad(z, 1, constant_values=np.nan).ravel().tolist(), wide.ravel().tolist()
    held = (np.pad(fixed, 1, constant_values=True) | np.isnan(wide)).ravel().tolist()
    heap = [(w[at], at) for at in np.nonzero(np.isfinite(wide).ravel())[0].tolist()]
    heapq.heapify(heap)
    around = [dr * cols + dc for dr, dc in NEIGHBOURS]
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        low, at = pop(heap)
        if low > w[at]:
            continue
        low += epsilon
        for d in around:
            to = at + d
            if not held[to] and low < w[to]:
                reach = ground[to]
                if low > reach:
                    reach = low
                if reach < w[to]:
                    w[to] = reach
                    push(heap, (reach, to))
    return np.array(w).reshape(wide.shape)[1:-1, 1:-1]


def fill(cells: DataFrame, epsilon: float = 0.0, block: int = BLOCK) -> DataFrame:
    """grid_id, r, c, z, filled: depressions raised to their spill level (plus ``epsilon`` for each step away from it).

    The result is the greatest fixed point of w = z on the border and
    w = max(z, lowest of eight neighbours + epsilon) inside; levels start at infinity and
    only go down, so supersteps of blocks reach the same values as one heap would.  Without
    an epsilon the levels follow from a graph of watersheds (:mod:`terrace.operators.spill`).
    """
    b = bounds(cells)
    if epsilon == 0:
        return spill.fill(cells, F.broadcast(b) if b.count() <= 100_000 else b, block)
    at = cells.join(F.broadcast(b), "grid_id") if b.count() <= 100_000 else cells.join(b, "grid_id")
    border = (F.col("r") == F.col("r0")) | (F.col("r") == F.col("r1")) | (F.col("c") == F.col("c0")) | (F.col("c") == F.col("c1"))
    # Blocks of narrow rasters are longer, so that a block has as many cells as elsewhere.
    side = lambda low, high: F.least(F.lit(block), F.col(high) - F.col(low) + 1)
    tall, wide = ((F.lit(block * block) / side(low, high)).cast("int") for low, high in (("c0", "c1"), ("r0", "r1")))
    state = at.select(
        "grid_id", "r", "c", F.col("z").cast("double").alias("z"), border.alias("fixed"),
        F.when(border, F.col("z").cast("double")).otherwise(F.lit(float("inf"))).alias("w"),
        F.floor(F.col("r") / tall).cast("int").alias("br"), F.floor(F.col("c") / wide).cast("int").alias("bc"), tall.alias("tall"), wide.alias("wide"),
    )

    def relax(frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = frame["r"].min(), frame["c"].min()
        shape = frame["r"].max() - r0 + 1, frame["c"].max() - c0 + 1
        i, j = (frame["r"] - r0).to_numpy(), (frame["c"] - c0).to_numpy()
        z, w, fixed = np.full(shape, np.nan), np.full(shape, np.nan), np.ones(shape, dtype=bool)
        z[i, j], w[i, j] = frame["z"], frame["w"]
        own = frame["own"].to_numpy()
        fixed[i, j] = frame["fixed"].to_numpy() | ~own
        out = _heap_fill(z, w, fixed, epsilon)
        mine = frame[own]
        return mine.assign(new=out[i[own], j[own]])[["grid_id", "r", "c", "z", "fixed", "w", "br", "bc", "tall", "wide", "new"]]

    schema = "grid_id long, r int, c int, z double, fixed boolean, w double, br int, bc int, tall int, wide int, new double"
    many = state.select("grid_id", "br", "bc").distinct().groupBy("grid_id").count().where("count > 1").limit(1).count() > 0
    while True:
        owned = state.withColumn("own", F.lit(True))
        if many:  # a ring of cells of the neighbouring blocks
            shifts = F.array(*[F.struct(F.floor((F.col("r") + dr) / F.col("tall")).cast("int").alias("br"), F.floor((F.col("c") + dc) / F.col("wide")).cast("int").alias("bc")) for dr, dc in NEIGHBOURS])
            ring = state.withColumn("to", F.explode(F.array_distinct(shifts))).where((F.col("to.br") != F.col("br")) | (F.col("to.bc") != F.col("bc")))
            ring = ring.select("grid_id", "r", "c", "z", "fixed", "w", F.col("to.br").alias("br"), F.col("to.bc").alias("bc"), "tall", "wide", F.lit(False).alias("own"))
            owned = owned.unionByName(ring)
        step = cut_lineage(owned.groupBy("grid_id", "br", "bc").applyInPandas(relax, schema))
        changed = many and not step.where("new < w").isEmpty()
        state = step.withColumn("w", F.col("new")).drop("new")
        if not changed:
            return state.select("grid_id", "r", "c", "z", F.col("w").alias("filled"))


def depth(filled: DataFrame) -> DataFrame:
    return filled.withColumn("depth", F.col("filled") - F.col("z"))


def flow_direction(filled: DataFrame, block: int = BLOCK) -> DataFrame:
    """grid_id, r, c, filled, direction (place in the neighbour order, -1 if none is lower), tr, tc (the cell it flows to).

    Steepest drop by distance; the first neighbour in order wins a tie.  One kernel call a block, with a ring of cells around it.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        window = Window(frame, block)
        level = np.pad(window.array("filled", np.nan), 1, constant_values=np.nan)
        here = level[1:-1, 1:-1]
        best, direction = np.zeros(here.shape), np.full(here.shape, -1, dtype=np.int32)
        for k, (dr, dc) in enumerate(NEIGHBOURS):
            drop = (here - level[1 + dr : 1 + dr + here.shape[0], 1 + dc : 1 + dc + here.shape[1]]) / (math.sqrt(2.0) if dr and dc else 1.0)
            steeper = drop > best
            best[steeper], direction[steeper] = drop[steeper], k
        own = frame[frame["own"].to_numpy()]
        k = direction[window.at][frame["own"].to_numpy()]
        moves = np.array([*NEIGHBOURS, (0, 0)])
        to_r, to_c = (pd.array(own[n].to_numpy() + moves[k, i], dtype="Int32") for i, n in enumerate(("r", "c")))
        to_r[k < 0], to_c[k < 0] = pd.NA, pd.NA
        return own.assign(direction=k, tr=to_r, tc=to_c)[["grid_id", "r", "c", "filled", "direction", "tr", "tc"]]

    schema = "grid_id long, r int, c int, filled double, direction int, tr int, tc int"
    return with_halo(filled.select("grid_id", "r", "c", F.col("filled").cast("double").alias("filled")), block).groupBy("grid_id", "br", "bc").applyInPandas(run, schema)


class _Streams:
    """The flow inside one block: for each of its cells the place of the cell it flows to, or -1, and whether that one is in another block."""

    def __init__(self, frame: pd.DataFrame) -> None:
        keys = (frame["r"].to_numpy().astype(np.int64) * (1 << 31)) + frame["c"].to_numpy()
        flows = frame["direction"].to_numpy() >= 0
        self.keys, self.target = keys, np.where(flows, frame["tr"].fillna(0).to_numpy().astype(np.int64) * (1 << 31) + frame["tc"].fillna(0).to_numpy().astype(np.int64), 0)
        order = np.argsort(keys, kind="stable")
        found = np.minimum(np.searchsorted(keys[order], self.target), len(keys) - 1)
        inside = flows & (keys[order][found] == self.target)
        self.down, self.leaves = np.where(inside, order[found], -1), flows & ~inside
        # Every cell comes before the one it flows to.
        down, waits = self.down.tolist(), np.bincount(self.down[self.down >= 0], minlength=len(keys)).tolist()
        self.order = [k for k, n in enumerate(waits) if not n]
        for at in self.order:
            to = down[at]
            if to >= 0:
                waits[to] -= 1
                if not waits[to]:
                    self.order.append(to)

    def gathered(self, weight: np.ndarray) -> np.ndarray:
        """The weight of each cell and of all cells of the block that drain to it."""
        total, down = weight.tolist(), self.down.tolist()
        for at in self.order:
            if down[at] >= 0:
                total[down[at]] += total[at]
        return np.array(total)

    def exits(self) -> np.ndarray:
        """For each cell the place of the cell by which its water leaves the block, or -1."""
        way, down, leaves = [-1] * len(self.down), self.down.tolist(), self.leaves.tolist()
        for at in reversed(self.order):
            way[at] = at if leaves[at] else way[down[at]] if down[at] >= 0 else -1
        return np.array(way)


def _gather(state: DataFrame) -> DataFrame:
    """Of a forest (grid_id, cell, up, acc) each cell's own acc and that of all cells that lead to it, by pointer doubling."""
    state = cut_lineage(state)
    while not state.where("up IS NOT NULL").isEmpty():
        gains = state.where("up IS NOT NULL").groupBy("grid_id", F.col("up").alias("cell")).agg(F.sum("acc").alias("gain"))
        hop = state.select("grid_id", F.col("cell").alias("up"), F.col("up").alias("next"))
        state = state.join(gains, ["grid_id", "cell"], "left").join(hop, ["grid_id", "up"], "left")
        state = cut_lineage(state.select("grid_id", "cell", F.col("next").alias("up"), (F.col("acc") + F.coalesce("gain", F.lit(0))).cast("long").alias("acc")))
    return state.select("grid_id", "cell", "acc")


def _in_blocks(flow: DataFrame, block: int) -> DataFrame:
    at = [F.floor(F.col(n) / block).cast("int").alias(b) for n, b in (("r", "br"), ("c", "bc"))]
    return flow.select("grid_id", "r", "c", "direction", "tr", "tc", *at)


def flow_accumulation(flow: DataFrame, block: int = BLOCK) -> DataFrame:
    """grid_id, r, c, accumulation: the cell and all cells that drain to it.

    A first pass over blocks finds what each cell at an edge receives from its own block and by
    which cell of another block water goes on from where it enters; the forest of those entries
    alone is solved by pointer doubling; a second pass spreads what enters each block.
    """
    flow = cut_lineage(_in_blocks(flow, block))
    rim = F.pmod(F.col("r"), F.lit(block)).isin(0, block - 1) | F.pmod(F.col("c"), F.lit(block)).isin(0, block - 1)

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        streams = _Streams(frame)
        total, way, leaves = streams.gathered(np.ones(len(frame), dtype=np.int64)), streams.exits(), streams.leaves
        at = np.nonzero(frame["rim"].to_numpy())[0]
        going = pd.DataFrame({"cell": streams.keys[at], "up": pd.array(streams.target[way[at]], dtype="Int64"), "acc": 0})
        going.loc[way[at] < 0, "up"] = pd.NA
        leaving = pd.DataFrame({"cell": streams.target[leaves], "up": pd.array([pd.NA] * int(leaves.sum()), dtype="Int64"), "acc": total[leaves]})
        return pd.concat([going, leaving]).assign(grid_id=frame["grid_id"].iloc[0])[["grid_id", "cell", "up", "acc"]]

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        total = _Streams(frame).gathered(1 + frame["enters"].to_numpy())
        return frame.assign(accumulation=total)[["grid_id", "r", "c", "accumulation"]]

    ways = flow.withColumn("rim", rim).groupBy("grid_id", "br", "bc").applyInPandas(first, "grid_id long, cell long, up long, acc long")
    # A cell at an edge that nothing enters carries nothing on: the forest of entries is that of the cells with a share.
    ways = cut_lineage(ways.groupBy("grid_id", "cell").agg(F.max("up").alias("up"), F.sum("acc").alias("acc"), F.max(F.col("acc") > 0).alias("entered")).where("entered").drop("entered"))
    enters = _gather(ways).select("grid_id", F.expr("cast(cell div 2147483648 as int)").alias("r"), F.expr("cast(cell % 2147483648 as int)").alias("c"), F.col("acc").alias("enters"))
    fed = flow.join(enters, ["grid_id", "r", "c"], "left").withColumn("enters", F.coalesce("enters", F.lit(0)))
    return fed.groupBy("grid_id", "br", "bc").applyInPandas(second, "grid_id long, r int, c int, accumulation long")


def catchments(flow: DataFrame, pours: DataFrame, block: int = BLOCK) -> DataFrame:
    """pour_id, grid_id, r, c of every cell that drains to each pour point (pour_id, grid_id, r, c), itself included; catchments may nest.

    A first pass over blocks tells which pour points of the block lie on the way of water that
    enters at its edge, and where it leaves; which pour points lie further on follows on the
    forest of edge cells alone, all at once by doubling: after k rounds those under 2^k blocks
    downstream are known.  A second pass gives each cell the pour points on its way.
    """
    marked = pours.groupBy("grid_id", "r", "c").agg(F.collect_set("pour_id").alias("own"))
    flow = cut_lineage(_in_blocks(flow, block).join(marked, ["grid_id", "r", "c"], "left"))
    rim = F.pmod(F.col("r"), F.lit(block)).isin(0, block - 1) | F.pmod(F.col("c"), F.lit(block)).isin(0, block - 1)
    kind = pours.schema["pour_id"].dataType.simpleString()

    def passed(frame: pd.DataFrame, streams: _Streams) -> list[tuple]:
        """The pour points on the way of each cell, inside the block and beyond it."""
        sets: list[tuple] = [()] * len(frame)
        own = [() if x is None else tuple(x) for x in frame["own"]]
        beyond = [() if x is None else tuple(x) for x in frame["beyond"]] if "beyond" in frame else None
        down, leaves = streams.down.tolist(), streams.leaves.tolist()
        for at in reversed(streams.order):
            further = sets[down[at]] if down[at] >= 0 else beyond[at] if beyond and leaves[at] else ()
            sets[at] = own[at] + further if own[at] else further
        return sets

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        streams = _Streams(frame)
        way, sets, at = streams.exits(), passed(frame, streams), np.nonzero(frame["rim"].to_numpy())[0]
        up = pd.array(streams.target[way[at]], dtype="Int64")
        up[way[at] < 0] = pd.NA
        return pd.DataFrame({"grid_id": frame["grid_id"].iloc[0], "cell": streams.keys[at], "up": up, "pours": [list(sets[k]) or None for k in at.tolist()]})

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        found = frame.assign(pour_id=[list(x) or None for x in passed(frame, _Streams(frame))])[["pour_id", "grid_id", "r", "c"]]
        return found.dropna(subset=["pour_id"]).explode("pour_id")

    edge = cut_lineage(flow.withColumn("rim", rim).groupBy("grid_id", "br", "bc").applyInPandas(first, f"grid_id long, cell long, up long, pours array<{kind}>"))
    jump = edge.where("up IS NOT NULL").select("grid_id", "cell", "up")
    met = cut_lineage(edge.where("pours IS NOT NULL").select(F.explode("pours").alias("pour_id"), "grid_id", "cell"))
    while not jump.isEmpty():
        landed = met.select("pour_id", "grid_id", F.col("cell").alias("up"))
        met = cut_lineage(met.unionByName(jump.join(landed, ["grid_id", "up"]).select("pour_id", "grid_id", "cell")))
        hop = jump.select("grid_id", F.col("cell").alias("up"), F.col("up").alias("next"))
        jump = cut_lineage(jump.join(hop, ["grid_id", "up"]).select("grid_id", "cell", F.col("next").alias("up")))
    to = [F.expr("cast(cell div 2147483648 as int)").alias("tr"), F.expr("cast(cell % 2147483648 as int)").alias("tc")]
    beyond = met.groupBy("grid_id", "cell").agg(F.collect_list("pour_id").alias("beyond")).select("grid_id", *to, "beyond")
    return flow.join(beyond, ["grid_id", "tr", "tc"], "left").groupBy("grid_id", "br", "bc").applyInPandas(second, f"pour_id {kind}, grid_id long, r int, c int")


def label_zones(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """grid_id, r, c, label of 8-connected groups of the given cells; labels count from 1 in the order of each group's first cell, row by row.

    Cells are united inside blocks; only what touches across a block's edge is united by joins.
    Groups are numbered by sorted ranges and the counts of the ranges before.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        window = Window(frame, block)
        place = np.full(window.shape, -1)
        place[window.at] = np.arange(len(frame))
        keys = window.key(*window.at)
        own = frame["own"].to_numpy()
        links, touch = [], [[] for _ in range(len(frame))]
        wide = np.pad(place, 1, constant_values=-1)
        for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
            other = wide[1 + dr : 1 + dr + place.shape[0], 1 + dc : 1 + dc + place.shape[1]]
            met = (place >= 0) & (other >= 0)
            u, v = place[met], other[met]
            inside = own[u] & own[v]
            links.append((u[inside], v[inside]))
            for x, y in zip(u[own[u] != own[v]].tolist(), v[own[u] != own[v]].tolist()):
                x, y = (x, y) if own[x] else (y, x)
                touch[x].append(int(keys[y]))
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(frame), dtype=np.int64)
        rank[order] = np.arange(len(frame))
        parts = joined_parts(len(frame), rank[np.concatenate([u for u, _ in links])], rank[np.concatenate([v for _, v in links])])
        found = frame.assign(root=keys[order][parts[rank]], touch=[t or None for t in touch])
        return found[own][["grid_id", "r", "c", "root", "touch"]]

    wide = with_halo(cells.select("grid_id", "r", "c").distinct(), block)
    local = cut_lineage(wide.groupBy("grid_id", "br", "bc").applyInPandas(run, "grid_id long, r int, c int, root long, touch array<long>"))
    rim = local.where("touch IS NOT NULL")
    roots = rim.select("grid_id", cell_key(F.col("r"), F.col("c")).alias("cell"), F.col("root").alias("b"))
    edges = rim.select("grid_id", F.col("root").alias("a"), F.explode("touch").alias("cell")).join(roots, ["grid_id", "cell"]).select("grid_id", "a", "b").distinct()
    nodes = local.join(united(edges, cut_lineage), ["grid_id", "root"], "left").select("grid_id", "r", "c", F.coalesce("least", "root").alias("root"))
    nodes = cut_lineage(nodes)
    groups = numbered(nodes.select("grid_id", "root").distinct(), [F.asc("grid_id"), F.asc("root")], "n")
    first = groups.groupBy("grid_id").agg(F.min("n").alias("first"))
    groups = groups.join(first, "grid_id").select("grid_id", "root", (F.col("n") - F.col("first") + 1).cast("int").alias("label"))
    return nodes.join(groups, ["grid_id", "root"]).select("grid_id", "r", "c", "label")


def pour_points(zones: DataFrame, accumulation: DataFrame) -> DataFrame:
    """grid_id, label, r, c, accumulation: the cell of each zone with the most inflow, the first row by row on a tie."""
    joined = zones.join(accumulation, ["grid_id", "r", "c"])
    best = joined.groupBy("grid_id", "label").agg(F.max(F.struct("accumulation", (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc"))).alias("b"))
    return best.select("grid_id", "label", (-F.col("b.nr")).alias("r"), (-F.col("b.nc")).alias("c"), F.col("b.accumulation").alias("accumulation"))


def zone_statistics(zones: DataFrame, depths: DataFrame, resolution_m: float = 1.0, least_area_m2: float = 200.0) -> DataFrame:
    """grid_id, label, cells, area_m2, max_depth_m, mean_depth_m, centre_r, centre_c of zones of at least the given area."""
    joined = zones.join(depths.select("grid_id", "r", "c", "depth"), ["grid_id", "r", "c"])
    stats = joined.groupBy("grid_id", "label").agg(
        F.count(F.lit(1)).alias("cells"), F.max("depth").alias("max_depth_m"), F.avg("depth").alias("mean_depth_m"), F.avg("r").alias("centre_r"), F.avg("c").alias("centre_c")
    )
    return stats.withColumn("area_m2", F.col("cells") * resolution_m * resolution_m).where(F.col("area_m2") >= least_area_m2)


def zone_catchments(zones: DataFrame, accumulation: DataFrame, cell_area_m2: float) -> DataFrame:
    """grid_id, label, catchment_cells, catchment_area_m2: the largest accumulation of each zone."""
    most = zones.join(accumulation, ["grid_id", "r", "c"], "left").groupBy("grid_id", "label").agg(F.coalesce(F.max("accumulation"), F.lit(0)).cast("double").alias("catchment_cells"))
    return most.withColumn("catchment_area_m2", F.col("catchment_cells") * cell_area_m2)


def smooth(cells: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """grid_id, r, c, z smoothed by a separable Gaussian with reflected edges; a cell that is missing adds nothing.

    Each axis is one grouped kernel over stripes of ``STRIPE`` whole lines, so a cell is shuffled once an axis.
    """
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    kind = "grid_id long, r int, c int, z double, r0 int, r1 int, c0 int, c1 int"
    rows = cells.select("grid_id", "r", "c", "z").join(bounds(cells), "grid_id").select("grid_id", "r", "c", "z", "r0", "r1", "c0", "c1")

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            low, n = int(frame[f"{axis}0"].iloc[0]), int(frame[f"{axis}1"].iloc[0] - frame[f"{axis}0"].iloc[0]) + 1
            at, line = frame[axis].to_numpy() - low, frame[other].to_numpy() - int(frame[other].min())
            lines = np.zeros((int(line.max()) + 1, n))
            lines[line, at] = frame["z"].to_numpy()
            wide = np.pad(lines, ((0, 0), (radius, radius)), mode="symmetric")
            smoothed = sum(w * wide[:, k : k + n] for k, w in enumerate(weights))
            return frame.assign(z=smoothed[line, at])

        return df.groupBy("grid_id", F.expr(f"{other} div {STRIPE}").alias("stripe")).applyInPandas(lambda key, frame: run(frame), kind)

    return along(along(rows, "r", "c"), "c", "r").select("grid_id", "r", "c", "z")


def flat_fraction(cells: DataFrame, tolerance: float) -> DataFrame:
    """grid_id, flat: the share of cells whose four neighbours are all within the tolerance."""
    rows, cols = Over.partitionBy("grid_id", "r").orderBy("c"), Over.partitionBy("grid_id", "c").orderBy("r")
    near = [f("z").over(w) for w in (rows, cols) for f in (F.lag, F.lead)]
    level = F.lit(True)
    for other in near:
        level = level & F.coalesce(F.abs(F.col("z") - other) <= tolerance, F.lit(True))
    return cells.withColumn("level", level).groupBy("grid_id").agg(F.avg(F.col("level").cast("double")).alias("flat"))


def band_cells(cells: DataFrame, interval: float) -> DataFrame:
    """Adds band: the lower bound of the half-open elevation band of each cell."""
    return cells.withColumn("band", F.floor(F.col("z") / interval) * interval)


def band_histogram(cells: DataFrame, interval: float) -> DataFrame:
    return band_cells(cells, interval).groupBy("grid_id", "band").agg(F.count(F.lit(1)).alias("cells"))


def contour_crossings(cells: DataFrame, interval: float, major: int = 5) -> DataFrame:
    """grid_id, level, crossings, major: neighbouring cells on different sides of each level, by row and by column."""
    rows, cols = Over.partitionBy("grid_id", "r").orderBy("c"), Over.partitionBy("grid_id", "c").orderBy("r")
    near = cells.withColumn("right", F.lead("z").over(rows)).withColumn("below", F.lead("z").over(cols))
    both = near.select("grid_id", "z", F.explode(F.array("right", "below")).alias("other")).where("other IS NOT NULL")
    low, high = F.least("z", "other"), F.greatest("z", "other")
    first, last = (F.floor(low / interval) + 1).cast("long"), F.floor(high / interval).cast("long")
    crossed = both.where(last >= first).select("grid_id", F.explode(F.sequence(first, last)).alias("step"))
    counted = crossed.groupBy("grid_id", "step").agg(F.count(F.lit(1)).alias("crossings"))
    return counted.select("grid_id", (F.col("step") * interval).alias("level"), "crossings", (F.col("step") % major == 0).alias("major"))


def dilate(mask: DataFrame, radius: int) -> DataFrame:
    """Cells within an elliptical kernel of the given radius of a mask cell (grid_id, r, c)."""
    disc = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if abs(dc) <= round(radius * math.sqrt(max(0.0, 1 - (dr / max(radius, 1)) ** 2)))]
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in disc]))
    wide = mask.select("grid_id", "r", "c", offsets.alias("o"))
    return wide.select("grid_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()


def resize(mask: DataFrame, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """grid_id, r, c of the mask's cells on a raster of another size: a cell takes the source cell that its scaled index, rounded down, names.

    Each source cell yields its targets by whole-number arithmetic, so nothing is joined or shuffled.
    """

    def targets(name: str, n: int, to: int):
        first, end = F.expr(f"cast((cast({name} as bigint) * {to} + {n - 1}) div {n} as int)"), F.expr(f"cast(((cast({name} as bigint) + 1) * {to} + {n - 1}) div {n} as int)")
        return F.explode(F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>")))

    inside = mask.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    return inside.select("grid_id", targets("r", rows, to_rows).alias("r"), "c").select("grid_id", "r", targets("c", cols, to_cols).alias("c"))


def rasterize_boxes(boxes: DataFrame) -> DataFrame:
    """(id, grid_id, r, c) of every cell in the truncated pixel box of each row (id, grid_id, r0, c0, r1, c1: double), edges included."""
    cut = boxes.select("id", "grid_id", *[F.col(n).cast("int").alias(n) for n in ("r0", "c0", "r1", "c1")])
    rows = cut.select("*", F.explode(F.sequence("r0", "r1")).alias("r"))
    return rows.select("id", "grid_id", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def mask_overlap(shapes: DataFrame, mask: DataFrame) -> DataFrame:
    """id, fraction: the share of each shape's cells (id, grid_id, r, c) that the mask covers."""
    hit = shapes.join(mask.select("grid_id", "r", "c").distinct().withColumn("w", F.lit(1.0)), ["grid_id", "r", "c"], "left")
    return hit.groupBy("id").agg(F.avg(F.coalesce("w", F.lit(0.0))).alias("fraction"))


def decode_elevation(red, green, blue):
    """Elevation of an RGB-encoded pixel."""
    return red * 256.0 + green + blue / 256.0 - 32768.0


def stitch(spark: SparkSession, tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells of the wanted tiles (x, y); tiles that are missing give 0 m, as an absent tile does."""
    pixel = F.explode(F.sequence(F.lit(0), F.lit(65_535))).alias("p")
    frame = wanted.select("x", "y", pixel)
    got = tiles.select("x", "y", F.col("pixel").alias("p"), "z")
    return frame.join(got, ["x", "y", "p"], "left").select("x", "y", "p", F.coalesce("z", F.lit(0.0)).alias("z"))

"""Fill, labels, directions and accumulation over many small blocks against versions that see the whole raster."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import raster, spill

SHAPE = (33, 27)


@pytest.fixture(scope="module")
def rasters():
    rng = np.random.default_rng(8)
    noise = rng.random(SHAPE).round(2)
    bowl = np.hypot(*np.mgrid[-16:17, -13:14]) + noise
    holes = np.where(rng.random(SHAPE) < 0.05, np.nan, noise)
    holes[10:15, 10] = holes[10:15, 14] = holes[10, 10:15] = holes[14, 10:15] = np.nan
    return {1: noise, 2: bowl, 3: holes}


@pytest.fixture(scope="module")
def cells(spark, rasters):
    rows = [(g, r - 5, c, None if np.isnan(v) else float(v)) for g, z in rasters.items() for (r, c), v in np.ndenumerate(z)]
    return raster.cut_lineage(spark.createDataFrame(rows, "grid_id long, r int, c int, z double"))


def filled(z):
    w, heap = np.full(z.shape, np.inf), []
    for (r, c), v in np.ndenumerate(z):
        if not np.isnan(v) and (r in (0, z.shape[0] - 1) or c in (0, z.shape[1] - 1)):
            w[r, c] = v
            heapq.heappush(heap, (v, r, c))
    while heap:
        low, r, c = heapq.heappop(heap)
        for i in range(max(0, r - 1), min(z.shape[0], r + 2)):
            for j in range(max(0, c - 1), min(z.shape[1], c + 2)):
                if w[i, j] == np.inf and not np.isnan(z[i, j]):
                    w[i, j] = max(low, z[i, j])
                    heapq.heappush(heap, (w[i, j], i, j))
    return w


@pytest.mark.parametrize("block", [2, 5, 512])
def test_fill_equals_one_heap(cells, rasters, block):
    got = {}
    for x in raster.fill(cells, 0.0, block).collect():
        got.setdefault(x["grid_id"], np.full(SHAPE, np.inf))[x["r"] + 5, x["c"]] = np.inf if x["filled"] is None or np.isnan(x["filled"]) else x["filled"]
    for g, z in rasters.items():
        assert np.array_equal(got[g], filled(z))


@pytest.mark.parametrize("block", [4, 512])
def test_labels_directions_and_accumulation(spark, rasters, cells, block):
    high = cells.where("z > 0.45 AND grid_id <> 2")
    seen = {}
    for x in raster.label_zones(high, block).collect():
        seen.setdefault(x["grid_id"], {})[x["r"] + 5, x["c"]] = x["label"]
    for g in (1, 3):
        want, n = {}, 0
        members = {(r, c) for (r, c), v in np.ndenumerate(rasters[g]) if v > 0.45}
        for start in sorted(members):
            if start not in want:
                n, todo = n + 1, [start]
                want[start] = n
                while todo:
                    r, c = todo.pop()
                    for to in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                        if to in members and to not in want:
                            want[to] = n
                            todo.append(to)
        assert seen[g] == want
    level = {1: rasters[1], 2: rasters[2]}
    flow = raster.flow_direction(cells.where("grid_id < 3").withColumnRenamed("z", "filled"), block)
    down = {(x["grid_id"], x["r"] + 5, x["c"]): (x["direction"], x["tr"], x["tc"]) for x in flow.collect()}
    for (g, r, c), (k, tr, tc) in down.items():
        best, at = 0.0, (-1, None, None)
        for i, (dr, dc) in enumerate(raster.NEIGHBOURS):
            if 0 <= r + dr < SHAPE[0] and 0 <= c + dc < SHAPE[1]:
                drop = (level[g][r, c] - level[g][r + dr, c + dc]) / (math.sqrt(2.0) if dr and dc else 1.0)
                if drop > best:
                    best, at = drop, (i, r + dr - 5, c + dc)
        assert (k, tr, tc) == at
    total = dict.fromkeys(down, 1)
    for g, r, c in sorted(down, key=lambda x: -level[x[0]][x[1], x[2]]):
        k, tr, tc = down[g, r, c]
        if k >= 0:
            total[g, tr + 5, tc] += total[g, r, c]
    flow = flow.withColumn("r", F.col("r") + 5).withColumn("tr", F.col("tr") + 5)
    assert {(x["grid_id"], x["r"], x["c"]): x["accumulation"] for x in raster.flow_accumulation(flow, block).collect()} == total


def test_empty_rasters(spark):
    none = spark.createDataFrame([], "grid_id long, r int, c int, z double")
    assert raster.fill(none).count() == 0 and raster.label_zones(none).count() == 0
    flow = raster.flow_direction(none.withColumnRenamed("z", "filled"))
    assert flow.count() == 0 and raster.flow_accumulation(flow).count() == 0


def test_forests_of_passes_keep_the_best_ways():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 14
        edges = [(int(a), int(b), float(rng.integers(0, 9))) for a, b in rng.integers(0, n, (30, 2)) if a != b] + [(spill.OUTSIDE, 0, 3.0), (spill.OUTSIDE, 5, 1.0)]
        ends = {spill.OUTSIDE, 1, 2, 3}
        whole, less = spill.levels(edges), spill.levels(spill.reduced(edges, ends))
        assert {k: v for k, v in whole.items() if k in ends} == less


@pytest.mark.parametrize("block", [4, 512])
def test_nested_catchments(spark, cells, block):
    flow = raster.cut_lineage(raster.flow_direction(cells.where("grid_id = 2").withColumn("r", F.col("r") + 5).withColumnRenamed("z", "filled")))
    down = {(x["r"], x["c"]): (x["tr"], x["tc"]) for x in flow.collect()}
    pours = [(1, 16, 13), (2, 10, 10), (3, 10, 10), (4, 25, 5), (5, 0, 0), (6, 16, 12), (7, 40, 40)]
    want = set()
    for start in down:
        at = start
        while at is not None and at[0] is not None:
            want |= {(p, *start) for p, r, c in pours if (r, c) == at}
            at = down[at]
    got = raster.catchments(flow, spark.createDataFrame([(p, 2, r, c) for p, r, c in pours], "pour_id int, grid_id long, r int, c int"), block).collect()
    assert {(x["pour_id"], x["r"], x["c"]) for x in got} == want and len(got) == len(want)

"""Sharding by a k-d tree over the documents' metadata, cut at weighted medians.

The law is ``bytes``: shards are of nearly equal size.

1. Equal texts are one unit, with their bytes together and the least of their metadata; a
   group of over one shard's bytes falls apart into its rows.  Units are written once.
2. Each metadata dimension is mapped to 30 bits of its range (text by its first bytes, sizes
   by logarithm), with 32 bits of the unit's hash behind them, so that ties can be cut too.
3. Level by level all nodes are cut along their widest dimension at the weighted median, or
   where leaves are odd at the matching share: every pass sums bytes by node and bucket and
   goes into the bucket that holds the cut, until what is left in it does not matter.
   Heavy units, of over ``HEAVY`` of a shard's bytes, are at most 1 / HEAVY a shard; the
   driver knows them one by one.  They go to their side of the cut, unless that leaves more
   on a side than the light units can level out, and the cut of the light ones is moved by
   what the heavy ones weigh.  A unit of a whole shard's bytes or more has a shard alone.
4. Where shards still differ by over ``UNEVEN``, groups are taken apart at a quarter of the
   bytes and the tree is cut again, as long as that helps.
5. Rows are range-sorted by shard and numbered by the counts of the ranges before.

The driver sees sums by node and bucket and the heavy units.

Defined cases: a null text has no bytes, as an empty one, and equals it; null metadata and
null doc_ids count as the least; rows that share doc_id and text stay in one shard; rows of
one shard are numbered by doc_id; fewer units than shards leave shards empty; a single long
text can make its shard larger than others; an empty table gives an empty result; absent
dimensions are left out and extra columns ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

SHARDS = 16
MOST_SHARDS = 1024
DIMENSIONS = ("lang", "source", "size", "doc_id")
#: Of a shard's bytes: what makes a unit heavy, what may be left in the bucket of a cut, and what shards may differ by.
HEAVY, FINE, UNEVEN = 1 / 256, 1 / 4096, 0.01
BUCKETS = 256
_TIE, _SIDE = 32, 30


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def _unit(apart: list[int]) -> Column:
    return F.when(F.col("group").isin(apart), F.xxhash64("group", "doc_id")).otherwise(F.col("group")) if apart else F.col("group")


def _coordinate(docs: DataFrame, name: str) -> Column:
    """A column's place on its axis as a double; null where it has none."""
    if name == "size":
        return F.log2("size")
    kind = docs.schema[name].dataType.typeName()
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.substring(F.hex(name), 1, 12), 12, "0"), 16, 10).cast("double")
    value = F.col(name).cast("double") if kind not in ("date", "timestamp", "timestamp_ntz") else F.unix_timestamp(name).cast("double")
    return F.when(~F.isnan(value), F.greatest(F.least(value, F.lit(1e300)), F.lit(-1e300)))


def _rows(docs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """group, doc_id, size, text_crc32 and the coordinates of every document; written once."""
    text = F.coalesce("text", F.lit(""))
    known = [d for d in dimensions if d == "size" or d in docs.columns]
    rows = docs.select("doc_id", *[d for d in known if d not in ("size", "doc_id")], text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"))
    return materialize(rows.select("group", "doc_id", "size", "text_crc32", *[_coordinate(rows, d).alias(f"d{k}") for k, d in enumerate(known)]), "shard-rows")


def _level(heavy: list[tuple[int, int]], light: int, wanted: float, cut: int) -> tuple[set[int], float]:
    """Heavy units (key, bytes) that go left, and the light bytes wanted there."""
    left = {i for i, (key, _) in enumerate(heavy) if key < cut}
    need = wanted - sum(heavy[i][1] for i in left)
    while not 0 <= need <= light:
        short = need > light  # the left side lacks bytes even with all light units
        off = need - light if short else -need
        side = [i for i in range(len(heavy)) if (i in left) != short and heavy[i][1] < 2 * off]
        if not side:
            break
        best = min(side, key=lambda i: (abs(heavy[i][1] - off), abs(heavy[i][0] - cut)))
        left ^= {best}
        need += heavy[best][1] if best not in left else -heavy[best][1]
    return left, min(max(need, 0), light)


class _Cut:
    """The search for the cut of one node: keys from ``low`` to below ``high`` are left to look at, with ``below`` light bytes before them."""

    def __init__(self, node: int, dimension: int, low: int, high: int, share: float) -> None:
        self.node, self.dimension, self.low, self.high, self.share = node, dimension, low, high, share
        self.below, self.need, self.left, self.done = 0, None, set(), False

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low) // BUCKETS))

    def look(self, sums: dict[int, int], heavy: list[tuple[int, int]], fine: float) -> None:
        """Go into the bucket that holds the cut."""
        width = self.width
        if self.need is None:
            light, weight = sum(sums.values()), dict(sums)
            for key, size in heavy:
                weight[(key - self.low) // width] = weight.get((key - self.low) // width, 0) + size
            wanted, total, middle = self.share * sum(weight.values()), 0, self.high
            for bucket in sorted(weight):
                if total + weight[bucket] / 2 >= wanted:
                    middle = self.low + bucket * width
                    break
                total += weight[bucket]
            self.left, self.need = _level(heavy, light, wanted, middle)
        for bucket in sorted(sums):
            if self.below + sums[bucket] >= self.need:
                low = self.low + bucket * width
                if sums[bucket] <= fine or width == 1:
                    self.low = low if self.need - self.below <= sums[bucket] / 2 else low + width
                    self.done = True
                else:
                    self.low, self.high = low, min(self.high, low + width)
                return
            self.below += sums[bucket]
        self.low, self.done = self.high, True


def _tree(units: DataFrame, axes: int, shards: int, total: int) -> tuple[DataFrame, int]:
    """unit and shard of every unit, and how far the largest or smallest shard is from its share, in bytes."""
    spark, border = units.sparkSession, HEAVY * total / shards
    heavy = sorted(((r["unit"], r["bytes"], list(r["keys"])) for r in units.where(F.col("bytes") > border).collect()), key=lambda h: (-h[1], h[0]))
    alone = []
    while heavy and shards > 1 and heavy[0][1] >= total / shards:
        unit, size, _ = heavy.pop(0)
        alone.append(unit)
        total, shards = total - size, shards - 1
    share = total / shards
    light = units.where(F.col("bytes") <= border).select("unit", "bytes", "keys", F.lit(0).alias("node"))
    nodes, at = {0: shards}, {unit: 0 for unit, _, _ in heavy}
    while any(m > 1 for m in nodes.values()):
        found = light.groupBy("node").agg(*[f(F.col("keys")[k]).alias(f"{n}{k}") for k in range(axes) for n, f in (("min", F.min), ("max", F.max))]).collect()
        ends = {r["node"]: [(r[f"min{k}"], r[f"max{k}"]) for k in range(axes)] for r in found}
        for unit, _, keys in heavy:
            old = ends.get(at[unit], [(key, key) for key in keys])
            ends[at[unit]] = [(min(a, key), max(b, key)) for (a, b), key in zip(old, keys)]
        cuts = {}
        for node, leaves in nodes.items():
            if leaves > 1 and node in ends:
                k = max(range(axes), key=lambda k: (ends[node][k][1] >> _TIE) - (ends[node][k][0] >> _TIE))
                cuts[node] = _Cut(node, k, ends[node][k][0], ends[node][k][1] + 1, (leaves // 2) / leaves)
        owned = {node: [(unit, keys[c.dimension], size) for unit, size, keys in heavy if at[unit] == node] for node, c in cuts.items()}
        while todo := [c for c in cuts.values() if not c.done]:
            looks = spark.createDataFrame([(c.node, c.dimension, c.low, c.high, c.width) for c in todo], "node int, dimension int, low long, high long, width long")
            key = F.col("keys")[F.col("dimension")]
            seen = light.join(F.broadcast(looks), "node").where((key >= F.col("low")) & (key < F.col("high")))
            sums: dict[int, dict[int, int]] = {}
            for r in seen.groupBy("node", F.expr("(keys[dimension] - low) div width").alias("bucket")).agg(F.sum("bytes").alias("bytes")).collect():
                sums.setdefault(r["node"], {})[r["bucket"]] = r["bytes"]
            for c in todo:
                c.look(sums.get(c.node, {}), [(k, size) for _, k, size in owned[c.node]], FINE * share)
        for node, c in cuts.items():
            for i, (unit, _, _) in enumerate(owned[node]):
                at[unit] = 2 * node + (i not in c.left)
        steps = spark.createDataFrame([(c.node, c.dimension, c.low) for c in cuts.values()] or [(-1, 0, 0)], "node int, dimension int, low long")
        goes = F.when(F.col("dimension").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + (F.col("keys")[F.col("dimension")] >= F.col("low")).cast("int"))
        light = materialize(light.join(F.broadcast(steps), "node", "left").select("unit", "bytes", "keys", goes.alias("node")), "shard-level")
        moved = {unit for node in cuts for unit, _, _ in owned[node]}
        at = {unit: node if unit in moved else 2 * node for unit, node in at.items()}
        nodes = {child: n for node, leaves in nodes.items() for child, n in ((2 * node, leaves // 2 if leaves > 1 else 1), (2 * node + 1, leaves - leaves // 2 if leaves > 1 else 0)) if n}
    number = {node: k for k, node in enumerate(sorted(nodes))}
    names = spark.createDataFrame(list(number.items()), "node int, shard int")
    shard_bytes = {r["shard"]: r["bytes"] for r in light.join(F.broadcast(names), "node").groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    for unit, size, _ in heavy:
        shard_bytes[number[at[unit]]] = shard_bytes.get(number[at[unit]], 0) + size
    off = max(abs(shard_bytes.get(k, 0) - share) for k in range(shards))
    placed = light.join(F.broadcast(names), "node").select("unit", "shard")
    known = [(unit, number[at[unit]]) for unit, _, _ in heavy] + [(unit, shards + k) for k, unit in enumerate(alone)]
    if known:
        placed = placed.unionByName(spark.createDataFrame(known, "unit long, shard int"))
    return placed, off


def fit(rows: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """The shard of every unit, and the groups that fall apart into rows, of the written ``rows``."""
    axes = sum(c.startswith("d") and c[1:].isdigit() for c in rows.columns)
    least = [F.min(f"d{k}").alias(f"d{k}") for k in range(axes)]
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *least), "shard-groups")
    head = groups.agg(F.sum("bytes").alias("bytes"), *[f(f"d{k}").alias(f"{n}{k}") for k in range(axes) for n, f in (("min", F.min), ("max", F.max))]).first()
    total = head["bytes"] or 0
    side = []
    for k in range(axes):
        low, high = head[f"min{k}"], head[f"max{k}"]
        flat = low is None or not high > low
        place = F.lit(0.0) if flat else (F.coalesce(F.col(f"d{k}"), F.lit(low)) - F.lit(low)) / F.lit(high - low)
        side.append(F.shiftleft(F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)) * (2**_SIDE - 1)).cast("long"), _TIE) + F.col("unit").bitwiseAND(2**_TIE - 1))
    limit, best = total / shards, None
    for _ in range(4):
        apart = [r["group"] for r in groups.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select("group").collect()]
        units = groups.where(~F.col("group").isin(apart)).withColumnRenamed("group", "unit") if apart else groups.withColumnRenamed("group", "unit")
        if apart:
            loose = rows.where(F.col("group").isin(apart)).groupBy(_unit(apart).alias("unit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *least)
            units = units.unionByName(loose)
        units = materialize(units.select("unit", "bytes", F.array(*side).alias("keys")), "shard-units")
        placed, off = _tree(units, axes, shards, total)
        if best and off > 0.8 * best[2]:
            break
        best = placed, apart, off
        if off <= UNEVEN * total / shards or groups.where((F.col("bytes") > limit / 4) & (F.col("rows") > 1) & ~F.col("group").isin(apart)).isEmpty():
            break
        limit /= 4
    return best[:2]


def placed_rows(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32 and shard of every document."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} shards; more are cut from the shards of a first run")
    rows = _rows(docs, dimensions)
    units, apart = fit(rows, shards)
    return rows.withColumn("unit", _unit(apart)).join(units, "unit").select("doc_id", "size", "text_crc32", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    order = ("shard", "doc_id", "size", "text_crc32")
    rows = placed_rows(docs, shards, dimensions).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "shard-slots")
    spans = rows.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(spans.select("part", "shard", (before - F.col("first")).alias("shift")), ["part", "shard"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, per_file: int = 50_000) -> DataFrame:
    """Write the documents, with all their columns, as Parquet in one folder a shard (``shard=k``); the number of shards may follow from their bytes.

    Returns what was written; a column of the documents named ``shard`` is left out.
    """
    if shards is None:
        total = docs.agg(F.sum(text_size(F.col("text")))).first()[0] or 0
        shards = max(1, min(MOST_SHARDS, -(-total // target_bytes))) if target_bytes else SHARDS
    rows = _rows(docs, dimensions)
    units, apart = fit(rows, shards)
    group, unit = fresh(docs, "group"), fresh(docs, "unit")
    named = docs.drop("shard").withColumn(group, F.xxhash64(F.coalesce("text", F.lit(""))))
    named = named.withColumn(unit, F.when(F.col(group).isin(apart), F.xxhash64(group, "doc_id")).otherwise(F.col(group)) if apart else F.col(group))
    placed = named.join(units.withColumnRenamed("unit", unit), unit).drop(group, unit)
    placed.repartitionByRange("shard", "doc_id").write.option("maxRecordsPerFile", per_file).partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)

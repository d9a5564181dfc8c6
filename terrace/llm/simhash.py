"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: one Python/Arrow pass hashes the word shingles of whole texts
   (XXH64, seed 42) and sets each bit that more than half of the hashes set.
2. Equal fingerprints become one class.
3. The 64 bits are grouped into partitions so that correlated bits sit together.
   Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 guarantee that two
   fingerprints within the distance agree up to t_i bits in some partition i.
   Dynamic programming allots the t_i on candidate counts estimated over all
   fingerprints, among layouts of two, three and four partitions.
4. A partition with threshold t is probed through signatures that leave out every
   t of its bits: fingerprints that share a signature are candidates, and each
   candidate is verified on all 64 bits.
5. Links become components by star contraction.

Wide fingerprints have further words of 64 bits, each over the same shingles mixed anew;
candidates found by the first word are verified on all of them (:mod:`.near_text`).

Within a signature bucket only a spanning set of links is emitted, never all
pairs, unless the bucket is small or its links are few.  Buckets over ``CHUNK`` fingerprints are cut
into chunks and every pair of chunks is verified by itself, so no bucket is
gathered in one task.

Defined cases: null and empty texts have fingerprint zero and link like any
other; texts with fewer words than a shingle hash their whole word sequence;
repeated rows fall into one class; a null ``doc_id`` is never a component's name
unless it has no other; an empty table gives an empty result; extra columns are
ignored or carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_digest
from .graph import components

SHINGLE = 3
DISTANCE = 3
#: 64-bit words of a wide fingerprint.
WIDE = 4
LAYOUTS = 8
#: Cost of a probe (a row that is shuffled and sorted) in candidates (two machine words compared).
PROBE_COST = 500.0
#: Largest bucket that one task verifies; larger ones are cut into chunks of about half this size.
CHUNK = 16_384
#: Largest table of bucket names that is broadcast.
BROADCAST_BUCKETS = 500_000
#: Buckets up to this size are verified pair by pair.
SMALL = 48
#: Comparisons of a larger bucket that are made at once, and the links a fingerprint beyond which only a spanning set is sought.
COMPARED, MANY_LINKS = 1 << 15, 4


_SALTS = [np.uint64(k * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) for k in range(WIDE)]


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits that stand for each shingle: its hash, then hashes of that."""
    if not k:
        return hashes
    h = hashes + _SALTS[k]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(text: bytes | None, shingle: int = SHINGLE, width: int = 1) -> list[int]:
    """SimHash of one text in ``width`` unsigned 64-bit words."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * width
    if len(words) < shingle:
        parts = iter((b" ".join(words),))
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    total, counts = 0, np.zeros((width, 64), dtype=np.int64)
    while True:  # a bounded piece of a long text at a time
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, _take(parts, 65_536), repeat(42)), dtype=np.uint64)
        if not len(hashes):
            break
        total += len(hashes)
        for k in range(width):
            counts[k] += np.unpackbits(_mixed(hashes, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    return wide_fingerprint(text, shingle)[0]


def _take(parts: Iterator[bytes], n: int) -> Iterator[bytes]:
    for _, part in zip(range(n), parts, strict=False):
        yield part


def _columns(width: int) -> list[str]:
    return ["fp", *[f"fp{k}" for k in range(1, width)]]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, width: int = 1, digests: bool = False) -> DataFrame:
    """doc_id, fp (signed 64-bit; and fp1, ... of wide ones) and, if asked for, the digest of the text of every document, written once."""
    names = _columns(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(b, shingle, width) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            found = np.array(found, dtype=np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k].copy()) for k in range(width)], *batch.columns[2:]], ["doc_id", *names, *batch.schema.names[2:]])

    more = [text_digest(docs).alias("digest")] if digests else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return materialize(rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", digest binary" * digests), "fingerprints")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def co_occurrence(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each two bits are set together, over all of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64)), 0
        for frame in frames:
            values = frame["fp"].to_numpy(dtype=np.int64)
            for start in range(0, len(values), 8192):
                bits = np.unpackbits(values[start : start + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(values)
        if n:
            i, j = np.divmod(np.arange(4096), 64)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "c": np.append(total.ravel(), n)})

    # 4,097 sums whatever the size of the table
    sums = classes.select("fp").mapInPandas(run, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in sums:
        if r["i"] < 0:
            n = int(r["c"])
        else:
            both[r["i"], r["j"]] = r["c"]
    return n, both


def bit_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, groups = list(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        first = max(left, key=lambda b: (corr[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allot(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds by dynamic programming: costs[i][t + 1] for t from -1; sum(t_i + 1) = distance + 1 at least cost."""
    need = distance + 1
    best: list[tuple[float, list[int]] | None] = [(0.0, []), *[None] * need]
    for row in costs:
        nxt: list[tuple[float, list[int]] | None] = [None] * (need + 1)
        for used, state in enumerate(best):
            if state is None:
                continue
            for share, cost in enumerate(row[: need - used + 1]):
                if nxt[used + share] is None or state[0] + cost < nxt[used + share][0]:
                    nxt[used + share] = (state[0] + cost, [*state[1], share - 1])
        best = nxt
    return best[need]


def signatures(classes: DataFrame, distance: int = DISTANCE) -> list[int]:
    """The masks to probe: fingerprints within the distance agree under at least one of them."""
    n, both = co_occurrence(classes)
    if n < 2:
        return [(1 << 64) - 1]
    layouts = {m: bit_groups(n, both, m) for m in range(2, min(LAYOUTS, distance + 1) + 1)}
    blocks = [(m, i, sum(1 << b for b in g)) for m, groups in layouts.items() for i, g in enumerate(groups)]
    # Pairs that agree in a whole block, counted over all fingerprints.
    keyed = classes.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("k")) for m, i, mask in blocks])).alias("b"))
    pairs = keyed.groupBy("b.m", "b.i", "b.k").count().groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("c")).collect()
    equal = {(r["m"], r["i"]): r["c"] for r in pairs}
    p = np.diag(both) / n
    agree = p * p + (1 - p) * (1 - p)
    odds = (1 - agree) / np.maximum(agree, 1e-9)
    best = None
    for m, groups in layouts.items():
        costs = []
        for i, group in enumerate(groups):
            e, row = [1.0], [0.0]
            for b in group:  # elementary symmetric sums: pairs that differ in exactly t bits, relative to none
                e = [1.0, *[(e[t] if t < len(e) else 0.0) + e[t - 1] * odds[b] for t in range(1, min(len(e), distance) + 1)]]
            for t in range(min(distance + 1, len(group))):
                probes = float(np.prod([(len(group) - j) / (j + 1) for j in range(t)])) if t else 1.0
                candidates = equal.get((m, i), 0.0) * sum(e[: t + 1])
                row.append(candidates + PROBE_COST * n * probes)
            costs.append(row)
        found = allot(costs, distance)
        if best is None or found[0] < best[0]:
            best = (*found, groups)
    _, thresholds, groups = best
    masks = []
    for group, t in zip(groups, thresholds, strict=True):
        if t >= 0:
            masks += [sum(1 << b for b in group if b not in out) for out in combinations(group, t)]
    return masks


def _near(prints: np.ndarray, others: np.ndarray, distance: int, bits: int) -> np.ndarray:
    """Which fingerprints (rows of words) are within the distance on the first word and, if wide, within ``bits`` on all."""
    near = np.bitwise_count(prints[:, 0] ^ others[..., 0]) <= distance
    if prints.shape[1] > 1:
        at = np.flatnonzero(near)
        far = np.bitwise_count(prints[at] ^ (others[at] if others.ndim > 1 else others)).sum(axis=1, dtype=np.int64) > bits
        near[at[far]] = False
    return near


def _spanning(prints: np.ndarray, distance: int, bits: int) -> tuple[list[int], list[int]]:
    """Links between positions that join exactly what all links join, found without emitting all pairs."""
    a, b = [], []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = _near(prints[rest], prints[x], distance, bits)
            if near.any():
                found = rest[near].tolist()
                a += [x] * len(found)
                b += found
                stack.extend(found)
                rest = rest[~near]
    return a, b


def _all_pairs(prints: np.ndarray, distance: int, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All links between positions, a block of comparisons at a time; None where they are over ``MANY_LINKS`` times the fingerprints."""
    first, n, found, a, b = np.ascontiguousarray(prints[:, 0]), len(prints), 0, [], []
    rows = max(1, COMPARED // n)
    apart, count = np.empty(rows * n, dtype=np.uint64), np.empty(rows * n, dtype=np.uint8)
    for k in range(0, n, rows):
        x, y = first[k : k + rows, None], first[k:]
        shape = (len(x), len(y))
        differ = np.bitwise_xor(x, y, out=apart[: len(x) * len(y)].reshape(shape))
        at = np.flatnonzero(np.bitwise_count(differ, out=count[: len(x) * len(y)].reshape(shape)) <= distance)
        i, j = np.divmod(at, len(y))
        later = j > i
        i, j = i[later] + k, j[later] + k
        if prints.shape[1] > 1 and len(i):
            near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= bits
            i, j = i[near], j[near]
        found += len(i)
        if found > MANY_LINKS * n:
            return None
        a.append(i)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def _link(distance: int, bits: int, names: list[str]):
    """From rows sorted by (sig, key, part) to links within each bucket; buckets may cross batches."""

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        sig, key, part, node = (frame[c].to_numpy() for c in ("sig", "key", "part", "node"))
        prints = np.ascontiguousarray(frame[names].to_numpy(dtype=np.int64)).view(np.uint64)
        new = np.ones(len(node), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(node)))
        a, b = [], []
        run = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        if len(small):
            f, r = prints[small], run[small]
            for s in range(1, min(SMALL, len(f))):
                same = np.flatnonzero(r[s:] == r[:-s])
                if not len(same):
                    break
                near = same[_near(f[same], f[same + s], distance, bits)]
                a += node[small[near]].tolist()
                b += node[small[near + s]].tolist()
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            x, y = _all_pairs(prints[start : start + size], distance, bits) or _spanning(prints[start : start + size], distance, bits)
            a += node[start + np.array(x, dtype=np.int64)].tolist()
            b += node[start + np.array(y, dtype=np.int64)].tolist()
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            last = frame.iloc[-1]
            tail = (frame["sig"] == last["sig"]) & (frame["key"] == last["key"]) & (frame["part"] == last["part"])
            held = frame[tail]  # at most two chunks of rows
            if not tail.all():
                yield linked(frame[~tail])
        if held is not None and len(held):
            yield linked(held)

    return run


def link_classes(classes: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK, width: int = 1, bits: int = 256) -> DataFrame:
    """Links (a, b) between nodes that connect exactly what all links within the distance connect; ``classes`` has node and the words of its fingerprint."""
    names = _columns(width)
    masks = signatures(classes, distance)
    parts = F.array(*[F.struct(F.lit(s).alias("sig"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for s, mask in enumerate(masks)])
    rows = classes.select("node", *names, F.explode(parts).alias("s")).select("s.sig", "s.key", "node", *names)
    sizes = classes.select(F.explode(parts).alias("s")).select("s.sig", "s.key").groupBy("sig", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.where(F.col("n") > chunk).select("sig", "key", F.ceil(F.col("n") / (chunk / 2)).cast("int").alias("chunks")), "hot-buckets")
    ready, n_hot = rows.withColumn("part", F.lit(0).cast("long")), hot.count()
    if n_hot:
        # A hot bucket is cut into chunks, and every pair of chunks is a part of its own.
        split = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot, ["sig", "key"], "left")
        split = split.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        split = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        ready = split.withColumn("part", F.least("c", "o").cast("long") * (1 << 31) + F.greatest("c", "o"))
    ready = ready.select("sig", "key", "part", "node", *names).repartition("sig", "key", "part").sortWithinPartitions("sig", "key", "part", "node")
    return ready.mapInPandas(_link(distance, bits, names), "a long, b long")


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprint rows of all documents, and (fp, component_id) of every fingerprint."""
    rows = fingerprints(docs)
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.col("fp").alias("node"), "fp", "least"), "classes")
    roots = components(link_classes(classes))
    named = classes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, named.join(least, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    rows, classes = near_classes(docs)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

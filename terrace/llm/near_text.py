"""Near-duplicate texts: SimHash retrieves, exact Jaccard similarity of five-word shingles decides.

1. Wide fingerprints over five-word shingles are linked by operator 10: one of the first
   two words of 64 bits within ``DISTANCE`` by the generalised pigeonhole principle, all 256
   bits within ``BITS``, which is so wide that a pair at a similarity of 0.8 is lost there
   once in thousands.
   The components of these links are loose groups; no text outside of them is looked at
   again.
2. The texts of each loose group are cut into shingle sets, once, and compared exactly;
   links are pairs at ``LEAST`` or more, of which only a spanning set is kept.  Groups of
   many or long texts are cut into chunks, each pair of which is a part of its own.
3. Components of the exact links are the near-duplicates.

Defined cases: null and empty texts have the empty set and are alike; texts with fewer words
than a shingle are one shingle; rows are found again by text and doc_id together, so a null
or shared doc_id costs no other row, and of repeated rows one stays; an empty table gives an
empty result; extra columns are carried untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep_one, materialize, text_digest
from .graph import components
from .simhash import CHUNK, WIDE, _columns, fingerprints, link_classes

SHINGLE = 5
#: Words of 64 bits that are probed, differing bits of one of them and of all 256 bits that make texts candidates.
PROBED, DISTANCE, BITS = 2, 11, 60
#: Least similarity of near-duplicates, as a fraction.
LEAST = (4, 5)
#: Texts, and bytes of their sets, that one part verifies, about.
PART_ROWS, PART_BYTES = 2048, 64 << 20
#: Largest table of candidates that is broadcast to find their texts.
BROADCAST_ROWS = 250_000


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of one text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if len(words) < shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype=np.uint64))


def spanning_links(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links between places that join exactly what all pairs of similar sets join."""
    up, down = least
    sizes = np.array([len(s) for s in sets])
    links, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            # Sets whose sizes alone keep them apart need no look at their members.
            fit = rest[down * np.minimum(sizes[rest], sizes[x]) >= up * np.maximum(sizes[rest], sizes[x])]
            shared = np.zeros(len(fit), dtype=np.int64)
            if len(fit) and len(mine := sets[x]):
                # All members of all fitting sets are looked up at once, and the hits added up by set.
                every, ends = np.concatenate([sets[k] for k in fit.tolist()]), np.cumsum(sizes[fit])
                hits = np.append(0, np.cumsum(mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every))
                shared = hits[ends] - hits[ends - sizes[fit]]
            near = fit[(up + down) * shared >= up * (sizes[fit] + sizes[x])]
            links += [(x, k) for k in near.tolist()]
            stack.extend(near.tolist())
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return links


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # a short piece of a batch at a time
            part = batch.slice(start, 256)
            packed = [shingle_set(b).tobytes() for b in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("loose"), part.column("member"), pa.array(packed, pa.binary())], names=["loose", "member", "shingles"])


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (loose, part) to links within each; they may cross batches."""
    held, at = [], None

    def linked() -> pd.DataFrame:
        found = spanning_links([np.frombuffer(s, dtype=np.uint64) for _, s in held])
        return pd.DataFrame({"a": [held[i][0] for i, _ in found], "b": [held[j][0] for _, j in found]}, dtype="int64")

    for frame in frames:
        for loose, part, member, shingles in frame[["loose", "part", "member", "shingles"]].itertuples(index=False):
            if (loose, part) != at:
                if len(held) > 1:
                    yield linked()
                held, at = [], (loose, part)
            held.append((int(member), shingles))
    if len(held) > 1:
        yield linked()


def exact_links(sets: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Links (a, b) between members of one loose group from the written ``sets`` (loose, member, shingles)."""
    sizes = sets.groupBy("loose").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    chunks = F.when((F.col("n") <= part_rows) & (F.col("bytes") <= part_bytes), F.lit(1)).otherwise(F.ceil(F.greatest(F.col("n") * 2 / part_rows, F.col("bytes") * 2 / part_bytes)))
    large = sizes.select("loose", chunks.cast("int").alias("chunks")).where("chunks > 1")
    split = sets.join(large, "loose", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    split = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    ready = split.select("loose", (F.least("c", "o").cast("long") * (1 << 31) + F.greatest("c", "o")).alias("part"), "member", "shingles")
    ready = ready.repartition("loose", "part").sortWithinPartitions("loose", "part", "member")
    return ready.mapInPandas(_verified, "a long, b long")


def near_rows(docs: DataFrame, distance: int = DISTANCE, bits: int = BITS) -> DataFrame:
    """doc_id, digest of the text and component of every document; documents of one component are near-duplicates."""
    names = _columns(WIDE)
    rows = fingerprints(docs, SHINGLE, WIDE, digests=True)
    classes = materialize(rows.groupBy(*names).agg(F.count_distinct("digest").alias("texts")).select(F.monotonically_increasing_id().alias("node"), "texts", *names), "classes")
    links = None
    for k in range(PROBED):  # the words take turns as the first one
        turned = classes.select("node", *[F.col(n).alias(name) for n, name in zip(names[k:] + names[:k], names)])
        more = link_classes(turned, distance, CHUNK, WIDE, bits)
        links = more if links is None else links.unionByName(more)
    roots = components(links).withColumnRenamed("root", "loose")
    grouped = classes.join(roots, "node", "left").where("loose IS NOT NULL OR texts > 1").select(*names, F.coalesce("loose", "node").alias("loose"))
    members = rows.join(grouped, names).select("digest", "loose").distinct()
    members = materialize(members.withColumn("member", F.monotonically_increasing_id()), "near-members")
    digest, few = fresh(docs, "digest"), members.count() <= BROADCAST_ROWS
    wanted = members.select(F.col("digest").alias(digest), "loose", "member")
    texts = docs.select(F.col("text").cast("string").alias("text"), text_digest(docs).alias(digest)).join(F.broadcast(wanted) if few else wanted, digest)
    sets = materialize(texts.select("loose", "member", "text").mapInArrow(_sets, "loose long, member long, shingles binary").dropDuplicates(["member"]), "near-sets")
    near = components(exact_links(sets)).withColumnRenamed("node", "member")
    named = members.join(near, "member", "left").select("digest", F.coalesce("root", "member").alias("near"))
    return rows.select("doc_id", "digest").join(named, "digest", "left").select("doc_id", "digest", F.coalesce(F.col("near").cast("string"), F.hex("digest")).alias("component"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the row whose doc_id is the smallest, with all its columns."""
    return keep_one(docs, near_rows(docs))

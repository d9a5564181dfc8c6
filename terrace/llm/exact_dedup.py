"""Exact deduplication with sharded cuckoo-filter indexes.

Texts are equal when identical after lower-casing A-Z.  Each row becomes a
SHA-256 digest in one pass over the texts.  Every input partition folds its own
digests through a local :class:`CuckooIndex` (a group of copies shrinks to one
entry per partition before anything is shuffled), the entries are dealt out by
digest, and each shard folds them through its own index.  A filter hit is only a
hint: it is verified against the full digest kept in the bucket.  A local index is
emptied at ``MOST_LIVE`` entries and the number of shards follows the number of rows,
so no index grows with the corpus.

Defined cases: a null text counts as empty, so null and empty texts form one
group; a null ``doc_id`` loses against every other; rows repeated with the same
``doc_id`` and text count as members and exactly one of them is kept; an empty
table gives an empty result; extra columns are ignored or carried untouched.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize

SLOTS = 4
MAX_KICKS = 200
#: Entries of one index, about.
MOST_LIVE = 200_000


class CuckooIndex:
    """Cuckoo filter whose slots also hold the full key (and a value), so hits can be verified and the table rebuilt.

    ``put`` inserts or replaces, ``get`` looks up, ``delete`` removes a live key.
    When an insertion cannot find a slot, the table doubles and is rebuilt from
    the stored keys; nothing is ever lost or reported falsely.
    """

    def __init__(self, capacity: int = 1024):
        self.size = 0
        self._allocate(max(2, 1 << max(1, (capacity // SLOTS - 1).bit_length())))

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.values: list = [None] * (SLOTS * buckets)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mixed = xxhash.xxh3_64_intdigest(key)
        mark = (mixed & 0xFFFF) or 1
        first = (mixed >> 16) & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _find(self, key: bytes) -> int:
        mark, *both = self._place(key)
        for bucket in both:
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def get(self, key: bytes, default=None):
        slot = self._find(key)
        return default if slot < 0 else self.values[slot]

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) >= 0

    def __len__(self) -> int:
        return self.size

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        self.marks[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def put(self, key: bytes, value=None) -> None:
        slot = self._find(key)
        if slot >= 0:
            self.values[slot] = value
            return
        self.size += 1
        left = self._insert(key, value)
        if left is not None:
            self._grow(left)

    def _grow(self, left: tuple[bytes, object]) -> None:
        """Double the table and fill it again from the stored keys, until all have a slot."""
        stored, buckets = [*self.items(), left], 2 * (self.mask + 1)
        self._allocate(buckets)
        while any(self._insert(k, v) is not None for k, v in stored):
            buckets *= 2
            self._allocate(buckets)

    def _insert(self, key: bytes, value) -> tuple[bytes, object] | None:
        """Put a new key in; what was left without a slot after ``MAX_KICKS`` moves, if anything."""
        mark, first, second = self._place(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.keys[slot], self.values[slot] = mark, key, value
                    return None
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            old = self.marks[slot], self.keys[slot], self.values[slot]
            self.marks[slot], self.keys[slot], self.values[slot] = mark, key, value
            mark, key, value = old
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.keys[slot], self.values[slot] = mark, key, value
                    return None
        return key, value

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def normalised(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text with A-Z lower-cased; null counts as empty."""
    return [(b or b"").lower() for b in column.cast(pa.binary()).to_pylist()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        digests = [hashlib.sha256(b).digest() for b in normalised(batch.column(1))]
        rids = pa.array(range(row, row + len(digests)), pa.int64())
        row += len(digests)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), rids], ["doc_id", "digest", "rid"])


def digest_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest of the normalised text, rid (a row id, fixed because the table is written)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests, "doc_id long, digest binary, rid long")
    return materialize(rows, "digests")


_LIVE = "digest binary, keep_id long, keep_rid long, group_size long"


def _order(entry: tuple) -> tuple:
    """Of equal texts the largest doc_id stays; null loses; of repeated rows the first."""
    doc_id, rid, _ = entry
    return (doc_id is not None, doc_id or 0, -rid)


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    entries = list(index.items())
    for start in range(0, len(entries), 20_000):
        part = entries[start : start + 20_000]
        columns = [pa.array([k for k, _ in part], pa.binary()), *[pa.array([v[i] for _, v in part], pa.int64()) for i in range(3)]]
        yield pa.RecordBatch.from_arrays(columns, ["digest", "keep_id", "keep_rid", "group_size"])


def _fold(most: int | None):
    """Insert each digest into an index, or, where the digest is live already, let the better row stand for it; emptied at ``most`` entries, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for key, *new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                live = index.get(key)
                if live is not None:
                    best = max(live, new, key=_order)
                    new = (best[0], best[1], live[2] + new[2])
                index.put(key, new)
            if most and len(index) >= most:
                yield from _entries(index)
                index = CuckooIndex()
        yield from _entries(index)

    return run


def live_groups(digests: DataFrame, most: int = MOST_LIVE) -> DataFrame:
    """One row per distinct text: digest, keep_id, keep_rid, group_size."""
    entries = digests.select("digest", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.lit(1).cast("long").alias("group_size"))
    shards = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // most))
    return entries.mapInArrow(_fold(most), _LIVE).repartition(shards, "digest").mapInArrow(_fold(None), _LIVE)


def apply_changes(changes: DataFrame) -> DataFrame:
    """Live digests after a log of changes (``seq`` long, ``op`` 'insert' or 'delete', ``digest`` binary, ``doc_id`` long).

    Changes are dealt out by digest and applied in order of ``seq`` within a shard;
    a delete of a digest that is not live does nothing; the first insert of a live
    digest keeps its doc_id until it is deleted.  Null digests are ignored.
    """

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for op, key, doc_id in zip(*(batch.column(n).to_pylist() for n in ("op", "digest", "doc_id")), strict=True):
                if op == "delete":
                    index.delete(key)
                elif op == "insert" and key not in index:
                    index.put(key, doc_id)
        entries = list(index.items())
        for start in range(0, len(entries), 20_000):
            part = entries[start : start + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v for _, v in part], pa.int64())], ["digest", "doc_id"])

    rows = changes.where(F.col("digest").isNotNull()).select("seq", "op", "digest", F.col("doc_id").cast("long").alias("doc_id"))
    return rows.repartition("digest").sortWithinPartitions("seq").mapInArrow(play, "digest binary, doc_id long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Decision for every row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = digest_table(docs)
    groups = live_groups(digests)
    return digests.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id."""
    digests = digest_table(docs)
    winners = live_groups(digests)
    mark, winner, same = fresh(docs, "digest"), fresh(docs, "winner"), fresh(docs, "same")
    names = docs.columns
    text_at = [c.lower() for c in names].index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = pa.array([hashlib.sha256(b).digest() for b in normalised(batch.column(text_at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digest], [*batch.schema.names, mark])

    marked = docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())]))
    stay = winners.select(F.col("digest").alias(mark), F.col("keep_id").alias(winner))
    # The doc_id is part of the key, so the copies of one text are not dealt to one task.
    stay = stay.withColumnRenamed(mark, found := fresh(docs, "found"))
    kept = marked.join(stay, (F.col(mark) == F.col(found)) & F.col("doc_id").cast("long").eqNullSafe(F.col(winner)))
    # Only where a winning row is itself repeated does a second pass take one of its repeats.
    repeats = digests.groupBy("digest", "doc_id").count().where("count > 1").select(F.col("digest").alias(mark), F.lit(True).alias(same))
    if not repeats.isEmpty():
        kept = kept.dropDuplicates([mark])
    return kept.select(*names)

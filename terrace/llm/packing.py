"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

1. Tokenise whole texts (one pass; words are encoded once each and remembered up to a
   bound), cut only documents longer than a sequence, and write the pieces.
2. Range-sort the pieces by falling length; a piece's rank is its place in its range
   plus the counts of the ranges before.
3. Pieces of over half a sequence open one each.  The others are placed in supersteps,
   by classes of length: (L/4, L/2], (L/8, L/4] and so on.  A superstep range-sorts the
   pieces left in the class together with all open gaps by falling size and sweeps
   them: from the longest piece on, each takes its successor, the smallest gap that
   still holds it.  Where several pieces ask for one gap the better rank wins and the
   next takes the next larger free gap.  Each range sweeps by itself; what it leaves
   open is matched between ranges from the counts of their left pieces and gaps, and
   those pieces and gaps are joined.  Then the gaps shrink and the next superstep sees
   them.  A gap takes one piece in a superstep; only where pieces are many times more
   than gaps is a gap cut into slots of the class's length first.  When a superstep
   places less than ``FEW`` of the pieces left, new sequences are opened for the rest.
4. The places inside a sequence are the running sums of its lengths.

The driver sees counts by range and by length, never pieces or gaps.

Defined cases: a null text counts as empty and is the end token alone; a document
of exactly a sequence's length is not cut; repeated rows are packed as documents
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LENGTH = 2048
END = 0
#: Shortest class of lengths, as a part of a sequence: all pieces up to it are one class.
LEAST_CLASS = 64
#: Share of the pieces left that a superstep has to place, or else new sequences are opened; and of the last class.
FEW, FEW_LAST = 0.3, 0.05
#: So many times more pieces than gaps make a superstep cut gaps into slots.
CROWD = 4
#: Rows of a range in a superstep, about, and the least number of ranges.
RANGE_ROWS, LEAST_RANGES = 25_000, 4
#: Words up to this many bytes are remembered, up to so many in each of two generations.
MEMO_BYTES, MEMO_ENTRIES = 48, 400_000

_TOKENIZERS: dict[str, "ChunkTokenizer"] = {}


#: Texts of these characters alone are cut into words here, by the tokenizer's own rule; all others chunk by chunk, and chunks of other characters go to the library whole.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ\\x20\\x09-\\x0D]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\x20\\x09-\\x0D]+")


class ChunkTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The model drops white space and never merges across it, nor across words, so the
    words of plain texts are encoded once each.  New words are encoded together; the
    mark at the end of a word tells their ids apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, missing: set[str]) -> None:
        """Put the ids of words that are not in ``words`` there."""
        if len(self.words) + len(missing) > MEMO_ENTRIES:  # the older half goes, what is still in use comes back from it
            self.words, self.older = {}, self.words
        found = {w: self.older[w] for w in missing if w in self.older}
        new = [w for w in missing if w not in found]
        if new:
            ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(new):
                raise ValueError("the tokenizer joined or split words")
            data, at = ids.tobytes(), 0
            for word, cut in zip(new, (4 * cuts).tolist(), strict=True):
                found[word] = data[at:cut]
                at = cut
        self.words.update(found)

    def _plain(self, text: str) -> bytes:
        words = _WORDS.findall(text.lower())
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            self._learn({w for w in words if w not in self.words})
            known = self.words
            if any(w not in known for w in words):  # the generations changed in between
                self._learn({w for w in words if w not in known})
                known = {**self.older, **self.words} if any(w not in self.words for w in words) else self.words
            found = b"".join([known[w] for w in words])
            for word in {w for w in words if len(w) > MEMO_BYTES}:
                self.words.pop(word, None)
            return found

    def encode(self, data: bytes) -> bytes:
        text = data.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        parts = []
        for chunk in data.split():
            text = chunk.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                parts.append(self._plain(text))
            else:
                parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
        return b"".join(parts)


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_file: str, limit: int = LENGTH) -> DataFrame:
    """One row per piece: pid (a row id), doc_id, piece, start, length, ids_crc32; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokenizer(tokenizer_file), np.array([END], dtype="<u4").tobytes()
        pid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = memoryview(encoder.encode(text or b"") + end)
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((pid, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    pid += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["pid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, PIECES), "pieces")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank: from 0, by falling length and then pid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, seen = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.assign(shard=shard, place=np.arange(seen, seen + len(frame), dtype=np.int64))
            seen += len(frame)

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", shard int, place long"
    order = [F.desc("length"), F.asc("pid")]
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, schema), "ranked")
    before, total = [], 0
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    for shard in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(shard, 0)
    starts = F.array(*[F.lit(x) for x in before]).cast("array<bigint>")
    return placed.withColumn("rank", F.col("place") + F.element_at(starts, F.col("shard") + 1)).drop("shard", "place")


#: A piece that took a gap, a piece or a gap that its range left open.
_PAIR, _PIECE, _GAP = 0, 1, 2
_SWEPT = "kind int, shard int, idx long, rank long, length long, seq long, size long"


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sweep one range, sorted by falling size with gaps before pieces: every piece takes the last gap that is free, which is the smallest that holds it."""
    shard, free, left = TaskContext.get().partitionId(), [], 0
    for frame in frames:
        out: list[tuple] = []
        for is_piece, rank, seq, size in zip(frame["is_piece"].tolist(), frame["rank"].tolist(), frame["seq"].tolist(), frame["size"].tolist(), strict=True):
            if not is_piece:
                free.append((seq, size))
            elif free:
                gap = free.pop()
                out.append((_PAIR, 0, rank, size, *gap))
            else:
                out.append((_PIECE, left, rank, size, -1, -1))
                left += 1
        yield _frame(shard, out)
    for start in range(0, len(free), 20_000):
        yield _frame(shard, [(_GAP, start + k, -1, -1, *gap) for k, gap in enumerate(free[start : start + 20_000])])


def _frame(shard: int, rows: list[tuple]) -> pd.DataFrame:
    kind, idx, rank, length, seq, size = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 6))
    return pd.DataFrame({"kind": kind.astype(np.int32), "shard": np.full(len(kind), shard, dtype=np.int32), "idx": idx, "rank": rank, "length": length, "seq": seq, "size": size})


def between_ranges(left: dict[int, tuple[int, int]]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[tuple[int, int]]], int]:
    """Which left pieces take which left gaps of earlier ranges, the last gap first, from the counts (pieces, gaps) of each range.

    Returns for pieces and for gaps, by range, steps (first idx, number of the pair there); in the
    gaps numbers rise as idx falls, an idx before the first step is not paired.  And the number of pairs.
    """
    free: list[list[int]] = []  # ranges with free gaps: [range, how many]
    of_pieces: dict[int, list[tuple[int, int]]] = {}
    of_gaps: dict[int, list[tuple[int, int]]] = {}
    pairs = 0
    for shard in sorted(left):
        n, gaps = left[shard]
        at, steps = 0, of_pieces.setdefault(shard, [])
        while at < n and free:
            there, have = free[-1]
            take = min(n - at, have)
            steps.append((at, pairs))
            of_gaps.setdefault(there, []).append((have - take, pairs + take - 1))
            pairs, at = pairs + take, at + take
            free[-1][1] -= take
            if not free[-1][1]:
                free.pop()
        steps.append((at, -1))  # from here on without a gap
        if gaps:
            free.append([shard, gaps])
    return of_pieces, of_gaps, pairs


def _paired(swept: DataFrame, left: dict[int, tuple[int, int]]) -> DataFrame:
    """Left pieces and gaps with ``pair``: the number of the pair between ranges, or -1."""
    of_pieces, of_gaps, _ = between_ranges(left)
    steps = {(_PIECE, s): (np.array([x for x, _ in v]), np.array([p for _, p in v]), 1) for s, v in of_pieces.items()}
    steps |= {(_GAP, s): (np.array([-1, *[x for x, _ in reversed(v)]]), np.array([-1, *[p for _, p in reversed(v)]]), -1) for s, v in of_gaps.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pair = np.full(len(frame), -1, dtype=np.int64)
            kind, shard, idx = (frame[c].to_numpy() for c in ("kind", "shard", "idx"))
            for k, s in set(zip(kind.tolist(), shard.tolist(), strict=True)):
                if (k, s) in steps:
                    first, number, way = steps[k, s]
                    here = (kind == k) & (shard == s)
                    at = np.searchsorted(first, idx[here], side="right") - 1
                    pair[here] = np.where(number[at] < 0, -1, number[at] + way * (idx[here] - first[at]))
            yield frame.assign(pair=pair)

    return swept.where(f"kind <> {_PAIR}").mapInPandas(run, f"{_SWEPT}, pair long")


def _superstep(todo: DataFrame, gaps: DataFrame, slotted: bool, ranges: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One sweep of pieces (rank, length) over gaps (seq, size): (placed, pieces left, gaps left, how many were placed). Slots of one sequence become one gap again."""
    both = todo.select(F.lit(True).alias("is_piece"), "rank", F.lit(-1).cast("long").alias("seq"), F.col("length").alias("size"))
    both = both.unionByName(gaps.select(F.lit(False).alias("is_piece"), F.lit(-1).cast("long").alias("rank"), "seq", "size"))
    order = [F.desc("size"), F.asc("is_piece"), F.asc("rank"), F.asc("seq")]
    swept = materialize(both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(_sweep, _SWEPT), "swept")
    tally = [F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in ((_PAIR, "pairs"), (_PIECE, "pieces"), (_GAP, "gaps"))]
    counts = swept.groupBy("shard").agg(*tally).collect()  # one row a range
    left = {r["shard"]: (r["pieces"], r["gaps"]) for r in counts}
    number = sum(r["pairs"] for r in counts)
    rest = materialize(_paired(swept, left), "left")
    placed = swept.where(f"kind = {_PAIR}").select("rank", "length", "seq", "size")
    if between := between_ranges(left)[2]:
        far = rest.where(f"kind = {_PIECE} and pair >= 0").select("pair", "rank", "length").join(rest.where(f"kind = {_GAP} and pair >= 0").select("pair", "seq", "size"), "pair").drop("pair")
        placed = placed.unionByName(materialize(far, "far"))
    shrunk = placed.select("seq", (F.col("size") - F.col("length")).alias("size")).unionByName(rest.where(f"kind = {_GAP} and pair < 0").select("seq", "size"))
    if slotted:
        shrunk = materialize(shrunk.groupBy("seq").agg(F.sum("size").alias("size")), "gaps")
    return placed.select("rank", "length", "seq"), rest.where(f"kind = {_PIECE} and pair < 0").select("rank", "length"), shrunk.where("size > 0"), number + between


def _slots(gaps: DataFrame, longest: int) -> DataFrame:
    """Each gap as slots of ``longest`` and one for the rest."""
    whole = F.floor(F.col("size") / longest).cast("int")
    sizes = F.concat(F.array_repeat(F.lit(longest).cast("long"), whole), F.array(F.col("size") - whole * longest))
    return gaps.select("seq", F.explode(F.filter(sizes, lambda x: x > 0)).alias("size"))


def place(rows: DataFrame, limit: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to ranked rows (rank, length and others), drops rank."""
    spark = rows.sparkSession
    lengths = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `limit` rows
    long = rows.where(F.col("length") > limit // 2).select("rank", "length", F.col("rank").alias("seq"))  # the first ranks
    opened = sum(n for size, n in lengths.items() if size > limit // 2)
    placed = [long]
    gaps = long.where(F.col("length") < limit).select("seq", (limit - F.col("length")).alias("size"))
    free = sum(n for size, n in lengths.items() if limit // 2 < size < limit)
    longest = limit // 2
    while longest:
        shortest = 0 if longest <= max(1, limit // LEAST_CLASS) else longest // 2
        left = sum(n for size, n in lengths.items() if shortest < size <= longest)
        todo = rows.where((F.col("length") > shortest) & (F.col("length") <= longest)).select("rank", "length")
        number, more = left, 0
        if not shortest:  # lengths differ by more than twice here: room is counted in tokens first
            more = max(0, -(-(sum(size * n for size, n in lengths.items()) - opened * limit) // limit)) if left else 0
        while left:
            slotted = left > CROWD * free
            if slotted:
                gaps = _slots(gaps, longest)
            if not more and (not free or number < (FEW if shortest else FEW_LAST) * left):
                more = -(-left // (limit // longest))  # so many surely hold the rest
            if more:
                new = spark.range(opened, opened + more).select(F.col("id").alias("seq"), F.lit(limit).cast("long").alias("size"))
                gaps, slotted = gaps.unionByName(_slots(new, longest)), True
                opened, free, more = opened + more, free + more, 0
            done, todo, gaps, number = _superstep(todo, gaps, slotted, max(LEAST_RANGES, -(-(left + free) // RANGE_ROWS)))
            placed.append(done)
            left -= number
        longest = shortest
    whole = placed[0]
    for part in placed[1:]:
        whole = whole.unionByName(part)
    # At most `limit` pieces share a sequence.
    within = Window.partitionBy("seq").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("rank", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long").alias("offset"))
    return rows.join(offsets, "rank").drop("rank")


def pack_documents(docs: DataFrame, tokenizer_file: str, limit: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return place(ranked(pieces(docs, tokenizer_file, limit)), limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

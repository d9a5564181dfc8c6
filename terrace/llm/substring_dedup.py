"""Substring deduplication by compaction of a de Bruijn graph of token k-mers.

The edges of the graph are the ``WINDOW``-word windows; an edge joins two nodes, the
sequences of one word less at its two ends.  Wanted are the edges that start at more
than one place of the corpus.  Shuffling every edge would cost more than the corpus
itself, so the graph is first thinned out:

1. Anchors.  Every window has a smallest ``ANCHOR``-word k-mer (by a hash order);
   about a tenth of the positions are the smallest of some window.  Equal windows
   have equal anchors at equal offsets, so a window whose anchor starts at one place
   only is not repeated.  A partial aggregation by anchor finds the lone ones, and a
   join brings their places back to their documents.
2. Edges.  Only windows with a repeated anchor become edges of the graph: (hash,
   document, place).  A second partial aggregation finds the edges with one source
   place, and a join brings those back.
3. Spans.  What is left of each document are runs of consecutive repeated edges, its
   spans.  Equal spans (by the SHA-256 of their words) become one trail with a number of
   sources, so a passage that thousands of documents share is from here on one row.
4. Compaction.  The nodes of all trails are aggregated with the node before and after.
   A node where these differ, or where a trail begins or ends, is a junction; a join
   brings the junctions back to the trails, which are cut there.  The pieces between
   junctions are the nonbranching paths: every trail that meets one runs along all of it.
5. Verification.  Edges were compared by 64-bit hashes so far; paths are compared by the
   SHA-256 of their words at their source coordinates.  A path that has two sources is
   repeated.  One that has a single source owes it to a collision of hashes; its
   windows are then compared one by one, and documents with an edge that fails are
   computed again without it.

The first two aggregations return the lone keys, not the repeated ones: a lone key has exactly
one source, so no join ever meets a hot key, however many copies a passage has.  All
joins are by document.  Texts are shuffled compressed.

Hashes are 64-bit: word hashes (XXH64) combined by a rolling polynomial, mixed.

Defined cases: a null or empty text has no words; a text under ``WINDOW`` words
keeps all; rows with a repeated or null doc_id are told apart by a row id of their
own (their texts repeat each other, so long ones are removed); an empty table gives
an empty result; extra columns are ignored or carried untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

WINDOW = 35
ANCHOR = 8
#: Visits of a node beyond which a junction is dealt to several tasks, and the largest table of such nodes that is broadcast.
HOT_NODE = 10_000
BROADCAST_NODES = 500_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _WordHashes(dict):
    """Word to XXH64, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Grams:
    """Rolling hashes of word sequences and window minima, for one Python task."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64):
        self.window, self.anchor, self.drop = window, anchor, np.uint64(64 - bits)
        self.words = _WordHashes()
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << n.bit_length()
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base & _MASK, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.words.__getitem__, words)), dtype=np.uint64)

    def rolled(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of each k consecutive values."""
        n = len(values)
        self._powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.power[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.inverse[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) >> self.drop

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of every k-mer, smallest of each window, places that are the smallest of some window)."""
        grams = self.rolled(values, self.anchor)
        width = self.window - self.anchor + 1
        low = _sliding(grams, width, np.minimum)
        edge = np.zeros(width - 1, dtype=np.uint64)
        best = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
        return grams, low, np.flatnonzero(best == grams)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` consecutive values, by doubling."""
    out, step, n = values, 1, len(values) - width + 1
    while 2 * step <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[:n], out[width - step :][:n]) if step < width else out


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _identified(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """Adds a column of its own, and its name: the doc_id where it tells all rows apart (True), else a row id in a written table (False)."""
    mark = fresh(docs, "did")
    repeats = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeats.isEmpty():
        return docs.withColumn(mark, F.col("doc_id").cast("long")), mark, True
    return materialize(docs.withColumn(mark, F.monotonically_increasing_id()), "documents"), mark, False


def _sources(keys: list[np.ndarray], places: list[np.ndarray], dids: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(join(keys, np.uint64).view(np.int64)), pa.array(join(dids, np.int64)), pa.array(join(places, np.int32).astype(np.int32))], ["key", "did", "place"]
    )


def _lone(sources: DataFrame, name: str) -> DataFrame:
    """(did, name): the places of each document whose key starts nowhere else."""
    once = sources.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("did"), F.min("place").alias("place")).where("n = 1")
    return once.groupBy("did").agg(F.collect_list("place").alias(name))  # at most a document's own length


def _packed(texts: DataFrame) -> DataFrame:
    """(did, blob): compressed texts, for shuffling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [squeeze.compress(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["did", "blob"])

    return texts.mapInArrow(run, "did long, blob binary")


def _places(column: pa.Array) -> Iterator[np.ndarray]:
    """Each list as an array, null as empty."""
    for x in column:
        yield np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, dtype=np.int64)


def _repeated_candidates(grams: Grams, values: np.ndarray, lone: np.ndarray) -> np.ndarray:
    """Places of windows whose anchor is repeated."""
    kmers, low, _ = grams.anchors(values)
    return np.flatnonzero(~np.isin(low, kmers[lone]))


def repeated_edges(texts: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    """(did, blob, lone, single) of every text (did, text): what :func:`spans_of` needs."""

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(window, anchor, bits)
        for batch in batches:
            keys, places, dids = [], [], []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = _split(text)
                if len(words) >= window:
                    kmers, _, at = grams.anchors(grams.hashes(words))
                    keys.append(kmers[at])
                    places.append(at)
                    dids.append(np.full(len(at), did, dtype=np.int64))
            yield _sources(keys, places, dids)

    def find_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, unpack = Grams(window, anchor, bits), zstandard.ZstdDecompressor()
        for batch in batches:
            keys, places, dids = [], [], []
            for did, blob, lone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _places(batch.column(2)), strict=True):
                words = _split(unpack.decompress(blob))
                if len(words) >= window:
                    values = grams.hashes(words)
                    at = _repeated_candidates(grams, values, lone)
                    if len(at):
                        keys.append(grams.rolled(values, window)[at])
                        places.append(at)
                        dids.append(np.full(len(at), did, dtype=np.int64))
            yield _sources(keys, places, dids)

    kind = "key long, did long, place int"
    lone = materialize(_lone(texts.mapInArrow(find_anchors, kind), "lone"), "lone-anchors")
    packed = _packed(texts)
    edges = packed.join(lone, "did", "left").select("did", "blob", "lone").mapInArrow(find_edges, kind)
    single = _lone(edges, "single")
    back = lone.join(single, "did", "full_outer")
    return packed.join(back, "did", "left").select("did", "blob", "lone", "single")


def spans_of(grams: Grams, words: list[bytes], lone: np.ndarray, single: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive repeated edges: (place of the first, number)."""
    if len(words) < grams.window:
        return []
    repeated = np.setdiff1d(_repeated_candidates(grams, grams.hashes(words), lone), single, assume_unique=True)
    return _runs(repeated)


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    first = np.flatnonzero(np.diff(places, prepend=places[0] - 2) > 1)
    return list(zip(places[first].tolist(), np.diff(np.append(first, len(places))).tolist(), strict=True))


def _gone(n: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n words lie in a span."""
    gone = np.zeros(n, dtype=bool)
    for start, edges in spans:
        gone[start : start + edges + window - 1] = True
    return gone


_SPAN = "struct<start:int,edges:int,digest:binary,words:binary>"
_DONE = f"did long, n_words long, n_removed long, out string, spans array<{_SPAN}>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("edges", pa.int32()), ("digest", pa.binary()), ("words", pa.binary())]))


def _cut(text: bytes, words: list[bytes], spans: list[tuple[int, int]], window: int, form) -> tuple[int, int, str | None]:
    gone = _gone(len(words), spans, window)
    removed = int(gone.sum())
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words)
    return len(words), removed, form(kept, removed)


def _documents(edges: DataFrame, window: int, anchor: int, bits: int, form) -> DataFrame:
    """What is left of every document without its spans, and the spans with their words, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, unpack, squeeze = Grams(window, anchor, bits), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS]
        for batch in batches:
            rows = []
            for did, blob, lone, single in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _places(batch.column(2)), _places(batch.column(3)), strict=True):
                text = unpack.decompress(blob)
                words = _split(text)
                spans, told = spans_of(grams, words, lone, single), []
                for start, edges in spans:
                    passage = b" ".join(words[start : start + edges + window - 1])
                    told.append({"start": start, "edges": edges, "digest": hashlib.sha256(passage).digest(), "words": squeeze.compress(passage)})
                rows.append((did, *_cut(text, words, spans, window, form), told))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["did", "n_words", "n_removed", "out", "spans"])

    return materialize(edges.mapInArrow(run, _DONE), "spans")


def trails_of(done: DataFrame) -> DataFrame:
    """Distinct spans: trail (an id), n (how many sources), did and start of one source, edges, words; written once."""
    spans = done.select("did", F.explode("spans").alias("s")).select("did", "s.start", "s.edges", "s.digest", "s.words")
    each = spans.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "start", "edges", "words")).alias("at"))
    return materialize(each.select(F.monotonically_increasing_id().alias("trail"), "n", "at.did", "at.start", "at.edges", "at.words"), "trails")


def _nodes(grams: Grams, words: list[bytes]) -> np.ndarray:
    return grams.rolled(grams.hashes(words), grams.window - 1)


def _visits(trails: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    """(node, trail, pos, around) of every node along the trails; ``around`` tells the nodes before and after, 0 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, unpack = Grams(window, anchor, bits), zstandard.ZstdDecompressor()
        for batch in batches:
            for trail, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes = _nodes(grams, _split(unpack.decompress(blob)))
                short = np.concatenate([[0], (nodes % np.uint64((1 << 31) - 1)).astype(np.int64) + 1, [0]])
                around = short[:-2] << 32 | short[2:]
                for start in range(0, len(nodes), 100_000):
                    part = slice(start, start + 100_000)
                    n = len(nodes[part])
                    columns = [pa.array(nodes[part].view(np.int64)), pa.array(np.full(n, trail)), pa.array(np.arange(start, start + n, dtype=np.int32)), pa.array(around[part])]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "trail", "pos", "around"])

    return trails.select("trail", "words").mapInArrow(run, "node long, trail long, pos int, around long")


def _cuts(visits: DataFrame, hot_node: int) -> DataFrame:
    """trail, cuts: the places of the junctions along each trail."""
    degrees = visits.groupBy("node").agg(F.min("around").alias("one"), F.max("around").alias("other"), F.count(F.lit(1)).alias("n"))
    junctions = materialize(degrees.where("one <> other").select("node", F.ceil(F.col("n") / hot_node).cast("int").alias("salts")), "junctions")
    hot = junctions.where("salts > 1")
    n_hot = hot.count()
    places = visits.select("node", "trail", "pos").withColumn("salt", F.lit(0))
    if n_hot:  # visits of a hot node are dealt by trail and place
        places = places.drop("salt").join(F.broadcast(hot) if n_hot <= BROADCAST_NODES else hot, "node", "left")
        places = places.withColumn("salt", F.pmod(F.xxhash64("trail", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    salted = junctions.select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return places.join(salted, ["node", "salt"]).groupBy("trail").agg(F.collect_list("pos").alias("cuts"))  # at most a trail's own length


def compacted(trails: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64, hot_node: int = HOT_NODE) -> DataFrame:
    """Nonbranching paths along each trail: trail, first and last (edges from, to), n, digest of the words; written once."""
    cuts = _cuts(_visits(trails, window, anchor, bits), hot_node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for trail, n, edges, blob, at in zip(*(batch.column(k).to_pylist() for k in range(4)), _places(batch.column(4)), strict=True):
                words = _split(unpack.decompress(blob))
                ends = np.union1d(at, [0, edges]).tolist()
                for first, last in zip(ends, ends[1:], strict=False):
                    rows.append((trail, first, last, n, hashlib.sha256(b" ".join(words[first : last + window - 1])).digest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["trail", "first", "last", "n", "digest"])

    joined = trails.join(cuts, "trail", "left").select("trail", "n", "edges", "words", "cuts")
    return materialize(joined.mapInArrow(run, "trail long, first int, last int, n long, digest binary"), "paths")


def repeated_paths(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The compacted graph: did (the doc_id, or a row id where that does not tell rows apart) and place of one source, n_words and sources of every repeated path."""
    rows, mark, _ = _identified(docs.select("doc_id", "text"))
    texts = rows.select(F.col(mark).alias("did"), F.col("text").cast("string").alias("text"))
    trails = trails_of(_documents(repeated_edges(texts, window, anchor, 64), window, anchor, 64, lambda kept, removed: None))
    at = compacted(trails, window, anchor).join(trails.select("trail", "did", "start"), "trail")
    at = at.groupBy("digest").agg(F.sum("n").alias("sources"), F.min(F.struct("did", F.col("start") + F.col("first"), F.col("last") - F.col("first") + window - 1)).alias("p"))
    return at.select(F.col("p.did").alias("did"), F.col("p.col2").alias("place"), F.col("p.col3").cast("long").alias("n_words"), "sources")


def false_edges(trails: DataFrame, paths: DataFrame, window: int, anchor: int, bits: int) -> DataFrame | None:
    """(did, place) of edges that only look repeated because hashes collide; None if there are none."""
    once = paths.groupBy("digest").agg(F.sum("n").alias("n"), F.min("trail").alias("trail"), F.min("first").alias("first"), F.min("last").alias("last")).where("n = 1")
    doubtful = materialize(once.select("trail", "first", "last"), "doubtful")
    if doubtful.isEmpty():
        return None

    def edges(words: list[bytes], grams: Grams) -> np.ndarray:
        return grams.rolled(grams.hashes(words), window)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, unpack = Grams(window, anchor, bits), zstandard.ZstdDecompressor()
        for batch in batches:
            for blob, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(edges(_split(unpack.decompress(blob)), grams)[first:last].view(np.int64))], ["edge"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, unpack = Grams(window, anchor, bits), zstandard.ZstdDecompressor()
        for batch in batches:
            for trail, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = edges(_split(unpack.decompress(blob)), grams).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), trail)), pa.array(np.arange(len(found), dtype=np.int32))], ["edge", "trail", "pos"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for trail, n, did, start, blob, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _split(unpack.decompress(blob))
                found = [hashlib.sha256(b" ".join(words[k : k + window])).digest() for k in at]
                size = len(at)
                columns = [pa.array(found, pa.binary()), pa.array([n] * size, pa.int64()), pa.array([did] * size, pa.int64()), pa.array([start + k for k in at], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "did", "place"])

    suspects = doubtful.join(trails, "trail").select("words", "first", "last").mapInArrow(wanted, "edge long").distinct()
    places = trails.select("trail", "words").mapInArrow(windows, "edge long, trail long, pos int").join(suspects, "edge", "left_semi")
    places = places.groupBy("trail").agg(F.collect_list("pos").alias("at"))  # at most a trail's own length
    exact = trails.join(places, "trail").select("trail", "n", "did", "start", "words", "at").mapInArrow(digests, "digest binary, n long, did long, place int")
    lonely = exact.groupBy("digest").agg(F.sum("n").alias("n"), F.min("did").alias("did"), F.min("place").alias("place")).where("n = 1")
    return materialize(lonely.select("did", "place"), "false-edges")


def _kept(texts: DataFrame, window: int, anchor: int, bits: int, form) -> DataFrame:
    """did, n_words, n_removed, out of every text (did, text): the compacted and verified result."""
    done = _documents(repeated_edges(texts, window, anchor, bits), window, anchor, bits, form)
    trails = trails_of(done)
    result = done.select("did", "n_words", "n_removed", "out")
    if trails.where("n = 1").isEmpty():  # every span is the whole of another one, word by word
        return result
    wrong = false_edges(trails, compacted(trails, window, anchor, bits), window, anchor, bits)
    if wrong is None:
        return result

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for did, text, spans, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (text or "").encode()
                places = np.concatenate([np.arange(s["start"], s["start"] + s["edges"]) for s in spans])
                rows.append((did, *_cut(text, _split(text), _runs(np.setdiff1d(places, bad)), window, form)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["did", "n_words", "n_removed", "out"])

    wrong = wrong.groupBy("did").agg(F.collect_list("place").alias("bad"))  # at most a document's own length
    spans = done.select("did", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["edges"].alias("edges"))).alias("spans"))
    mended = texts.join(wrong, "did").join(spans, "did").select("did", "text", "spans", "bad").mapInArrow(again, "did long, n_words long, n_removed long, out string")
    mended = materialize(mended, "mended")
    return result.join(mended.select("did"), "did", "left_anti").unionByName(mended)


def kept_digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows, mark, same = _identified(docs.select("doc_id", "text"))
    texts = rows.select(F.col(mark).alias("did"), F.col("text").cast("string").alias("text"))
    done = _kept(texts, window, anchor, bits, lambda kept, removed: hashlib.sha256(kept).hexdigest()).withColumnRenamed("out", "kept_sha256")
    if not same:
        done = done.join(rows.select("doc_id", F.col(mark).alias("did")), "did")
        return done.select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.select(F.col("did").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All documents with their columns; where words were removed, ``text`` is the kept words joined by a space and ``n_chars`` its length."""
    names = docs.columns
    rows, mark, _ = _identified(docs)
    texts = rows.select(F.col(mark).alias("did"), F.col("text").cast("string").alias("text"))
    done = _kept(texts, window, anchor, 64, lambda kept, removed: kept.decode() if removed else None)
    new = fresh(rows, "kept_text")
    changed = done.where("n_removed > 0").select(F.col("did").alias(mark), F.col("out").alias(new))
    joined = rows.join(changed, mark, "left")
    out = joined.withColumn("text", F.coalesce(new, F.col("text").cast("string")))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.char_length(new).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*names)

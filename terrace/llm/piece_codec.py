"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a text the table stores the one token that ends its encoding.
An automaton over the vocabulary lists the tokens that end at a position; the
right one is the token t that is compatible with the token stored where t begins:
two tokens are compatible if encoding their concatenation gives just these two.
The ids are then read backwards along the table, in time linear in the text.

No vocabulary piece holds an inner word-begin mark (U+2581) besides pure runs of
it, and characters outside the vocabulary never merge, so a text is cut before
each run of marks and around line breaks.  Characters that stand side by side in
a piece are put into one class; no merge crosses from one class to another (such as
letters and punctuation), so a text is cut there, too.  Equal segments are encoded
once and remembered up to a bound.  Runs of marks have a tie in their merge scores (the
leftmost pair wins) and merge after everything else, so they are taken apart by
that rule.

Defined cases: a null text counts as empty and has no ids; an empty table gives an
empty result; repeated rows are encoded alike; any character encodes, through
byte pieces if need be; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Classes of fewer characters are not told apart.
CLASS_CHARS = 16
#: Segments up to this length are remembered, up to so many.
MEMO_CHARS, MEMO_ENTRIES = 48, 120_000
_FREE = -1  # stands for a character outside the vocabulary


def character_classes(pieces: Iterable[str]) -> list[str]:
    """Sets of characters linked by standing side by side in a piece, marks left out; the larger sets only."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while above.setdefault(c, c) != c:
            above[c] = c = above.setdefault(above[c], above[c])
        return c

    for piece in pieces:
        bare = piece.replace(MARK, "")
        for a, b in zip(bare, bare[1:], strict=False):
            above[top(a)] = top(b)
    classes = defaultdict(list)
    for c in list(above):
        classes[top(c)].append(c)
    return sorted(("".join(sorted(cs)) for cs in classes.values() if len(cs) >= CLASS_CHARS), key=lambda cs: (-len(cs), cs))


def segment_pattern(classes: list[str]) -> re.Pattern[str]:
    """A run of marks with the characters of one class, or of none, that follow it; a line break; marks alone."""
    inner = [re.escape(cs) for cs in classes]
    return re.compile(f"{MARK}*(?:{''.join(f'[{cs}]+|' for cs in inner)}[^{''.join(inner)}{MARK}\n]+)|\n|{MARK}+")


class PieceCodec:
    """Encoder and decoder for a BPE model with byte fallback, a dummy prefix and no text normalisation."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.byte_ids, self.byte_of = [0] * 256, {}
        self.rank: dict[str, tuple[float, int]] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[piece] = (-model.get_score(i), i)
        self.runs = {len(p): i for p, (_, i) in self.rank.items() if not p.strip(MARK)}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1 or piece.strip(MARK):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        if any(MARK in p[1:] for p in self.rank if p.strip(MARK)):
            raise ValueError("pieces with an inner word-begin mark are not supported")
        self.segment = segment_pattern(character_classes(self.rank))
        self.sizes = [len(p) for p in self.pieces]
        self.numbers = [str(i) for i in range(len(self.pieces))]
        self.spaced = [p.replace(MARK, " ") for p in self.pieces]
        self.fits: list[dict[int, bool]] = [{} for _ in range(len(self.pieces) + 1)]  # by left token, _FREE last: which ones may follow, remembered up to a bound
        self.n_fits = 0

    def _merged(self, text: str) -> list[int]:
        """Encoding of a short text by merging the best pair again and again; only for compatibility tests."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                found = self.rank.get(parts[k] + parts[k + 1])
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], k)
            if best is None:
                return [self.rank[p][1] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; where left is free, ``right`` has to encode to itself."""
        if self.n_fits > 400_000:
            self.n_fits = 0
            for row in self.fits:
                row.clear()
        text, wanted = self.pieces[right], [right]
        if left != _FREE:
            text, wanted = self.pieces[left] + text, [left, right]
        self.n_fits += 1
        known = self.fits[left][right] = self._merged(text) == wanted
        return known

    def _core(self, text: str) -> list[int]:
        """Ids of a text that has at most one mark, at its start."""
        fits = self.fits
        last = [_FREE] * len(text)  # the token that ends the prefix up to this character
        after = [fits[_FREE]] * (len(text) + 1)  # what is known to follow it; the empty prefix is at -1
        for end, (token, size) in self.automaton.iter(text):
            if last[end] != _FREE:
                continue  # a prefix has one last token
            known = after[end - size].get(token)
            if known is None:
                known = self._compatible(last[end - size] if size <= end else _FREE, token)
            if known:
                last[end], after[end] = token, fits[token]
        ids: list[int] = []
        sizes = self.sizes
        at = len(text) - 1
        while at >= 0:  # backwards
            token = last[at]
            if token == _FREE:
                ids += [self.byte_ids[b] for b in reversed(text[at].encode())]
                at -= 1
            else:
                ids.append(token)
                at -= sizes[token]
        ids.reverse()
        return ids

    def _run(self, n: int) -> list[int]:
        """Ids of n marks alone: the leftmost pair merges first, so a run grows from the left as far as pieces exist."""
        sizes = [1] * n
        at = 0
        while at < len(sizes) - 1:
            if sizes[at] + sizes[at + 1] in self.runs:
                sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        return [self.runs[s] for s in sizes]

    def segment_ids(self, segment: str) -> list[int]:
        bare = segment.lstrip(MARK)
        marks = len(segment) - len(bare)
        if marks <= 1:
            return self._core(segment)
        if not bare:
            return self._run(marks)
        ids = self._core(MARK + bare)
        if self.pieces[ids[0]] == MARK:  # the last mark stayed alone and belongs to the run
            return self._run(marks) + ids[1:]
        return self._run(marks - 1) + ids

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s)]

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids that hold whole byte runs, marks as spaces."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.spaced[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            value = self.byte_of.get(i)
            if value is not None:
                held.append(value)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.spaced[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_part(ids)
        return text[1:] if text.startswith(" ") else text


class _Memo(dict):
    """Segment to (ids in decimal joined by commas, decoded text)."""

    def __init__(self, codec: PieceCodec):
        self.codec, self.old = codec, {}

    def __missing__(self, segment: str) -> tuple[str, str]:
        value = self.old.get(segment)
        if value is None:
            ids = self.codec.segment_ids(segment)
            value = ",".join([self.codec.numbers[i] for i in ids]), self.codec.decode_part(ids)
        if len(segment) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:  # the older half goes, what is still in use comes back from it
                self.old = dict(self)
                self.clear()
            self[segment] = value
        return value


_LOADED: dict[str, tuple[PieceCodec, _Memo]] = {}


def loaded(model_file: str) -> tuple[PieceCodec, _Memo]:
    """The codec of this Python worker, kept between tasks."""
    if model_file not in _LOADED:
        codec = PieceCodec(model_file)
        _LOADED[model_file] = codec, _Memo(codec)
    return _LOADED[model_file]


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = loaded(model_file)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = loaded(model_file)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                numbers, texts = zip(*map(memo.__getitem__, codec.segments(text)), strict=True) if text else ((), ())
                ids = ",".join(numbers)
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded = "".join(texts)
                text_sha.append(hashlib.sha256((decoded[1:] if decoded.startswith(" ") else decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Repair of damaged conversations by the cheapest edits, with an audit of what was done.

A conversation is well formed if its roles are an optional system turn and then user and
assistant in turns, ended by the assistant.  Keep (K, free), Rerole (R, 3), Delete (D, 4)
and Insert (I, 3) make it so; blank and duplicate rows have to be deleted, truncated rows
that stay cost 3 more.  Of the cheapest edits the audit, their initials in order, is the
least in ASCII.

1. Rows that are equal in conversation, turn, role and text become one cell with a count
   (pre-aggregated before the shuffle); the first turn of each repeated role and text is
   found by digest.  Cells are written once, with their texts.
2. The cells, without texts, are range-sorted by conversation and place, so that a
   conversation of any size is spread over many tasks.  In a task the rows of a
   conversation are one segment (of ``SEGMENT`` rows at most); a dynamic program runs over
   four states (nothing yet, after system, after user, after assistant).  The edits so far
   of each state are a linked list with shared prefixes; a node has its ancestors at
   distances of powers of two and a rolling hash of all initials up to it.  Where two ways
   cost the same, their longest common prefix is searched by those hashes, and the next
   initials decide; that both ways hang on one node there verifies the hashes, and if
   they do not (a collision) the nodes themselves are compared.
3. A segment that may begin or go on in another task is solved from each state that it can
   begin in.  Segments of one conversation are chained by their costs and by the order of
   their audits (inserted rows belong to the segment of the row after them, so that of two
   audits of a segment neither can begin the other).
4. Audits and cells are sorted once more by conversation and streamed through SHA-256.

The hash of a conversation has to be taken in order: that pass reads one conversation in
one task, as a stream, with its audit (a byte a row) in memory and nothing else.

Defined cases: a null conv_id is a conversation of its own; null roles and texts are one
space, null turns come first; rows of one turn are taken by role and then by the digest of
role and text, repeated rows are adjacent; a role without characters has no initial and
must be reroled or deleted; a gap count beyond the range of long is null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of one segment, and of one cell, at most.
SEGMENT = 8192
RUN = 4096
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of a role leads from a state.
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What has to be inserted at the end of a conversation that is left in a state.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
MODULUS, BASE = (1 << 61) - 1, 1_000_003

_BLANK = "\\x20\\x09-\\x0D"
SEGMENTS = "part int, seq int, is_open boolean, illegal long, first_role string, last_role string, cost long, audit string, costs array<long>, ranks array<int>, audits array<string>"


class Prefixes:
    """Edit prefixes as linked nodes; node 0 is the empty prefix."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.modulus = modulus
        self.initial, self.depth, self.hash, self.up = [""], [0], [0], [(0,)]

    def add(self, parent: int, initial: str) -> int:
        node, lifted, at, k = len(self.depth), [parent], parent, 0
        while k < len(self.up[at]) and at:
            at = self.up[at][k]
            lifted.append(at)
            k += 1
        self.initial.append(initial)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(initial)) % self.modulus)
        self.up.append(tuple(lifted))
        return node

    def lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            ups = self.up[node]
            node = ups[min(len(ups), (self.depth[node] - depth).bit_length()) - 1]
        return node

    def _split(self, x: int, y: int, differ) -> tuple[int, int]:
        """The ancestors of two nodes of one depth just below their longest common prefix."""
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and k < len(self.up[y]) and differ(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return x, y

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of x comes before that of y; a prefix comes first."""
        shallow = min(self.depth[x], self.depth[y])
        a, b = self.lift(x, shallow), self.lift(y, shallow)
        if a == b:
            return self.depth[x] < self.depth[y]
        p, q = self._split(a, b, lambda m, n: self.hash[m] != self.hash[n])
        if self.up[p][0] != self.up[q][0] or self.initial[p] == self.initial[q]:
            p, q = self._split(a, b, lambda m, n: m != n)
        return self.initial[p] < self.initial[q]

    def audit(self, node: int) -> str:
        found = []
        while node:
            found.append(self.initial[node])
            node = self.up[node][0]
        return "".join(reversed(found))


def _better(tree: Prefixes, best: dict[int, tuple[int, int]], state: int, cost: int, parent: int, initial: str) -> None:
    if state in best and best[state][0] < cost:
        return
    node = tree.add(parent, initial)
    if state not in best or cost < best[state][0] or tree.less(node, best[state][1]):
        best[state] = (cost, node)


def solve(rows: list[tuple[str, bool, bool]], entry: int, tree: Prefixes) -> dict[int, tuple[int, int]]:
    """Rows (role initial, must go, truncated): for each state at the end the least cost and the least audit's node."""
    now = {entry: (0, 0)}
    for initial, gone, truncated in rows:
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in now.items():
            _better(tree, after, state, cost + DELETE, node, "D")
        if not gone:
            # A row inserted before a deleted one could as well, and with a smaller audit, be inserted after it.
            opened = dict(now)
            for state in (START, SYSTEM, ASSISTANT):
                if state in now:
                    _better(tree, opened, USER, now[state][0] + INSERT, now[state][1], "I")
            if USER in opened:
                _better(tree, opened, ASSISTANT, opened[USER][0] + INSERT, opened[USER][1], "I")
            more = UNFINISHED if truncated else 0
            for state, (cost, node) in opened.items():
                kept = FOLLOWS.get(initial, {}).get(state)
                if kept is not None:
                    _better(tree, after, kept, cost + KEEP + more, node, "K")
                for role in "ua":
                    if state in FOLLOWS[role]:
                        _better(tree, after, FOLLOWS[role][state], cost + REROLE + more, node, "R")
        now = after
    return now


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class _Segment:
    """Rows of one conversation that follow each other in one task."""

    def __init__(self, conversation, seq: int, unknown_start: bool) -> None:
        self.conversation, self.seq, self.unknown_start = conversation, seq, unknown_start
        self.rows: list[tuple[str, bool, bool]] = []

    def record(self, part: int, is_open: bool) -> tuple:
        illegal = sum(not _legal(a[0], b[0]) for a, b in zip(self.rows, self.rows[1:]))
        costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
        for entry in range(4) if self.unknown_start else (START,):
            tree = Prefixes()
            ends = solve(self.rows, entry, tree)
            if entry == START:
                best = min(cost + INSERT * len(ENDS[s]) for s, (cost, _) in ends.items())
                least = [s for s, (cost, _) in ends.items() if cost + INSERT * len(ENDS[s]) == best]
                least.sort(key=cmp_to_key(lambda s, t: -1 if tree.less(ends[s][1], ends[t][1]) else 1))
                audit = tree.audit(ends[least[0]][1]) + ENDS[least[0]]
            if is_open:
                order = sorted(ends, key=cmp_to_key(lambda s, t: -1 if tree.less(ends[s][1], ends[t][1]) else 1))
                for s, (cost, node) in ends.items():
                    costs[4 * entry + s], ranks[4 * entry + s], audits[4 * entry + s] = cost, order.index(s), tree.audit(node)
        more = (costs, ranks, audits) if is_open else (None, None, None)
        return (self.conversation, part, self.seq, is_open, illegal, self.rows[0][0], self.rows[-1][0], best, audit, *more)


def _segments(longest: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, seq = TaskContext.get().partitionId(), None, [], 0

        def batch(records: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records), schema)], schema=schema)

        for rows in batches:
            names = ("conv_id", "initial", "blank", "truncated", "is_first", "copies")
            for conversation, initial, blank, truncated, is_first, copies in zip(*(rows[n].to_pylist() for n in names)):
                for k in range(copies):
                    if now is None or now.conversation != conversation or len(now.rows) >= longest:
                        if now is not None:
                            whole = now.conversation != conversation and not now.unknown_start
                            held.append(now.record(part, not whole))
                        now = _Segment(conversation, seq, now is None or now.conversation == conversation)
                        seq += 1
                    now.rows.append((initial, blank or not is_first or k > 0, truncated))
            if len(held) >= 1000:
                yield batch(held)
                held = []
        if now is not None:
            held.append(now.record(part, True))
        if held:
            yield batch(held)

    return run


def chain(segments: list[tuple[list, list]]) -> list[int]:
    """From the (costs, ranks) of a conversation's segments in order, the pair 4 * entry + exit that each one takes."""
    inf = float("inf")
    ahead = [[INSERT * len(ENDS[s]) for s in range(4)]]
    for costs, _ in reversed(segments):
        ahead.append([min((costs[4 * p + q] + ahead[-1][q] for q in range(4) if costs[4 * p + q] is not None), default=inf) for p in range(4)])
    ahead.reverse()
    state, picks = START, []
    for k, (costs, ranks) in enumerate(segments):
        good = [q for q in range(4) if costs[4 * state + q] is not None and costs[4 * state + q] + ahead[k + 1][q] == ahead[k][state]]
        exit_ = min(good, key=lambda q: ranks[4 * state + q])
        picks.append(4 * state + exit_)
        state = exit_
    return picks


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "seq"], ignore_index=True)
    lists = [([None if pd.isna(x) else int(x) for x in c], [None if pd.isna(x) else int(x) for x in r]) for c, r in zip(rows["costs"], rows["ranks"])]
    picks = chain(lists)
    rows["pick"] = picks
    rows["cost"] = [c[p] for (c, _), p in zip(lists, picks)]
    rows["tail"] = [""] * (len(rows) - 1) + [ENDS[picks[-1] % 4]]
    rows["seam"] = [0, *(int(not _legal(a, b)) for a, b in zip(rows["last_role"], rows["first_role"][1:]))]
    return rows[["part", "seq", "pick", "cost", "tail", "seam"]]


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by the checksum of conversation and turn; columns conv_id, turn, role, text, copies."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def _cells(rows: DataFrame, run: int) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) as written cells with their faults; of the rows of a cell all but the first are duplicates."""
    cells = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    cells = cells.select("*", digest.alias("digest"), F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated"))
    cells = materialize(cells, "conversation-cells")
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = cells.groupBy("conv_id", "digest").agg(F.count("*").alias("cells"), F.min(order)["turn"].alias("first_turn")).where("cells > 1")
    firsts = firsts.select(F.col("conv_id").alias("first_conv"), F.col("digest").alias("first_digest"), "first_turn", "cells")
    joined = cells.join(firsts, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("digest") == F.col("first_digest")), "left")
    marked = joined.withColumn("is_first", F.col("cells").isNull() | F.col("turn").eqNullSafe(F.col("first_turn")))
    marked = marked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {run}"))))
    marked = marked.withColumn("copies", F.least(F.lit(run).cast("long"), F.col("copies") - F.col("piece") * run)).withColumn("is_first", F.col("is_first") & (F.col("piece") == 0))
    return materialize(marked.select("conv_id", "turn", "role", "text", "digest", "initial", "blank", "truncated", "is_first", "piece", "copies"), "conversation-faults")


_PLACE = ("turn", "role", "digest", "piece")


def _audits(cells: DataFrame, longest: int) -> DataFrame:
    """conv_id, cost, audit and illegal of every conversation that has cells."""
    narrow = cells.select("conv_id", *_PLACE, "initial", "blank", "truncated", "is_first", "copies")
    narrow = narrow.repartitionByRange("conv_id", *_PLACE).sortWithinPartitions("conv_id", *_PLACE)
    kind = cells.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {SEGMENTS}"
    arrow = pa.schema([pa.field("conv_id", narrow.select("conv_id").limit(0).toArrow().schema.field(0).type)] + [
        pa.field(n, t) for n, t in (("part", pa.int32()), ("seq", pa.int32()), ("is_open", pa.bool_()), ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
                                    ("cost", pa.int64()), ("audit", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())))
    ])
    segments = materialize(narrow.mapInArrow(_segments(longest, arrow), schema), "conversation-segments")
    spread = segments.where("is_open").groupBy("conv_id").agg(F.collect_list(F.struct("part", "seq")).alias("s")).where("size(s) > 1")
    keys = materialize(spread.select(F.explode("s").alias("s")).select("s.*"), "conversation-spread")
    alone = segments.join(keys, ["part", "seq"], "left_anti").select("conv_id", "cost", "audit", "illegal")
    several = segments.join(keys, ["part", "seq"])
    narrow_schema = "part int, seq int, pick int, cost long, tail string, seam long"
    chained = several.select("conv_id", "part", "seq", "first_role", "last_role", "costs", "ranks").groupBy("conv_id").applyInPandas(_chained, narrow_schema)
    taken = several.drop("cost").join(chained, ["part", "seq"])
    whole = taken.groupBy("conv_id").agg(
        F.sum(F.col("cost") + F.when(F.col("tail") == "", 0).otherwise(INSERT * F.length("tail"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", F.concat(F.col("audits")[F.col("pick")], F.col("tail")).alias("text")))), lambda s: s["text"]), "").alias("audit"),
        F.sum(F.col("illegal") + F.col("seam")).alias("illegal"),
    )
    return materialize(alone.unionByName(whole), "conversation-audits")


def repaired_lines(audit: str) -> Iterator[tuple[str, str]]:
    """Of each initial of an audit: the initial, and the role that a reroled or inserted row gets."""
    place, odd = 0, (len(audit) - audit.count("D")) % 2
    for initial in audit:
        if initial == "D":
            yield initial, ""
        else:
            yield initial, "user" if (place - odd) % 2 == 0 else "assistant"
            place += 1


class _Repaired:
    """The repaired text of one conversation, hashed as its rows come."""

    def __init__(self, audit: str) -> None:
        self.lines, self.hash, self.begun = repaired_lines(audit), hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def row(self, role: str, text: str) -> None:
        for initial, new_role in self.lines:
            if initial == "I":
                self.line(new_role, "")
                continue
            if initial != "D":
                self.line(role if initial == "K" else new_role, text)
            return

    def digest(self) -> str:
        for _, new_role in self.lines:
            self.line(new_role, "")
        return self.hash.hexdigest()


def _hashes(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, ids, digests = None, None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])

        for rows in batches:
            for conversation, audit, role, text, copies in zip(*(rows[n].to_pylist() for n in ("conv_id", "audit", "role", "text", "copies"))):
                if audit is not None:
                    if state is not None:
                        ids.append(now)
                        digests.append(state.digest())
                    now, state = conversation, _Repaired(audit)
                    continue
                for _ in range(copies):
                    state.row(role, text)
            if ids:
                yield done()
                ids, digests = [], []
        if state is not None:
            ids.append(now)
            digests.append(state.digest())
            yield done()

    return run


def repaired_hashes(cells: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired conversation; cells and audits meet in one sorted stream."""
    kind = cells.schema["conv_id"].dataType.simpleString()
    both = cells.select("conv_id", F.lit(1).alias("what"), *_PLACE, "text", "copies", F.lit(None).cast("string").alias("audit")).unionByName(
        audits.select("conv_id", F.lit(0).alias("what"), "audit"), allowMissingColumns=True
    )
    arrow = both.select("conv_id").limit(0).toArrow().schema.field(0).type
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "what", *_PLACE).mapInArrow(_hashes(arrow), f"conv_id {kind}, repaired_sha256 string")


def _counts(cells: DataFrame) -> DataFrame:
    gone: Column = F.when(F.col("blank"), F.lit(0))
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1
    turns = cells.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(gone.when(F.col("is_first"), F.col("copies") - 1).otherwise(F.col("copies"))).alias("duplicate"),
        F.sum(gone.when(F.col("is_first") & F.col("truncated"), F.lit(1)).otherwise(0)).alias("truncated"),
    )
    return turns.groupBy("conv_id").agg(
        F.coalesce(span - F.count("turn"), F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated")
    ).select("conv_id", F.expr("try_cast(gaps as long)").alias("gaps"), F.lit(True).alias("has_rows"), "blank", "duplicate", "truncated")


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, longest: int = SEGMENT, run: int = RUN) -> DataFrame:
    """Judge and repair conversations (conv_id, turn, role, text, and copies if a row stands for several).

    Returns for each conv_id of ``ids`` (or of ``rows``) gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    cells = _cells(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies"), run)
    audits = _audits(cells, longest)
    parts = _counts(cells).unionByName(audits, allowMissingColumns=True).unionByName(repaired_hashes(cells, audits), allowMissingColumns=True)
    parts = parts.unionByName((rows if ids is None else ids).select("conv_id").distinct(), allowMissingColumns=True)
    found = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", "has_rows", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id",
        F.when(F.col("has_rows"), F.col("gaps")).otherwise(zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage conversations and repair them; one row for each original conv_id."""
    return repair_conversations(damage(conversations), conversations)

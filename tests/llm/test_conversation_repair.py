"""Conversation repair against a plain version that keeps every audit as text, with nulls, ties, long conversations over several tasks and colliding hashes."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from terrace.llm import conversation_repair as repair
from terrace.llm.oracles import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, copies2 int, part int, audit string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain(rows):
    """Rows (turn, role, text) after damage, in order: counts, cost, audit and hash."""
    blank = duplicate = truncated = 0
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        blank, duplicate, truncated = blank + (kind == "blank"), duplicate + (kind == "duplicate"), truncated + (kind == "truncated")
    best = {"": (0, "", ())}

    def put(table, state, entry):
        if state not in table or entry < table[state]:
            table[state] = entry

    def inserts(table):
        opened = dict(table)
        for _ in range(3):
            for state, (cost, audit, out) in list(opened.items()):
                for role, name in (("u", "user"), ("a", "assistant")):
                    if (state, role) in NEXT:
                        put(opened, NEXT[state, role], (cost + 3, audit + "I", (*out, name + ":")))
        return opened

    for (_, role, text), kind in zip(rows, kinds):
        after, extra = {}, 3 * (kind == "truncated")
        for state, (cost, audit, out) in inserts(best).items():
            put(after, state, (cost + 4, audit + "D", out))
            if kind not in ("blank", "duplicate"):
                if (state, role[:1]) in NEXT:
                    put(after, NEXT[state, role[:1]], (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in NEXT:
                        put(after, NEXT[state, r], (cost + 3 + extra, audit + "R", (*out, f"{name}:{text}")))
        best = after
    cost, audit, out = min(v for k, v in inserts(best).items() if k in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return sorted(rows, key=key)


def damaged(rows):
    found = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, out = zlib.crc32(name.encode()) % 20, found.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return {conv: plain(ordered(rows)) for conv, rows in found.items()}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ärger"])
            text = rng.choice([None, "", " \t\n", "Yes.", "No!", "What", "more ", "x" * 3000 + ".", "äö?\n", f"text {rng.random()}."])
            rows.append((conv, rng.choice([None, *range(-2, 12)]), role, text, 1, 2, "z"))
    return rows + rows[:5]


def collected(frame):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = [tuple(r[n] for n in names) for r in frame.collect()]
    found = {r[0]: r[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_damaged_rows_of_any_kind(spark):
    rows = random_rows(1, 150, 14)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(repair.repair_damaged(frame)) == damaged(rows)


def test_sql_says_the_same(spark):
    rows = random_rows(2, 60, 9)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "a", "b", "c"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    found = con.execute(ORACLES["op11_conversation_repair"]).fetchall()
    assert {r[0]: tuple(r[1:]) for r in found} == damaged(rows)


@pytest.mark.parametrize("longest", [1, 3, 50])
def test_a_conversation_over_many_tasks(spark, longest):
    rng = random.Random(longest)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"{t}."]), 1, 2, None) for t in range(400)]
    rows += [(7, 900, "user", "again.", 1, 2, None)] * 30 + [(c, 0, "user", "Hm.", 1, 2, None) for c in (6, 8, 9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = collected(repair.repair_conversations(frame.select("conv_id", "turn", "role", "text"), longest=longest, run=7))
    byconv = {c: plain(ordered([r[1:4] for r in rows if r[0] == c])) for c in (6, 7, 8, 9)}
    assert found == byconv


def test_empty_tables_and_dropped_conversations(spark):
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    found = collected(repair.repair_damaged(spark.createDataFrame([(3, gone, "user", "a.", 1, 1, "")], SCHEMA)))
    assert found == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    far = [(5, -(2**63), "user", "a.", 1, 1, ""), (5, 2**63 - 1, "assistant", "b.", 1, 1, "")]
    assert collected(repair.repair_conversations(spark.createDataFrame(far, SCHEMA)))[5][0] is None


@pytest.mark.parametrize("modulus", [1, 3, repair.MODULUS])
def test_ties_are_decided_even_if_hashes_collide(modulus):
    tree, rng = repair.Prefixes(modulus), random.Random(modulus)
    nodes = {"": 0}
    for _ in range(300):
        text = rng.choice(list(nodes))
        for initial in rng.choice(["D", "I", "K", "R", "DKR"]):
            if text + initial not in nodes:
                nodes[text + initial] = tree.add(nodes[text], initial)
            text += initial
    assert all(tree.audit(n) == t for t, n in nodes.items())
    some = rng.sample(list(nodes), 60)
    assert all(tree.less(nodes[a], nodes[b]) == (a < b) for a, b in itertools.product(some, some))


def test_chained_segments_equal_one_segment():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(2, 12))]
        segment = repair._Segment(1, 0, True)
        segment.rows = rows
        whole = segment.record(0, True)
        cut = sorted({0, len(rows), rng.randint(1, len(rows) - 1)})
        parts = []
        for a, b in zip(cut, cut[1:]):
            part = repair._Segment(1, 0, True)
            part.rows = rows[a:b]
            parts.append(part.record(0, True))
        picks = repair.chain([(p[-3], p[-2]) for p in parts])
        assert "".join(p[-1][k] for p, k in zip(parts, picks)) + repair.ENDS[picks[-1] % 4] == whole[8]
        assert sum(p[-3][k] for p, k in zip(parts, picks)) + 3 * len(repair.ENDS[picks[-1] % 4]) == whole[7]

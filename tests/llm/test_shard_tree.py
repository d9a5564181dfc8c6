"""Sharding by a k-d tree: the law, groups of equal texts, slots and files, with nulls, hot groups, very long texts and repeated rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from terrace.llm import shard_tree
from tests.llm.test_operators import passage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, unit int, node int, size string, bytes long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, "x", 1, 2, "s", 3) for i, t, lang, source in rows], SCHEMA).repartition(4)


def mixed(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, passage(seed * 10_000 + i, rng.randint(1, 80)) + " ä🙂", rng.choice(["en", "de", "fr", None]), rng.choice(["web", "web", "web", "books", None])) for i in range(n)]
    return rows + [(n + i, passage(5, 40), "en", "web") for i in range(n // 50)] + [(None, None, None, None), (None, "", "en", "web"), (n + 90_000, "", None, None)]


def checked(found, rows, shards=16):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r["law"] for r in found} <= {"bytes"} and {r["grown_shard"] for r in found} <= {None}
    slots, weight = defaultdict(list), Counter(dict.fromkeys(range(shards), 0))
    for r in found:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return weight


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_are_of_nearly_equal_bytes_and_groups_stay_together(spark, shards):
    rows = mixed(1500)
    found = shard_tree.shard_documents(frame(spark, rows), shards).collect()
    weight = checked(found, rows, shards)
    mean = sum(weight.values()) / shards
    assert max(abs(w - mean) for w in weight.values()) <= 0.01 * mean
    homes = defaultdict(set)
    for r in found:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_with_a_third_of_all_rows_is_split(spark):
    rows = mixed(800) + [(10_000 + i, passage(8, 60), "en", "web") for i in range(400)]
    weight = checked(shard_tree.shard_documents(frame(spark, rows)).collect(), rows)
    mean = sum(weight.values()) / 16
    assert max(abs(w - mean) for w in weight.values()) <= 0.02 * mean


def test_long_texts_few_rows_and_no_rows(spark):
    rows = mixed(200) + [(7000, passage(9, 4000), "en", "web")]
    weight = checked(shard_tree.shard_documents(frame(spark, rows)).collect(), rows)
    assert sum(w > 0 for w in weight.values()) == 16
    few = [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, None, None, None)]
    checked(shard_tree.shard_documents(frame(spark, few)).collect(), few)
    assert shard_tree.shard_documents(frame(spark, few).where("false")).count() == 0
    with pytest.raises(ValueError):
        shard_tree.shard_documents(frame(spark, few), 0)


def test_cuts_follow_the_widest_dimension(spark):
    rows = [(i, f"{i:04d}" * 5, lang, "s") for i, lang in enumerate(["a", "b"] * 512)]
    found = shard_tree.placed_rows(frame(spark, rows), 4, ("lang", "doc_id")).collect()
    corners = {(r["doc_id"] % 2, r["doc_id"] >= 512, r["shard"]) for r in found}
    assert len(corners) == 4 and len({c[2] for c in corners}) == 4


def test_written_shards_hold_all_columns(spark, tmp_path):
    rows = mixed(300, 3)
    docs = frame(spark, rows)
    back = shard_tree.write_shards(docs, str(tmp_path / "out"), target_bytes=20_000)
    kept = [c for c in docs.columns if c != "shard"]
    assert Counter(map(tuple, back.select(*kept).collect())) == Counter(map(tuple, docs.select(*kept).collect()))
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert back.select("shard").distinct().count() == -(-total // 20_000)

"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from terrace.llm import exact_dedup, graph, license_scan, near_text, packing, piece_codec, quality_rules, simhash, substring_dedup, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, did int, words int, key int"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows_of():
    texts = [None, "", "  \n\t ", "one", "One", "two words", "two words", "The Idiot said SO.\n" * 30, passage(1, 400), passage(1, 400).upper(), passage(2, 60) + " " + passage(3, 80), passage(4, 50) + "\n" + passage(3, 80), passage(5, 30_000), "ß Ünï 中文 \x00 ▁ 🙂", passage(6, 120), passage(6, 120) + " tail"]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], "s", len(t or ""), "d", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [(6, "two words", "de", None, None, None, None, None, None), (None, "one", "en", "s", 3, "d", 1, 2, 3), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame([r for k, r in enumerate(rows_of()) if k < 16], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return (text or "").encode().lower()


def test_cuckoo_index_inserts_deletes_and_grows():
    rng, index, truth = random.Random(3), exact_dedup.CuckooIndex(8), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(12_000):
        key = rng.choice(keys)
        if rng.random() < 0.35:
            assert index.delete(key) == (truth.pop(key, None) is not None)
        else:
            index.put(key, step)
            truth[key] = step
    assert dict(index.items()) == truth and len(index) == len(truth)
    assert all(index.get(k) == truth.get(k) and (k in index) == (k in truth) for k in keys)


def test_cuckoo_index_takes_any_key():
    index = exact_dedup.CuckooIndex(8)
    keys = [b"", b"a", b"ab", *(b"same first bytes" + bytes([k]) for k in range(200))]
    for k, key in enumerate(keys):
        index.put(key, k)
    assert len(index) == len(keys) and all(index.get(key) == k for k, key in enumerate(keys)) and index.mask < 4096


def test_exact_groups_of_large_ids_in_small_indexes(spark):
    rows = [(None if k % 7 == 0 else 2**62 + k, f"text {k % 50}") for k in range(400)]
    digests = exact_dedup.digest_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.live_groups(digests, 10).collect()}
    want = defaultdict(list)
    for i, text in rows:
        want[hashlib.sha256(text.encode()).digest()].append(i)
    assert got == {d: (max(i for i in ids if i is not None), len(ids)) for d, ids in want.items()}


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in rows_of():
        groups[hashlib.sha256(lower(r[1])).hexdigest()].append(r[0])
    assert len(got) == len(rows_of())
    for digest, ids in groups.items():
        mine = [r for r in got if r["text_sha256"] == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert sum(r["kept"] for r in mine) == 1 and {r["keep_id"] for r in mine} == {best} and {r["group_size"] for r in mine} == {len(ids)}
        assert next(r["doc_id"] for r in mine if r["kept"]) == best
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(lower(r["text"]) for r in kept.collect()) == sorted({lower(r[1]) for r in rows_of()})
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_apply_changes(spark):
    a, b = b"a" * 32, b"b" * 32
    log = [(1, "insert", a, 1), (2, "insert", a, 2), (3, "delete", a, None), (4, "insert", a, 5), (5, "insert", b, 6), (6, "delete", b, None), (7, "delete", b, None), (8, "insert", None, 9)]
    live = exact_dedup.apply_changes(spark.createDataFrame(log, "seq long, op string, digest binary, doc_id long")).collect()
    assert [(bytes(r["digest"]), r["doc_id"]) for r in live] == [(a, 5)]


def base_counts(text):
    words = (text or "").encode().split()
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_guard(docs, empty):
    got = quality_rules.judge_quality(docs).collect()
    want = Counter((r[0], *base_counts(r[1])) for r in rows_of())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge_quality(empty).count() == 0


def test_quality_divergence_rejects_symbol_soup(spark):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "to", "house", "river", "garden", "in"]) + str(rng.randint(0, 9)) * (rng.random() < 0.02) for _ in range(200))
    soup = " ".join(rng.choice("QWERTZUIOP") * 3 + rng.choice(["***", "$$$", "&&&", "%%%"]) + str(rng.random()) for _ in range(200))
    frame = spark.createDataFrame([(i, prose(), "en") for i in range(40)] + [(99, soup, "en")], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(frame).collect()}
    assert not kept[99] and all(v for k, v in kept.items() if k != 99)


def test_quality_divergence_rejects_texts_without_the_words_of_their_language(spark):
    rng = random.Random(2)
    rare = [passage(k, 1) + str(k) for k in range(400)]

    def prose(common, n=260):
        return " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(rare) for _ in range(n))

    rows = [(k, prose(quality_rules.COMMON_WORDS[lang]), lang) for lang in ("en", "de") for k in range(0 if lang == "en" else 100, 60 if lang == "en" else 160)]
    rows += [(900, prose(quality_rules.COMMON_WORDS["de"]), "en"), (901, prose(rare), "en"), (902, prose(rare, 55), "en"), (903, prose(rare), "xx")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[900] and not kept[901] and kept[902] and kept[903] and all(v for k, v in kept.items() if k < 900)


def test_quality_stage_judges_rows_of_one_id_apart(spark):
    good, bad = " ".join(passage(k, 1) for k in range(60)), "bad"
    frame = spark.createDataFrame([(1, good, "xx", 1), (1, bad, "xx", 2), (None, good, "xx", 3), (None, bad, None, 4)], "doc_id long, text string, lang string, mark int")
    assert sorted(r["mark"] for r in quality_rules.keep_good(frame).collect()) == [1, 3]


def cover(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(b" ".join(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[b" ".join(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield w, gone


@pytest.mark.parametrize(("window", "anchor"), [(35, 8), (7, 3), (4, 1)])
def test_substring_dedup(docs, unique, empty, window, anchor):
    for frame, rows in ((docs, rows_of()), (unique, rows_of()[:16])):
        want = Counter((r[0], len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for r, (w, g) in zip(rows, cover([r[1] for r in rows], window), strict=True))
        assert Counter(map(tuple, substring_dedup.kept_digests(frame, window, anchor).collect())) == want
    assert substring_dedup.kept_digests(empty).count() == 0


def family():
    """Texts whose repeated spans branch: edited copies of one text, a passage in many contexts, a text that repeats itself."""
    base, common = passage(50, 300).split(), passage(51, 70)
    texts = [" ".join(base), " ".join(base)]
    for k in range(6):
        words = list(base)
        words[40 * k + 30] = f"edit{k}"
        texts.append(" ".join(words))
    context = [passage(60 + k, 90) for k in range(3)]
    texts += [f"{c} {common} {passage(70 + k, 50)}" for k, c in enumerate(context)] + [f"{c} {common}" for c in context]
    return texts + [" ".join([passage(80, 40)] * 5), common, passage(90, 400), None]


@pytest.mark.parametrize("bits", [64, 14])
def test_substring_paths_are_verified_word_by_word(spark, bits):
    texts = family() + [passage(1000 + k, 150) for k in range(60 if bits < 64 else 0)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Counter((k, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for k, (w, g) in enumerate(cover(texts, 12)))
    assert Counter(map(tuple, substring_dedup.kept_digests(frame, 12, 4, bits).collect())) == want


def test_substring_junctions_of_hot_nodes(spark):
    frame = spark.createDataFrame(list(enumerate(family())), "did long, text string").repartition(3)
    trails = substring_dedup.trails_of(substring_dedup._documents(substring_dedup.repeated_edges(frame, 12, 4, 64), 12, 4, 64, lambda kept, removed: None))
    cold, hot = (Counter(map(tuple, substring_dedup.compacted(trails, 12, 4, 64, n).collect())) for n in (10_000, 2))
    assert cold == hot and len(cold) > 10


def test_substring_paths(spark):
    texts = family()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = [(t or "").encode().split() for t in texts]
    grams = Counter(b" ".join(w[i : i + 12]) for w in words for i in range(len(w) - 11))
    seen = Counter()
    for r in substring_dedup.repeated_paths(frame, 12, 4).collect():
        path = words[r["did"]][r["place"] : r["place"] + r["n_words"]]
        assert len(path) == r["n_words"] >= 12 and r["sources"] > 1
        inside = [b" ".join(path[i : i + 12]) for i in range(len(path) - 11)]
        assert {grams[g] for g in inside} == {r["sources"]}
        seen.update(inside)
    assert seen == Counter({g: 1 for g, n in grams.items() if n > 1})


def test_substring_stage_keeps_rows_and_columns(unique):
    out = substring_dedup.remove_repeats(unique)
    assert out.columns == unique.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    for r, (w, g) in zip(rows_of()[:16], cover([r[1] for r in rows_of()[:16]], 35), strict=True):
        text = rows[r[0]]["text"]
        assert text == (b" ".join(x for x, y in zip(w, g, strict=True) if not y).decode() if any(g) else r[1])
        assert rows[r[0]]["n_chars"] == (len(text) if any(g) else r[4])


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x</p>", 1), (2, "http://b/\r\nX: y", "<p>x</p>", 2), (3, None, None, 3), (4, "http://c/", "", 4), (5, "u", "ü\r\n\r\nz" * 5000, 5), (5, "u", "ü\r\n\r\nz" * 5000, 5), (None, "n", "<p>x</p>", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    where = [str(tmp_path / n) for n in ("one", "two")]
    manifests = [warc.write_archive(frame.repartition(n), p, shard=4096, roll=2048).collect() for n, p in zip((2, 3), where, strict=True)]
    assert {(r["path"], r["sha256"]) for r in manifests[0]} == {(r["path"], r["sha256"]) for r in manifests[1]}
    got = Counter(map(tuple, warc.read_archive(spark.createDataFrame(manifests[0], warc.MANIFEST), where[0]).collect()))
    digest = warc.payload_digest
    x, e, z = b"<p>x</p>", b"", ("ü\r\n\r\nz" * 5000).encode()
    assert got == Counter([(1, 8, digest(x), "revisit", 2), (2, 8, digest(x), "response", None), (None, 8, digest(x), "revisit", 2), (3, 0, digest(e), "revisit", 4), (4, 0, digest(e), "response", None), (5, len(z), digest(z), "response", None), (5, len(z), digest(z), "revisit", 5)])
    assert not list((tmp_path / "one").glob("_temporary*")) and (tmp_path / "one" / "_SUCCESS").exists()
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_warc_against_a_plain_loop_with_extreme_ids(spark, tmp_path):
    rng = random.Random(12)
    ids = [None, -(2**63), 2**63 - 1, 10**15, *range(300)]
    pages = [(rng.choice(ids), f"http://h/{k}", rng.choice(["", None, "same", passage(k, 30), passage(k % 40, 200)])) for k in range(900)]
    pages += [(7, "http://hot/", "hot")] * 400 + [(None, "u", "nobody")] * 3
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    manifest = warc.write_archive(frame, str(tmp_path / "a"), shard=4_096, roll=2_048)
    got = Counter(map(tuple, warc.read_archive(manifest, str(tmp_path / "a")).collect()))
    groups = defaultdict(list)
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    want = Counter()
    for payload, members in groups.items():
        best = max((m for m in members if m is not None), default=None)
        left = [*members]
        if best is not None:
            left.remove(best)
            want[best, len(payload), warc.payload_digest(payload), "response", None] += 1
        for m in left:
            want[m, len(payload), warc.payload_digest(payload), "response" if best is None else "revisit", best] += 1
    assert got == want
    spans = []
    for r in sorted(manifest.collect(), key=lambda r: r["path"]):
        with open(tmp_path / "a" / r["path"], "rb") as stream:
            held = [f["X-Page-ID"] for f, _ in warc.parse(stream)]
        spans.append([int(x) if x else -(2**64) for x in held])
    assert len({r["shard"] for r in manifest.collect()}) > 5 and len(spans) > 20
    assert all(s == sorted(s) for s in spans) and all(a[-1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_piece_codec_equals_library(docs, empty):
    model, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES), random.Random(5)
    letters = " " * 6 + "▁\n\t\x00aeiounrst.,!<>/019ñéßü中文🙂\u3000"
    for _ in range(800):
        text = " " * rng.randint(0, 20) * (rng.random() < 0.3) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = model.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == model.decode(ids)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows_of():
        ids = model.encode(r[1] or "")
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))] += 1
    assert Counter(map(tuple, piece_codec.encoded_digests(docs, PIECES).collect())) == want
    assert {r["doc_id"]: r["ids"] for r in piece_codec.encode_decode(docs, PIECES).collect()}[5] == model.encode("two words")
    assert piece_codec.encoded_digests(empty, PIECES).count() == 0


def test_piece_codec_cuts_where_no_piece_crosses(monkeypatch):
    model, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES), random.Random(7)
    assert all(codec.segment.fullmatch(p) for p in codec.rank)  # no piece is cut
    letters = "abeinorst" * 3 + "ABéßščД" + "авеинорст" * 2 + "().,;:!?-=*/<>'\"_#$%&|{}[]^~\\…—«»" + "0123456789" + "   ▁▁\n\r\t\x00" + "的据数中ال한ת²°·„🙂\u0301\u3000"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        ids = model.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == model.decode(ids)
    words, ends = ["".join(rng.choice("abeinorst") for _ in range(9)) for _ in range(40)], [",", ".", ";", ")", "!!", "...", '",', "&&&", "###", "?)"]
    encoded, plain = [], codec.segment_ids
    monkeypatch.setattr(codec, "segment_ids", lambda s: encoded.append(s) or plain(s))
    memo = piece_codec._Memo(codec)
    for word in words:
        for end in ends:
            text = f"{word}{end} {word}"
            ids = model.encode(text)
            found = [memo[s] for s in codec.segments(text)]
            assert ",".join(f[0] for f in found) == ",".join(map(str, ids)) and "".join(f[1] for f in found)[1:] == model.decode(ids)
    assert len(encoded) == len(words) + len(ends)  # and not once for each pair of a word and what ends it


def test_packing(docs, empty):
    import zlib

    library = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(docs, WORDS).collect()
    want, total = Counter(), 0
    for r in rows_of():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], dtype="<u4")
            want[r[0], k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.pack_documents(empty, WORDS).count() == 0


def best_fit_in_supersteps(lengths, limit):
    """The same supersteps on one list: (sequence fills, how many)."""
    fills, few = [], packing.FEW
    todo = sorted(lengths, reverse=True)
    while todo and todo[0] > limit // 2:
        fills.append([todo.pop(0)])
    longest = limit // 2
    while longest:
        shortest = 0 if longest <= max(1, limit // packing.LEAST_CLASS) else longest // 2
        mine = [n for n in todo if shortest < n <= longest]
        todo = [n for n in todo if n <= shortest]
        placed = len(mine)
        while mine:
            if placed < (few if shortest else packing.FEW_LAST) * len(mine) or not fills:
                fills += [[] for _ in range(-(-len(mine) // (limit // longest)) if shortest else -(-sum(mine) // limit))]
            free = sorted((limit - sum(f), k) for k, f in enumerate(fills))
            placed, left = 0, []
            for n in mine:
                at = next((i for i, (g, _) in enumerate(free) if g >= n), None)
                if at is None:
                    left.append(n)
                else:
                    fills[free.pop(at)[1]].append(n)
                    placed += 1
            mine = left
        longest = shortest
    assert all(sum(f) <= limit for f in fills)
    return len([f for f in fills if f])


@pytest.mark.parametrize(("limit", "n"), [(64, 300), (2048, 1500), (1, 5)])
def test_packing_is_as_good_as_best_fit_on_one_list(spark, limit, n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(np.ceil(rng.gamma(1.2, limit / 4, n)), limit).astype(int).tolist()
    frame = spark.createDataFrame([(k, length) for k, length in enumerate(lengths)], "pid long, length long").repartition(3)
    rows = packing.place(packing.ranked(frame), limit).collect()
    assert sorted((r["pid"], r["length"]) for r in rows) == list(enumerate(lengths))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in map(sorted, bins.values()):
        assert parts[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= limit
    assert len(bins) <= best_fit_in_supersteps(lengths, limit) * 1.02 + 1 and len(bins) <= -(-sum(lengths) // limit) * 1.15 + 1


def test_packing_a_crowd_of_short_pieces(spark):
    lengths = [2000] * 3 + [k % 9 + 1 for k in range(3000)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    rows = packing.place(packing.ranked(frame)).collect()
    assert len(rows) == len(lengths) and len({r["sequence_id"] for r in rows}) <= -(-sum(lengths) // 2048) + 1


def test_pieces_between_ranges_take_the_last_gap():
    rng = random.Random(6)
    for _ in range(200):
        left = {s: (rng.randint(0, 5), rng.randint(0, 5)) for s in range(rng.randint(1, 6))}
        of_pieces, of_gaps, pairs = packing.between_ranges(left)
        free, want = [], []
        for s in sorted(left):
            for k in range(left[s][0]):
                if free:
                    want.append(((s, k), free.pop()))
            free += [(s, k) for k in range(left[s][1])]

        def number(steps, s, k, way):
            found = [(first, p) for first, p in steps.get(s, []) if first <= k]
            if not found or max(found)[1] < 0:
                return None
            return max(found)[1] + way * (k - max(found)[0])

        assert pairs == len(want)
        for (ps, pk), (gs, gk) in want:
            assert number(of_pieces, ps, pk, 1) == number(of_gaps, gs, gk, -1) is not None
        taken = {g for _, g in want}
        assert all((number(of_gaps, s, k, -1) is None) == ((s, k) not in taken) for s in left for k in range(left[s][1]))


def test_license_scan(spark, docs, empty):
    mit = next(t for n, _, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 100)
    cut = " ".join(mit.split()[:-5])
    texts = {1: passage(9, 700) + " Licensed under the Apache License, Version 2.0. " + passage(10, 40), 2: passage(11, 333) + "\n" + mit.upper() + "\n" + passage(12, 200), 3: cut, 4: " ".join(mit.split()[:20]), 5: "this work is licensed", 6: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(frame).collect()}
    assert got == {1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: "", 5: "", 6: ""}
    assert license_scan.scan_licenses(docs).count() == len(rows_of()) and license_scan.scan_licenses(empty).count() == 0


def test_license_scan_against_plain_containment(spark):
    import regex

    def cut(text):
        words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rng, texts = random.Random(21), [None, "", "one two"]
    for n, (_, _, text) in enumerate(license_scan.TEMPLATES):
        for k in range(12):
            words = [w for w in text.split() if rng.random() > 0.01 * (k % 5)]
            texts.append(passage(3000 + 20 * n + k, rng.randint(0, 150)) + " " + " ".join(words) + ". " + passage(5000 + 20 * n + k, rng.randint(0, 90)))
    templates, want = [(name, family, cut(t)) for name, family, t in license_scan.TEMPLATES], {}
    for k, text in enumerate(texts):
        found, have = [], cut(text)
        for name, family, t in templates:
            if len(t & have) / len(t) >= 0.8:
                found.append((family, len(t & have) / len(t), name))
        best = {f: max(c for g, c, _ in found if g == f) for f, _, _ in found}
        want[k] = ",".join(sorted({name for f, c, name in found if c == best[f]}))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(frame).collect()} == want
    assert len({x for w in want.values() for x in w.split(",")}) > 12


def test_toxicity_learns_and_holds_out(spark, docs, empty):
    rng, insults, groups = random.Random(4), ["idiot", "scum", "trash"], ["northerners", "southerners"]
    rows, labels = [], []
    for i in range(600):
        words, bad = [f"w{rng.randint(0, 300)}" for _ in range(60)], i % 5 == 0
        if bad:
            words[rng.randint(0, 59)] = rng.choice(insults)
            words[rng.randint(0, 59)] = rng.choice(groups)
        rows.append((i, " ".join(words) + ".", "en"))
        labels.append((i, int(bad)))
    rows.append((1000, None, None))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(frame, marks).collect()}
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 for i in got)
    unseen = [i for i in range(600) if got[i]["held_out"]]
    assert len(unseen) > 50 and sum(got[i]["predicted"] == (i % 5 == 0) for i in unseen) / len(unseen) > 0.95
    kept = {r["doc_id"] for r in toxicity.drop_toxic(frame, marks).collect()}
    assert kept == {i for i in got if not got[i]["predicted"]}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r["score"] for r in toxicity.score_documents(docs, none).collect()}) == 1
    assert toxicity.score_documents(empty, none).count() == 0


def test_toxicity_learns_pairs_that_tell_nothing_alone(spark):
    rng, rows, labels = random.Random(14), [], []
    for i in range(2600):
        words = [f"w{rng.randint(0, 200)}" for _ in range(25)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["idiot"] * insult + ["northerners"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult == group)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r for r in toxicity.score_documents(frame, marks).collect() if r["held_out"]]
    # A plain table of the four cells of the pair is right always, every additive model about half the time.
    assert len(got) > 500 and sum((r["score"] >= 0.5) == bool(labels[r["doc_id"]][1]) for r in got) / len(got) >= 0.9


def test_toxicity_learns_pairs_of_terms_rarer_than_many_others(spark):
    rng, rows, labels, either = random.Random(6), [], [], set()
    common = [f"w{i}" for i in range(1500)]
    for i in range(6000):
        words = rng.sample(common, 200)
        insult, group = rng.random() < 0.1, rng.random() < 0.1
        if insult or group:
            either.add(i)
        words += ["idiot"] * insult + ["northerners"] * group
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group) if insult or group else rng.randint(0, 1)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r for r in toxicity.score_documents(frame, marks).collect() if r["held_out"] and r["doc_id"] in either]
    assert len(got) > 150 and sum((r["score"] >= 0.5) == bool(labels[r["doc_id"]][1]) for r in got) / len(got) >= 0.95


def test_toxicity_pairs_equal_a_plain_table_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TERMS", 50)
    rng = random.Random(8)
    rows = [np.array(sorted(rng.sample(range(25), rng.randint(0, 9))), dtype=np.int64) for _ in range(400)]
    labels = np.array([float((3 in r) == (7 in r) if rng.random() < 0.9 else rng.random() < 0.5) for r in rows])

    def information(cells):
        return sum(t * math.log(t / n) + (n - t) * math.log((n - t) / n) if 0 < t < n else 0.0 for n, t in cells)

    def table(*keys):
        cells = {}
        for r, y in zip(rows, labels, strict=True):
            key = tuple(k in r for k in keys)
            n, t = cells.get(key, (0, 0))
            cells[key] = (n + 1, t + y)
        return information(cells.values())

    for least in (3.0, 45.0):
        met = {(i, j) for r in rows for i in r.tolist() for j in r.tolist() if i < j}
        want = {(i, j) for i, j in met if 2 * (table(i, j) + table() - table(i) - table(j)) >= least}
        sample = toxicity.Sample(rows, labels, 25)
        assert {(i, int(j)) for i in range(25) for j in sample.pairs_of(i, least)} == want
        assert toxicity.telling_terms(spark, sample, least).tolist() == sorted({x for pair in want for x in pair})
        assert (3, 7) in want
        # No term that is in a telling pair is left out beforehand.
        assert toxicity.may_pair(400, sample.n, least)[sorted({x for pair in want for x in pair})].all()


def test_toxicity_logit_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.FactorizationMachine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 8)))
    for _ in range(20):
        active = sorted(rng.choice(30, size=rng.integers(0, 12), replace=False).tolist())
        naive = 0.3 + sum(model.w[i] for i in active) + sum(float(model.v[i] @ model.v[j]) for i in active for j in active if i < j)
        assert abs(model.logit(active) - naive) < 1e-9


def test_toxicity_sample_is_bounded_under_repeated_ids(spark):
    frame = spark.createDataFrame([(k % 3, f"text {k}") for k in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(frame, marks).count() == 300


def test_url_filter(spark):
    urls = ["http://A.Net/x", "http://example.net/en/1", "http://sub.example.net/en/", "https://example.com/de/1?q", "http://example.org/fr/", "http://example.org/en", "http://foo.net", None, "no scheme", "http://spam-farm.example.org/en/", "http://my-spam-farm.org/", "x://h?p=http://y.net/", "http://badexample.com/de/", ""]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame).collect()}
    assert url_filter.judge_urls(frame).count() == len(urls) + 1
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [("net/", "block"), ("example.net/en/", "allow"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[0]["host"], got[0]["path"], got[7]["host"], got[11]["host"], got[11]["path"]) == ("a.net", "/x", "", "h", "")
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


@pytest.mark.parametrize("common", ["ads", "banner", "wp", "login", "php"])
def test_url_filter_fetches_rules_by_whole_tokens(spark, common):
    blocked = ["http://h/ads/banners/1.gif", "http://h/ads/topbanner.gif", "http://h/ADS/x_banner2", "http://h/wp-login.php5", "http://h/a/wp-login.phpx?y", "http://h/doubleclick", "http://doubleclic\u212a.h/"]
    urls = blocked + [f"http://h/{n}/{common}.txt" for n in range(20)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(frame).collect()}
    assert [got[i] for i in range(len(urls))] == ["block"] * 5 + ["allow", "block"] + ["allow"] * 20
    assert all(url_filter.bounded(token, pattern) for _, needs, pattern in url_filter.PATTERN_RULES for token in needs)
    assert not url_filter.bounded("banner", r"/ads/.*banner") and not url_filter.bounded("php", r"/wp-login\.php")


def simhash_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids, distance):
    best = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= distance and best[j] < best[i]:
                    best[i], changed = best[j], True
    found = defaultdict(list)
    for i, b in enumerate(best):
        found[b].append(ids[i])
    return {i: min((x for x in m if x is not None), default=None) for m in found.values() for i in m}


def test_simhash_components(docs, empty):
    rows = rows_of()
    prints = [simhash_of(r[1]) for r in rows]
    want = roots(prints, list(range(len(rows))), 3)
    named = defaultdict(list)
    for k, r in enumerate(rows):
        named[want[k]].append(r[0])
    expected = Counter((r[0], f"{p:016x}", min((i for i in named[want[k]] if i is not None), default=None)) for k, (r, p) in enumerate(zip(rows, prints, strict=True)))
    assert Counter(map(tuple, simhash.simhash_components(docs).collect())) == expected
    assert simhash.simhash_components(empty).count() == 0 and near_text.drop_near_duplicates(empty).count() == 0


def identity_rows():
    """Rows whose ids say little: nulls with different texts, one id for two texts, a null-id copy of a row that has an id, repeated rows."""
    a, b, c, d, e = (passage(s, 80) for s in range(40, 45))
    return [(None, a, 1), (None, b, 2), (None, b, 2), (7, c, 3), (7, d, 4), (3, e, 5), (None, e.upper(), 6), (9, "  " + e, 7), (None, None, 8), (8, "", 9)]


def assert_identity(spark, drop):
    rows = identity_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3)
    out = drop(frame)
    assert out.columns == frame.columns and Counter(map(tuple, out.collect())) == Counter([rows[0], rows[1], *rows[3:6], rows[9]])


def test_simhash_drop_keeps_rows_of_null_and_shared_ids(spark):
    assert_identity(spark, near_text.drop_near_duplicates)


@pytest.mark.parametrize("chunk", [16, 4096])
def test_simhash_links_lose_nothing(spark, chunk):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(20)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & ((1 << 64) - 1) for c in centres for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    classes = spark.createDataFrame([(p, p) for p in signed], "node long, fp long")
    found = {r["node"]: r["root"] for r in graph.components(simhash.link_classes(classes, 3, chunk)).collect()}
    want = roots([p & ((1 << 64) - 1) for p in signed], signed, 3)
    assert {p: found.get(p, p) for p in signed} == want


def edited(text, edits, rng):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = "edited" + str(rng.randrange(1000))
    return " ".join(words)


def near_texts():
    rng = random.Random(3)
    texts = [None, "", " \t", "one", "ONE", "two words", "one two three four five", "one two three four six"]
    for k in range(40):
        base = passage(500 + k, 200)
        texts += [base, *(edited(base, n, rng) for n in (1, 2, 3, 5, 8))]
    texts += [passage(700 + k, 9) for k in range(60)]
    words = [passage(900, 30_000).split()]
    return texts + [" ".join(words[0]), " ".join(words[0][:-900]), " ".join(words[0][:20_000])]


def exact_components(texts):
    sets = [set(near_text.shingle_set((t or "").encode()).tolist()) for t in texts]
    root, near = list(range(len(texts))), []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                near.append((j, i))
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root, near


def test_near_duplicates_are_exactly_similar(spark):
    texts = near_texts()
    root, near = exact_components(texts)
    frame = spark.createDataFrame([(i, t, "d", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, digest string, member int, component int").repartition(3)
    rows = near_text.near_rows(frame).collect()
    component = {r["doc_id"]: r["component"] for r in rows}
    assert len(rows) == len(texts)
    # Nothing is joined that exact similarity does not join, and at least 0.9 of the similar pairs are.
    where = {}
    for i, r in enumerate(root):
        where.setdefault(component[i], set()).add(r)
    assert all(len(w) == 1 for w in where.values())
    assert sum(component[a] == component[b] for a, b in near) >= 0.9 * len(near)
    kept = near_text.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    got = {r["doc_id"] for r in kept.collect()}
    assert set(root) <= got and len(got) == len(set(component.values())) and {0, 3, 5, 6, 7, 308} <= got and not {1, 2, 4, 309} & got


@pytest.mark.parametrize("rows", [4, 2048])
def test_exact_links_over_chunks(spark, rows):
    texts = [t for t in near_texts()[8:80]]
    root, _ = exact_components(texts)
    sets = spark.createDataFrame([(1, i, bytearray(near_text.shingle_set(t.encode()).tobytes())) for i, t in enumerate(texts)], "loose long, member long, shingles binary")
    found = {r["node"]: r["root"] for r in graph.components(near_text.exact_links(sets, rows)).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == root


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_buckets_of_few_links_are_compared_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (900, 4), dtype=np.uint64)
    prints[500:560] = prints[:60]
    prints[500:560, 0] ^= np.uint64(0b10110)
    prints[560:600, 0] = prints[:40, 0]  # near in the first word only
    prints[700:703] = prints[1]
    frame = pd.DataFrame({"sig": 0, "key": 0, "part": 0, "node": np.arange(900)} | {f"f{k}": prints[:, k].view(np.int64) for k in range(4)})
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if simhash._near(prints[[j]], prints[i], 5, 30)[0]}
    sought = []
    monkeypatch.setattr(simhash, "_spanning", lambda prints, *a, plain=simhash._spanning: sought.append(len(prints)) or plain(prints, *a))
    link = simhash._link(5, 30, [f"f{k}" for k in range(4)])
    got = pd.concat(link(iter([frame])))
    assert set(map(tuple, got.to_numpy().tolist())) == want and len(want) == 69 and not sought
    frame[["f0", "f1", "f2", "f3"]] = 7
    assert len(pd.concat(link(iter([frame])))) == 899 and sought == [900]

"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules look at each text alone: too few words, or too many words inside
repeated five-word windows.  The method then compares two histograms of a document
with those of its language: characters by class, and the most common words of the
language (all other words in one bin).  The references are sums over all documents
that pass the base rules, by language; a language outside ``COMMON_WORDS`` is
compared with the pooled reference and by characters alone.  The measure is the
Jensen-Shannon distance (square root of the divergence, base 2).  Documents under
``LEAST_WORDS`` words are not judged by it, for their histograms say too little.  The
limit for words follows from the reference: ``WORD_SHARE`` of the distance of a text of
the same length that has no common word of its language, but not less than
``NOISE`` times what chance alone brings at that length (a histogram of k bins drawn
n times is about sqrt((k - 1) / (8 n ln 2)) away from its source).

Repeated windows are found inside each row by sorting window hashes (XXH64 of the
five words in sequence), so no text leaves its row and nothing is shuffled but the
references' sums.

Defined cases: a null or empty text has no words and fails the base rules; a null
language counts as unknown; repeated rows are judged alike; an empty table gives an
empty result; extra columns are ignored or carried untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, pin, word_array

WINDOW = 5
LEAST_WORDS = 50
#: Largest Jensen-Shannon distance that passes.
CHARACTER_LIMIT = 0.30
#: The word limit, see above.
WORD_SHARE, NOISE = 0.85, 1.5
#: Smoothing of a histogram's bins.
PRIOR = 0.5

# The most common words of four languages.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "nicht", "ein"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "at", "this"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}

SYMBOLS = r"[#*$%&|<>]"
#: Character classes but for the last, which takes the rest of the word characters (lower-case letters).
CLASSES = {"upper": r"[A-ZÀ-ÖØ-Þ]", "digit": r"[0-9]", "stop": r"[.,;:!?]", "symbol": r"[#*$%&|<>@^_=+~`{}\[\]\\/]", "quote": r"['\"()\-]"}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def window_hashes(words: Column, n: Column) -> Column:
    """XXH64 of the words of each window, in sequence."""
    last = F.greatest(n - WINDOW, F.lit(0)).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with its base counts and histograms; texts stay behind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.lower(F.coalesce(F.col("lang").cast("string"), F.lit("")))
    rows = pin(docs.select(F.col("doc_id"), lang.alias("lang"), text.alias("text")), words=word_array(F.col("text")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = pin(rows, hashes=window_hashes(F.col("words"), F.col("n_words")))
    # Only rows with a repeated window are sorted further.
    sorted_pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = pin(rows, pairs=F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), sorted_pairs))
    pairs = F.col("pairs")
    marked = F.transform(
        pairs,
        lambda p, k: F.when((p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]), p["i"]),
    )
    rows = pin(rows, starts=F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum")),
        lambda s: s["sum"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = pin(rows, lines=lines)
    classes = [_count(F.col("text"), p).alias(c) for c, p in CLASSES.items()]
    hits = F.lit(None).cast("array<string>")
    for language, common in COMMON_WORDS.items():
        found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}])(" + "|".join(common) + r")(?![\p{L}])"), F.lit(1))
        hits = F.when(F.col("lang") == language, found).otherwise(hits)
    rows = pin(rows, hits=hits)
    per_word = F.lit(None).cast("array<bigint>")
    for language, common in COMMON_WORDS.items():
        counts = F.transform(F.array(*[F.lit(w) for w in common]), lambda w: F.size(F.filter("hits", lambda x: x == w)).cast("bigint"))
        per_word = F.when(F.col("lang") == language, counts).otherwise(per_word)
    measured_rows = rows.select(
        "doc_id",
        F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("")).alias("lang"),
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered.cast("long"), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*classes).alias("classes"),
        per_word.alias("common"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured_rows.withColumn("base_failed", failed)


def _histograms(rows: DataFrame) -> DataFrame:
    """Adds chars and vocab: counts by bin, the rest in the last bin."""
    total = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    chars = F.concat("classes", F.array(F.greatest(F.col("word_chars") - total, F.lit(0).cast("bigint"))))
    used = F.aggregate("common", F.lit(0).cast("bigint"), lambda s, x: s + x)
    vocab = F.concat("common", F.array(F.greatest(F.col("n_words") - used, F.lit(0).cast("bigint"))))
    return rows.withColumn("chars", chars).withColumn("vocab", vocab)


def references(rows: DataFrame) -> DataFrame:
    """Reference histograms by language (and pooled, under the empty name), summed over all documents that pass the base rules."""
    good = _histograms(rows).where(~F.col("base_failed"))
    n_chars, n_vocab = len(CLASSES) + 1, len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).cast("double") for i in range(n_chars)]
    words = [F.coalesce(F.sum(F.get("vocab", F.lit(i))), F.lit(0)).cast("double") for i in range(n_vocab)]
    aggregates = [F.array(*sums).alias("ref_chars"), F.array(*words).alias("ref_vocab")]
    by_language = good.where("lang <> ''").groupBy("lang").agg(*aggregates)
    pooled = good.agg(*aggregates).select(F.lit("").alias("lang"), "ref_chars", "ref_vocab").where(F.get("ref_chars", F.lit(0)).isNotNull())
    return by_language.unionByName(pooled)


def _shares(counts: Column) -> Column:
    smooth = F.transform(counts, lambda x: x.cast("double") + PRIOR)
    total = F.aggregate(smooth, F.lit(0.0), lambda s, x: s + x)
    return F.transform(smooth, lambda x: x / total)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, 0 to 1."""
    terms = F.zip_with(_shares(p), _shares(q), lambda a, b: (a * F.log2(2 * a / (a + b)) + b * F.log2(2 * b / (a + b))) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept, and the two distances for every document."""
    rows = materialize(measured(docs), "quality")
    # One row for each language of the fixed list and one pooled: broadcast at any size of the corpus.
    joined = _histograms(rows).join(F.broadcast(references(rows)), "lang", "left")
    judged = joined.withColumn("char_distance", js_distance(F.col("chars"), F.col("ref_chars"))).withColumn(
        "word_distance", F.when(F.col("lang") != "", js_distance(F.col("vocab"), F.col("ref_vocab")))
    )
    bins = len(next(iter(COMMON_WORDS.values())))
    bare = F.array(*[F.lit(0).cast("bigint")] * bins, F.col("n_words"))
    chance = NOISE * F.sqrt(bins / (8 * math.log(2) * F.greatest(F.col("n_words"), F.lit(1))))
    judged = judged.withColumn("word_limit", F.when(F.col("lang") != "", F.greatest(WORD_SHARE * js_distance(bare, F.col("ref_vocab")), chance)))
    far = (F.col("char_distance") > CHARACTER_LIMIT) | (F.col("word_distance") > F.col("word_limit"))
    verdict = F.when(F.col("base_failed"), False).when(F.col("n_words") < LEAST_WORDS, True).otherwise(~F.coalesce(far, F.lit(False)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), F.round("word_limit", 6).alias("word_limit")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; every row is judged by its own text, whatever its doc_id."""
    row, names = fresh(docs, "row"), docs.columns
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "quality-documents")
    good = judge_quality(rows.select(F.col(row).alias("doc_id"), "text", "lang")).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(good, row, "left_semi").select(*names)

"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i says
whether any word of the text hashes to bucket i.  The second sum learns pairs of
terms that matter together (an insult with the mention of a group) which a linear
model cannot.  Words are runs of letters and digits, A-Z lower-cased.

Fitting uses a bounded sample: one row of each of at most ``FIT_ROWS`` labelled
doc_ids outside the held-out fold, those whose hash comes first.  The model has every
bucket of the sample that tells something by itself (log-likelihood ratio of at least
``LEAST_G2``) and both buckets of every pair of the sample's buckets that tells more
than its two terms do (by ``LEAST_PAIR``), so that terms which matter only together are
learnt as well, rare ones too; no number of terms or pairs is fixed.  The pairs are those
that meet in some text of the sample, looked at in tasks of their own.  Scoring reads
every whole text.

Defined cases: a null text counts as empty and scores sigmoid(w0); labels that
are null are not used; of contradicting labels of one doc_id the larger counts;
of several texts of one doc_id the first in order is learnt from;
without any label of either kind the model is constant at the smoothed base rate;
repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1 << 18
FIT_ROWS = 20_000
#: Least log-likelihood ratio statistic of a term: rarer evidence is left out, as chance.
LEAST_G2 = 15.0
#: Least ratio of a pair beyond those of its two terms; high, since all pairs of the sample are tried.
LEAST_PAIR = 45.0
#: Tasks that look at pairs, each at a share of the first terms.
PAIR_TASKS = 32
#: Terms of documents that a task has in hand at once, give or take one document.
MOST_TERMS = 1 << 20
FACTORS = 8
THRESHOLD = 0.3

#: A-Z to a-z, ASCII letters, digits and bytes of other letters stay, the rest becomes a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


class _Buckets(dict):
    """Word to bucket, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % BUCKETS
        return value


def terms(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_FOLD).split())


def held_out() -> F.Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class FactorizationMachine:
    """Weights over the chosen buckets; trained with AdaGrad on logistic loss, deterministic."""

    def __init__(self, buckets: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.w0, self.w, self.v = buckets, float(w0), w, v

    def logit(self, active: list[int]) -> float:
        if not active:
            return self.w0
        rows = self.v[active]
        s = rows.sum(axis=0)
        return self.w0 + float(self.w[active].sum()) + 0.5 * float((s * s - (rows * rows).sum(axis=0)).sum())

    def score(self, active: list[int]) -> float:
        z = max(-30.0, min(30.0, self.logit(active)))
        return 1.0 / (1.0 + np.exp(-z))


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by index, in their order."""
    if values.ndim == 1:
        return np.bincount(index, values, size)
    return np.stack([np.bincount(index, column, size) for column in values.T], axis=1)


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, epochs: int = 30, rate: float = 0.1, shrink: float = 2e-4) -> FactorizationMachine:
    """``rows``: for each document the positions (in ``buckets``) of the terms it has."""
    n, k = len(rows), len(buckets)
    rng = np.random.default_rng(7)
    base = (labels.sum() + 1) / (n + 2)
    w0, w, v = float(np.log(base / (1 - base))), np.zeros(k), rng.normal(0, 0.01, (k, FACTORS))
    if n == 0 or k == 0 or labels.min() == labels.max():
        return FactorizationMachine(buckets, w0, w, np.zeros((k, FACTORS)))
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full((k, FACTORS), 1e-8)
    size = 64
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, size):
            picked = order[start : start + size]
            lens = np.array([len(rows[i]) for i in picked])
            cols = np.concatenate([rows[i] for i in picked]).astype(np.int64)
            owner = np.repeat(np.arange(len(picked)), lens)
            held = v[cols]
            s = _sums(owner, held, len(picked))
            q = _sums(owner, (held * held).sum(axis=1), len(picked))
            z = w0 + _sums(owner, w[cols], len(picked)) + 0.5 * ((s * s).sum(axis=1) - q)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[picked]) / len(picked)
            d0 = err.sum()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            touched, at = np.unique(cols, return_inverse=True)
            dw = _sums(at, err[owner], len(touched)) + shrink * w[touched]
            dv = _sums(at, err[owner][:, None] * (s[owner] - held), len(touched)) + shrink * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.5 * rate * dv / np.sqrt(gv[touched])
    return FactorizationMachine(buckets, w0, w, v)


class Sample:
    """The sample as flat arrays: the positions of each document's terms, distinct and sorted, and where each term occurs."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, k: int):
        self.k, self.bad = k, labels > 0
        lens = np.array([len(r) for r in rows], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lens)])
        self.terms = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
        self.at = self.docs = None
        self.n = np.bincount(self.terms, minlength=k)
        self.t = np.bincount(self.terms[self.bad[owner]], minlength=k)
        self.places = np.concatenate([[0], np.cumsum(self.n)])
        x = np.arange(len(rows) + 1, dtype=float)
        self.x_log_x = x * np.log(np.maximum(x, 1))
        self.rows, self.toxic = len(rows), int(self.bad.sum())
        self.single = self._information(self.n, self.t) + self._information(self.rows - self.n, self.toxic - self.t)

    def _index(self) -> None:
        """Where each term occurs, and in which document; made in the tasks, not sent to them."""
        self.at = np.argsort(self.terms, kind="stable")
        self.docs = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.starts))[self.at]

    def _information(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Log-likelihood of the labels in cells of n rows of which t are toxic."""
        return self.x_log_x[t] + self.x_log_x[n - t] - self.x_log_x[n]

    def _met(self, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """How often each term follows the occurrences ``at`` in their documents."""
        out, lens = np.zeros(self.k, np.int64), self.starts[docs + 1] - at - 1
        cuts = np.searchsorted(np.cumsum(lens), np.arange(MOST_TERMS, int(lens.sum()), MOST_TERMS))
        for part, size in zip(np.split(at + 1, cuts), np.split(lens, cuts), strict=True):
            total = int(size.sum())
            if total:
                out += np.bincount(self.terms[np.arange(total) + np.repeat(part - (np.cumsum(size) - size), size)], minlength=self.k)
        return out

    def pairs_of(self, term: int, least: float) -> np.ndarray:
        """The later terms that meet ``term`` in some document and whose four cells tell more of the labels than the two terms do by themselves."""
        if self.at is None:
            self._index()
        own = slice(self.places[term], self.places[term + 1])
        at, docs = self.at[own], self.docs[own]
        toxic = self.bad[docs]
        bad = self._met(at[toxic], docs[toxic])
        both = bad + self._met(at[~toxic], docs[~toxic])
        later = np.nonzero(both)[0]
        both, bad, two, two_bad = both[later], bad[later], self.n[later], self.t[later]
        n, t, one, one_bad = self.rows, self.toxic, self.n[term], self.t[term]
        cells = self._information(both, bad) + self._information(one - both, one_bad - bad) + self._information(two - both, two_bad - bad) + self._information(n - one - two + both, t - one_bad - two_bad + bad)
        return later[2 * (cells + self._information(n, t) - self.single[term] - self.single[later]) >= least]


def may_pair(n: float, counts: np.ndarray, least: float = LEAST_PAIR) -> np.ndarray:
    """Which terms can be in a telling pair at all: what a pair tells beyond its terms is at most the entropy of either term."""
    p = np.clip(counts / max(n, 1.0), 1e-12, 1 - 1e-12)
    return (counts < n) & (-2 * n * (p * np.log(p) + (1 - p) * np.log(1 - p)) >= least)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorizationMachine:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets()
        for batch in batches:
            sets = [sorted({memo[t] for t in terms(b)}) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["toxic", "buckets"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # `chosen` has at most fit_rows rows of two numbers, so it may be broadcast at any size of the corpus.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = materialize(sample.select("toxic", "text").mapInArrow(featurize, "toxic int, buckets array<int>"), "toxic-sample")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic")), F.lit(0)).alias("t")).first()
    n, t = total["n"], total["t"]
    seen = rows.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    seen = materialize(seen, "toxic-terms")

    def entropy(a, b):
        return sum(F.when(x > 0, x * F.log(x / (a + b))).otherwise(0.0) for x in (a, b))

    n1, n0 = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    m1, m0 = F.lit(float(t)) - n1, F.lit(float(n - t)) - n0
    gain = entropy(n1, n0) + entropy(m1, m0)
    base = sum(x * math.log(x / n) for x in (t, n - t) if x)
    found = seen.select("bucket", "n", (2 * (gain - base) >= LEAST_G2).alias("tells")).toPandas().sort_values("bucket")  # at most BUCKETS rows
    alone, common = found["bucket"].to_numpy()[found["tells"]], found["bucket"].to_numpy()[may_pair(float(n), found["n"].to_numpy())]
    wanted = np.union1d(alone, common).astype(np.int64)

    def narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["buckets"] = [wanted[np.isin(wanted, b)].astype(np.int32) for b in frame["buckets"]]
            yield frame

    data = rows.mapInPandas(narrow, "toxic int, buckets array<int>").toArrow()  # at most fit_rows rows
    lists = data["buckets"].combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    marks = (data["toxic"].to_numpy() > 0).astype(float)
    sets = [values[ends[i] : ends[i + 1]] for i in range(len(marks))]
    order = sorted(range(len(sets)), key=lambda i: (marks[i], sets[i].astype(">i4").tobytes()))
    marks, sets = marks[order], [sets[i] for i in order]

    def positions(buckets: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(buckets, s[np.isin(s, buckets, assume_unique=True)]).astype(np.int32) for s in sets]

    together = common[telling_terms(docs.sparkSession, Sample(positions(common), marks, len(common)))] if len(common) and 0 < marks.sum() < len(marks) else common[:0]
    buckets = np.union1d(alone, together).astype(np.int64)
    return fit(positions(buckets), marks, buckets)


def telling_terms(spark: SparkSession, sample: Sample, least: float = LEAST_PAIR) -> np.ndarray:
    """Positions of the terms of all telling pairs.  The bounded sample goes to every task; each looks at the pairs of its share of the terms."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for share in (int(i) for frame in frames for i in frame["id"]):
            out: set[int] = set()
            for term in range(share, sample.k, PAIR_TASKS):
                later = sample.pairs_of(term, least)
                if len(later):
                    out.update((term, *later.tolist()))
            yield pd.DataFrame({"term": np.array(sorted(out), dtype=np.int64)})

    told = spark.range(0, PAIR_TASKS, 1, PAIR_TASKS).mapInPandas(look, "term long").distinct()
    return np.sort(told.toPandas()["term"].to_numpy())  # at most BUCKETS rows


def _scorer(model: FactorizationMachine):
    """From texts to scores; words map to model positions (or none) through a bounded memory."""
    place = {int(b): i for i, b in enumerate(model.buckets)}

    class Positions(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 300_000:
                self.clear()
            value = self[word] = place.get(zlib.crc32(word) % BUCKETS, -1)
            return value

    memo = Positions()

    def score(column: pa.Array) -> list[float]:
        out = []
        for text in column.cast(pa.binary()).to_pylist():
            active = set(map(memo.__getitem__, terms(text)))
            active.discard(-1)
            out.append(float(model.score(sorted(active))))
        return out

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    model = train(docs, labels)
    names = docs.columns
    at = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            keep = pa.array([s < THRESHOLD for s in score(batch.column(at))], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)

"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words and their 4 to 6 byte beginnings, hashed to buckets of a table of fixed
size; a term counts once per document. Every bucket that a bounded sample of labelled rows
(``fit_rows``, the rows with the smallest keyed hash) holds gets a weight and a factor vector. The
machine's score is sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>), so two terms that are harmless alone
(an insult's stem, the mention of a group) can weigh together.

The fit is on the log loss over the sample, on the driver. Buckets whose log odds stand out are
fitted alone first, by Adam; that is where AdaGrad, row by row over all buckets, begins, so what
the outstanding terms explain already moves nothing else. Scoring is one pass over all rows with the
table.

Defined cases: null and word-free texts get the score of no terms; rows without a label, null
labels and null ids are not learned from; a doc_id with several labels is toxic if one of
them says so; of rows that share a doc_id the one with the least text hash is learned from; with no labelled rows, or one
class only, the score is the smoothed base rate; repeated rows are each scored; texts of any length count whole; an
empty table gives an empty result; further columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, give_back, map_batches, map_carried, named, text_of, utf8
from .decontaminate import words

BUCKETS = 1 << 20
FIT_ROWS = 20_000
FACTORS = 4
EPOCHS = 8
START_TERMS = 4_096
LEARNED = 1e-2
REMEMBERED = 100_000


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def buckets(word: bytes) -> list[int]:
    forms = [b"=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(x) % BUCKETS for x in forms]


def _places(word: bytes, known: dict[bytes, bytes]) -> bytes:
    if len(known) >= REMEMBERED:
        known.clear()
    found = known[word] = np.array(buckets(word), np.int32).tobytes()
    return found


def places(text: bytes, known: dict[bytes, bytes]) -> np.ndarray:
    """The distinct buckets of a text, ascending. ``known``: words met before, with their buckets packed."""
    get = known.get
    return np.unique(np.frombuffer(b"".join([get(w) or _places(w, known) for w in set(words(text))]), np.int32))


def _terms(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms): distinct buckets of each row as packed 32-bit integers."""

    def make():
        known: dict[bytes, bytes] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [places(x, known).tobytes() for x in utf8(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "terms"])

        return step

    return map_batches(docs.select("doc_id", "text", "toxic"), "doc_id long, toxic int, terms binary", make)


class Machine:
    """Bias, and of each bucket the weight and factors."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v
        self.known: dict[bytes, bytes] = {}

    def margin(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        v = self.v[at]
        s = v.sum(0)
        return float(self.bias + self.w[at].sum() + 0.5 * (s @ s - np.vdot(v, v)))

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(places(text, self.known)), -35, 35))))


def _outstanding(rows: list[tuple[int, np.ndarray]], most: int = START_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose log odds stand out from chance, and half those odds."""
    n, pos = len(rows), sum(t for t, _ in rows)
    of = np.zeros((2, BUCKETS), np.int32)
    for t, x in rows:
        of[t, x] += 1
    a, b = of[1] + 0.5, of[0] + 0.5
    odds = np.log(a / (pos + 1.0)) - np.log(b / (n - pos + 1.0))
    z = np.where(of[0] + of[1] >= 3, odds / np.sqrt(1 / a + 1 / b), 0)
    terms = np.argsort(-z, kind="stable")[:most]
    terms = np.sort(terms[z[terms] >= 2.8])
    return terms, 0.5 * np.clip(odds[terms], -4, 4)


def _begin(rows: list[tuple[int, np.ndarray]], factors: int, steps: int = 300, rate: float = 0.05, decay: float = 2e-3, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Bias, buckets, weights and factors of the buckets that stand out alone, by Adam over the whole sample."""
    terms, start = _outstanding(rows)
    place = np.full(BUCKETS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    kept = [k[k >= 0] for k in (place[x] for _, x in rows)]
    y = np.array([t for t, _ in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(k) for k in kept])
    col = np.concatenate(kept)
    n, m = len(rows), len(terms)
    base = (y.sum() + 0.5) / (n + 1)
    theta = [np.array([np.log(base / (1 - base))]), start, np.random.default_rng(seed).normal(0, 0.05, (m, factors))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for t in range(1, steps * (m > 0) + 1):
        b, w, v = theta
        s = np.array([np.bincount(row, v[col, f], n) for f in range(factors)]).reshape(factors, n).T
        squares = np.bincount(row, (v * v).sum(1)[col], n)
        margin = b[0] + np.bincount(row, w[col], n) + 0.5 * ((s * s).sum(1) - squares)
        g = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y) / n
        gw = np.bincount(col, g[row], m) + decay / n * w * n**0.5
        gv = np.array([np.bincount(col, g[row] * (s[row, f] - v[col, f]), m) for f in range(factors)]).reshape(factors, m).T + decay / n * v * n**0.5
        for k, grad in enumerate((np.array([g.sum()]), gw, gv)):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return float(theta[0][0]), terms, theta[1], theta[2]


def train(rows: list[tuple[int, np.ndarray]], factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, spread: float = 0.01, seed: int = 3) -> Machine:
    """Fit on (label, buckets): begin with what stands out alone, then AdaGrad over every bucket, row by row."""
    n, pos = len(rows), sum(t for t, _ in rows)
    w, v = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, factors), np.float32)
    if not 0 < pos < n:
        return Machine(float(np.log((pos + 0.5) / (n - pos + 0.5))), w, v)
    rng = np.random.default_rng(seed)
    there = np.zeros(BUCKETS, bool)
    for _, x in rows:
        there[x] = True
    held = np.flatnonzero(there)  # what the sample lacks weighs nothing
    v[held] = rng.normal(0, spread, (len(held), factors))
    bias, terms, w[terms], v[terms] = _begin(rows, factors)
    gw, gv = np.full(BUCKETS, 1e-2, np.float32), np.full((BUCKETS, factors), 1e-2, np.float32)
    for _ in range(epochs):
        for k in rng.permutation(n).tolist():
            y, x = rows[k]
            own, vx = w[x], v[x]
            s = vx.sum(0)
            margin = bias + float(own.sum()) + 0.5 * float(s @ s - np.vdot(vx, vx))
            g = 1 / (1 + np.exp(-min(max(margin, -35.0), 35.0))) - y
            if abs(g) < LEARNED:
                continue
            bias -= 0.01 * g
            one = g + decay * own
            two = g * (s - vx) + decay * vx
            gw[x] += one * one
            gv[x] += two * two
            step = rate / max(len(x), 1) ** 0.5
            w[x] = own - step * one / np.sqrt(gw[x])
            v[x] = vx - step * two / np.sqrt(gv[x])
    return Machine(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Learn from at most ``fit_rows`` labelled rows that are not held out."""
    own = labels.select(named("doc_id").alias("doc_id"), named("toxic").alias("toxic"))
    own = own.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(named("doc_id").alias("doc_id"), text_of(docs)).join(F.broadcast(chosen), "doc_id")  # ``fit_rows`` small rows
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    rows = sorted((r.doc_id, r.toxic, bytes(r.terms)) for r in _terms(one).toLocalIterator())  # at most ``fit_rows`` rows of terms
    return train([(t, np.frombuffer(x, np.int32)) for _, t, x in rows])


def _scored(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The caller's columns ``keep`` as one, and score."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))  # ``BUCKETS`` rows

    def make():
        own = Machine(*shared.value)
        return lambda batch: [pa.array([own.score(x) for x in utf8(batch.column("text"))], pa.float64())]

    return map_carried(carry(docs, keep, text_of(docs)), "score double", make)


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (doc_id) and the score, under ``name``."""
    keep = keep or ["doc_id"]
    return give_back(_scored(docs, machine, keep), keep, F.col("score").alias(name))


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns as they were."""
    return give_back(_scored(docs, machine, docs.columns).filter(F.col("score") < threshold), docs.columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, learned from ``labels``."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

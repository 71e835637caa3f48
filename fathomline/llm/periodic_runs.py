"""Periodic runs of words: stretches that repeat themselves with a period, two times or more.

Lags are counted before any is looked at. For a lag p, the matches are the places whose word equals the
one p words on; a run of period p has at least max(shortest - p, p) of them in a row. Words of a text that are frequent in it (heavy)
are counted by exact autocorrelation: the power spectra of their 0/1 sequences are added and brought back by one inverse
transform. The differences of all pairs of places count the others (light). Only lags with enough matches get an island scan.

Lags are taken in ascending order. A run of period d and length l has l - k d matches at the lag k d, and a run whose
smallest period is k d shares none of them (two runs with periods that divide q overlap in less than q words), so they are subtracted
when the run is found: a text of one word all over needs one scan, not half as many as it has words.

An island scan of a lag of ``NARROW`` words or more looks at every q-th place only: an island is at least q matches long, so it holds
one of them, with five more matches before or behind it; from there it is measured both ways.

Defined cases: null, empty and word-free texts have no words and no runs; texts of any length are taken whole; rows that
are repeated each get their row; an empty table gives an empty result; further columns are ignored or pass through,
whatever their names. Runs may overlap; ties for the longest go to the smallest start, then the smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, carry, give_back, map_carried, named, text_of, utf8

SHORTEST = 12
NARROW = 12
PAD = 5
AROUND = np.array([*range(-PAD, 0), *range(1, PAD + 1)])
# Fixed value: a word, as the contract has it.
WORD = r"[^\x20\x09-\x0D]+"


def numbered_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in a row as numbers, equal for equal words of one text and for no others; where each text starts (and the end)."""
    numbers: list[int] = []
    starts, first = [0], 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(w, first + len(own)) for w in words]
        first += len(own)
        starts.append(len(numbers))
    return np.array(numbers, np.int64), np.array(starts, np.int64)


def _heavy(places: list[np.ndarray], n: int) -> np.ndarray:
    """Matches by lag (0 to n // 2) of the words that stand at ``places``: counts of at most n, so rounding the transform is exact."""
    size = 1 << (2 * n - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        line = np.zeros(size)
        line[at] = 1
        spectrum = np.fft.rfft(line)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: n // 2 + 1]).astype(np.int64)


def lag_counts(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text and each lag up to half its length the number of matches, at the place ``start of the text + lag``."""
    total, lengths = len(numbers), np.diff(starts)
    counts = np.zeros(total, np.int64)
    if not total:
        return counts
    begin, length = np.repeat(starts[:-1], lengths), np.repeat(lengths, lengths)
    order = np.argsort(numbers, kind="stable")
    ends = np.cumsum(np.bincount(numbers))
    size = np.diff(ends, prepend=0)
    heavy = size > 2 * np.sqrt(length[order[ends - 1]])  # by word: pairs of the others are at most n sqrt(n) a text
    after = ends[numbers[order]] - np.arange(total) - 1  # how many equal words stand behind
    alive = np.flatnonzero(~heavy[numbers[order]] & (after > 0))
    keys, waiting, k = [], 0, 0
    while len(alive):
        k += 1
        here = order[alive]
        lag = order[alive + k] - here
        fits = 2 * lag <= length[here]
        alive, here, lag = alive[fits], here[fits], lag[fits]
        keys.append(begin[here] + lag)
        waiting += len(lag)
        alive = alive[after[alive] > k]
        if waiting > total or not len(alive):
            counts += np.bincount(np.concatenate(keys), minlength=total)[:total]
            keys, waiting = [], 0
    words = np.flatnonzero(heavy)
    texts = begin[order[ends[words] - 1]]
    for start in np.unique(texts).tolist():
        n = int(length[start])
        found = _heavy([order[ends[w] - size[w] : ends[w]] - start for w in words[texts == start]], n)
        counts[start : start + len(found)] += found[: n]
    return counts


def _extent(x: np.ndarray, y: np.ndarray) -> int:
    """How many places x and y agree in from their beginning."""
    at, step, n = 0, 64, min(len(x), len(y))
    while at < n:
        same = x[at : min(n, at + step)] == y[at : min(n, at + step)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + step, 4 * step
    return n


def islands(padded: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches of at least ``least`` places in a row that equal the place ``lag`` further on;
    before and behind the text ``padded`` has ``PAD`` numbers that are no word's and no two of which are equal."""
    x, n = padded[PAD:-PAD], len(padded) - 2 * PAD
    if lag < NARROW:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-lag] == x[lag:]).astype(np.int8), [0]])))
        return [(a, b - a) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]
    a = np.arange(PAD, n - lag + PAD, lag)
    a = a[padded[a] == padded[a + lag]]
    if not len(a):
        return []
    around = a[:, None] + AROUND
    same = padded[around] == padded[around + lag]
    out, done = [], -1
    for i in (a[same[:, :PAD].all(1) | same[:, PAD:].all(1)] - PAD).tolist():
        if i > done:
            left, right = _extent(x[i::-1], x[i + lag : lag - 1 : -1]), _extent(x[i:], x[i + lag :])
            done = i + right
            if left + right - 1 >= least:
                out.append((i - left + 1, left + right - 1))
    return out


def _divisors(q: int) -> list[int]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out


def find(numbers: np.ndarray, starts: np.ndarray, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, smallest period), by start and then period."""
    counts = lag_counts(numbers, starts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in starts[1:]]
    lengths = np.diff(starts)
    lag = np.arange(len(numbers)) - np.repeat(starts[:-1], lengths)
    enough = np.maximum(shortest - lag, lag)
    promising = np.flatnonzero((lag > 0) & (counts >= enough))
    texts = np.searchsorted(starts, promising, "right") - 1
    current = -1
    for at, text in zip(promising.tolist(), texts.tolist()):
        if counts[at] < enough[at]:  # what matches here belongs to runs of shorter periods
            continue
        start, end, q = int(starts[text]), int(starts[text + 1]), int(lag[at])
        if text != current:
            current, padded = text, np.concatenate([np.arange(-PAD, 0), numbers[start:end], np.arange(-2 * PAD, -PAD)])
            x = padded[PAD:-PAD]
        for i, matches in islands(padded, q, int(enough[at])):
            length = matches + q
            if any((x[i : i + length - d] == x[i + d : i + length]).all() for d in _divisors(q)):
                continue
            out[text].append((i, length, q))
            multiples = np.arange(2 * q, min(length, (end - start) // 2 + 1), q)
            counts[start + multiples] -= length - multiples
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those behind the first period of a run, joined by a space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(change).tolist()) if not n]
    return b" ".join(words)


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(docs: DataFrame, keep: list[str] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """Columns ``keep`` (doc_id), then n_words, runs (start, length, period of each run of at least ``shortest`` words and two periods, by start and
    period) and collapsed (the words that are in no run behind its first period, joined by a space)."""

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t.split() for t in utf8(batch.column("text"))]
            found = find(*numbered_words(texts), shortest)
            flat = list(zip(*(r for runs in found for r in runs))) or [[], [], []]
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], names=["start", "length", "period"])
            at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
            plain = pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
            return [pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(at, structs), plain]

        return step

    keep = keep or ["doc_id"]
    found = map_carried(carry(docs, keep, text_of(docs)), f"n_words long, runs {RUNS}, collapsed string", make)
    return give_back(found, keep, "n_words", "runs", "collapsed")


def collapse_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The documents as they come, but those with runs have only the words that stay, joined by a space, as their text."""
    names = docs.columns
    held = docs.select(F.struct(*(named(c).alias(c) for c in names)).alias(KEPT), text_of(docs))
    found = find_runs(held, [KEPT], shortest)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(KEPT)["text"].cast("string"))
    return found.select(*((text if c == "text" else F.col(KEPT).getField(c)).alias(c) for c in names))


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of what stays."""
    found = find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text: in a tenth of the documents (by the checksum of doc_id; a null id: in none) the words from some place on repeat the first
    few of them; those texts come as words joined by a space."""
    doc_id, n = named("doc_id").cast("long"), F.size("w")
    checksum = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    chosen = F.coalesce(checksum % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(doc_id.alias("doc_id"), text_of(docs), F.floor(checksum / 10).alias("g"), words.alias("w"))
    rows = rows.withColumn("a", F.when(n > 0, F.pmod("g", F.nullif(n, F.lit(0)))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    changed = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))), F.lit(1), n)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))

"""Periodic runs, resampling and Jaccard links against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import jaccard_join, periodic_runs, queries, resampling
from test_operators import clashing, unharmed

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def plain_runs(w, shortest=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            x = w[i : j + q]
            if j > i and len(x) >= max(shortest, 2 * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                out.append((i, len(x), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_TEXTS = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a\x0bb\n" * 6, "x a b c d e f a b c d e f y", "a b c d e f " * 2, "é é\x0c" * 9, "a b " * 12, "p q r s " * 5 + "z " + "q r s p " * 4]


def test_periodic_runs_against_plain(spark):
    rng = random.Random(3)
    texts = list(RUN_TEXTS)
    for n in (30, 60, 90, 200, 300):
        for k in (1, 2, 3, 40):
            w = [str(rng.randrange(k)) for _ in range(n)]
            a, p = rng.randrange(n), rng.randrange(1, n)
            texts += [" ".join(w), " ".join(w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < n else "y" for i in range(n))]
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts += [" ".join(fibonacci[-1]), " ".join(fibonacci[-1][:144])]
    rows = list(enumerate(texts)) + [(None, "u v " * 9), (3, texts[7]), (3, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, periodic_runs.report(periodic_runs.with_planted_runs(docs)).collect()), key=str)
    assert got == sorted(((i, *plain_report(i, t)) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 2


def test_periodic_runs_over_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", F.substring_index(F.col("text"), " ", 250).alias("text"))
    got = by_id(periodic_runs.report(periodic_runs.with_planted_runs(rows)))
    assert all(tuple(got[r.doc_id])[1:] == plain_report(r.doc_id, r.text) for r in rows.collect())
    assert queries.op11_periodic_runs(spark, SF).count() == docs.count()


def test_periodic_runs_of_huge_and_monotonous_texts(spark):
    rng = random.Random(5)
    long = [str(rng.randrange(2)) for _ in range(60_000)]
    texts = ["a " * 1_000_000, " ".join(long), " ".join(long[:20_000] * 3)]
    rows = by_id(periodic_runs.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [tuple(r) for r in rows[0].runs] == [(0, 1_000_000, 1)] and rows[0].collapsed == "a"
    assert (0, 60_000, 20_000) in [tuple(r) for r in rows[2].runs]
    whole = np.array(long)
    for start, length, period in rows[1].runs:
        x = whole[start : start + length]
        assert (x[period:] == x[:-period]).all() and length >= max(12, 2 * period)
        assert start == 0 or whole[start - 1] != whole[start - 1 + period]
        assert start + length == len(whole) or whole[start + length] != whole[start + length - period]


def test_lag_counts_are_exact():
    rng = random.Random(7)
    texts = [[b"%d" % min(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (1, 2, 40, 3_000, 500)]
    numbers, starts = periodic_runs.numbered_words(texts)
    counts = periodic_runs.lag_counts(numbers, starts)
    for w, a in zip(texts, starts):
        for lag in range(1, len(w) // 2 + 1):
            assert counts[a + lag] == sum(x == y for x, y in zip(w, w[lag:])), (len(w), lag)


def test_periodic_runs_carry_columns(spark):
    docs = clashing(spark.createDataFrame([(1, "a " * 20), (None, None), (2, "one  two")], "doc_id long, text string"))
    out = periodic_runs.collapse_runs(docs)
    assert out.columns == docs.columns and unharmed(out)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a", None: None, 2: "one  two"}
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    assert [tuple(r) for r in by_id(periodic_runs.find_runs(docs, shortest=30))[1].runs] == []


def plain_resample(rows, target, buckets=10_000, ngram=(1, 1), least=20, percent=10):
    def features(text):
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(ngram[0], ngram[1] + 1) for i in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    found = [features(t) for _, t in rows]
    s, t = Counter(bucket(x) for _, f in found for x in f), Counter(bucket(x) for y in target for x in features(y)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + float(buckets)) / ((s[b] + 1.0) * (t.total() + float(buckets)))))
    out = []
    for (doc_id, _), (n, f) in zip(rows, found):
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(can[: len(can) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resampling_by_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wanted = con.execute(queries.oracle_sql()["op12_resampling"]).fetchall()
    found = queries.op12_resampling(spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and sum(r[4] is not None for r in wanted) > 10
    assert dict(found.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")


@pytest.mark.parametrize("ngram", [(1, 1), (1, 3), (2, 2)])
def test_resampling_against_plain(spark, ngram):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("Aa bB cé d9 the of".split()) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "?! --"), (None, "the of " * 30), (None, None), (5, rows[5][1]), (903, "日本 the " * 20), (904, "x" * 300_000 + " y" * 40)]
    target = ["the of the of d9", None, "zzz", ""]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, block int")
    got = [tuple(r) for r in resampling.resample(docs, bench, ngram=ngram, percent=30).collect()]
    want = plain_resample(rows, target, ngram=ngram, percent=30)
    cut = lambda rows: sorted((r[:4] for r in rows), key=str)
    assert cut(got) == cut(want) and sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert sorted((r[4], r[0]) for r in got if r[4] and r[0] not in (5, None)) == sorted((r[4], r[0]) for r in want if r[4] and r[0] not in (5, None))


def test_resampling_edges(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    (row,) = resampling.resample(docs, none, least_words=1, percent=100).collect()
    assert (row.n_features, row.rank) == (3, 1)
    drawn = resampling.draw(clashing(docs), docs, least_words=1, percent=100)
    assert unharmed(drawn) and drawn.count() == 1
    assert resampling.draw(docs.withColumn("rank", F.lit("mine")), docs, least_words=1, percent=100).collect()[0].asDict() == {"doc_id": 1, "text": "a b c", "rank": "mine"}


def plain_sets(texts, shingle):
    out = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        out.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()})
    return out


def plain_components(ids, sets, percent):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [ids[i] if not sets[i] else least.get(find(i)) for i in range(len(ids))]


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        k = rng.randrange(len(words))
        words[k : k + rng.randrange(2)] = [f"n{rng.randrange(10**9)}"] * rng.randrange(2)
    return words


def group_texts(rng):
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [None, "", "  ", "One", "one", "one two", "ONE TWO", "one two three", "one two three one two three", "É a b", "é a b"]
    for n in (5, 20, 60, 200):
        base = fresh(n)
        texts += [" ".join(changed(rng, base, rng.randrange(1 + n // 20))) for _ in range(12)]
    for size, changes in ((80, 2), (80, 9)):  # a large group of near copies; a template whose texts are just not near enough
        base = fresh(150)
        texts += [" ".join(changed(rng, base, changes)) for _ in range(size)]
    passage = fresh(60)  # half of many texts
    texts += [" ".join([*fresh(60), *passage]) for _ in range(60)]
    chain = fresh(120)  # each near the next, the ends far apart
    for _ in range(15):
        chain = changed(rng, chain, 2)
        texts.append(" ".join(chain))
    return texts + [texts[20], texts[20], texts[50].upper()]


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_links_against_all_pairs(spark, shingle, percent):
    texts = group_texts(random.Random(shingle))
    ids = [3 * i % 1000 for i in range(len(texts))]
    ids[25] = ids[0] = None
    ids[40] = ids[41]
    docs = clashing(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4))
    sets = plain_sets(texts, shingle)
    want = sorted(((i, len(x), c) for i, x, c in zip(ids, sets, plain_components(ids, sets, percent))), key=str)
    got = sorted(map(tuple, jaccard_join.join(docs, jaccard_join.Similarity(shingle, percent)).collect()), key=str)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 30


def test_jaccard_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids, sets = [r.doc_id for r in rows], plain_sets([r.text for r in rows], 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(x), c) for i, x, c in zip(ids, sets, plain_components(ids, sets, 90))}
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rule, changes", [(jaccard_join.Similarity(5, 80), 14), (jaccard_join.Similarity(3, 90), 12)])
def test_templates_do_not_become_all_pairs(spark, monkeypatch, rule, changes):
    """300 texts of one base, no two of them near enough: a few thousand pairs are confirmed, not 44,850."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(300):
        w = list(base)
        for k in rng.sample(range(400), changes):
            w[k] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    pairs = []
    product = jaccard_join._product
    monkeypatch.setattr(jaccard_join, "_product", lambda p, *more: pairs.append(p.count()) or product(p, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = plain_sets(texts, rule.shingle)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, rule).collect()}
    assert got == dict(enumerate(plain_components(list(range(300)), sets, rule.percent)))
    assert sum(pairs) < 3_000, pairs


def test_jaccard_counts_and_bounds():
    rule, rng = jaccard_join.Similarity(3, 90), random.Random(1)
    for a in range(1, 60):
        for b in range(1, 60):
            fits = [o for o in range(min(a, b) + 1) if 100 * o >= 90 * (a + b - o)]
            assert (min(fits) if fits else rule.least(a, b)) == rule.least(a, b)
            assert not fits or min(fits) > a - rule.prefix(a)
    hashes = jaccard_join.WordHashes()
    x = [f"w{k}".encode() for k in range(300)]
    y = x[:100] + [b"new"] + x[103:]
    s, t = (jaccard_join.shingles(b" ".join(w), 3, hashes) for w in (x, y))
    differ = len(np.setxor1d(s, t))
    assert len(s) == 298 and jaccard_join.apart(*(jaccard_join.parities(z, 512) for z in (s, t))) <= differ == 8
    assert jaccard_join.apart(jaccard_join.parities(s, 2048), jaccard_join.parities(t, 512)) <= differ
    assert jaccard_join.apart(jaccard_join.parities(s, 8192), jaccard_join.parities(t, 8192)) == differ

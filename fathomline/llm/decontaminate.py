"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive words of the test items. Over each document's
words runs the Wu-Manber loop: the shift table says, from the block of two words that ends at
the current place, how far no pattern can end, so most places are skipped; where the
shift is zero, the block's hash bucket selects the windows that end with it, and a direct
comparison of all words confirms the occurrence. Items shorter than a window are patterns
of their own length with tables of their own.

The tables hold some ``table_words`` benchmark words. A larger benchmark is split by
item hash and the documents are searched once per part: a part's hits are written to the shared folder, by the hash of the
text, before the next part is collected and sent out, and are united afterwards.

Defined cases: null and word-free texts have no words and no hits; a word-free item has no
windows; equal item_ids are one item; items without an id contaminate but are not listed; repeated documents are each reported; an
empty benchmark contaminates nothing; an empty table gives an empty result; texts of any length are searched whole; further columns
are ignored or pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, carry, give_back, map_carried, named, stored, text_of, utf8

WINDOW = 10
TABLE_WORDS = 2_000_000


def _table() -> bytes:
    """Bytes that are no word become spaces, A-Z become lower case; UTF-8 bytes over 127 stay."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        out[c] = c
    for c in range(65, 91):
        out[c] = c + 32
    return bytes(out)


TO_WORDS = _table()


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class WuManber:
    """Shift tables and suffix buckets for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list], length: int):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - 2 : end] if self.block == 2 else p[0]
                step = length - end
                if step < self.shift.get(key, self.skip):
                    self.shift[key] = step
            self.bucket[p[-2:] if self.block == 2 else p[-1]].append((list(p), items))

    def search(self, text: list[bytes]) -> list[tuple[int, list]]:
        """(start, items) of every occurrence."""
        found, shift, m, skip = [], self.shift.get, self.length, self.skip
        at, n = m - 1, len(text)
        while at < n:
            key = (text[at - 1], text[at]) if self.block == 2 else text[at]
            step = shift(key, skip)
            if step:
                at += step
                continue
            start = at - m + 1
            for p, items in self.bucket[key]:
                if text[start : at + 1] == p:
                    found.append((start, items))
            at += 1
        return found


def build(items: list[tuple]) -> list[WuManber]:
    """One matcher for each pattern length, from (item_id, text bytes)."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words(text)
        m = min(WINDOW, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            owners = by_length[m][tuple(w[k : k + m])]
            if item not in owners:
                owners.append(item)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def scan(text: bytes, matchers: list[WuManber]) -> tuple[int, list[int], set]:
    """Number of words, hit positions as flat [start, end) pairs that neither touch nor overlap, items."""
    w = words(text)
    spans, items = [], set()
    for m in matchers:
        for start, owners in m.search(w):
            spans.append((start, start + m.length))
            items.update(owners)
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return len(w), flat, items


def _parts(benchmark: DataFrame, table_words: int) -> Iterator[tuple[bool, list[tuple]]]:
    """The items, in parts whose words fit the bound; each part is brought to the driver when it is asked for."""
    items = benchmark.select(named("item_id").cast("string").alias("item_id"), F.coalesce(text_of(benchmark), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2 + 1
    parts = -(-total // table_words)
    for k in range(parts):
        chosen = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield k + 1 == parts, [(r[0], r[1].encode()) for r in chosen.collect()]  # some ``table_words`` words


BUILT: dict[str, list[WuManber]] = {}


def _matchers(token: str, shared) -> list[WuManber]:
    """The tables of one part: made once in a Python worker, those of the part before are dropped."""
    if token not in BUILT:
        BUILT.clear()
        BUILT[token] = build(shared.value)
    return BUILT[token]


def _search(docs: DataFrame, shared) -> DataFrame:
    """Columns n_words, spans and items beside what ``docs`` carries."""
    token = uuid.uuid4().hex

    def make():
        matchers = _matchers(token, shared)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            n, flat, items = [], [], []
            for text in utf8(batch.column("text")):
                a, b, c = scan(text, matchers)
                n.append(a)
                flat.append(b)
                items.append(sorted(x for x in c if x is not None))
            return [pa.array(n, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

        return step

    return map_carried(docs, "n_words long, spans array<int>, items array<string>", make)


def _total(spans: Column) -> Column:
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], table_words: int) -> DataFrame:
    """The caller's columns ``keep`` as one, n_words, spans (flat word positions of the hits) and items."""
    hashes = [F.xxhash64(named("text").cast("string")).alias("t1"), F.xxhash64(F.lit("second"), named("text").cast("string")).alias("t2")]
    key = ["t1", "t2"]
    earlier = None
    for last, part in _parts(benchmark, table_words):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        if last:
            break
        hits = _search(carry(docs.select(*hashes, text_of(docs)), key, F.col("text")), shared).filter(F.size("spans") > 0)
        hits = stored(give_back(hits, key, "spans", "items").dropDuplicates(key), "hits")
        shared.destroy()
        earlier = hits if earlier is None else earlier.unionAll(hits)
    if earlier is None:
        return _search(carry(docs, keep, text_of(docs)), shared)
    # A text has a row of hits from each part at most.
    gathered = earlier.groupBy(*key).agg(F.collect_list("spans").alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    rows = carry(docs, keep, text_of(docs), *hashes)
    rows = _search(carry(rows, [KEPT, *key], F.col("text")), shared)
    rows = give_back(rows, [KEPT, *key], "n_words", "spans", "items").join(gathered, key, "left")
    pairs = F.sort_array(F.flatten(F.transform(F.concat(F.array("spans"), F.coalesce("s", F.array().cast("array<array<int>>"))), _pairs)))
    merged = F.aggregate(
        pairs,
        F.array().cast("array<int>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["b"]))),
        ).otherwise(F.concat(acc, F.array(x["a"], x["b"]))),
    )
    items = F.sort_array(F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast("array<string>")))))
    return rows.select(KEPT, "n_words", F.when(F.col("s").isNull(), F.col("spans")).otherwise(merged).alias("spans"), items.alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """Columns ``keep`` (doc_id), then n_words, n_hit, n_items, items_sha256 and contaminated; one row for each document.

    Also ``spans`` (flat word positions of the hits) and ``items``.
    """
    keep = keep or ["doc_id"]
    return give_back(
        _found(docs, benchmark, keep, table_words),
        keep,
        "n_words",
        _total(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        "items",
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, table_words: int = TABLE_WORDS) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they were."""
    return give_back(_found(docs, benchmark, docs.columns, table_words).filter(F.size("spans") == 0), docs.columns)


def _pairs(flat: Column) -> Column:
    starts = F.filter(flat, lambda x, i: i % 2 == 0)
    ends = F.filter(flat, lambda x, i: i % 2 == 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

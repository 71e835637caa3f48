"""Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes.

Documents are dealt by ranges of doc_id, tokenized where they lie, and written in ascending
doc_id order (ties: by the text's hash, then as they came) as columns ``shard, ahead, doc_id, n_tokens, tokens``; ``ahead``
counts the ids of the shard before the row. Row groups and pages are
sized by parameters; the writer adds column and offset indexes, so a reader can take a
range of documents, or only the metadata columns, without touching other pages. Token
lists are dictionary-encoded by default and delta-encoded with ``encoding="delta"``.

Defined cases: null text is empty (it holds the end id alone); null doc_id sorts first;
repeated rows are kept, each with its own place in the file, and a doc_id of very many rows is dealt to several
shards; texts of any length are encoded whole; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_batches

END_ID = 2
JOINED = 256
PLAIN = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070))]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _letters(kind: str) -> str:
    """The characters of a general category (or white space, "Z") in the plain range, for a character class."""
    chosen = [c for c in PLAIN if (regex.fullmatch(r"\s", c) if kind == "Z" else unicodedata.category(c)[0] == kind)]
    return "".join(f"\\u{ord(c):04x}" for c in chosen)


class WordMemory:
    """Encodes whole texts with the tokenizers library, each distinct pre-token once.

    A byte-level BPE encodes the pieces that its pre-tokenizer cuts one by one, so a text's ids are
    those of its pieces in order. Texts of the plain range are cut here and their pieces looked up;
    pieces not met before go through the library, as do, whole, all texts with other characters (whose
    classes might depend on the Unicode version), all that hold the content of an added token, and all texts of
    other kinds of tokenizers.
    """

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        before = described.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not described.get("normalizer") and not described["model"].get("dropout")
        added = [t["content"] for t in described.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search  # may lie across pieces
        self.id_bytes = np.array([len(self.model.id_to_token(i) or "") for i in range(self.model.get_vocab_size())], np.int64)  # a character a byte
        self.blank = {c for c in PLAIN if regex.fullmatch(r"\s", c)}
        letter, number, space = (_letters(k) for k in "LNZ")
        self.cut = re.compile(f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.plain = re.compile("[\\x00-\u024f\u2000-\u206f]*").fullmatch

    def _library(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        out = []
        for k in range(0, len(texts), 4_096):
            out += [array("i", x.ids).tobytes() for x in encode(texts[k : k + 4_096], add_special_tokens=False)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pre-tokens. Those of a blank and a character that is not white space are cut again
        where they were joined, so they go to the library in longer texts; the bytes that each id
        stands for tell where a piece ends. All others go one by one."""
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        joined, rest = [], []
        for w in pieces:
            (joined if len(w) > 1 and w[0] == " " and w[1] not in self.blank else rest).append(w)
        for k in range(0, len(joined), JOINED):
            part = joined[k : k + JOINED]
            whole = "".join(part)
            if self.added(whole):  # one that lies across joined pieces
                rest += part
                continue
            ids = np.array(encode([whole], add_special_tokens=False)[0].ids, "<i4")
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in part])
            reached = np.cumsum(self.id_bytes[ids])
            last = np.searchsorted(reached, ends)
            if last[-1] == len(ids) - 1 and (reached[last] == ends).all():
                data, at = ids.tobytes(), (4 * (last + 1)).tolist()
                self.known.update(zip(part, [data[a:b] for a, b in zip([0, *at], at)]))
            else:
                rest += part
        self.known.update(zip(rest, self._library(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        if not self.cuts:
            return self._library(texts)
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        pieces: list[str] = []
        ends = []
        for x in texts:
            if self.plain(x) and not self.added(x):
                pieces += self.cut(x)
            ends.append(len(pieces))
        found = list(map(known.get, pieces))
        lacking = [i for i, x in enumerate(found) if x is None]
        wanted = {pieces[i] for i in lacking}
        again = {w for w in wanted if w in older}  # what is met again moves to the younger generation
        known.update((w, older[w]) for w in again)
        self._learn(list(wanted - again))
        for i in lacking:
            found[i] = known[pieces[i]]
        return [b"".join(found[a:b]) if a < b or not x else self._library([x])[0] for x, a, b in zip(texts, [0, *ends], ends)]


@lru_cache(maxsize=2)
def _memory(path: str, remembered: int) -> WordMemory:
    """One for all tasks of a Python worker."""
    return WordMemory(path, remembered)


def tokenize(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, at_once: int = 1 << 18, remembered: int = 450_000) -> DataFrame:
    """Columns shard (the partition), ahead (ids of the partition before the row), doc_id, n_tokens, tokens; row order is kept.
    ``at_once``: characters encoded together."""
    path = vocabulary or tokenizer_path()
    end = np.array([end_id], "<i4").tobytes()
    names = ["shard", "ahead", "doc_id", "n_tokens", "tokens"]

    def make():
        model = _memory(path, remembered)
        before = 0  # a task is one partition, its batches come in order

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal before
            found: list[bytes] = []
            group: list[str] = []
            held = 0
            for text in batch.column("text").to_pylist():
                group.append(text)
                held += len(text)
                if held >= at_once:
                    found += model.encode(group)
                    group, held = [], 0
            found += model.encode(group)
            sizes = np.array([len(x) // 4 + 1 for x in found], np.int64)
            ends = before + np.cumsum(sizes)
            ahead, before = ends - sizes, int(ends[-1])
            tokens = _lists(np.frombuffer(end.join([*found, b""]), np.int32), sizes)
            return pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(ahead), batch.column("doc_id"), pa.array(sizes), tokens], names=names)

        return step

    rows = docs.select("shard", "doc_id", "text")
    return map_batches(rows, "shard int, ahead long, doc_id long, n_tokens long, tokens array<int>", make)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
) -> None:
    """Write the token table of ``docs`` (doc_id, text) below ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = ["doc_id", "tie", "place"]  # so that a doc_id of very many rows, and equal rows, can be dealt to several shards
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("shard", F.spark_partition_id())
    )
    (
        tokenize(ordered, vocabulary, end_id)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true" if encoding == "dictionary" else "false")
        .option("parquet.dictionary.page.size", str(2 << 20))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The token table, optionally only a range of doc_id (pushed down to pages)."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    return df if last is None else df.filter(F.col("doc_id") <= last)


def positions(tokens: DataFrame) -> DataFrame:
    """Columns doc_id, start (tokens of all rows before in file order), n_tokens, ids_crc32, from the written table.

    The totals of the shards are as many rows as there are write partitions, so no row but them is shuffled.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("tokens")
            values = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = column.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            return pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("ahead"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=names)

        return step

    names = ["shard", "ahead", "doc_id", "n_tokens", "ids_crc32"]
    rows = map_batches(tokens.select("shard", "ahead", "doc_id", "tokens"), "shard int, ahead long, doc_id long, n_tokens long, ids_crc32 long", make)
    totals = tokens.groupBy("shard").agg(F.max(F.col("ahead") + F.col("n_tokens")).alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path)
    return positions(read_tokens(spark, path))

"""Binary layouts as data: fields, and lists of records counted by a field before them, compiled to a schema and a decoder.

A field has a struct code (little-endian), in which ``{name}`` stands for the value of any earlier field of the record or of those around it, and a conversion
of what was read. Fields whose name begins with an underscore are read but not given. Nothing in a file ends the job: a record that can't be read to its end keeps
what was read, and ``problem`` says what went wrong and where; bytes behind the last field are a problem too.

Defined cases: a negative length or count is none; null content has the problem ``no content``; an empty file ends in its first field; a count that
the file can't hold ends where the bytes do.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Spark's types for the struct codes.
TYPES = {"b": "tinyint", "B": "smallint", "h": "smallint", "H": "int", "i": "int", "I": "bigint", "q": "bigint", "Q": "decimal(20,0)", "f": "float", "d": "double", "s": "binary"}
HEAD = 4096  # bytes of a file's beginning that a check sees
AHEAD = 65_536  # bytes that pieces of a file are put together to


@dataclass(frozen=True)
class Field:
    """One value. ``kind`` is its SQL type, which a conversion has to be given with."""

    name: str
    code: str
    convert: Callable[[Any], Any] | None = None
    kind: str | None = None

    def sql(self) -> str:
        return self.kind or TYPES[self.code[-1]]

    def size(self) -> str:
        """Its bytes, or ``varies``."""
        return "varies" if "{" in self.code else str(struct.calcsize("<" + self.code))

    @cached_property
    def length(self) -> str | None:
        """The field that says how many bytes this one has, where that is all that its code says."""
        found = re.fullmatch(r"\{(\w+)\}s", self.code)
        return found and found[1]


@dataclass(frozen=True)
class Repeat:
    """As many records as the earlier field ``count`` says. Records of one field that has the list's name are its values."""

    name: str
    fields: tuple[Field | Repeat, ...]
    count: str

    def plain(self) -> bool:
        return len(self.fields) == 1 and isinstance(self.fields[0], Field) and self.fields[0].name == self.name

    def sql(self) -> str:
        return f"array<{self.fields[0].sql()}>" if self.plain() else f"array<struct<{ddl(self.fields, ': ')}>>"

    @cached_property
    def steps(self) -> tuple[Run | Field | Repeat, ...]:
        return steps(self.fields)


@dataclass(frozen=True)
class Run:
    """Fields of one value and a fixed size that stand one behind the other: they are read at once."""

    fields: tuple[Field, ...]
    code: str
    size: int


def steps(fields: tuple[Field | Repeat, ...]) -> tuple[Run | Field | Repeat, ...]:
    out: list = []
    for fixed, some in groupby(fields, lambda f: isinstance(f, Field) and re.fullmatch(r"\d*s|[bBhHiIqQfd]", f.code) is not None):
        if fixed:
            run = tuple(some)
            code = "<" + "".join(f.code for f in run)
            out.append(Run(run, code, struct.calcsize(code)))
        else:
            out += some
    return tuple(out)


def given(fields: tuple[Field | Repeat, ...]) -> list[Field | Repeat]:
    return [f for f in fields if not f.name.startswith("_")]


def ddl(fields: tuple[Field | Repeat, ...], between: str = " ") -> str:
    return ", ".join(f"{f.name}{between}{f.sql()}" for f in given(fields))


def _given(record: dict, parts: tuple[Field | Repeat, ...]) -> dict:
    """Of a record what is given of its fields."""
    return {f.name: record.get(f.name) if isinstance(f, Field) or f.plain() or f.name not in record else [_given(x, f.fields) for x in record[f.name]] for f in given(parts)}


class Broken(Exception):
    """What can't be read, and where."""


class Reader:
    """One file's bytes, which come in pieces, a place in them, and the values of the records that are open. What was read is let go when the next pieces are taken up."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.data, self.start, self.at, self.open = iter(pieces), b"", 0, 0, []

    def has(self, size: int) -> bool:
        """Whether so many bytes are left."""
        if self.at + size <= len(self.data):
            return True
        some = [self.data[self.at :]] if self.at < len(self.data) else []
        found = sum(map(len, some))
        for piece in self.pieces:
            some.append(piece)
            found += len(piece)
            if found >= max(size, AHEAD):
                break
        self.data, self.start, self.at = b"".join(some), self.start + self.at, 0
        return size <= found

    def rest(self) -> int:
        """How many bytes are left."""
        return len(self.data) - self.at + sum(map(len, self.pieces))

    def value(self, name: str) -> Any:
        for record in reversed(self.open):
            if name in record:
                return record[name]
        raise Broken(f"no field {name} before place {self.start + self.at}")

    def take(self, field: Field) -> Any:
        size, code = self.value(field.length) if field.length else None, ""
        if isinstance(size, int):
            size = max(0, size)
        else:
            code = "<" + re.sub(r"\{(\w+)\}", lambda m: str(max(0, self.value(m[1]))), field.code)
            size = struct.calcsize(code)
        if not self.has(size):
            raise Broken(f"{field.name} at {self.start + self.at} needs {size} bytes, {len(self.data) - self.at} are left")
        raw = struct.unpack_from(code, self.data, self.at)[0] if code else self.data[self.at : self.at + size]
        try:
            found = field.convert(raw) if field.convert else raw
        except Exception as e:  # a caller's conversion may fail as it likes
            raise Broken(f"{field.name} at {self.start + self.at}: {e}") from e
        self.at += size
        return found

    def take_run(self, run: Run, out: dict) -> None:
        if not self.has(run.size):
            for f in run.fields:  # up to the one that breaks
                out[f.name] = self.take(f)
            return
        for f, raw in zip(run.fields, struct.unpack_from(run.code, self.data, self.at)):
            try:
                out[f.name] = f.convert(raw) if f.convert else raw
            except Exception as e:  # likewise
                before = struct.calcsize("<" + "".join(x.code for x in run.fields[: run.fields.index(f)]))
                raise Broken(f"{f.name} at {self.start + self.at + before}: {e}") from e
        self.at += run.size

    def step(self, step: Run | Field | Repeat, out: dict) -> None:
        if isinstance(step, Run):
            self.take_run(step, out)
        elif isinstance(step, Field):
            out[step.name] = self.take(step)
        else:
            rows = out[step.name] = []
            for _ in range(max(0, self.value(step.count))):
                if step.plain():
                    rows.append(self.take(step.fields[0]))
                    continue
                row: dict = {}
                rows.append(row)
                self.record(step.steps, row)

    def record(self, steps: tuple[Run | Field | Repeat, ...], out: dict) -> None:
        """Fill ``out``; what was read stays in it if something breaks."""
        self.open.append(out)
        for step in steps:
            self.step(step, out)
        self.open.pop()

    def records(self, steps: tuple[Run | Field | Repeat, ...], out: dict, path: list[str], around: tuple = ()) -> Iterator[tuple[tuple, int, dict]]:
        """The records of the list that ``path`` leads to, each with its number and the numbers and records around it; other lists are read and let go record by record."""
        self.open.append(out)
        for step in steps:
            if not isinstance(step, Repeat):
                self.step(step, out)
                continue
            found = step.name == path[0]
            for k in range(max(0, self.value(step.count))):
                row: dict = {}
                if found and len(path) > 1:
                    yield from self.records(step.steps, row, path[1:], (*around, (k, row)))
                    continue
                try:
                    if step.plain():
                        row[step.name] = self.take(step.fields[0])
                    else:
                        self.record(step.steps, row)
                except Broken:
                    if found and not step.plain():
                        yield around, k, row
                    raise
                if found:
                    yield around, k, row
            if found and not around:
                return  # what stands behind the list isn't read
        self.open.pop()


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field | Repeat, ...]
    check: Callable[[bytes], str | None] = lambda data: None  # a problem that can be seen in a file's beginning (``HEAD``) before anything is read

    @cached_property
    def steps(self) -> tuple[Run | Field | Repeat, ...]:
        return steps(self.fields)

    def decode(self, data: bytes | None) -> tuple[dict, str | None]:
        """The fields that could be read, and the problem, if there is one."""
        out: dict = {}
        if data is None:
            return out, "no content"
        if problem := self.check(data[:HEAD]):
            return out, problem
        reader = Reader([data])
        try:
            reader.record(self.steps, out)
        except Broken as e:
            return out, str(e)
        rest = reader.rest()
        return out, f"{rest} bytes after the last field" if rest else None

    def records(self, pieces: Iterable[bytes], path: str) -> Iterator[tuple[tuple, int, dict]]:
        """Of a file in pieces the records of one list (``a``), or of a list in another one's records (``a.b``), as they are read: the numbers and records around it as far as they
        stand before it, its number, and itself. As in ``decode`` one that breaks off is given as far as it goes, and nothing comes after it."""
        reader = Reader(pieces)
        reader.has(HEAD)
        if self.check(reader.data[:HEAD]):
            return
        try:
            yield from reader.records(self.steps, {}, path.split("."))
        except Broken:
            return

    def each(self, data: bytes | None, name: str) -> Iterator[dict]:
        """The records of one list of a file, as they are read. What stands behind the list isn't read."""
        return (row for _, _, row in self.records([] if data is None else [data], name))

    def _rows(self, path: str, only: list[str] | None, at_once: int) -> tuple[StructType, Callable[[Iterable[tuple[str | None, Iterable[bytes]]]], Iterator[pa.RecordBatch]]]:
        """The schema of ``read_each``, and what makes its batches of files and their pieces."""
        names, fields, within = path.split("."), self.fields, []
        inner = lambda name: next(f for f in fields if isinstance(f, Repeat) and f.name == name)
        for name, below in zip(names, names[1:]):
            fields = inner(name).fields
            within.append((name, tuple(f for f in fields[: fields.index(inner(below))] if isinstance(f, Field))))
        mine = tuple(f for f in given(inner(names[-1]).fields) if only is None or f.name in only)
        around = "".join(f", {name} struct<seq: int{''.join(f', {f.name}: {f.sql()}' for f in given(before))}>" for name, before in within)
        schema = StructType.fromDDL(f"source_file string{around}, seq int, {ddl(mine)}")
        arrow = to_arrow_schema(schema)
        flat = all(isinstance(f, Field) or f.plain() for f in mine)

        def run(files: Iterable[tuple[str | None, Iterable[bytes]]]) -> Iterator[pa.RecordBatch]:
            rows = ((file, *found) for file, pieces in files for found in self.records(pieces, path))
            while some := list(islice(rows, at_once)):
                yield pa.RecordBatch.from_pylist([{"source_file": file} | {name: {"seq": k} | _given(x, before) for (name, before), (k, x) in zip(within, around)} | {"seq": seq} | (row if flat else _given(row, mine)) for file, around, seq, row in some], schema=arrow)

        return schema, run

    def read_each(self, files: DataFrame, path: str, at_once: int = 5_000) -> DataFrame:
        """Of (source_file, content) a row of each record of a list (see ``records``): source_file, a struct (seq, fields) for each record around it, seq, its fields. A file's records are never in memory at once."""
        schema, rows = self._rows(path, None, at_once)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            contents = ((file.as_py(), content.as_py()) for batch in batches for file, content in zip(batch.column("source_file"), batch.column("content")))
            yield from rows((file, [] if content is None else [content]) for file, content in contents)

        return files.select(F.col("source_file").cast("string").alias("source_file"), "content").mapInArrow(run, schema)

    def read_pieces(self, pieces: DataFrame, path: str, only: list[str] | None = None, at_once: int = 5_000) -> DataFrame:
        """``read_each`` of files in small pieces, rows of (source_file, place, content): a file's bytes are its pieces in the order of ``place``. One task reads them one behind the other,
        and neither the bytes of a file nor its records are in memory at once. ``only``: the fields that are given."""
        schema, rows = self._rows(path, only, at_once)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            contents = (x for batch in batches for x in zip(*(batch.column(name).to_numpy(zero_copy_only=False).tolist() for name in ("source_file", "content"))))
            yield from rows((file, (content for _, content in some if content is not None)) for file, some in groupby(contents, itemgetter(0)))

        dealt = pieces.select(F.col("source_file").cast("string").alias("source_file"), "place", "content").repartition("source_file")
        return dealt.sortWithinPartitions("source_file", "place").select("source_file", "content").mapInArrow(run, schema)

    def schema(self) -> StructType:
        return StructType.fromDDL(f"source_file string, {ddl(self.fields)}, problem string")

    def read(self, files: DataFrame) -> DataFrame:
        """A row of each file of (source_file, content): source_file, the fields, and problem."""
        schema = self.schema()
        arrow = to_arrow_schema(schema)
        fields = self.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, content in zip(batch.column("source_file").to_pylist(), batch.column("content").to_pylist()):
                    record, problem = self.decode(content)
                    yield pa.RecordBatch.from_pylist([{"source_file": file} | _given(record, fields) | {"problem": problem}], schema=arrow)

        return files.select(F.col("source_file").cast("string").alias("source_file"), "content").mapInArrow(run, schema)

    def table(self) -> list[tuple[str, str, str]]:
        """name, format, size of every field in file order; nested names are joined by `` - ``."""
        out: list[tuple[str, str, str]] = []

        def add(fields: tuple[Field | Repeat, ...], before: str) -> None:
            for f in fields:
                if isinstance(f, Field):
                    out.append((before + f.name, "<" + f.code, f.size()))
                else:
                    add(f.fields, before if f.plain() else f"{before}{f.name} - ")

        add(self.fields, "")
        return out


def text(name: str, encoding: str) -> tuple[Field, Field]:
    """A text with its length in bytes before it."""
    return Field(f"_{name}_length", "i"), Field(name, f"{{_{name}_length}}s", lambda raw: raw.decode(encoding).removeprefix("﻿"), "string")

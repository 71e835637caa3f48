"""Media columns: ISO base media files (MP4) and their structure, without decoding payloads.

``pack`` stores a payload as 8-bit PCM samples in an audio track: fixed frames of 576
samples, chunks of frames, every n-th frame marked as sync sample. ``probe`` walks the
nested boxes and decodes the sample tables of each track (stts, stsc, stsz or stz2, stco or co64, stss) and the
runs of its movie fragments (tfhd, trun): codec, duration and the byte range of each keyframe; it never looks inside ``mdat``.

Broken files: a track whose tables are missing, end early or contradict each other has ``problem`` set, and what could be read
of it; samples that reach past the end of the file are left out and are a problem too; a file without a track has no tracks;
where boxes nest deeper than ``DEPTH``, the file has a problem and what stands before that place; a duration of more than 63 bits is a problem and 0. The
columns of a file are those of its first track.

Defined cases: null text is empty; an empty payload is one frame of padding; equal texts
give equal bytes; texts of any length are stored whole; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh_path, map_batches, named, text_of, utf8

FRAME = 576
RATE = 8000
KEY_EVERY = 25
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
DEPTH = 64  # of nested boxes; the format's own have a dozen
LONGEST = (1 << 63) - 1
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    return struct.pack(">I4s", size, kind) + b"".join(body)


def full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the frame size."""
    short = -len(data) % FRAME or (FRAME if not data else 0)
    return data + b"\xff" * short


def pack(payload: bytes, key_every: int = KEY_EVERY) -> bytes:
    """An MP4 whose only track holds ``payload`` (a positive multiple of 576 bytes) unchanged."""
    frames = len(payload) // FRAME
    keys = range(1, frames + 1, key_every)
    chunks = -(-frames // key_every)
    last = frames - (chunks - 1) * key_every
    runs = [(1, key_every if chunks > 1 else last)] + ([(chunks, last)] if chunks > 1 and last != key_every else [])
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    wide = len(payload) > 0xF0000000

    def moov(base: int) -> bytes:
        at = [base + k * key_every * FRAME for k in range(chunks)]
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *at)),
        )
        long = len(payload)
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, min(long, 0xFFFFFFFF), 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, min(long, 0xFFFFFFFF), 0, 0, 0, 0x100, 0), MATRIX, bytes(8), flags=7),
                box(
                    b"mdia",
                    struct.pack(">I4sIQQIQHH", 44, b"mdhd", 1 << 24, 0, 0, RATE, long, 0x55C4, 0),
                    full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
                    box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
                ),
            ),
        )

    extra = 16 if wide else 8
    base = len(head) + len(moov(0)) + extra
    data_head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return head + moov(base) + data_head + payload


def walk(data):
    """Yield (path, body start, body end) for every box, depth first. Broken sizes end the walk of their parent;
    boxes inside of more than ``DEPTH`` others are an error."""
    open_boxes: list[tuple[tuple, int]] = [((), len(data))]
    start = 0
    while open_boxes:
        path, end = open_boxes[-1]
        if start + 8 > end:
            open_boxes.pop()
            start = end
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            open_boxes.pop()
            start = end
            continue
        here = (*path, kind)
        yield here, body, start + size
        if kind in CONTAINERS:
            if len(here) > DEPTH:
                raise ValueError(f"boxes nest deeper than {DEPTH}")
            open_boxes.append((here, start + size))
            start = body
        else:
            start += size


class Track:
    """What the boxes of one track say."""

    def __init__(self):
        self.number, self.codec, self.timescale, self.duration, self.problem = None, None, 0, 0, None
        self.sizes: list[int] = []
        self.offsets: list[int] = []
        self.keys: list[int] = []  # sample numbers from 1
        self.defaults = (0, 0, 0)  # duration, size and flags of a fragment's samples

    def keyframes(self) -> list[tuple[int, int, int]]:
        return [(k, self.offsets[k - 1], self.sizes[k - 1]) for k in self.keys if 0 < k <= len(self.offsets)]

    def runs(self) -> list[tuple[int, int]]:
        """(offset, length) of the stretches of samples that lie one after the other."""
        out: list[list[int]] = []
        for at, n in zip(self.offsets, self.sizes):
            if out and sum(out[-1]) == at:
                out[-1][1] += n
            else:
                out.append([at, n])
        return [tuple(x) for x in out]


class Tables:
    """Reads numbers of a track's boxes; what is missing or ends early is an error."""

    def __init__(self, data, boxes: dict[bytes, tuple[int, int]]):
        self.data, self.boxes = data, boxes

    def read(self, kind: bytes, fmt: str, skip: int = 4) -> tuple:
        if kind not in self.boxes:
            raise ValueError(f"no box {kind.decode('latin-1').strip()}")
        at, end = self.boxes[kind]
        if at + skip + struct.calcsize(fmt) > end:
            raise ValueError(f"box {kind.decode('latin-1').strip()} ends early")
        return struct.unpack_from(fmt, self.data, at + skip)

    def column(self, kind: bytes, unit: str, per: int = 1, skip: int = 4) -> tuple:
        (n,) = self.read(kind, ">I", skip)
        return self.read(kind, f">{n * per}{unit}", skip + 4)


def _sample_sizes(t: Tables, most: int) -> list[int]:
    if b"stz2" in t.boxes:
        width, n = t.read(b"stz2", ">3xBI", 4)
        if width == 4:
            return [x for b in t.read(b"stz2", f">{(n + 1) // 2}B", 12) for x in (b >> 4, b & 15)][:n]
        if width not in (8, 16):
            raise ValueError("box stz2 has an unknown width")
        return list(t.read(b"stz2", f">{n}{'B' if width == 8 else 'H'}", 12))
    fixed, n = t.read(b"stsz", ">II")
    if fixed and n > most // fixed:
        raise ValueError("more samples than the file has room for")
    return [fixed] * n if fixed else list(t.read(b"stsz", f">{n}I", 12))


def _decode(t: Tables, track: Track, most: int) -> None:
    """Fill the track from its sample tables."""
    track.codec = t.read(b"stsd", ">4s", 12)[0].decode("latin-1")
    long = t.read(b"mdhd", ">B", 0)[0] == 1
    track.timescale, track.duration = t.read(b"mdhd", ">IQ" if long else ">II", 20 if long else 12)
    sizes = _sample_sizes(t, most)
    times = t.column(b"stts", "I", 2)
    track.duration = sum(c * d for c, d in zip(times[::2], times[1::2])) or track.duration
    chunks = t.column(b"co64", "Q") if b"co64" in t.boxes else t.column(b"stco", "I")
    groups = t.column(b"stsc", "I", 3)
    firsts = [*groups[::3], len(chunks) + 1]
    if any(a >= b for a, b in zip(firsts, firsts[1:])) or firsts[0] != 1:
        if groups or sizes:
            raise ValueError("box stsc contradicts the chunks")
    k = 0
    for first, after, per in zip(firsts, firsts[1:], groups[1::3]):
        for at in chunks[first - 1 : after - 1]:
            for size in sizes[k : k + per]:
                if at + size > most:
                    raise ValueError("a sample reaches past the end of the file")
                track.offsets.append(at)
                track.sizes.append(size)
                at += size
                k += 1
    track.keys = list(t.column(b"stss", "I")) if b"stss" in t.boxes else list(range(1, k + 1))
    if k < len(sizes):
        raise ValueError("more samples than the chunks hold")


def _fragment(data, boxes: list[tuple[bytes, int, int]], moof: int, tracks: dict[int, Track], most: int) -> None:
    """Add the runs of one track fragment to its track."""
    (head,) = [(a, b) for kind, a, b in boxes if kind == b"tfhd"][:1] or [(0, 0)]
    t = Tables(data, {b"tfhd": head})
    version_flags, number = t.read(b"tfhd", ">II", 0)
    track = tracks.get(number)
    if track is None:
        return
    flags, at = version_flags & 0xFFFFFF, 8
    base, (duration, size, sample_flags) = moof, track.defaults
    for bit, fmt in ((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")):
        if flags & bit:
            (value,) = t.read(b"tfhd", fmt, at)
            at += struct.calcsize(fmt)
            base = value if bit == 1 else base
            duration = value if bit == 8 else duration
            size = value if bit == 16 else size
            sample_flags = value if bit == 32 else sample_flags
    place = base
    for kind, a, b in boxes:
        if kind != b"trun":
            continue
        t = Tables(data, {b"trun": (a, b)})
        version_flags, n = t.read(b"trun", ">II", 0)
        flags, at, first = version_flags & 0xFFFFFF, 8, None
        if flags & 1:
            place = base + t.read(b"trun", ">i", at)[0]
            at += 4
        if flags & 4:
            (first,) = t.read(b"trun", ">I", at)
            at += 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if n > most:
            raise ValueError("more samples than the file has room for")
        for k, values in enumerate([t.read(b"trun", f">{len(fields)}I", at + 4 * len(fields) * i) for i in range(n)]):
            own = dict(zip(fields, values))
            long, shown = own.get(0x200, size), own.get(0x400, first if k == 0 and first is not None else sample_flags)
            if place < 0 or place + long > most:
                raise ValueError("a sample reaches past the end of the file")
            track.offsets.append(place)
            track.sizes.append(long)
            track.duration += own.get(0x100, duration)
            if not shown & 0x10000:  # the bit that says "not a sync sample"
                track.keys.append(len(track.offsets))
            place += long


def tracks_of(data: bytes) -> list[Track]:
    """All tracks of a file, in order."""
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[int, list]] = []
    moof, broken = 0, None
    boxes_of = walk(data)
    while True:
        try:
            path, a, b = next(boxes_of)
        except StopIteration:
            break
        except ValueError as error:
            broken = str(error)
            break
        if path == (b"moof",):
            moof = a - 8
        elif path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (a, b))
        elif path == (b"moov", b"mvex", b"trex") and a + 24 <= b:
            _, number, _, duration, size, flags = struct.unpack_from(">6I", data, a)
            defaults[number] = (duration, size, flags)
        elif path == (b"moof", b"traf"):
            fragments.append((moof, []))
        elif path[:2] == (b"moof", b"traf"):
            fragments[-1][1].append((path[-1], a, b))
    out, by_number = [], {}
    for boxes in found:
        track, t = Track(), Tables(data, boxes)
        try:
            long = t.read(b"tkhd", ">B", 0)[0] == 1
            (track.number,) = t.read(b"tkhd", ">I", 20 if long else 12)
            track.defaults = defaults.get(track.number, track.defaults)
            _decode(t, track, len(data))
        except ValueError as error:
            track.problem = str(error)
        by_number.setdefault(track.number, track)
        out.append(track)
    for begin, boxes in fragments:
        try:
            _fragment(data, boxes, begin, by_number, len(data))
        except ValueError as error:
            for track in out[:1]:
                track.problem = track.problem or str(error)
    if broken and not out:
        out.append(Track())
    for track in out:
        if track.duration > LONGEST:
            track.duration, broken = 0, broken or "a duration has more than 63 bits"
        track.problem = track.problem or broken
    return out


def probe(data: bytes) -> dict:
    """Codec, timescale, duration, sample count, problem, and (sample number, offset, length) of the keyframes
    and the stretches of all samples of the first track; of a file without one, nulls and zeros."""
    t = (tracks_of(data) or [Track()])[0]
    return {"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": len(t.offsets), "keys": t.keyframes(), "runs": t.runs(), "problem": t.problem}


def payload_of(data: bytes, found: dict | None = None) -> bytes:
    """The track's samples in order, read through its sample tables."""
    return b"".join(data[a : a + n] for a, n in (found or probe(data))["runs"])


PACKED = "doc_id long, n_bytes long, media binary"
PROBED = (
    "doc_id long, n_bytes long, codec string, timescale long, duration long, "
    "keyframes array<struct<sample: long, start: long, length: long>>, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, media_bytes long, media_sha256 string, problem string"
)


def encode_documents(docs: DataFrame, key_every: int = KEY_EVERY) -> DataFrame:
    """Columns doc_id, n_bytes and media (the MP4) from doc_id and text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column("text"))
            sizes = pa.array([len(x) for x in texts], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array([pack(pad(x), key_every) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

        return step

    return map_batches(docs.select(named("doc_id").cast("long").alias("doc_id"), text_of(docs)), PACKED, make)


def describe(media: DataFrame) -> DataFrame:
    """Codec, duration, keyframe byte ranges and digests of the files in column ``media``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(10)]
            for data in batch.column("media").to_pylist():
                data = data or b""
                found = probe(data)
                payload = payload_of(data, found)
                row = (
                    found["codec"],
                    found["timescale"],
                    found["duration"],
                    [{"sample": s, "start": a, "length": n} for s, a, n in found["keys"]],
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]),
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    found["problem"],
                )
                for c, v in zip(cols, row):
                    c.append(v)
            keys = pa.list_(pa.struct([("sample", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
            kinds = [pa.string(), pa.int64(), pa.int64(), keys, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split(" ")[0] for x in PROBED.replace("array<struct<sample: long, start: long, length: long>>", "x").split(", ")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

        return step

    return map_batches(media.select("doc_id", "n_bytes", "media"), PROBED, make)


def store_and_describe(docs: DataFrame) -> DataFrame:
    """Write the media column as Parquet in the shared folder, read it back and describe it."""
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    encode_documents(docs).write.option("compression", "zstd").parquet(path)
    return describe(spark.read.parquet(path))

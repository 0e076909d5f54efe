"""Media columns from ISO base media containers (MP4 and relatives).

A container is walked box by box, its sample tables are decoded, and codec, duration and the byte ranges of
keyframe groups are stored as columns; payload bytes are never decoded.  :func:`write` makes the plainest such
container, one track of 8-bit samples, so that any bytes can be carried in one and read back exactly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex", b"mfra", b"skip"}
UNIT = 64
RATE = 8000
GROUP_UNITS = 16

TRACK = (
    "track_id int, handler string, codec string, timescale long, duration long, seconds double, samples long, "
    "media_bytes long, keyframes array<struct<sample:long,offset:long,length:long>>"
)
COLUMNS = f"brand string, tracks array<struct<{', '.join(f'{n}:{t}' for n, t in (c.strip().split(' ', 1) for c in TRACK.split(', ')))}>>, error string"


class Broken(ValueError):
    """The bytes are no well-formed container."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(type, first byte of the body, end)`` of each box between two offsets."""
    at = start
    while at < end:
        if end - at < 8:
            raise Broken(f"{end - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise Broken(f"short box header at {at}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise Broken(f"box {kind!r} at {at} runs to {at + size}, its parent ends at {end}")
        yield kind, body, at + size
        at += size


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes below, each with its path, in file order."""
    if len(path) > 12:
        raise Broken("boxes nest too deeply")
    for kind, body, stop in boxes(data, start, end):
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))


#: Flags of fragments: what a track fragment header and a run of samples hold, and the mark of samples that are no keyframe.
TFHD = (("base", 0x1, ">Q"), ("description", 0x2, ">I"), ("duration", 0x8, ">I"), ("size", 0x10, ">I"), ("flags", 0x20, ">I"))
TFHD_FROM_MOOF = 0x20000
TRUN_OFFSET, TRUN_FIRST_FLAGS = 0x1, 0x4
TRUN_FIELDS = (("duration", 0x100), ("size", 0x200), ("flags", 0x400), ("shift", 0x800))
NO_KEYFRAME = 0x10000


def _table(data: memoryview, at: int, stop: int, kind: str, width: int = 1) -> np.ndarray:
    """A counted table: a 32-bit count, then rows of ``width`` numbers."""
    (n,) = struct.unpack_from(">I", data, at)
    size = np.dtype(kind).itemsize * width * n
    if at + 4 + size > stop:
        raise Broken("a sample table is longer than its box")
    return np.frombuffer(data, kind, n * width, at + 4).astype(np.int64).reshape(n, width)


class Track:
    """The sample tables of one track."""

    def __init__(self) -> None:
        self.id = self.scale = self.length = 0
        self.handler = self.codec = ""
        self.sizes = self.runs = self.chunks = self.deltas = np.empty(0, np.int64)
        self.sync: np.ndarray | None = None
        self.defaults = {"duration": 0, "size": 0, "flags": 0}
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # offsets, sizes, keyframe or not, of each run of a fragment
        self.added = 0  # the duration of all fragments

    def read(self, data: memoryview, kind: bytes, at: int, stop: int) -> None:
        version = data[at] if stop > at else 0
        if kind == b"tkhd":
            (self.id,) = struct.unpack_from(">I", data, at + (20 if version else 12))
        elif kind == b"mdhd":
            self.scale, self.length = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
            if self.length >= (1 << 63 if version else (1 << 32) - 1):  # not known
                self.length = 0
        elif kind == b"hdlr":
            self.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            if struct.unpack_from(">I", data, at + 4)[0]:
                self.codec = bytes(data[at + 12 : at + 16]).decode("latin-1").strip()
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            if same and n * same > len(data):
                raise Broken("more samples than the file holds")
            self.sizes = np.full(n, same, np.int64) if same else _table(data, at + 8, stop, ">u4")[:, 0]
        elif kind == b"stz2":
            bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            if bits == 4:
                if at + 12 + (n + 1) // 2 > stop:
                    raise Broken("a sample table is longer than its box")
                raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
                self.sizes = np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
            elif bits in (8, 16):
                self.sizes = _table(data, at + 8, stop, ">u2" if bits == 16 else ">u1")[:, 0]
            else:
                raise Broken(f"sample sizes of {bits} bits")
        elif kind == b"stsc":
            self.runs = _table(data, at + 4, stop, ">u4", 3)
        elif kind in (b"stco", b"co64"):
            self.chunks = _table(data, at + 4, stop, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stts":
            self.deltas = _table(data, at + 4, stop, ">u4", 2)
        elif kind == b"stss":
            self.sync = _table(data, at + 4, stop, ">u4")[:, 0]

    def fragment(self, data: memoryview, kind: bytes, at: int, stop: int, state: dict) -> None:
        """A header or a run of samples of a track fragment; ``state`` goes from box to box of a fragment."""
        flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
        if kind == b"tfhd":
            state |= {"flags": self.defaults["flags"], "size": self.defaults["size"], "duration": self.defaults["duration"]}
            place = at + 8
            for name, flag, form in TFHD:
                if flags & flag:
                    (state[name],) = struct.unpack_from(form, data, place)
                    place += struct.calcsize(form)
            if not flags & 0x1:
                state["base"] = state["moof"] if flags & TFHD_FROM_MOOF or "end" not in state else state["end"]
            state["next"] = state["base"]
            return
        (n,) = struct.unpack_from(">I", data, at + 4)
        place, first = at + 8, None
        if flags & TRUN_OFFSET:
            state["next"] = state["base"] + struct.unpack_from(">i", data, place)[0]
            place += 4
        if flags & TRUN_FIRST_FLAGS:
            (first,) = struct.unpack_from(">I", data, place)
            place += 4
        held = [name for name, flag in TRUN_FIELDS if flags & flag]
        if place + 4 * len(held) * n > stop:
            raise Broken("a run of samples is longer than its box")
        if n > len(data):
            raise Broken("more samples than the file holds")
        table = np.frombuffer(data, ">u4", n * len(held), place).astype(np.int64).reshape(n, len(held))
        field = {name: table[:, held.index(name)] if name in held else np.full(n, state.get(name, 0), np.int64) for name, _ in TRUN_FIELDS}
        if first is not None and n and "flags" not in held:
            field["flags"][0] = first
        sizes = field["size"]
        total = int(sizes.sum())
        if state["next"] < 0 or state["next"] + total > len(data):
            raise Broken("a sample ends after the file")
        self.pieces.append((state["next"] + np.cumsum(sizes) - sizes, sizes, field["flags"] & NO_KEYFRAME == 0))
        self.added += int(field["duration"].sum())
        state["next"] = state["end"] = state["next"] + total

    def offsets(self) -> np.ndarray:
        """The byte offset of each sample of the sample tables."""
        if not len(self.sizes):
            return np.empty(0, np.int64)
        if not len(self.runs) or not len(self.chunks):
            raise Broken("samples without chunks")
        if self.runs[0, 0] != 1 or (np.diff(self.runs[:, 0]) <= 0).any() or self.runs[-1, 0] > len(self.chunks):
            raise Broken("chunks aren't in order")
        ends = np.append(self.runs[1:, 0], len(self.chunks) + 1)
        per_chunk = np.repeat(self.runs[:, 1], ends - self.runs[:, 0])
        if per_chunk.sum() != len(self.sizes):
            raise Broken("chunks and samples don't add up")
        upto = np.append(0, np.cumsum(self.sizes))
        first = np.cumsum(per_chunk) - per_chunk
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
        at = self.chunks[chunk] + upto[:-1] - upto[first[chunk]]
        if at.min() < 0:
            raise Broken("a sample before the file")
        return at

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset, size and keyframe or not of each sample, those of the tables first, then those of fragments."""
        at = self.offsets()
        key = np.ones(len(at), bool) if self.sync is None else np.zeros(len(at), bool)
        if self.sync is not None:
            if len(self.sync) and (self.sync.min() < 1 or self.sync.max() > len(at)):
                raise Broken("a sync sample that isn't there")
            key[self.sync - 1] = True
        return tuple(np.concatenate(x) for x in zip((at, self.sizes, key), *self.pieces, strict=True))

    def duration(self) -> int:
        """As stated, or as the tables say; with what fragments add."""
        return (self.length or sum(int(n) * int(d) for n, d in self.deltas.tolist())) + self.added

    def keyframes(self) -> list[tuple[int, int, int]]:
        """``(number, offset, length)`` of each keyframe sample; without a sync table every sample of the tables is one."""
        at, sizes, key = self.samples()
        which = np.flatnonzero(key)
        return list(zip((which + 1).tolist(), at[which].tolist(), sizes[which].tolist(), strict=True))


def parse(data: bytes) -> tuple[str, list[Track]]:
    """The major brand and the tracks of a container, fragments included."""
    view = memoryview(data)
    brand, tracks, trex = "", [], {}
    moof = end = 0  # where the fragment begins, and where the last box of the file ended
    state: dict = {}
    try:
        for path, at, stop in walk(view, 0, len(view)):
            if len(path) == 1:
                moof, end = end, stop
                state = {"moof": moof}
            if path == (b"ftyp",):
                brand = bytes(view[at : at + 4]).decode("latin-1")
            elif path == (b"moov", b"trak"):
                tracks.append(Track())
            elif path[:2] == (b"moov", b"trak"):
                tracks[-1].read(view, path[-1], at, stop)
            elif path == (b"moov", b"mvex", b"trex"):
                number, _, duration, size, flags = struct.unpack_from(">5I", view, at + 4)
                trex[number] = {"duration": duration, "size": size, "flags": flags}
            elif path == (b"moof", b"traf", b"tfhd"):
                (number,) = struct.unpack_from(">I", view, at + 4)
                state["track"] = next((t for t in tracks if t.id == number), None)
                if state["track"] is None:
                    raise Broken(f"a fragment of track {number}, which isn't there")
                state["track"].defaults = trex.get(number, state["track"].defaults)
                state["track"].fragment(view, b"tfhd", at, stop, state)
            elif path == (b"moof", b"traf", b"trun"):
                if "track" not in state:
                    raise Broken("a run of samples without its header")
                state["track"].fragment(view, b"trun", at, stop, state)
    except (struct.error, IndexError) as e:
        raise Broken(f"a box is cut short: {e}") from None
    if not brand and not tracks:
        raise Broken("neither a brand nor a track")
    return brand, tracks


def samples(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, found through its sample tables and fragments."""
    at, sizes, _ = track.samples()
    if not len(at):
        return b""
    ends = at + sizes
    if ends.max() > len(data):
        raise Broken("a sample ends after the file")
    cuts = np.flatnonzero(at[1:] != ends[:-1]) + 1  # neighbouring samples are read together
    return b"".join(data[at[i] : ends[j - 1]] for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _words(*numbers: int) -> bytes:
    return struct.pack(f">{len(numbers)}I", *numbers)


def write(payload: bytes, unit: int = UNIT, rate: int = RATE, group: int = GROUP_UNITS) -> bytes:
    """A container whose one audio track holds ``payload`` (a multiple of ``unit`` bytes) as raw 8-bit samples.

    A table sample is ``unit`` bytes; ``group`` of them make a chunk that begins with a keyframe.  Equal payloads give
    equal files.
    """
    n, rest = divmod(len(payload), unit)
    if rest:
        raise ValueError(f"the payload is no multiple of {unit} bytes")
    chunks = -(-n // group)
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, rate << 16 if rate < 1 << 16 else 0))
    runs = [1, min(group, n), 1] + ([chunks, n - (chunks - 1) * group, 1] if chunks > 1 and n % group else [])
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    first = np.arange(chunks, dtype=np.int64) * group

    def head(base: int) -> bytes:
        wide = base + len(payload) >= 1 << 32
        offsets = (base + first * unit).astype(">u8" if wide else ">u4").tobytes()
        table = _box(
            b"stbl",
            _full(b"stsd", _words(1), entry),
            _full(b"stts", _words(1, n, unit)),
            _full(b"stss", _words(chunks), (first + 1).astype(">u4").tobytes()),
            _full(b"stsc", _words(len(runs) // 3, *runs)),
            _full(b"stsz", _words(unit, n)),
            _full(b"co64" if wide else b"stco", _words(chunks), offsets),
        )
        long = n * unit >= 1 << 32
        length = (lambda pre, post: struct.pack(">I", 1 << 24) + bytes(16) + pre + struct.pack(">Q", n * unit) + post) if long else (lambda pre, post: bytes(12) + pre + _words(n * unit) + post)
        return _box(b"ftyp", b"isom", _words(512), b"isom") + _box(
            b"moov",
            _box(b"mvhd", length(_words(rate), struct.pack(">IH10x", 0x10000, 0x100) + matrix + bytes(24) + _words(2))),
            _box(
                b"trak",
                _box(b"tkhd", (struct.pack(">I", 1 << 24 | 7) + bytes(16) if long else struct.pack(">I8x", 7)) + _words(1, 0) + (struct.pack(">Q", n * unit) if long else _words(n * unit)) + bytes(8) + struct.pack(">HHHH", 0, 0, 0x100, 0) + matrix + bytes(8)),
                _box(
                    b"mdia",
                    _box(b"mdhd", length(_words(rate), struct.pack(">HH", 0x55C4, 0))),
                    _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
                    _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", _words(1), _full(b"url ", flags=1))), table),
                ),
            ),
        )

    large = len(payload) + 8 >= 1 << 32
    base = len(head(0)) + (16 if large else 8)
    if len(head(base)) + (16 if large else 8) != base:  # wide offsets take more room
        base = len(head(base)) + (16 if large else 8)
    mark = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return head(base) + mark + payload


def _describe(data: bytes | None) -> tuple[str | None, list[dict] | None, str | None]:
    if data is None:
        return None, None, None
    try:
        brand, tracks = parse(data)
        found = []
        for t in tracks:
            sizes, length = t.samples()[1], t.duration()
            keys = [dict(zip(("sample", "offset", "length"), k, strict=True)) for k in t.keyframes()]
            found.append({"track_id": t.id, "handler": t.handler, "codec": t.codec, "timescale": t.scale, "duration": length, "seconds": length / t.scale if t.scale else None, "samples": len(sizes), "media_bytes": int(sizes.sum()), "keyframes": keys})
            if t.id >= 1 << 31 or length >= 1 << 63:
                raise Broken("a number that fits no column")
        return brand, found, None
    except (ValueError, OverflowError) as e:  # a Broken is a ValueError
        return None, None, str(e)


def _media_columns(batches: Iterator[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = list(zip(*(_describe(x.as_py()) for x in part.column(part.num_columns - 1)), strict=True))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(v, kinds.field(n).type) for v, n in zip(found, ("brand", "tracks", "error"), strict=True))], schema=pa.schema([*(part.schema.field(i) for i in range(part.num_columns - 1)), *(kinds.field(n) for n in ("brand", "tracks", "error"))]))


def media_columns(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key`` with ``brand``, ``tracks`` (codec, duration, keyframe byte ranges) and ``error`` for the container in the
    binary column ``content``.  A null container has nulls; one that is malformed has ``error`` and nothing else."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = files.select(F.col(key), F.col(content))
    kinds = to_arrow_schema(StructType.fromDDL(COLUMNS))
    out = f"`{key}` {rows.schema[key].dataType.simpleString()}, {COLUMNS}"
    return rows.mapInArrow(partial(_media_columns, kinds=kinds), out)


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, seconds double, keyframes long"
)


def padded(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """The text's UTF-8 with bytes 0 up to a positive multiple of ``unit``, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0"), len(raw)


def digest(text: str | None) -> tuple:
    """Store a text in a container, read it back through the sample tables, and describe both."""
    payload, n = padded(text)
    media = write(payload)
    _, (track,) = parse(media)
    back, keys = samples(media, track), track.keyframes()
    span = f"{keys[0][1]}+{keys[0][2]}..{keys[-1][1]}+{keys[-1][2]}"
    histogram = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16)
    feature = f"{track.codec}/{track.scale} {track.duration()} {len(track.sizes)}x{int(track.sizes[0])} key {len(keys)} {span} level {'.'.join(map(str, histogram.tolist()))}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, track.codec, track.duration() / track.scale, len(keys)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
    names = [c.strip().split(" ")[0] for c in DIGEST.split(",")]
    for batch in batches:
        cols = list(zip(*(digest(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def round_trip(docs: DataFrame) -> DataFrame:
    """Each row's text through a container and back: see :data:`DIGEST`.

    Null text counts as empty, an empty text is one unit of zeros; equal texts have equal values.  Repeated rows and
    null ids are kept, an empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digests, DIGEST)

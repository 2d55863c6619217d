"""Media columns: MPEG audio streams as binary values, written and read whole.

The reader walks a stream frame by frame: it skips ID3v2 (2.2 to 2.4, with extended headers and
unsynchronisation) and reads its text frames, finds frame headers (MPEG-1, 2 and 2.5, layers I to III, free
format too), and where one is broken searches on for the next header whose own frame is followed by another
header, a tag or the end. It reads a Xing, Info or VBRI table, verifies the CRC-16 of protected frames of
all layers, and returns exact durations (samples over sample rate, summed by rate) and the offset of
every frame.

The writer stores bytes losslessly in a valid stream: MPEG-2 layer III frames of 576 samples of
silence (no main data, so the standard leaves the rest of the frame to ancillary data) carry 576
bytes each, protected by CRC, behind an ID3v2 tag with the byte count and an Info table.

Defined results: a null value reads as an empty stream (no frames, duration 0); bytes that are no
frame are counted as skipped; a free-format header (bit rate 0) counts where a second one of its kind
follows, whose distance is its length; a damaged frame is returned with crc false, its bytes as they
stand; equal rows are read each. Other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table

UNIT = 576

#: Fixed values of the standard: kbit/s by (MPEG-1 or not, layer), index 1 to 14.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Fixed values of the standard: sample rates by version bits (3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5).
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    channels: int
    length: int
    samples: int
    side: int  # bytes of layer III side information
    mode: int  # channel mode and its extension, four bits
    padding: int

    @property
    def body(self) -> int:
        """Where main or ancillary data begin."""
        return 4 + 2 * self.protected + self.side

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


@functools.lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    one, padding = version == 3, four[2] >> 1 & 1
    bitrate, hertz = BITRATES[one, layer][index - 1] * 1000 if index else 0, RATES[version][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    length = (12 * bitrate // hertz + padding) * 4 if layer == 1 else samples // 8 * bitrate // hertz + padding
    if not index:
        length = 0  # free format: the stream tells
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, bitrate, hertz, 2 - mono, length, samples, side, four[3] >> 4, padding * (4 if layer == 1 else 1))


def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return tuple(out)


_CRC = _crc_table()


@functools.lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _crc_bits(data: bytes, bits: int, c: int) -> int:
    """The CRC of the first `bits` bits of data, carried on from c."""
    for b in data[: bits >> 3]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for k in range(bits & 7):
        bit = data[bits >> 3] >> (7 - k) & 1
        c = (c << 1 ^ 0x8005) & 0xFFFF if (c >> 15) ^ bit else c << 1 & 0xFFFF
    return c


#: Fixed values of the standard: bits of a layer II allocation as (subbands, bits), by table; the last is that of MPEG-2.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def _allocation(h: Header) -> tuple[int, ...]:
    """Bits of each subband's allocation in layer II."""
    each = h.bitrate // h.channels
    if h.version != 3:
        name = "lsf"
    elif 0 < each <= 48000:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if each and each <= 80000 or h.rate == 48000 else "b"
    return tuple(bits for many, bits in ALLOCATIONS[name] for _ in range(many))


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits behind the checksum it covers (body begins there)."""
    if h.layer == 3:
        return 8 * h.side
    bound = 0 if h.channels == 1 else 4 * (h.mode & 3) + 4 if h.mode >> 2 == 1 else 32
    if h.layer == 1:
        return 4 * (32 + min(bound, 32))
    bits = _allocation(h)
    word, total, at = int.from_bytes(body, "big"), 8 * len(body), 0
    used = 0
    for band, n in enumerate(bits):
        for _ in range(2 if band < bound else 1):
            value = word >> max(0, total - at - n) & ((1 << n) - 1)
            at += n
            # A band above the bound is coded once for both channels, whose scale factors are chosen apart.
            used += (value != 0) * (2 if bound <= band and h.channels == 2 else 1)
    return at + 2 * used


def crc_holds(h: Header, data: bytes, at: int) -> bool | None:
    """Whether the checksum of the frame at `at` is that of its bytes; None where it has none."""
    if not h.protected:
        return None
    want = data[at + 4] << 8 | data[at + 5]
    if h.layer == 3:
        return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == want
    body = data[at + 6 : at + 6 + 48]  # more than any allocation takes
    bits = protected_bits(h, body)
    return bits <= 8 * len(body) and _crc_bits(body, bits, _crc_bits(data[at + 2 : at + 4], 16, 0xFFFF)) == want


#: Parts of a second that every sample rate divides.
FLICKS = 705_600_000


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    seek_points: list = field(default_factory=list)
    offsets: list = field(default_factory=list)
    headers: list = field(default_factory=list)
    crc_ok: list = field(default_factory=list)  # None where unprotected
    resyncs: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def flicks(self) -> int:
        """The exact duration in 1 / FLICKS seconds, each frame at its own rate."""
        return sum(h.samples * (FLICKS // h.rate) for h in self.headers)

    @property
    def duration(self) -> tuple[int, int]:
        """Exact seconds as a fraction: samples over their rate, or flicks where the rate changes."""
        rates = {h.rate for h in self.headers}
        return (self.flicks, FLICKS) if len(rates) > 1 else (self.samples, *rates) if rates else (0, 0)


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, at: int) -> tuple[int, dict]:
    """End of the tag at `at`, and its text frames (user-defined ones by their description)."""
    major, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + _syncsafe(data[at + 6 : at + 10]))
    body = data[at + 10 : end]
    end = min(len(data), end + 10 * (major == 4 and flags >> 4 & 1))  # a footer
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and major == 3:
        p = 4 + int.from_bytes(body[:4], "big")
    elif flags & 0x40 and major == 4:
        p = _syncsafe(body[:4].ljust(4, b"\0"))
    wide = 3 if major == 2 else 4
    head = 6 if major == 2 else 10
    out: dict = {}
    while p + head <= len(body) and body[p : p + wide].isalnum():
        name, raw = body[p : p + wide].decode("ascii"), body[p + wide : p + 2 * wide]
        size = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        part, form = body[p + head : p + head + size], body[p + 9] if major > 2 else 0
        p += head + size
        if major == 3 and form & 0xC0 or major == 4 and form & 0x0C:
            continue  # compressed or encrypted
        part = part[(1 if form & 0x20 and major == 3 or form & 0x40 and major == 4 else 0) + (4 if form & 1 and major == 4 else 0) :]
        if major == 4 and (form & 2 or flags & 0x80):
            part = part.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and part:
            text = part[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(part[0], "utf-8"), "replace")
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
                text = text.removeprefix("\ufeff")
            out[name] = text.rstrip("\0")
    return end, out


def _ends(data: bytes, at: int) -> bool:
    return at == len(data) or data[at : at + 3] in (b"TAG", b"ID3")


def _follows(data: bytes, at: int, kind: tuple, free: dict, change: bool) -> bool:
    """Is a frame of this kind, a tag, or the end at `at`? With change, also a frame of another kind that is itself so followed."""
    if _ends(data, at):
        return True
    h = header(data[at : at + 4])
    if h is None:
        return False
    if h.kind == kind:
        return True
    n = h.length or (free[h.kind] + h.padding if h.kind in free else 0)
    return change and n > 0 and at + n <= len(data) and _follows(data, at + n, h.kind, free, False)


#: No free-format frame is longer, at 640 kbit/s and 8 kHz either (144 * 640000 / 8000 bytes and one of padding).
FREE_MOST = 11521


class _Places:
    """Where a marker comes next: each stretch of the data is searched for it once."""

    def __init__(self, data: bytes, marker: bytes):
        self.data, self.marker, self.place = data, marker, -1

    def after(self, at: int) -> int:
        """The first place at or behind `at`, which does not fall from call to call; the end where there is none."""
        if self.place < at:
            found = self.data.find(self.marker, at)
            self.place = found if found >= 0 else len(self.data)
        return self.place


def _free_length(data: bytes, at: int, h: Header) -> int:
    """Length without padding of free-format frames like the one at `at`: the distance to the next like it, whose own frame ends the same way; 0 if there is none."""
    p, end = at + 4 + h.side, at + FREE_MOST + 2
    while (p := data.find(data[at : at + 2], p + 1, end)) >= 0:
        n = header(data[p : p + 4])
        if n is None or n.length or n.kind != h.kind:
            continue
        length = p - at - h.padding
        after = p + length + n.padding
        third = header(data[after : after + 4])
        if _ends(data, after) or third is not None and not third.length and third.kind == h.kind:
            return length
    return 0


def _rate_table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Read a Xing, Info or VBRI table from the first frame."""
    end = at + h.length
    for p in (at + 4 + h.side, at + 6 + h.side):
        if data[p : p + 4] in (b"Xing", b"Info") and p + 8 <= end:
            out.table = data[p : p + 4].decode()
            flags, p = struct.unpack_from(">I", data, p + 4)[0], p + 8
            if flags & 1 and p + 4 <= end:
                out.table_frames, p = struct.unpack_from(">I", data, p)[0], p + 4
            if flags & 2 and p + 4 <= end:
                out.table_bytes, p = struct.unpack_from(">I", data, p)[0], p + 4
            if flags & 4 and p + 100 <= end:
                whole = out.table_bytes or 0
                out.seek_points = [x * whole // 256 for x in data[p : p + 100]]
            return True
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:
        out.table = "VBRI"
        out.table_bytes, out.table_frames, entries, scale, width, _ = struct.unpack_from(">IIHHHH", data, p + 10)
        p, total = p + 26, 0
        for _ in range(min(entries, max(0, end - p) // max(1, width))):
            total += int.from_bytes(data[p : p + width], "big") * scale
            out.seek_points.append(total)
            p += width
        return True
    return False


def read(data: bytes | None) -> Stream:
    out, at, lost = Stream(), 0, False
    data = data or b""
    free: dict = {}
    markers = [_Places(data, m) for m in (b"\xff", b"ID3", b"TAG")]
    while at < len(data):
        h = header(data[at : at + 4])
        if h is not None and not h.length:
            if h.kind not in free and (n := _free_length(data, at, h)):
                free[h.kind] = n
            n = free.get(h.kind, 0) + h.padding
            h = replace(h, length=n, bitrate=n * 8 * h.rate // h.samples) if h.kind in free else None
        # In step with a stream a frame of another kind may follow; behind junk only one of its own.
        if h is not None and at + h.length <= len(data) and _follows(data, at + h.length, h.kind, free, not lost):
            lost = False
            if out.headers or out.table or not _rate_table(data, at, h, out):
                out.offsets.append(at)
                out.headers.append(h)
                out.crc_ok.append(crc_holds(h, data, at))
            at += h.length
            continue
        if data[at : at + 3] == b"ID3" and at + 10 <= len(data) and max(data[at + 6 : at + 10]) < 128:
            at, more = _id3v2(data, at)
            out.tags |= more
            continue
        if data[at : at + 3] == b"TAG" and len(data) - at == 128:
            out.tags["ID3v1"] = data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
            break
        if not lost:
            out.resyncs += 1
            lost = True
        after = min(m.after(at + 1) for m in markers)
        out.skipped += after - at
        at = after
    return out


# The writer's frames: MPEG-2 layer III, 16 kHz, mono, 144 kbit/s, protected; 15 bytes before the data, 648 in all.
_FRAME = bytes((0xFF, 0xF2, 0xD8, 0xC0))
_SIDE = bytes(9)
_PREFIX = _FRAME + crc16(_FRAME[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_INFO = bytes((0xFF, 0xF3, 0x48, 0xC0))  # 32 kbit/s, 144 bytes, unprotected


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\3" + text.encode()
    size = len(body)
    return name + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + b"\0\0" + body


def write(payload: bytes, n_bytes: int) -> bytes:
    """A stream that carries `payload`, whole units of 576 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload has to be a positive multiple of {UNIT} bytes")
    frames = len(payload) // UNIT
    out = np.zeros((frames, header(_FRAME).length), np.uint8)
    out[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, np.uint8)
    out[:, len(_PREFIX) : len(_PREFIX) + UNIT] = np.frombuffer(payload, np.uint8).reshape(frames, UNIT)
    tag = _text_frame(b"TXXX", f"payload_bytes\0{n_bytes}")
    tag = b"ID3\4\0\0" + bytes((0, 0, len(tag) >> 7, len(tag) & 127)) + tag
    first = header(_INFO).length
    total = first + out.size
    toc = bytes(min(255, 256 * (first + (k * frames // 100) * out.shape[1]) // total) for k in range(100))
    info = (_INFO + bytes(9) + b"Info" + struct.pack(">III", 7, frames, total) + toc).ljust(first, b"\0")
    return tag + info + out.tobytes()


def payload_of(data: bytes, stream: Stream) -> bytes:
    """What the writer stored, from the frames found."""
    if not stream.headers:
        return b""
    body = stream.headers[0].body
    first, step, n = stream.offsets[0], stream.headers[0].length, len(stream.offsets)
    if stream.offsets[-1] - first == (n - 1) * step:
        return np.frombuffer(data, np.uint8, n * step, first).reshape(n, step)[:, body : body + UNIT].tobytes()
    return b"".join(data[p + body : p + body + UNIT] for p in stream.offsets)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: each whole text as UTF-8, padded with 255 to a positive multiple of 576, as a stream."""

    def run(batch):
        media = []
        for body in batch.column(1).to_pylist():
            media.append(write(body + b"\xff" * (-len(body) % UNIT or (0 if body else UNIT)), len(body)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["key", "media"])

    rows = docs.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))
    return map_batches(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, media binary").withColumnRenamed("key", key)


READ = (
    "media_bytes long, tags map<string,string>, rate_table string, frames int, samples long, sample_rate int, duration_flicks long, crc_checked int, crc_ok int, "
    "resyncs int, skipped long, offsets array<long>, seek_points array<long>, payload binary"
)


def parse(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, the stored bytes (media) and everything read from them."""

    def run(batch):
        rows = []
        for data in batch.column(1).to_pylist():
            s = read(data)
            checked = [c for c in s.crc_ok if c is not None]
            rate = s.headers[0].rate if s.headers else 0
            rows.append(
                (len(data or b""), list(s.tags.items()), s.table, len(s.headers), s.samples, rate, s.flicks, len(checked), sum(checked), s.resyncs, s.skipped, s.offsets, s.seek_points, payload_of(data or b"", s))
            )
        i32, i64 = pa.int32(), pa.int64()
        kinds = (i64, pa.map_(pa.string(), pa.string()), pa.string(), i32, i64, i32, i64, i32, i32, i32, i64, pa.list_(i64), pa.list_(i64), pa.binary())
        names = ["key", "media", *(x.split()[0] for x in READ.split(", "))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    rows = media.select(F.col(key).alias("key"), F.col(column).cast("binary").alias("media"))
    return map_batches(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, media binary, {READ}").withColumnRenamed("key", key)


def digest(read_back: DataFrame, key: str = "doc_id") -> DataFrame:
    """The comparable columns of streams that `store` wrote, from what `parse` read back."""

    def run(batch):
        rows = []
        name = {f.name: k for k, f in enumerate(batch.schema)}
        get = lambda column: batch.column(name[column]).to_pylist()
        for media, payload, n, frames, samples, rate, crc, resyncs, offsets in zip(*map(get, ("media", "payload", "n_bytes", "frames", "samples", "sample_rate", "crc_ok", "resyncs", "offsets"))):
            x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
            energy, turns = int(np.dot(x.astype(np.int64), x)), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            seek = zlib.crc32(np.array(offsets, "<i8").tobytes())
            feature = f"frames={frames};samples={samples}/{rate};crc_ok={crc};resyncs={resyncs};seek={seek:08x};energy={energy};turns={turns}"
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        i64, s = pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), (i64, i64, s, i64, i64, s, s)))], out)

    kind = read_back.schema[key].dataType.simpleString()
    out = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = read_back.select(
        F.col(key).alias("key"), "media", "payload", F.col("tags")["payload_bytes"].cast("long").alias("n_bytes"), "frames", "samples", "sample_rate", "crc_ok", "resyncs", "offsets"
    )
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(rows, run, schema).withColumnRenamed("key", key)


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(parse(store(table(spark, sf_dir, "documents"))))


QUERIES = {"op3_mpeg_audio": op3_mpeg_audio}
ORACLES: dict[str, str] = {}

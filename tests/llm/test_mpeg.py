import hashlib
import random
import struct
import time
import zlib

import numpy as np

from tidemark.llm import mpeg
from tidemark.llm.common import table


def padded(body):
    return body + b"\xff" * (-len(body) % 576 if body else 576)


def test_round_trip_and_contract(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    rows = mpeg.op3_mpeg_audio(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-32:])
        assert f"frames={len(want) // 576};" in r.feature and "resyncs=0" in r.feature


def test_nulls_empty_equal_and_clashing(spark):
    rows = [(1, None, b"m"), (2, "", b"m"), (None, "aé", b"m"), (4, "x" * 576, b"m"), (5, "x" * 576, b"m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    out = {r.doc_id: r for r in mpeg.digest(mpeg.parse(mpeg.store(df))).collect()}
    assert out[1].payload_bytes == out[2].payload_bytes == 576 and out[1].n_bytes == 0
    assert out[1].media_sha256 == out[2].media_sha256 and out[None].n_bytes == 3
    assert out[4].feature == out[5].feature and out[4].payload_bytes == 576
    assert mpeg.digest(mpeg.parse(mpeg.store(df.limit(0)))).collect() == []
    nothing = mpeg.parse(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect()[0]
    assert (nothing.frames, nothing.samples, nothing.media_bytes) == (0, 0, 0)


def test_headers_and_lengths():
    h = mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00)))  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz, stereo
    assert (h.length, h.samples, h.side, h.channels, h.protected) == (417, 1152, 32, 2, False)
    assert mpeg.header(bytes((0xFF, 0xFB, 0x92, 0x00))).length == 418
    assert mpeg.header(bytes((0xFF, 0xFF, 0x10, 0x00))).length == 12 * 32000 // 44100 * 4
    for bad in (b"\xff\xfb\xf0\0", b"\xff\xfb\x0c\0", b"\xff\xeb\x90\0", b"\xff\xf9\x90\x02", b"\xfe\xfb\x90\0", b"\xff"):
        assert mpeg.header(bad) is None


def test_crc_of_a_known_string():
    assert mpeg.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def test_resynchronises_after_damage():
    rng = random.Random(2)
    payload = bytes(rng.randrange(256) for _ in range(576 * 9))
    whole = mpeg.write(payload, len(payload))
    s = mpeg.read(whole)
    assert s.table == "Info" and s.table_frames == 9 and s.samples == 9 * 576 and all(s.crc_ok) and mpeg.payload_of(whole, s) == payload
    assert s.tags == {"payload_bytes": str(len(payload))} and len(s.seek_points) == 100
    third = s.offsets[3]
    junk = b"\xff\xfb\x90noise\xff\xff" * 7
    hurt = whole[:third] + junk + whole[third:] + b"TAG" + b"name".ljust(125, b"\0")
    t = mpeg.read(hurt)
    assert t.resyncs == 1 and t.skipped == len(junk) + 648 and len(t.headers) == 8 and t.tags["ID3v1"] == "name"
    lost = mpeg.read(whole[: s.offsets[5]] + whole[s.offsets[5] + 100 :])
    assert lost.resyncs == 1 and len(lost.headers) == 7
    bad = bytearray(whole)
    bad[s.offsets[2] + 8] ^= 1  # side information
    assert mpeg.read(bytes(bad)).crc_ok.count(False) == 1


def test_vbri_table():
    h = bytes((0xFF, 0xFB, 0x90, 0x00))
    vbri = h + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 12, 3, 2, 2, 4) + struct.pack(">HHH", 100, 200, 300)
    data = vbri.ljust(417, b"\0") + (h + bytes(413)) * 3
    s = mpeg.read(data)
    assert (s.table, s.table_bytes, s.table_frames, s.seek_points, len(s.headers)) == ("VBRI", 5000, 12, [200, 600, 1200], 3)
    assert s.duration == (3 * 1152, 44100)


def bitwise(bits):
    c = 0xFFFF
    for bit in bits:
        top = (c >> 15) ^ bit
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def as_bits(data):
    return [b >> (7 - k) & 1 for b in data for k in range(8)]


def framed(four, body, covered):
    """A protected frame: header, checksum over the header's last two bytes and the `covered` first bits of the body."""
    c = bitwise(as_bits(four[2:4]) + as_bits(body)[:covered])
    frame = four + c.to_bytes(2, "big") + body
    return frame.ljust(mpeg.header(four).length, b"\0")


def test_checksums_of_layers_one_and_two():
    rng = random.Random(5)
    # Layer I, 32 kbit/s, 44.1 kHz, mono: 32 allocations of 4 bits; stereo: 64; joint with bound 8: 8 * 2 + 24.
    for mode, covered in ((0xC0, 128), (0x00, 256), (0x50, 160)):
        four = bytes((0xFF, 0xFE, 0x50, mode))
        frame = framed(four, bytes(rng.randrange(256) for _ in range(40)), covered)
        s = mpeg.read(frame * 3)
        assert s.crc_ok == [True] * 3 and s.samples == 3 * 384
        assert mpeg.read(frame[:8] + bytes((frame[8] ^ 8,)) + frame[9:] + frame * 2).crc_ok == [False, True, True]
    # Layer II, 64 kbit/s, 48 kHz, mono (table a): 11 * 4 + 12 * 3 + 4 * 2 = 88 bits, then 2 for each band that is used.
    four = bytes((0xFF, 0xFC, 0x44, 0xC0))
    empty = framed(four, bytes(60), 88)
    used = framed(four, b"\x10\x20" + bytes(58), 88 + 2 * 2)
    assert mpeg.read(empty + used * 2).crc_ok == [True] * 3
    # Table d (32 kHz, 32 kbit/s): 2 * 4 + 10 * 3 = 38 bits; MPEG-2: 4 * 4 + 7 * 3 + 19 * 2 = 75 bits; a stereo band counts twice.
    assert mpeg.read(framed(bytes((0xFF, 0xFC, 0x18, 0xC0)), bytes(30), 38) * 2).crc_ok == [True] * 2
    assert mpeg.read(framed(bytes((0xFF, 0xF4, 0x84, 0xC0)), bytes(30), 75) * 2).crc_ok == [True] * 2
    assert mpeg.read(framed(bytes((0xFF, 0xFC, 0x84, 0x00)), b"\x11" + bytes(60), 2 * 88 + 2 * 2) * 2).crc_ok == [True] * 2


def test_rates_that_change_and_exact_durations():
    a, b = bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\0"), bytes((0xFF, 0xFB, 0x94, 0x00)).ljust(384, b"\0")
    s = mpeg.read(a * 3 + b * 3)
    assert (len(s.headers), s.skipped, s.resyncs) == (6, 0, 0)
    assert s.duration[0] * 44100 * 48000 == s.duration[1] * (3 * 1152 * 48000 + 3 * 1152 * 44100)
    assert s.offsets == [0, 417, 834, 1251, 1635, 2019]


def test_free_format():
    four = bytes((0xFF, 0xFB, 0x00, 0x00))
    padded_four = bytes((0xFF, 0xFB, 0x02, 0x00))
    data = four.ljust(700, b"\1") + padded_four.ljust(701, b"\1") + four.ljust(700, b"\1")
    s = mpeg.read(data)
    assert s.offsets == [0, 700, 1401] and s.skipped == 0 and s.headers[0].bitrate == 700 * 8 * 44100 // 1152
    assert mpeg.read(four.ljust(700, b"\1")).headers == []


def tag(major, flags, body):
    n = len(body)
    return b"ID3" + bytes((major, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def test_tags_of_all_versions():
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\0") * 2
    read = lambda t: (lambda s: (s.tags, s.offsets, s.skipped))(mpeg.read(t + frame))
    two = b"TT2" + (6).to_bytes(3, "big") + b"\0title" + b"TXX" + (5).to_bytes(3, "big") + b"\0k\0vv"
    t = tag(2, 0, two)
    assert read(t) == ({"TT2": "title", "k": "vv"}, [len(t), len(t) + 417], 0)
    three = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0title"
    assert read(tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + three))[0] == {"TIT2": "title"}
    wide = b"\1" + "\ufeffaÿb".encode("utf-16-le")
    loose = b"TIT2" + len(wide).to_bytes(4, "big") + b"\0\0" + wide
    assert read(tag(3, 0x80, loose.replace(b"\xff", b"\xff\0")))[0] == {"TIT2": "aÿb"}
    four = b"TIT2" + bytes((0, 0, 0, 6)) + b"\0\0" + b"\3title"
    assert read(tag(4, 0x40, bytes((0, 0, 0, 6, 1, 0)) + four))[0] == {"TIT2": "title"}
    secret = b"TPE1" + bytes((0, 0, 0, 3)) + b"\0\x04" + b"\3xx"
    assert read(tag(4, 0, secret + four + bytes(20)))[0] == {"TIT2": "title"}
    assert read(tag(4, 0x10, four) + b"3DI" + bytes(7))[2] == 0


def test_repeated_rows_and_a_very_long_text(spark):
    body = "lörem ipsum " * 100_000
    df = spark.createDataFrame([(1, body), (1, body), (2, "")], "doc_id long, text string")
    out = mpeg.digest(mpeg.parse(mpeg.store(df))).collect()
    want = padded(body.encode())
    assert sorted((r.doc_id, r.payload_sha256) for r in out)[:2] == [(1, hashlib.sha256(want).hexdigest())] * 2 and len(out) == 3


def test_megabytes_of_junk_are_read_in_one_pass():
    rng = np.random.default_rng(3)
    junk = rng.integers(0, 256, 8 << 20, np.uint8).tobytes()
    began = time.perf_counter()
    out = mpeg.read(junk)
    assert time.perf_counter() - began < 2 and out.skipped > 8_000_000
    began = time.perf_counter()
    assert not mpeg.read(bytes((0xFF, 0xFB, 0x00, 0xC0)) + bytes(4 << 20)).headers  # a free-format header whose like never comes
    assert not mpeg.read(b"\xff\xfb\x00\xc0" + b"\xff" * (1 << 18)).headers
    assert time.perf_counter() - began < 2
    payload = bytes(range(256)) * 9
    whole = mpeg.write(payload, len(payload))
    again = mpeg.read(junk[:100_000].replace(b"\xff", b"\xfe") + whole)
    assert len(again.headers) == len(mpeg.read(whole).headers) and again.resyncs == 1

"""Ogg columns: an independent reader, damage, chaining, multiplexing, time, and odd texts."""

import random
import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest

from ridgeline.llm import ogg, queries


def slow_crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def slow_pages(data):
    """(serial, number, flags, granule, segments, body) of every page, checksums verified bit by bit."""
    at, out = 0, []
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        flags, granule, serial, number, crc = data[at + 5], *struct.unpack_from("<qIII", data, at + 6)
        n = data[at + 26]
        segments = list(data[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(segments)
        assert slow_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc
        out.append((serial, number, flags, granule, segments, data[at + 27 + n : end]))
        at = end
    return out


def slow_packets(pages, serial):
    out, now = [], b""
    for s, _, _, _, segments, body in pages:
        if s == serial:
            for size in segments:
                now, body = now + body[:size], body[size:]
                if size < 255:
                    out.append(now)
                    now = b""
    assert now == b""
    return out


SIZES = [0, 1, 254, 255, 256, 510, 575, 576, 577, 8000, 8001, 65_025, 130_050, 200_000]


@pytest.mark.parametrize("size", SIZES)
def test_an_independent_reader_finds_the_payload(size):
    payload = ogg.padded(random.Random(size).randbytes(size))
    data = ogg.write_sound(payload)
    pages = slow_pages(data)
    both = []
    for serial in (1, 2):
        own = [p for p in pages if p[0] == serial]
        assert [p[1] for p in own] == list(range(len(own))) and own[0][2] == ogg.FIRST and own[-1][2] & ogg.LAST
        assert sum(bool(p[2] & ogg.LAST) for p in own) == 1 and own[-1][3] == len(payload) // 2
        packets = slow_packets(pages, serial)
        assert packets[0][:8] == b"PCM     " and packets[1][:7] == b"\x03vorbis"
        both.append(b"".join(packets[2:]))
    assert [p[2] & ogg.FIRST for p in pages[:3]] == [ogg.FIRST, ogg.FIRST, 0]
    assert bytes(x for pair in zip(*both) for x in pair) == payload
    tracks, faults = ogg.read_sound(data)
    assert faults == 0 and ogg.joined(tracks) == payload and [t.end for t in tracks] == [len(payload) // 2] * 2


@pytest.mark.parametrize("seed", range(4))
def test_packets_of_any_size_survive_lacing(seed):
    rng = random.Random(seed)
    packets = [rng.randbytes(rng.choice([0, 1, 254, 255, 256, 510, 765, 65_024, 65_025, 65_026, 140_000, rng.randrange(3000)])) for _ in range(25)]
    data = b"".join(p for _, p in ogg.pages(77, [b"head"], [(p, i + 1) for i, p in enumerate(packets)]))
    assert slow_packets(slow_pages(data), 77) == [b"head", *packets]
    streams, bad = ogg.demultiplex(data)
    assert bad == 0 and len(streams) == 1 and streams[0].packets == [b"head", *packets] and streams[0].broken == streams[0].gaps == 0
    known = [e for e in streams[0].ends[1:] if e is not None]
    assert known == sorted(known) and known[-1] == 25
    assert ogg.end_times(ogg.Stream(1, packets, streams[0].ends[1:]), [1] * 25) == list(range(1, 26))


def test_checksum_equals_bitwise_division():
    rng = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


def test_damaged_pages_are_dropped_and_time_keeps_the_rest_in_place():
    payload = random.Random(3).randbytes(576 * 700)
    data = ogg.write_sound(payload)
    pages = slow_pages(data)
    at, begin = [], 0
    for p in pages:
        at.append(begin)
        begin += 27 + len(p[4]) + len(p[5])
    hurt = next(i for i, p in enumerate(pages) if p[0] == 1 and p[1] == 3)
    broken = bytearray(data)
    broken[at[hurt] + 300] ^= 1
    tracks, faults = ogg.read_sound(bytes(broken))
    left, right = tracks
    want = np.frombuffer(payload[::2], np.uint8)
    assert faults >= 2 and (right.samples == np.frombuffer(payload[1::2], np.uint8)).all() and len(left.samples) == len(want)
    same = left.samples == want
    lost = np.flatnonzero(~same)
    assert len(lost) and lost.min() >= 60_000 and len(lost) <= 65_025 + 2 * ogg.PACKET and (left.samples[lost] == 128).all()
    # a page that is gone, foreign bytes between pages, and an end that is cut off
    gone, bad = ogg.demultiplex(data[: at[hurt]] + data[at[hurt + 1] :])
    assert bad == 0 and gone[0].gaps == 1 and gone[1].gaps == 0
    streams, bad = ogg.demultiplex(b"junk" + data[: at[4]] + b"OggSjunk" + data[at[4] :])
    assert bad >= 2 and [len(s.packets) for s in streams] == [len(s.packets) for s in ogg.demultiplex(data)[0]]
    cut, bad = ogg.demultiplex(data[:-10])
    assert bad == 1 and sum(s.broken for s in cut) >= 1


def test_chained_streams_and_other_codecs():
    one = b"".join(p for _, p in ogg.pages(5, [b"OpusHead"], [(b"x" * 10, 960)]))
    streams, bad = ogg.demultiplex(one + one + ogg.write_sound(ogg.padded(b"abc")))
    assert bad == 0 and [s.serial for s in streams] == [5, 5, 1, 2] and streams[1].packets == [b"OpusHead", b"x" * 10]
    tracks, faults = ogg.read_sound(one + ogg.write_sound(ogg.padded(b"abc")))
    assert faults == 0 and ogg.joined(tracks) == b"abc" + b"\xff" * 573
    assert ogg.demultiplex(None) == ([], 0) and ogg.demultiplex(b"") == ([], 0) and ogg.demultiplex(b"text")[1] == 1


def test_columns_of_odd_texts(spark, tmp_path):
    long = "lang é\U0001f600 " * 200_000
    texts = [None, "", "a", "a", "é" * 288, "x" * 576, "x" * 577, "\x00OggS\x00", long]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "en", "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, sound string, n_bytes int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.op12_media_columns(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[3 if r.doc_id is None else r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = ogg.write_sound(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest()) and f"ms={len(payload) * 1000 // 16_000}" in r.feature and "faults=0" in r.feature
    assert rows[2][1:] == rows[-1][1:]  # equal texts, equal values
    media = ogg.sound_column(docs, out="lang")
    assert media.columns == docs.columns
    media.select("doc_id", "lang").write.parquet(f"{tmp_path}/media")
    table = ogg.stream_table(spark.read.parquet(f"{tmp_path}/media"), "lang")
    assert table.count() == 2 * len(texts) and table.filter("codec != 'PCM' or gaps + broken + dropped_pages > 0").count() == 0
    assert ogg.sound_features(docs.limit(0).withColumn("media", ogg.F.lit(b""))).count() == 0
    foreign = spark.createDataFrame([(1, b"no sound"), (2, None)], "doc_id long, media binary")
    assert [(r.sound.payload_bytes, r.sound.feature.split(" ")[-1]) for r in ogg.sound_features(foreign).orderBy("doc_id").collect()] == [(0, "faults=1"), (0, "faults=0")]
    assert ogg.stream_table(foreign).count() == 0

"""Ogg media columns: 8-bit sound in two logical streams, written to and read from binary columns page by page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import prepare

#: Fixed values of the container: capture pattern, header flags, and the granule position of a page on which no packet ends.
CAPTURE, CONTINUED, FIRST, LAST, NO_GRANULE = b"OggS", 1, 2, 4, 0xFFFFFFFFFFFFFFFF
#: Fixed values of the mapping of plain samples: its name, the number of unsigned 8-bit samples, and the comment's name.
PCM, UNSIGNED_8, COMMENT = b"PCM     ", 1, b"\x03vorbis"
HEADER = struct.Struct("<4sBBQIIIB")
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Samples a second, samples of a packet, and the unit that payloads are padded to (a multiple of two: left and right).
RATE, PACKET, UNIT = 8_000, 4_000, 576


def checksum(page: bytes) -> int:
    """The container's CRC: polynomial 0x04C11DB7, highest bit first, from zero, nothing inverted.

    zlib has the mirror image of this CRC, inverted before and after; on mirrored bytes, with both inversions undone, its
    mirrored result is the same number.
    """
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def lacing(size: int) -> bytes:
    """Segment sizes of a packet: 255 as often as it fits, then the rest, which may be 0 and ends the packet."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, number: int, granule: int, flags: int, segments: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(segments)) + segments
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages(serial: int, headers: list[bytes], packets: list[tuple[bytes, int]]) -> Iterator[tuple[int, bytes]]:
    """A logical stream's pages, each with the granule position up to which it reaches.

    The first header has a page of its own, the other headers share the next; packets (data, granule position of its end)
    then fill pages of 255 segments, running over from one to the next.
    """
    number = 0
    for i, part in enumerate((headers[:1], headers[1:])):
        if part:
            last = 0 if packets or (i == 0 and len(headers) > 1) else LAST
            yield 0, page(serial, number, 0, (FIRST if i == 0 else 0) | last, b"".join(map(lambda h: lacing(len(h)), part)), b"".join(part))
            number += 1
    segments, body, granule, reached, flags = b"", b"", NO_GRANULE, 0, 0
    for k, (data, end) in enumerate(packets):
        laces, at = lacing(len(data)), 0
        while laces:
            took, laces = laces[: 255 - len(segments)], laces[255 - len(segments) :]
            size = sum(took)
            segments, body, at = segments + took, body + data[at : at + size], at + size
            if not laces:
                granule = reached = end
            done = not laces and k == len(packets) - 1
            if len(segments) == 255 or done:
                yield reached, page(serial, number, granule, flags | (LAST if done else 0), segments, body)
                number, segments, body, granule, flags = number + 1, b"", b"", NO_GRANULE, CONTINUED if laces else 0


def multiplex(streams: list[Iterator[tuple[int, bytes]]]) -> bytes:
    """Pages of several streams in one file: all first pages, then always the page that reaches least far, of equals the earlier stream's."""
    out, waiting = [], []
    for s in streams:
        out.append(next(s)[1])
        waiting.append(next(s, None))
    while any(w is not None for w in waiting):
        i = min((w[0], i) for i, w in enumerate(waiting) if w is not None)[1]
        out.append(waiting[i][1])
        waiting[i] = next(streams[i], None)
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream as read: whole packets with the granule position of each one's end (None where its page tells none)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    broken: int = 0
    finished: bool = False
    next_page: int | None = None
    part: list[bytes] | None = None


def demultiplex(data: bytes | None) -> tuple[list[Stream], int]:
    """The logical streams of a file in order of their first pages, and the number of pages and runs of bytes that were dropped.

    A page counts only if its checksum holds; after one that doesn't, or bytes that are no page, reading goes on at the next
    capture pattern. A packet of which a page is missing is dropped and counted in ``broken``; ``gaps`` counts jumps of page
    numbers. A stream that begins again under a serial number that has ended is another stream, as in chained files.
    """
    streams, open_, bad, at = [], {}, 0, 0
    data = data or b""
    while at < len(data):
        whole = None
        if data[at : at + 4] == CAPTURE and len(data) >= at + 27:
            _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
            segments = data[at + 27 : at + 27 + n]
            size = 27 + n + sum(segments)
            if version == 0 and len(segments) == n and len(data) >= at + size:
                if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : at + size]) == crc:
                    whole = size
        if whole is None:
            bad += 1
            at = data.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        s = open_.get(serial)
        if s is None or (s.finished and flags & FIRST):
            s = open_[serial] = Stream(serial)
            streams.append(s)
        _take_page(s, flags, granule, number, segments, data[at + 27 + n : at + whole])
        at += whole
    for s in streams:
        s.broken += s.part is not None
        s.part = None
    return streams, bad


def _take_page(s: Stream, flags: int, granule: int, number: int, segments: bytes, body: bytes) -> None:
    follows = s.next_page == number
    if s.pages and not follows:
        s.gaps += 1
    if s.part is not None and not (follows and flags & CONTINUED):
        s.broken += 1
        s.part = None
    lost = bool(flags & CONTINUED) and s.part is None  # the rest of a packet whose beginning is missing
    s.broken += lost
    s.pages, s.next_page, s.finished = s.pages + 1, (number + 1) & 0xFFFFFFFF, bool(flags & LAST)
    at, begin = 0, 0
    closed = False
    for size in segments:
        at += size
        if size < 255:
            if lost:
                lost = False
            else:
                s.packets.append(b"".join([*(s.part or []), body[begin:at]]))
                s.ends.append(None)
                closed = True
            s.part, begin = None, at
    if segments and segments[-1] == 255 and not lost:
        s.part = [*(s.part or []), body[begin:at]]
    if closed and granule != NO_GRANULE:
        s.ends[-1] = granule


def end_times(s: Stream, durations: list[int]) -> list[int]:
    """The granule position of each packet's end: the page's for its last packet, and back from there by the packets' durations.

    Packets after the last position that a page tells are counted forward.
    """
    ends: list[int | None] = list(s.ends)
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] is None and ends[i + 1] is not None:
            ends[i] = ends[i + 1] - durations[i + 1]
    for i in range(len(ends)):
        if ends[i] is None:
            ends[i] = (ends[i - 1] if i else 0) + durations[i]
    return ends


def pcm_headers(rate: int) -> list[bytes]:
    """The two header packets of mono unsigned 8-bit samples: format, and an empty comment."""
    vendor = b"ridgeline"
    return [PCM + struct.pack(">HHIIBBHI", 0, 0, UNSIGNED_8, rate, 8, 1, PACKET, 0), COMMENT + struct.pack("<I", len(vendor)) + vendor + struct.pack("<IB", 0, 1)]


def write_sound(payload: bytes, rate: int = RATE) -> bytes:
    """A file of two mono streams, left with the even and right with the odd bytes of ``payload`` as unsigned 8-bit samples."""
    streams = []
    for serial in (1, 2):
        samples = payload[serial - 1 :: 2]
        cut = [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
        streams.append(pages(serial, pcm_headers(rate), [(p, min((i + 1) * PACKET, len(samples))) for i, p in enumerate(cut)]))
    return multiplex(streams)


@dataclass(frozen=True)
class Track:
    """Samples of a logical stream at their places in time, and what was read of it."""

    serial: int
    rate: int
    samples: np.ndarray
    packets: int
    pages: int
    begin: int
    end: int


def read_sound(data: bytes | None) -> tuple[list[Track], int]:
    """Tracks of all streams of plain 8-bit samples, and the number of faults: dropped pages, jumps, broken packets.

    Every packet's samples are put where its granule position says, so a missing packet leaves silence (128), not a shift.
    """
    streams, faults = demultiplex(data)
    out = []
    for s in streams:
        faults += s.gaps + s.broken
        if not s.packets or s.packets[0][:8] != PCM or len(s.packets[0]) < 28:
            continue
        _, _, kind, rate, _, channels, _, extra = struct.unpack_from(">HHIIBBHI", s.packets[0], 8)
        if kind != UNSIGNED_8 or channels != 1:
            continue
        head = 2 + extra
        body = s.packets[head:]
        ends = end_times(Stream(s.serial, body, s.ends[head:]), [len(p) for p in body])
        size = max(ends, default=0)
        samples = np.full(size, 128, np.uint8)
        for p, e in zip(body, ends, strict=True):
            a = max(e - len(p), 0)
            samples[a:e] = np.frombuffer(p, np.uint8)[len(p) - (e - a) :]
        out.append(Track(s.serial, rate, samples, len(body), s.pages, min((e - len(p) for p, e in zip(body, ends)), default=0), size))
    return out, faults


def joined(tracks: list[Track]) -> bytes:
    """Left and right samples in turn; a lone track is taken as it is."""
    if len(tracks) < 2:
        return tracks[0].samples.tobytes() if tracks else b""
    left, right = tracks[0].samples, tracks[1].samples
    both = np.full(2 * max(len(left), len(right)), 128, np.uint8)
    both[0 : 2 * len(left) : 2], both[1 : 2 * len(right) : 2] = left, right
    return both.tobytes()


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(text) // unit) * unit)
    return text + b"\xff" * (size - len(text))


def features(tracks: list[Track], faults: int) -> str:
    """Whole-number features of the sound: streams, pages, packets, milliseconds, faults, and by track mean and greatest deviation from
    silence, zero crossings and energy a sample."""
    parts = [f"streams={len(tracks)}", f"pages={sum(t.pages for t in tracks)}", f"packets={sum(t.packets for t in tracks)}", f"ms={max((t.end * 1000 // t.rate for t in tracks if t.rate), default=0)}", f"faults={faults}"]
    for name, t in zip("lr", tracks):
        x = t.samples.astype(np.int64) - 128
        if len(x):
            parts.append(f"{name}=mean:{int(x.sum()) // len(x)},peak:{int(np.abs(x).max())},crossings:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())},energy:{int((x * x).sum()) // len(x)}")
    return " ".join(parts)


def sound_column(docs: DataFrame, text_col: str = "text", out: str = "media", rate: int = RATE) -> DataFrame:
    """``docs`` with the binary column ``out``: each whole text in UTF-8, padded (see ``padded``), as a file of two streams.

    Null and empty texts are a unit of padding. Texts of any length are taken whole, one at a time, with some five times
    their bytes in memory. Equal texts give equal files. A column called ``out`` is replaced, all others stay; an empty table
    stays empty. Nothing shuffles.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf("binary")
    def write(texts: pa.Array) -> pa.Array:
        return pa.array((write_sound(padded((t or "").encode("utf-8", "replace")), rate) for t in _each(texts)), pa.binary())

    return docs.withColumn(out, write(F.col(text_col).cast("string")))


def _each(column: pa.Array) -> Iterator:
    for v in column:
        yield v.as_py()


SOUND = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def sound_features(media: DataFrame, media_col: str = "media", out: str = "sound") -> DataFrame:
    """``media`` with the struct ``out``, read from the files of a binary column: payload_bytes, payload_sha256, tail_crc32 (of the
    payload's last 32 bytes), media_bytes, media_sha256, feature.

    Null and foreign bytes have no payload (0 bytes) and count as faults in ``feature``, as do pages whose checksum fails.
    """
    prepare(media.sparkSession)

    @F.arrow_udf(f"struct<{SOUND.replace(' ', ':').replace(',:', ',')}>")
    def read(files: pa.Array) -> pa.Array:
        rows = []
        for data in _each(files):
            tracks, faults = read_sound(data)
            payload = joined(tracks)
            rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data or b""), sha256(data or b"").hexdigest(), features(tracks, faults)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [p.split(" ")[0] for p in SOUND.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names)

    return media.withColumn(out, read(F.col(media_col)))


def stream_table(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id, stream, serial, codec, packets, pages, packet_bytes, last_granule, gaps, broken, dropped_pages): one row a logical stream of any Ogg file.

    ``codec`` is the name at the head of the first packet, unprintable bytes left out. Null and foreign bytes have no stream.
    """
    prepare(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()
    shape = "stream int, serial long, codec string, packets long, pages long, packet_bytes long, last_granule long, gaps long, broken long, dropped_pages long"

    def read(batches):
        for b in batches:
            take, rows = [], []
            for i, data in enumerate(_each(b.column(1))):
                streams, bad = demultiplex(data)
                for k, s in enumerate(streams):
                    codec = "".join(chr(c) for c in (s.packets[0][:8] if s.packets else b"") if 32 < c < 127)
                    ends = [e for e in s.ends if e is not None]
                    take.append(i)
                    rows.append((k, s.serial, codec, len(s.packets), s.pages, sum(map(len, s.packets)), ends[-1] if ends else None, s.gaps, s.broken, bad))
            kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 7]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 10, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *columns], ["id", *[p.split(" ")[0] for p in shape.split(", ")]])

    return media.select(F.col(id_col).alias("id"), media_col).mapInArrow(read, f"id {kind}, {shape}")

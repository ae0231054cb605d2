"""Texts as sound in Ogg files, written and read back.

A payload of 8-bit samples goes into a physical stream with two logical ones: the samples, in
packets of ``PACKET`` samples, and marks, which hold the checksum of every ``MARK_EVERY``
samples. Reading verifies every page's checksum and number, reassembles packets from the lacing
values (also over page ends), separates the streams by serial number, and derives the time of
each packet from the granule positions (samples at ``RATE``).

Edge cases: a null or empty text is one block of 64 zero bytes. Texts of any length are split
over pages; a page holds 255 lacing values at most. Equal texts give equal files. A damaged file
raises ``ValueError``. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.llm.common import annotate, table, texts_of, utf8

RATE = 8_000
PACKET = 1_000
MARK_EVERY = 64_000
BLOCK = 64
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC-32: no reflection, no inversion, starting at 0.

    zlib computes the mirrored polynomial; mirrored bytes in and mirrored bits out make it this
    one, and its inversions cancel.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes

    def write(self) -> bytes:
        head = _HEAD.pack(b"OggS", 0, self.flags, self.granule, self.serial, self.number, 0,
                          len(self.lacing))
        raw = head + self.lacing + self.body
        return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def paginate(serial: int, packets: list[tuple[int, bytes]]) -> list[Page]:
    """Pages of one logical stream from (granule at its end, packet); the first packet, the
    stream's header, has a page of its own."""
    pages, lacing, body, granule, continued = [], bytearray(), bytearray(), -1, False

    def close(more):
        nonlocal granule, continued
        flags = (CONTINUED if continued else 0) | (0 if pages else FIRST)
        pages.append(Page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, continued = -1, more

    for n, (end, packet) in enumerate(packets):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for i, size in enumerate(sizes):
            if len(lacing) == 255:
                close(i > 0)
            lacing.append(size)
            body += packet[at:at + size]
            at += size
        granule = end
        if n == 0:
            close(False)
    if lacing:
        close(False)
    pages[-1].flags |= LAST
    return pages


def write_sound(payload: bytes) -> bytes:
    """A whole file; serial numbers follow from the payload."""
    serial = zlib.crc32(payload)
    samples = [(0, b"samples8" + struct.pack("<II", RATE, 1))]
    samples += [(min(i + PACKET, len(payload)), payload[i:i + PACKET])
                for i in range(0, len(payload), PACKET)]
    marks = [(0, b"marks   " + struct.pack("<I", MARK_EVERY))]
    marks += [(min(i + MARK_EVERY, len(payload)),
               struct.pack("<I", zlib.crc32(payload[i:i + MARK_EVERY])))
              for i in range(0, len(payload), MARK_EVERY)]
    one, two = paginate(serial, samples), paginate(serial ^ 0xFFFFFFFF, marks)
    rest, time = [*one[1:], *two[1:]], 0
    timed = []
    for page in rest:  # a page that ends no packet stands with the pages before it
        time = 0 if page.number == 1 else time
        time = max(time, page.granule)
        timed.append((time, page))
    timed.sort(key=lambda t: t[0])
    return b"".join(p.write() for p in [one[0], two[0], *[p for _, p in timed]])


def read_pages(data: bytes) -> list[Page]:
    pages, at = [], 0
    while at < len(data):
        if len(data) - at < 27 or data[at:at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27:at + 27 + count]
        end = at + 27 + count + sum(lacing)
        raw = data[at:end]
        if version or len(lacing) < count or end > len(data) \
                or checksum(raw[:22] + bytes(4) + raw[26:]) != crc:
            raise ValueError(f"damaged page at byte {at}")
        pages.append(Page(flags, granule, serial, number, lacing, raw[27 + count:]))
        at = end
    return pages


@dataclass
class Logical:
    """One logical stream: its packets, and the granule position at each one's end (-1 where
    the page names that of a later packet)."""
    serial: int
    packets: list[bytes]
    granules: list[int]


def demultiplex(data: bytes) -> dict[int, Logical]:
    streams, parts, seen, ended = {}, {}, {}, set()
    for page in read_pages(data):
        serial = page.serial
        if bool(page.flags & FIRST) != (serial not in streams) or serial in ended:
            raise ValueError(f"stream {serial} does not begin or end once")
        stream = streams.setdefault(serial, Logical(serial, [], []))
        if page.number != seen.get(serial, -1) + 1 \
                or bool(page.flags & CONTINUED) != (parts.get(serial) is not None):
            raise ValueError(f"stream {serial} misses a page")
        seen[serial] = page.number
        part, at, done = parts.get(serial), 0, 0
        for size in page.lacing:
            part = (part or b"") + page.body[at:at + size]
            at += size
            if size < 255:
                stream.packets.append(part)
                stream.granules.append(-1)
                part, done = None, done + 1
        parts[serial] = part
        if done:
            stream.granules[-1] = page.granule
        elif page.granule != -1:
            raise ValueError("a page that ends no packet names a position")
        if page.flags & LAST:
            ended.add(serial)
    if ended != streams.keys() or any(p is not None for p in parts.values()):
        raise ValueError("a stream has no end")
    return streams


@dataclass
class Sound:
    rate: int
    samples: bytes
    times: list[float]  # seconds at which each packet begins


def read_sound(data: bytes) -> Sound:
    streams = demultiplex(data).values()
    one = next((s for s in streams if s.packets[0].startswith(b"samples8")), None)
    two = next((s for s in streams if s.packets[0].startswith(b"marks")), None)
    if one is None or two is None:
        raise ValueError("samples or marks are missing")
    rate, _ = struct.unpack_from("<II", one.packets[0], 8)
    every, = struct.unpack_from("<I", two.packets[0], 8)
    samples = b"".join(one.packets[1:])
    # Positions stand at page ends; going back from each one gives every packet's begin.
    ends, position = [0] * len(one.packets), None
    for i in range(len(one.packets) - 1, 0, -1):
        position = one.granules[i] if one.granules[i] >= 0 else position
        ends[i] = position
        position -= len(one.packets[i])
    if position not in (0, None) or (len(ends) > 1 and ends[-1] != len(samples)):
        raise ValueError("granule positions and samples differ")
    sums = [struct.unpack("<I", p)[0] for p in two.packets[1:]]
    if sums != [zlib.crc32(samples[i:i + every]) for i in range(0, len(samples), every)]:
        raise ValueError("samples differ from their marks")
    return Sound(rate, samples, [(e - len(p)) / rate for e, p in zip(ends[1:], one.packets[1:])])


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes without padding, bytes padded to a positive multiple of the block)."""
    raw = utf8(text)
    return len(raw), raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def feature(sound: Sound) -> str:
    """Duration, level, energy, zero crossings and the spread of the samples, as text."""
    x = np.frombuffer(sound.samples, np.uint8)
    centred = x.astype(np.int64) - 128
    share = np.bincount(x >> 4, minlength=16) / len(x)
    spread = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return (f"seconds={len(x) / sound.rate:.4f};packets={len(sound.times)};"
            f"last={sound.times[-1]:.4f};mean={centred.sum() / len(x):.4f};"
            f"energy={(centred * centred).sum() / len(x):.4f};crossings={crossings};"
            f"entropy={spread:.4f}")


def store(docs: DataFrame) -> DataFrame:
    """(row, media binary): every text as a file."""
    def begin():
        return lambda batch: ([write_sound(payload_of(t)[1]) for t in texts_of(batch, "text")],)

    return annotate(docs, "text", begin, "media binary")


def digests(docs: DataFrame) -> DataFrame:
    """(row, ...): every text stored, read back and described."""
    def begin():
        def work(batch):
            out = [[] for _ in range(7)]
            for text in texts_of(batch, "text"):
                size, payload = payload_of(text)
                media = write_sound(payload)
                sound = read_sound(media)
                back = sound.samples
                for column, value in zip(out, (
                        size, len(back), hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-BLOCK:]), len(media),
                        hashlib.sha256(media).hexdigest(), feature(sound))):
                    column.append(value)
            return out
        return work

    return annotate(docs, "text", begin,
                    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                    "media_bytes long, media_sha256 string, feature string")


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = digests(docs)
    return out.select("row.doc_id", *[F.col(c) for c in out.columns[1:]])

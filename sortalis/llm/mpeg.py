"""MPEG audio as a media column: a writer that stores bytes in silent frames, and a reader of any stream.

The reader finds frames as a player does: it skips an ID3v2 tag, takes a header only where the next
frame's header follows (or the stream ends), and resynchronises byte by byte after damage.  It parses
ID3v2 and ID3v1 tags and Xing, Info and VBRI tables, verifies the CRC-16 of protected frames of all layers, and
gives the exact duration (samples over sample rate) and the offset of every frame for seeking.

The writer makes MPEG-1 layer III, 48 kHz, mono, protected frames.  Their side information is zero, so
a player hears silence and every byte after it is ancillary data: that is where the payload lies.  All
frames but the last have the largest bit rate; the last has the smallest that holds the rest.  The exact
payload length stands in a TXXX tag, and an Info frame has the frame count, the byte count and the
table of contents.

Defined cases: a null payload is empty; bytes that are no stream have no frames and no payload; equal
payloads give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

from sortalis.llm.textcols import slices, text_buffer
from sortalis.sources.shared import written

#: Fixed values of the format: kbit/s by index for (version 1, layers 1, 2, 3) and (version 2, layers 1, 2 and 3).
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Fixed values of the format: Hz by version bits and index.
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
BLOCK = 192
MEDIA_SCHEMA = "doc_id long, media binary, n_bytes long"
FEATURES_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "duration_s double, samples long, sample_rate int, crc_errors int, skipped_bytes long, seek array<long>"
)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The format's checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc = (crc << 8 ^ _CRC[(crc >> 8 ^ byte) & 0xFF]) & 0xFFFF
    return crc


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """The checksum of the first bits of some bytes."""
    crc = crc16(data[: bits // 8], crc)
    for k in range(bits % 8):
        top = crc >> 15 ^ data[bits // 8] >> 7 - k & 1
        crc = (crc << 1 ^ (0x8005 if top & 1 else 0)) & 0xFFFF
    return crc


def _crc_entry(byte: int) -> int:
    value = byte << 8
    for _ in range(8):
        value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


_CRC = [_crc_entry(b) for b in range(256)]


@dataclass(frozen=True)
class Header:
    """What the four bytes of a frame header say."""

    version: int  # 1, or 2 for MPEG-2 and 2.5
    layer: int
    protected: bool
    kbps: int
    sample_rate: int
    size: int
    samples: int
    side: int  # bytes of side information
    mono: bool
    bound: int  # the first subband that both channels share, 32 without joint stereo


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The header, or None where these bytes begin no frame of a known size."""
    if four not in _HEADERS:
        if len(_HEADERS) > 10_000:
            _HEADERS.clear()
        _HEADERS[four] = _parsed(four)
    return _HEADERS[four]


def _parsed(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    bits, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, sampling = four[2] >> 4, four[2] >> 2 & 3
    if bits == 1 or layer == 4 or rate in (0, 15) or sampling == 3 or four[3] & 3 == 2:
        return None
    version = 1 if bits == 3 else 2
    kbps, hz, padding = RATES[version, layer][rate], SAMPLE_RATES[bits][sampling], four[2] >> 1 & 1
    mono = four[3] >> 6 == 3
    if layer == 1:
        size, samples = (12_000 * kbps // hz + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and version == 2 else 1152
        size = samples // 8 * 1000 * kbps // hz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, hz, size, samples, side, mono, bound)


#: Fixed values of the format: layer II, bits of the allocation field and how many subbands have it, by table.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "2": ((4, 4), (3, 7), (2, 19))}


def _allocation(head: Header) -> list[int]:
    """The bits of each subband's allocation field in layer II."""
    each = head.kbps if head.mono else head.kbps // 2
    if head.version == 2:
        table = "2"
    elif each in (32, 48):
        table = "d" if head.sample_rate == 32_000 else "c"
    else:
        table = "a" if head.sample_rate == 48_000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATION[table] for _ in range(n)]


def checked_bits(head: Header, body: bytes) -> int:
    """How many bits after a frame's checksum it covers: side information, allocation, and in layer II scale factor selection."""
    channels = 1 if head.mono else 2
    if head.layer == 3:
        return 8 * head.side
    if head.layer == 1:
        return 4 * (32 if head.mono else min(32, head.bound) * 2 + max(0, 32 - head.bound))
    number, at, selected = int.from_bytes(body[6:40].ljust(34, b"\0"), "big"), 0, 0
    for subband, bits in enumerate(_allocation(head)):
        shared = channels == 2 and subband >= head.bound
        for _ in range(1 if shared else channels):
            value = number >> 34 * 8 - at - bits & (1 << bits) - 1
            selected += (channels if shared else 1) * (value > 0)
            at += bits
    return at + 2 * selected


@dataclass
class Stream:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)  # of the Xing, Info or VBRI frame
    offsets: list[int] = field(default_factory=list)  # of the audio frames
    headers: list[Header] = field(default_factory=list)
    crc_errors: int = 0
    skipped: int = 0
    bodies: list[tuple[int, int]] = field(default_factory=list)  # where the ancillary data of each frame lies

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        total: dict[int, int] = {}
        for h in self.headers:
            total[h.sample_rate] = total.get(h.sample_rate, 0) + h.samples
        return sum((Fraction(n, hz) for hz, n in total.items()), Fraction(0))

    def seek(self, seconds: float) -> int:
        """The offset of the frame that plays at a time; the last one beyond the end, 0 without frames."""
        at = 0.0
        for offset, h in zip(self.offsets, self.headers, strict=True):
            at += h.samples / h.sample_rate
            if seconds < at:
                return offset
        return self.offsets[-1] if self.offsets else 0


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads the text frames of a leading tag of version 2.2, 2.3 or 2.4; returns its size."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] == 0xFF or max(data[6:10]) > 127:
        return 0
    version, flags, size = data[3], data[5], _synchsafe(data[6:10])
    body = data[10 : 10 + size]
    if flags & 0x80 and version < 4:  # a zero byte stands after each 0xFF that could be taken for a frame
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        at = _synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    head, width = (6, 3) if version == 2 else (10, 4)
    while version in (2, 3, 4) and at + head <= len(body) and body[at]:
        size_of = body[at + width : at + 2 * width]
        length = _synchsafe(size_of) if version == 4 else int.from_bytes(size_of, "big")
        name, text = body[at : at + width].decode("latin-1"), body[at + head : at + head + length]
        if version == 4 and body[at + 9] & 3:  # of a frame's own: unsynchronised, with a length before the data
            text = text[4:] if body[at + 9] & 1 else text
            text = text.replace(b"\xff\0", b"\xff") if body[at + 9] & 2 else text
        if name.startswith("T") and text:
            coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[text[0] if text[0] < 4 else 0]
            parts = text[1:].decode(coding, "replace").rstrip("\0").split("\0")
            tags[f"{name}:{parts[0]}" if name in ("TXXX", "TXX") and len(parts) > 1 else name] = parts[-1]
        at += head + length
    return 10 + size + (10 if flags & 0x10 else 0)


def _id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Reads a trailing tag; returns its size."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return 0
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
        if text := data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip():
            tags.setdefault(name, text)
    return 128


def _table(body: bytes, head: Header) -> dict[str, object]:
    """The variable-bitrate table of a frame, if it has one."""
    at = 4 + head.side + (2 if head.protected and body[4 + head.side : 8 + head.side] not in (b"Xing", b"Info") else 0)
    kind = body[at : at + 4]
    if kind in (b"Xing", b"Info") and len(body) >= at + 8:
        flags, found = int.from_bytes(body[at + 4 : at + 8], "big"), {"kind": kind.decode()}
        at += 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name] = int.from_bytes(body[at : at + 4], "big")
                at += 4
        if flags & 4:
            found["toc"] = list(body[at : at + 100])
        return found
    if body[36:40] == b"VBRI" and len(body) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", body[46:60])
        toc = [int.from_bytes(body[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc}
    return {}


def parse(data: bytes) -> Stream:
    """Reads a whole stream."""
    out = Stream()
    at = _id3v2(data, out.tags)
    end = len(data) - _id3v1(data, out.tags)
    synced = False
    while at + 4 <= end:
        head = header(data[at : at + 4])
        after = at + head.size if head else 0
        whole = head is not None and after <= end
        if not whole or not (synced or after == end or header(data[after : after + 4])):
            synced = False
            later = data.find(b"\xff", at + 1, end)
            later = end if later < 0 else later
            out.skipped += later - at
            at = later
            continue
        body = data[at:after]
        if not out.headers and not out.table and head.layer == 3 and (table := _table(body, head)):
            out.table = table
        else:
            if head.protected and crc16_bits(body[6:].ljust(64, b"\0"), checked_bits(head, body), crc16(body[2:4])) != int.from_bytes(body[4:6], "big"):
                out.crc_errors += 1
            out.offsets.append(at)
            out.headers.append(head)
            out.bodies.append((at + 4 + 2 * head.protected + head.side, after))
        at, synced = after, True
    out.skipped += max(0, end - at)
    return out


def _frame_start(index: int) -> bytes:
    """Header, checksum and zero side information of a mono 48 kHz layer III frame."""
    two = bytes([index << 4 | 1 << 2, 0xC0])
    return b"\xff\xfa" + two + crc16(two + bytes(17)).to_bytes(2, "big") + bytes(17)


_STARTS = {3 * kbps: _frame_start(i) for i, kbps in enumerate(RATES[1, 3]) if kbps}
_SIZES = sorted(_STARTS)
_HEAD = 23


def _text_frame(name: bytes, body: str) -> bytes:
    coded = b"\3" + body.encode() + b"\0"
    size = len(coded)
    return name + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + b"\0\0" + coded


def store(payload: bytes) -> bytes:
    """A stream of silent frames that holds the payload."""
    tag = _text_frame(b"TXXX", f"payload_bytes\0{len(payload)}")
    lead = b"ID3\4\0\0" + bytes([len(tag) >> 21 & 127, len(tag) >> 14 & 127, len(tag) >> 7 & 127, len(tag) & 127]) + tag
    largest = _SIZES[-1]
    room, start = largest - _HEAD, _STARTS[largest]
    full, rest = divmod(len(payload), room)
    frames = [start + payload[i * room : (i + 1) * room] for i in range(full)]
    if rest:
        size = next(s for s in _SIZES if s - _HEAD >= rest)
        frames.append(_STARTS[size] + payload[full * room :] + bytes(size - _HEAD - rest))
    info_size = 288
    total = info_size + sum(map(len, frames))
    n = len(frames)
    toc = bytes(min(255, (info_size + min(i * n // 100, n) * largest) * 256 // total) for i in range(100))
    info = b"\xff\xfb" + _STARTS[info_size][2:4] + bytes(17) + b"Info" + struct.pack(">III", 7, n, total) + toc
    return lead + info + bytes(info_size - len(info)) + b"".join(frames)


def payload(data: bytes, stream: Stream | None = None) -> bytes:
    """The bytes stored in a stream by ``store``; empty if the tag is missing."""
    stream = stream or parse(data)
    said = stream.tags.get("TXXX:payload_bytes", "")
    length = int(said) if said.isascii() and said.isdigit() and len(said) < 19 else 0
    return b"".join(data[a:b] for a, b in stream.bodies)[:length]


def padded(text: bytes) -> bytes:
    """Spaces up to a positive multiple of the block."""
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


def stored(docs: DataFrame) -> DataFrame:
    """The media column: a stream for each text, with the length of the text in bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_buffer(part.column("text"))
                whole = raw.tobytes()
                texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                media = [store(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary()), pa.array(list(map(len, texts)), pa.int64())], names=["doc_id", "media", "n_bytes"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, MEDIA_SCHEMA)


def features(media: DataFrame) -> DataFrame:
    """What the reader finds in each row of a media column."""

    def row(doc_id: int | None, data: bytes | None, n_bytes: int) -> tuple:
        data = data or b""
        stream = parse(data)
        held = payload(data, stream)
        seconds = stream.duration
        feature = f"frames={len(stream.offsets)};samples={stream.samples};duration={seconds.numerator}/{seconds.denominator};crc_errors={stream.crc_errors};skipped={stream.skipped};table={stream.table.get('kind', '-')}:{stream.table.get('frames', 0)}"
        hz = stream.headers[0].sample_rate if stream.headers else 0
        return doc_id, n_bytes, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, float(seconds), stream.samples, hz, stream.crc_errors, stream.skipped, stream.offsets

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [row(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                names = [c.split()[0] for c in FEATURES_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return media.select("doc_id", "media", "n_bytes").mapInArrow(task, FEATURES_SCHEMA)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores the texts of the documents, as a table in the shared folder, and reads them back."""
    return features(written(stored(docs), "media", compression="zstd"))

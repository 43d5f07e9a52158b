import hashlib
import zlib
from fractions import Fraction

import pytest

from sortalis.llm.mpeg import RATES, crc16, header, media_features, padded, parse, payload, store


@pytest.mark.parametrize("size", [0, 1, 192, 937, 938, 1874, 50_000])
def test_round_trip(size):
    data = bytes((i * 7 + i // 251) % 256 for i in range(size))
    media = store(data)
    stream = parse(media)
    assert payload(media) == data
    assert stream.crc_errors == 0 and stream.skipped == 0
    assert stream.table["kind"] == "Info" and stream.table["frames"] == len(stream.offsets)
    assert stream.duration == Fraction(len(stream.offsets) * 1152, 48_000)
    assert all(header(media[o : o + 4]) for o in stream.offsets)
    assert stream.seek(0) == (stream.offsets[0] if stream.offsets else 0)
    assert stream.seek(1e9) == (stream.offsets[-1] if stream.offsets else 0)


def test_sync_bytes_in_the_payload_do_not_mislead():
    data = store(b"x" * 900)[-960:] * 20
    assert payload(store(data)) == data


def test_resynchronises_after_damage():
    media = bytearray(store(b"abc" * 3000))
    first = parse(bytes(media)).offsets
    media[first[3] : first[3] + 2] = b"\0\0"
    broken = parse(bytes(media))
    assert broken.offsets == [o for o in first if o != first[3]] and broken.skipped == first[4] - first[3]
    junk = parse(b"junk\xff\xfbjunk" + bytes(media[first[4] :]))
    assert len(junk.offsets) == len(first) - 4 and junk.skipped == 10


def test_checksum_errors_are_found():
    media = bytearray(store(b"abc" * 3000))
    media[parse(bytes(media)).offsets[1] + 10] ^= 1
    assert parse(bytes(media)).crc_errors == 1
    assert crc16(b"123456789") == 0xAEE7


def test_tags_and_tables_of_other_writers():
    frame = b"\xff\xfb\x90\x64"
    assert header(frame).size == 417 and not header(frame).mono and header(frame).side == 32
    body = frame + bytes(32) + b"VBRI" + bytes(6) + (4170).to_bytes(4, "big") + (10).to_bytes(4, "big") + b"\0\2\0\3\0\1\0\1" + bytes([5, 7])
    tail = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    stream = parse(body.ljust(417, b"\0") + (frame + bytes(413)) * 3 + tail)
    assert stream.table == {"kind": "VBRI", "bytes": 4170, "frames": 10, "toc": [15, 21]}
    assert stream.tags == {"TIT2": "Title", "TPE1": "Artist"} and len(stream.offsets) == 3
    assert stream.duration == Fraction(3 * 1152, 44_100)


@pytest.mark.parametrize(("four", "size", "samples"), [(b"\xff\xf3\x40\xc0", 144 * 32000 // 22050 // 2, 576), (b"\xff\xff\x10\x00", 32, 384), (b"\xff\xfd\x14\x00", 96, 1152)])
def test_sizes_of_other_layers(four, size, samples):
    got = header(four)
    assert got is not None and got.samples == samples and got.size == size


def test_no_frame():
    assert header(b"\xff\xfb\xf0\x00") is None and header(b"ab") is None
    assert parse(b"").offsets == [] and payload(b"not a stream") == b""
    assert len(RATES[1, 3]) == 15


@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_documents(name, request):
    docs = request.getfixturevalue(name)
    docs = docs[0] if name == "small" else docs
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        raw = (text or "").encode()
        data = padded(raw)
        assert len(data) % 192 == 0 and len(data) >= 192
        want.append((doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(store(data)), hashlib.sha256(store(data)).hexdigest()))
    got = media_features(docs).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, want))
    assert all(r.crc_errors == 0 and r.skipped_bytes == 0 and "frames=" in r.feature for r in got)


def test_no_rows(no_docs):
    assert media_features(no_docs).count() == 0


def serial_crc(bits):
    """Bit by bit, as the format's text has it."""
    crc = 0xFFFF
    for bit in bits:
        top = (crc >> 15) ^ bit
        crc = (crc << 1) & 0xFFFF ^ (0x8005 if top else 0)
    return crc


def bits_of(data):
    return [b >> 7 - k & 1 for b in data for k in range(8)]


# layer I mono (32 fields of 4 bits), layer I joint stereo with bound 8 (8 * 2 + 24), layer II mono 64 kbit/s at 48 kHz
# with nothing allocated (11 * 4 + 12 * 3 + 4 * 2), the same with the first field set (2 bits more), layer II stereo 384 at 44.1 kHz
@pytest.mark.parametrize(
    ("four", "first", "covered"),
    [(b"\xff\xfe\x44\xc0", b"\x11\x11", 128), (b"\xff\xfe\x44\x50", b"\x35\x71", 160), (b"\xff\xfc\x44\xc0", b"\0\0", 88), (b"\xff\xfc\x44\xc0", b"\x40\0", 90), (b"\xff\xfc\xe0\x00", b"\0\0", 2 * (11 * 4 + 12 * 3 + 7 * 2))],
)
def test_checksums_of_layers_one_and_two(four, first, covered):
    head = header(four)
    assert head.protected
    side = first + bytes(40)
    crc = serial_crc(bits_of(four[2:4]) + bits_of(side)[:covered])
    frame = (four + crc.to_bytes(2, "big") + side).ljust(head.size, b"\0")[: head.size]
    assert parse(frame * 3).crc_errors == 0 and len(parse(frame * 3).offsets) == 3
    broken = bytearray(frame)
    broken[6] ^= 8
    assert parse(bytes(broken) + frame * 2).crc_errors == 1


def test_tags_of_all_versions():
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    two = b"TT2" + (5).to_bytes(3, "big") + b"\0Song"
    three = (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\0Song"
    four = size(6) + b"\1\0" + b"TIT2" + size(5) + b"\0\0" + b"\3Song"
    odd = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0a\xff\0\xe0"
    for version, flags, body, want in ((2, 0, two, {"TT2": "Song"}), (3, 0x40, three, {"TIT2": "Song"}), (4, 0x40, four, {"TIT2": "Song"}), (3, 0x80, odd, {"TIT2": "a\xff\xe0"})):
        stream = parse(b"ID3" + bytes([version, 0, flags]) + size(len(body)) + body + frame * 2)
        assert stream.tags == want and len(stream.offsets) == 2 and not stream.skipped


def test_a_foreign_payload_tag_is_no_payload():
    tag = b"TXXX" + bytes([0, 0, 0, 19]) + b"\0\0" + b"\0payload_bytes\0soon"
    media = b"ID3\4\0\0" + bytes([0, 0, 0, len(tag)]) + tag + store(b"abc")[34:]
    assert parse(media).tags == {"TXXX:payload_bytes": "soon"} and payload(media) == b""

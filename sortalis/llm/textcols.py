"""Word and chunk boundaries of whole Arrow text columns, found without a Python loop.

Every function works on the UTF-8 bytes of a column.  The ASCII separators (space and 9 to 13)
never occur inside a multi-byte character, so byte positions are safe cut points.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The bytes that separate words, [\x20\x09-\x0D].
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[32, 9, 10, 11, 12, 13]] = True

#: Translation table that lowers A-Z and leaves every other byte alone.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


#: What a worker process holds from one task to the next, by the operator that holds it.
_HELD: dict[str, Callable[[], object]] = {}


def claim(owner: str, release: Callable[[], object] = lambda: None) -> None:
    """Called as a task of an operator starts: what other operators left in this worker process is released.

    Workers outlive stages, so without this the caches of several operators add up in one process.
    """
    others = [n for n in _HELD if n != owner]
    for name in others:
        _HELD.pop(name)()
    if others:  # what is free goes back to the system, as the next operator's memory has another shape
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _HELD[owner] = release


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null counts as the empty text, bytes that are no UTF-8 as U+FFFD."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    try:
        column.cast(pa.large_string())
    except pa.ArrowInvalid:
        column = pa.array([t.decode("utf-8", "replace").encode() for t in column.to_pylist()], pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most ``most_bytes`` of text, or one row."""
    _, offsets = text_buffer(batch.column(column))
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words ``[^\\x20\\x09-\\x0D]+``; document d has words first[d] to first[d + 1]."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATORS[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, first): cuts before each separator run, so that a chunk is a run of separators and the word after it."""
    begins = np.zeros(len(raw), dtype=bool)
    if len(raw):
        outside = SEPARATORS[raw]
        begins[1:] = outside[1:] & ~outside[:-1]
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    bounds = np.append(np.flatnonzero(begins), len(raw)).astype(np.int64)
    return bounds, np.searchsorted(bounds, offsets)


def pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The byte strings raw[starts[i]:ends[i]] as one Arrow column; nothing is copied where each begins at the end before."""
    if len(starts) and (starts[1:] == ends[:-1]).all():
        bounds = np.append(starts, ends[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    lengths = ends - starts
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    source = np.arange(out[-1], dtype=np.int64) + np.repeat(starts - out[:-1], lengths)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(out), pa.py_buffer(raw[source])])


def distinct(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct values of a column and, for each row, the index of its value."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def distinct_word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index): XXH64 of each distinct word, and for each word the index of its hash."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, index = distinct(pieces(raw, starts, ends))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(v, seed) for v in values), np.uint64, len(values)), index


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each word, computed once for each distinct word of the column."""
    hashes, index = distinct_word_hashes(raw, starts, ends, seed)
    return hashes[index]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor shifts and odd multiplications)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_points() -> Iterator[int]:
    """All code points of the blocks in which there is a letter or a digit."""
    for at in range(0, 0x110000, 4096):
        if re.search(r"\w", np.arange(at, at + 4096, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
            yield from range(at, at + 4096)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, in any case of its letters."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[i], starts[i] + 1, ... for lengths[i] of them, one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)

"""Compact blobs of sorted 64-bit keys, the unit in which tasks send counts to shards.

A key's shard is given by its leading bits, so the shards of a sorted array are consecutive runs.  Keys are hashes,
so shards are even, and their number grows with the text: a task holds one shard, of bounded size.
Keys travel as differences cut to the bytes that the largest one needs, which takes about six bytes a
key instead of the thirty or so of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as one byte string."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + body.tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    """What pack_keys was given."""
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    keys = steps.view(np.uint64).ravel()
    keys[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(keys, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Positive counts: a byte each, and the large ones apart."""
    counts = counts.astype(np.uint64)
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    """What pack_counts was given, for n counts."""
    out = np.frombuffer(blob, np.uint8, n).astype(np.uint64)
    large = out == 255
    out[large] = np.frombuffer(blob, np.uint64, int(large.sum()), offset=n)
    return out


def shard_bounds(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, bounds): the shards that sorted keys touch, and where the run of each begins; a last bound ends it."""
    shards = (keys >> np.uint64(64 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(keys) else np.zeros(0, np.int64)
    return shards[heads], np.append(heads, len(keys))


PART = 1 << 19  # keys of a shard that are merged at a time


def in_parts(runs: list[tuple[np.ndarray, ...]], edges: Callable[[int], np.ndarray]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(part, parts, arrays) of runs, each sorted keys and arrays beside them, joined range of keys by range of keys.

    There are as many ranges as give each about PART keys; ``edges`` says for a number of ranges where they meet.
    """
    parts = max(1, -(-sum(len(r[0]) for r in runs) // PART))
    inner = edges(parts)[1:-1]
    cuts = [[0, *np.searchsorted(r[0], inner).tolist(), len(r[0])] for r in runs]
    for i in range(parts):
        yield i, parts, [np.concatenate([x[..., c[i] : c[i + 1]] for x, c in zip(column, cuts, strict=True)], axis=-1) for column in zip(*runs, strict=True)]


def even_edges(low: int, high: int) -> Callable[[int], np.ndarray]:
    """Edges that cut the keys from low to below high into even ranges; the two outer ones are low and high, or the last key."""
    return lambda parts: np.array([min(low + (high - low) * i // parts, (1 << 64) - 1) for i in range(parts + 1)], np.uint64)


def shard_edges(shard: int, bits: int) -> Callable[[int], np.ndarray]:
    """Edges of the keys that lie in a shard."""
    return even_edges(shard << 64 - bits, shard + 1 << 64 - bits)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(counts, heads)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The position of each wanted key in sorted keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


SHARD_BYTES = 128 << 20  # of text, so that the keys of a shard fit in a worker


def shard_bits(partitions: int, text_bytes: int = 0) -> int:
    """Bits for as many shards as a shuffle has partitions, or more where a shard would stand for over SHARD_BYTES; 16 at least."""
    return max(4, (max(1, partitions) - 1).bit_length(), (-(-text_bytes // SHARD_BYTES) - 1).bit_length() if text_bytes else 0)


def bits_for(docs: DataFrame) -> int:
    """The bits of the shards of a frame's texts, whose bytes are added up in a job of its own."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0]
    return shard_bits(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total or 0)

"""Removal of word sequences that occur more than once in a corpus.

Method: Rabin-Karp hashes of every window of ``window`` words.  The hash of a window is the
polynomial of its words' XXH64 values in an odd base modulo 2^64, got from prefix sums; a bijective
finaliser spreads it.  Tasks send each hash of theirs once, with a mark if it repeats there already, to
the hash's shard; a shard keeps the hashes that are marked or came more than once as a sorted array in
the shared folder.  A second pass maps these arrays, looks each window up, and merges the windows found
into maximal intervals of words to remove.

Two different windows share a hash with probability 2^-64, so among n windows a given one is taken for
repeated by mistake with probability below n / 2^64: under one in a million at 10^13 windows.

Defined cases: a text that is null or shorter than the window keeps all of its words; windows do not
cross documents; rows that repeat are documents of their own, so all of their windows repeat; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortalis.llm.blobs import bits_for, find, in_parts, pack_keys, shard_bounds, shard_edges, unpack_keys
from sortalis.llm.textcols import mixed, ranges, slices, text_buffer, word_hashes, words
from sortalis.sources.shared import mapped, new_folder, write_file

WINDOW, SLICE = 35, 8 << 20
BASE = 0x9E3779B97F4A7C15  # an odd base
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:int,end:int>>, kept string"


def window_hashes(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values): the word at which each window starts and the window's hash; none crosses a document."""
    counts = np.diff(first)
    windows = np.maximum(counts - window + 1, 0)
    starts = ranges(first[:-1], windows)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(hashes) - 1, BASE, np.uint64)))
    downs = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(hashes) - 1, inverse, np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers, dtype=np.uint64))
    return starts, mixed((sums[starts + window] - sums[starts]) * downs[starts])


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[str, int]:
    """Counts the windows and writes the repeated hashes; returns (folder, bits of the shard number)."""
    spark = docs.sparkSession
    folder, bits = new_folder(spark, "windows"), bits_for(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, offsets = text_buffer(part.column("text"))
                starts, ends, first = words(raw, offsets)
                _, values = window_hashes(word_hashes(raw, starts, ends), first, window)
                values.sort()
                heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
                repeats = np.diff(heads, append=len(values)) > 1
                values = values[heads]
                shards, bounds = shard_bounds(values, bits)
                cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shards.astype(np.int32)),
                        pa.array([pack_keys(values[a:b]) for a, b in cuts], pa.binary()),
                        pa.array([np.packbits(repeats[a:b]).tobytes() for a, b in cuts], pa.binary()),
                    ],
                    names=["shard", "keys", "repeats"],
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for shard, keys, repeats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unpack_keys(keys)
                held.setdefault(shard, []).append((own, np.unpackbits(np.frombuffer(repeats, np.uint8), count=len(own)).astype(bool)))
        for shard in list(held):
            n: list[int] = []

            def write(out: BinaryIO, shard: int = shard, n: list = n) -> None:
                for _, _, (keys, marked) in in_parts(held.pop(shard), shard_edges(shard, bits)):
                    keys = np.sort(np.append(keys, keys[marked]))  # marked ones count twice
                    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
                    out.write(twice.tobytes())
                    n.append(len(twice))

            write_file(f"{folder}/{shard}.u64", write)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_repeated": pa.array([sum(n)], pa.int64())})

    sent = docs.selectExpr("cast(text as string) text").mapInArrow(count, "shard int, keys binary, repeats binary")
    sent.repartitionById(1 << bits, F.col("shard")).mapInArrow(gather, "shard int, n_repeated long").agg(F.sum("n_repeated")).collect()
    return folder, bits


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: what was removed, as intervals of words, and what is kept."""
    folder, bits = repeated_windows(docs, window)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, offsets = text_buffer(part.column("text"))
                starts, ends, first = words(raw, offsets)
                at, values = window_hashes(word_hashes(raw, starts, ends), first, window)
                order = np.argsort(values)
                ordered = values[order]
                hit = np.zeros(len(values), dtype=bool)
                shards, bounds = shard_bounds(ordered, bits)
                for shard, a, b in zip(shards.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if shard not in arrays:
                        arrays[shard] = mapped(f"{folder}/{shard}.u64", np.uint64)
                    hit[order[a:b]] = find(arrays[shard], ordered[a:b]) >= 0
                found = at[hit]
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, found, 1)
                np.add.at(change, found + window, -1)
                covered = np.cumsum(change)[:-1] > 0
                yield _rows(part.column("doc_id"), raw, starts, ends, first, covered)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, SCHEMA)


def _rows(doc_id: pa.Array, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    kept = ~covered
    lengths = ends[kept] - starts[kept]
    stops = np.cumsum(lengths + 1)
    joined = np.full(stops[-1] if len(stops) else 0, 32, np.uint8)
    if len(stops):
        body = ranges(starts[kept], lengths)
        joined[body + np.repeat(stops - lengths - 1 - starts[kept], lengths)] = raw[body]
    before = np.append(0, np.cumsum(kept))[first]  # kept words before each document
    edge = np.append(0, stops)
    text = joined.tobytes()
    texts = [text[a : max(a, b - 1)] for a, b in zip(edge[before[:-1]].tolist(), edge[before[1:]].tolist(), strict=True)]
    heads = covered.copy()
    heads[1:] &= ~covered[:-1]
    heads[first[:-1][first[:-1] < len(covered)]] = covered[first[:-1][first[:-1] < len(covered)]]
    tails = covered.copy()
    tails[:-1] &= ~covered[1:]
    last = first[1:][first[1:] > 0] - 1
    tails[last] = covered[last]
    begin, stop = np.flatnonzero(heads), np.flatnonzero(tails) + 1
    cut = np.searchsorted(begin, first)
    shift = np.repeat(first[:-1], np.diff(cut))
    pairs = pa.StructArray.from_arrays([pa.array((begin - shift).astype(np.int32)), pa.array((stop - shift).astype(np.int32))], names=["start", "end"])
    n_words = np.diff(first)
    return pa.RecordBatch.from_arrays(
        [
            doc_id,
            pa.array(n_words),
            pa.array(n_words - np.diff(before)),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pairs),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "kept"],
    )

"""Packing of documents into training sequences of several lengths.

Method (hierarchical multi-length packing): a document's ids are cut into full windows of the
longest tier and a rest.  A rest goes to the shortest tier that holds it.  Tiers are packed from the
longest to the shortest; the gap of a window is filled with the largest fitting rests of shorter
tiers, and with a cut of one where none fits, so that windows come out exactly full.  Windows are
then dealt to step groups of equal token counts, largest first to the group with the fewest tokens.

Each task packs what it reads, so nothing is shuffled.  What does not fill a window goes on to the
task's next rows; a task pads its last window only.  Numbers of sequences and groups, and which documents share
one, follow how the rows are split into tasks.

Defined cases: a null or empty text is one end id; rows are kept apart even if they repeat or have
no doc_id; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sortalis.llm.encoder import encoder
from sortalis.llm.textcols import slices

TIERS = (128, 256, 512, 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"


class Packer:
    """Packs pieces (document, start, length) of one task into windows whose sizes are the tiers."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.longest = self.tiers[-1]
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def add(self, document: int, tokens: int) -> list[list[tuple[int, int, int]]]:
        """Routes a document; returns the windows of the longest tier that it fills alone."""
        full = tokens // self.longest
        if rest := tokens % self.longest:
            insort(self.pool, (rest, document, full * self.longest))
        return [[(self.longest, document, i * self.longest)] for i in range(full)]

    def _fill(self, window: list[tuple[int, int, int]], gap: int) -> int:
        """Fills a gap from the pool, largest first, cutting the piece that closes it; returns what stays open."""
        while gap and self.pool:
            at = bisect_right(self.pool, (gap, 1 << 62, 0))
            if at:
                piece = self.pool.pop(at - 1)
            else:
                length, document, start = self.pool.pop(0)
                piece = (gap, document, start)
                insort(self.pool, (length - gap, document, start + gap))
            window.append(piece)
            gap -= piece[0]
        return gap

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(tier, pieces) of full windows; pieces of a window that stays open return to the pool unless last."""
        while self.pool:
            piece = self.pool.pop()
            tier, window = self.tier(piece[0]), [piece]
            gap = self._fill(window, tier - piece[0])
            if not gap:
                yield tier, window
            elif last:
                yield tier, window
            else:
                for p in window:
                    insort(self.pool, p)
                return


def balanced(sizes: list[int], group_tokens: int) -> list[int]:
    """A group number for each of some descending sizes: each goes to the group that has least so far."""
    heap = [(0, g) for g in range(-(-sum(sizes) // group_tokens))]
    out = []
    for size in sizes:
        load, group = heap[0]
        heapq.heapreplace(heap, (load + size, group))
        out.append(group)
    return out


def _padded(tokens: int, longest: int) -> int:
    """The length a sequence is stored at: itself if a power of two, else the longest tier."""
    return tokens if tokens & (tokens - 1) == 0 else longest


def packed(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, group_tokens: int = 8192) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, and the checksum of its ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer, coder = Packer(tiers), encoder(tokenizer_path)
        kept: dict[int, tuple[int | None, np.ndarray]] = {}
        documents = sequences = groups = 0

        def emit(windows: list[tuple[int, list[tuple[int, int, int]]]]) -> pa.RecordBatch:
            nonlocal sequences, groups
            windows.sort(key=lambda w: (w[0], -sum(p[0] for p in w[1])))
            step: list[int] = []
            for _, own in groupby(windows, key=lambda w: w[0]):
                dealt = balanced([sum(p[0] for p in w) for _, w in own], group_tokens)
                step += [base + groups + g for g in dealt]
                groups += max(dealt) + 1
            rows: list[tuple] = []
            for (tier, window), group in zip(windows, step, strict=True):
                size, at = sum(p[0] for p in window), 0
                for length, document, start in window:
                    doc_id, ids = kept[document]
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    rows.append((doc_id, start, length, crc, len(ids), base + sequences, at, _padded(size, packer.longest), tier, group))
                    at += length
                sequences += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 10
            types = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = coder.encode_column(part.column("text"))
                windows = []
                for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[first[row] : first[row + 1]], np.array([end_id], ids.dtype))
                    kept[documents] = (doc_id, own)
                    windows += [(packer.longest, w) for w in packer.add(documents, len(own))]
                    documents += 1
                windows += packer.windows(last=False)
                yield emit(windows)
                kept = {d: kept[d] for d in {p[1] for p in packer.pool}}
        yield emit(list(packer.windows(last=True)))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, SCHEMA)
